"""MinHash near-duplicates, verified by odd sketches and then on full sets.

A document's set of word shingles becomes MinHash samples. Bands of them name
buckets in which similar documents meet; all samples folded into a bitmap by
parity make its odd sketch: equal samples of two documents fall on the same bit
and cancel, so the ones of the XOR tell how many samples differ, the more
precisely the more similar the sets are. Documents of one bucket whose sketches
are near form coarse classes; within a coarse class links are confirmed on the
full sets, the nearest sketches first, and only between documents that aren't
connected yet: a class of n copies costs some n comparisons, not its pairs.

Equal sets are made one before. Buckets and classes of more than a block's rows
are dealt to blocks. Some members, the pivots, go to every block; whatever they
connect is the main component. Members outside it meet all other blocks in a
grid of bounded cells, so no link is lost. A pair with a similarity of 0.8 or
more misses all buckets with a probability of 6e-9, and sketches that differ in
more than `FAR` bits of 6e-9 too (normal approximation).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchforge.llm.common import remembers, slices, small_batches, stored, tidied
from matchforge.operators.components import connected_components

SHINGLE = 4
#: Bands and samples in each; samples of the sketch; its bits; bits that two sketches differ in at most.
BANDS, ROWS, SAMPLES, BITS, FAR = 48, 5, 384, 1024, 217
#: Rows of a bucket, and of a coarse class, that are compared in one task; elements of the sets there; pivots of a group.
BUCKET_BLOCK, CLASS_BLOCK, ELEMENTS, PIVOTS = 4096, 256, 1 << 22, 32
#: Bits of the filter of the ids whose texts are read again: 2048 rows of 4 KB at most.
FILTER = 1 << 26
#: Words whose hash a worker remembers, and shingles that are hashed at once.
WORDS, CHUNK = 500_000, 4096

U = np.uint64
MIX = np.array([xxhash.xxh64_intdigest(f"mix {k}") | 1 for k in range(4)], U)
TIMES, PLUS = (np.array([xxhash.xxh32_intdigest(f"{name} {k}") for k in range(SAMPLES)], np.uint32) for name in ("times", "plus"))
TIMES = TIMES | np.uint32(1)
_hashes: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * MIX[0]
    x = (x ^ (x >> U(29))) * MIX[1]
    return x ^ (x >> U(32))


def shingle_set(text: bytes | None) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of a text in UTF-8; none if it has no word."""
    words = (text or b"").lower().split()  # bytes: lower() and split() know A-Z and ASCII white space only
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], U)
    if len(_hashes) > WORDS:
        _hashes.clear()
    own = np.array([_hashes.get(w) or _hashes.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words], U)
    total = np.zeros(len(own) - SHINGLE + 1, U)
    for k in range(SHINGLE):
        total = mixed(total + own[k : len(own) - SHINGLE + 1 + k])
    return np.unique(total)


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that isn't empty: the least of each of `SAMPLES` permutations of 32-bit numbers."""
    x = (shingles >> U(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), CHUNK):
        np.minimum(least, (TIMES[:, None] * x[at : at + CHUNK] + PLUS[:, None]).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A 64-bit name of each band's bucket."""
    rows = least[: BANDS * ROWS].astype(U).reshape(BANDS, ROWS)
    names = np.arange(1, BANDS + 1, dtype=U)
    for k in range(ROWS):
        names = mixed(names * MIX[2] + rows[:, k])
    return names.view(np.int64)


def odd_sketch(least: np.ndarray) -> bytes:
    """The parities of how many samples fall on each bit."""
    places = mixed(least.astype(U) + np.arange(SAMPLES, dtype=U) * MIX[3]) % U(BITS)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=BITS) & 1).tobytes()


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch, buckets) of each row; null from digest on where there is no word."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("oddsketch", _hashes.clear)
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                shingles = shingle_set(text)
                least = samples(shingles) if len(shingles) else None
                rows.append((0, None, None, None) if least is None else (len(shingles), digest(shingles), odd_sketch(least), bands(least)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=["doc_id", "n_shingles", "digest", "sketch", "buckets"])

    schema = "doc_id bigint, n_shingles bigint, digest binary, sketch binary, buckets array<bigint>"
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


# ---- links within groups ---------------------------------------------------------------------------------------------


def linked(sketches: np.ndarray, sets: list[np.ndarray] | None, labels: np.ndarray, active: np.ndarray) -> list[tuple[int, int]]:
    """Links of a forest that connects what is similar among rows of different labels.

    Each active row meets all rows whose label differs from its own at that time. Without sets near sketches link.
    """
    found, labels = [], labels.copy()
    sizes = None if sets is None else np.array([len(s) for s in sets])
    for i in np.flatnonzero(active):
        others = np.flatnonzero(labels != labels[i])
        if sizes is not None:
            others = others[5 * np.minimum(sizes[others], sizes[i]) >= 4 * np.maximum(sizes[others], sizes[i])]
        apart = np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        others = others[apart <= FAR][np.argsort(apart[apart <= FAR], kind="stable")]
        while len(others):
            j, others = others[0], others[1:]
            if sets is not None:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common < 80 * (sizes[i] + sizes[j] - common):
                    continue
            found.append((i, j))
            labels[labels == labels[j]] = labels[i]
            others = others[labels[others] != labels[i]]
    return found


def cells_linked(rows: DataFrame, exact: bool) -> DataFrame:
    """Links (a, b) within cells: rows (group, cell, node, label, active, sketch and, if `exact`, text)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(cell: pa.Table) -> np.ndarray:
            node, label = (cell.column(c).to_numpy() for c in ("node", "label"))
            sketches = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), U).reshape(len(node), -1)
            sets = [shingle_set(t) for t in cell.column("text").cast(pa.binary()).to_pylist()] if exact else None
            pairs = linked(sketches, sets, label, cell.column("active").to_numpy(zero_copy_only=False))
            return node[np.array(pairs, np.int64).reshape(-1, 2)]

        def given(cells: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.concatenate(cells) if cells else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        remembers("oddsketch", _hashes.clear)
        open_cell: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("group", "cell")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            done = []
            for start, end in pairwise(cuts):
                part = batch.slice(start, end - start)
                if open_cell and any(open_cell[-1].column(c)[0] != part.column(c)[0] for c in ("group", "cell")):
                    done.append(links(pa.Table.from_batches(open_cell)))
                    open_cell = []
                open_cell.append(part)
            yield given(done)
        if open_cell:
            yield given([links(pa.Table.from_batches(open_cell))])

    dealt = small_batches(rows, 4_000 if not exact else 1_000).repartition("group", "cell").sortWithinPartitions("group", "cell", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def pick(node: str | Column, what: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(what)), n)


def links_within(rows: DataFrame, block: int, exact: bool) -> DataFrame:
    """Links (a, b) that connect what is similar in each group; rows: (group, node, size, blocks, sketch, and text if `exact`).

    size: rows of the group; blocks: how many tasks share it. Each block links
    its own rows and the pivots. What the largest component so found leaves out
    of a group then meets the group's other blocks, `block` rows with one block
    in each cell.
    """
    data = ["sketch", *(["text"] if exact else [])]
    own = pick("node", "block", F.col("blocks"))
    home = rows.select("group", own.alias("cell"), "node", F.col("node").alias("label"), F.lit(True).alias("active"), *data)
    many = rows.filter("blocks > 1")
    pivots = many.filter(pick("node", "pivot", F.col("size")) < PIVOTS).select("*", own.alias("home"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("cell"))
    sent = pivots.filter("cell <> home").select("group", F.col("cell").cast("bigint").alias("cell"), "node", F.col("node").alias("label"), F.lit(True).alias("active"), *data)
    first = stored(cells_linked(home.unionByName(sent), exact), "links")
    if many.isEmpty():
        return first
    known = connected_components(first)
    labelled = stored(many.join(known, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "labelled")
    sizes = labelled.groupBy("group", "label").agg(F.count("*").alias("n"))
    main = stored(sizes.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("n")).filter("n < all"), "main")
    grid = labelled.join(main.withColumn("chunks", F.ceil((F.col("all") - F.col("n")) / block).cast("bigint")), "group")
    outside = grid.filter("label <> main").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("x"), pick("node", "chunk", F.col("chunks")).alias("y"), F.lit(True).alias("active"))
    inside = grid.select("*", own.alias("x"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("y"), F.lit(False).alias("active"))
    cells = inside.unionByName(outside).select("group", (F.col("x") * F.col("chunks") + F.col("y")).alias("cell"), "node", "label", "active", *data)
    return first.unionByName(cells_linked(cells, exact))


# ---- the whole table -------------------------------------------------------------------------------------------------


def classes_of(facts: DataFrame) -> DataFrame:
    """(node, digest, n_shingles, least, sketch, buckets): one row for each different set, `least` its smallest doc_id."""
    kinds = facts.filter("n_shingles > 0").groupBy("digest").agg(*(F.first(c).alias(c) for c in ("n_shingles", "sketch", "buckets")), F.min("doc_id").alias("least"))
    return stored(kinds.withColumn("node", F.monotonically_increasing_id()), "classes")


def coarse_classes(classes: DataFrame) -> DataFrame:
    """(node, component) of nodes that near sketches in a bucket connect with others."""
    places = classes.select("node", F.explode("buckets").alias("group"))
    shared = stored(places.groupBy("group").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    rows = places.join(shared, "group").withColumn("blocks", F.ceil(F.col("size") / BUCKET_BLOCK).cast("bigint"))
    rows = stored(rows.join(classes.select("node", "sketch"), "node"), "members")
    return connected_components(links_within(rows, BUCKET_BLOCK, exact=False))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, text): one text of each set among those of the wanted doc_ids (`least`), and perhaps some others.

    Ids are looked up in a bitmap of fixed size, so texts of other documents
    needn't be shuffled; where it is full, more texts pass, none is lost.
    """
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(FILTER))
    bits = wanted.select(F.pmod(F.xxhash64("least"), F.lit(FILTER)).alias("bit"))
    maps = bits.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    whole = np.zeros(FILTER // 8, np.uint8)
    for k, part in maps:
        whole[(k - 1) * 4096 : k * 4096] = np.frombuffer(part, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(whole)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("oddsketch", _hashes.clear)
        for batch in (part for whole in batches for part in slices(whole)):
            bit = batch.column("bit").to_numpy() - 1  # bitmap_bit_position and _bucket_number count from 1
            passing = (held.value[bit >> 3] >> (bit & 7) & 1).astype(bool)
            texts = batch.filter(pa.array(passing)).column("text")
            sets = [shingle_set(t) for t in texts.cast(pa.binary()).to_pylist()]
            rows = pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), texts.cast(pa.string())], names=["digest", "text"])
            yield rows.filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))

    found = small_batches(docs).select("text", place.alias("bit")).mapInArrow(run, "digest binary, text string")
    return found.groupBy("digest").agg(F.first("text").alias("text"))


def confirmed_links(docs: DataFrame, classes: DataFrame, coarse: DataFrame) -> DataFrame:
    """Links (a, b) on full sets that connect all nodes of a coarse class that links connect at all."""
    members = stored(coarse.withColumnRenamed("component", "group").join(classes.select("node", "digest", "sketch", "n_shingles", "least"), "node"), "coarse")
    texts = texts_of(docs, members)
    sizes = stored(members.groupBy("group").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("all")), "sizes")
    blocks = F.greatest(F.ceil(F.col("size") / CLASS_BLOCK), F.ceil(F.col("all") / ELEMENTS)).cast("bigint")
    rows = members.join(texts, "digest").join(sizes, "group").withColumn("blocks", blocks)
    return links_within(stored(rows.select("group", "node", "size", "blocks", "sketch", "text"), "texts"), CLASS_BLOCK, exact=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.8 or more.

    docs: doc_id, text, and others that are left out. Returns one row for each
    row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept
    (doc_id is component_id).

    Texts without words, empty or null, are linked with nothing and kept. Rows
    count, not ids: rows of one id and equal sets are one component, with
    different texts they are linked only if similar. Rows without an id take the
    smallest id of their component; if it has none, they have no component_id
    and are kept. An empty table gives no rows. Very long texts are hashed in
    parts; sets in one task are bounded by their elements, but for a single one.
    """
    facts = stored(signatures(docs), "signatures")
    classes = classes_of(facts)
    links = confirmed_links(docs, classes, coarse_classes(classes))
    known = classes.select("node", "digest", "least").join(connected_components(links), "node", "left")
    known = stored(known.withColumn("component", F.coalesce("component", "node")).drop("node"), "known")
    least = stored(known.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    result = facts.select("doc_id", "n_shingles", "digest").join(stored(known.join(least, "component").select("digest", "component_id"), "components"), "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def oracle_sql() -> str:
    """The same by counting common shingles of all pairs that have one, and walking along links."""
    return r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON d.doc_id = c.a
"""
