"""Exact nearest rows by cosine of unit vectors, as blocks of matrix products with a reduction in each cell.

The index is dealt out once to cells of a bounded number of rows. Queries, a
stated set that grows with the tables, go to every cell as rows of a table: a
task holds one cell's vectors and streams the queries past them a block at a
time. Each query takes on no more than the wanted rows (or keys) of a cell, ties
by row_id, so the exchange that follows has cells x queries x depth rows at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchforge.sources.shared import stored

#: Rows of the index in a cell, on average at most; queries that are multiplied at once.
CELL_ROWS, QUERY_BLOCK = 131_072, 256
#: Similarities that are held at once while they are counted; bits of their rank keys that a pass counts.
AREA, DIGIT_BITS = 1 << 21, 16
DIGITS = 1 << DIGIT_BITS
SCHEMA = "query_id bigint, row_id bigint, slug string, view bigint, cv double"
#: Rows that are taken of similarities to a cell's rows in the order of their ids, given their slugs: (query, row) places.
Keep = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def best_places(similar: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the `depth` largest values of each row, the earlier ones of equal values."""
    if similar.shape[1] <= depth:
        return tuple(x.ravel() for x in np.indices(similar.shape))
    cut = np.partition(similar, -depth, axis=1)[:, -depth][:, None]
    above, equal = similar > cut, similar == cut
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= depth - above.sum(axis=1, keepdims=True))))


def cells_of(index: DataFrame) -> int:
    """Cells for an index: of `CELL_ROWS` rows, but some for each core where rows allow it."""
    rows = index.count()
    return max(-(-rows // CELL_ROWS), min(index.sparkSession.sparkContext.defaultParallelism, -(-rows // 1_024)), 1)


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    return part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, pa.RecordBatch]]:
    """Each batch of queries with the rows of its cell, and these rows' vectors as columns."""
    cell, parts, rows, own = None, [], None, None
    for batch in batches:
        key = batch.column("cell").to_numpy() * 2 + batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(start, end - start)
            if not part.num_rows:
                continue
            if key[start] // 2 != cell:
                cell, parts, own = key[start] // 2, [], None
            if key[start] % 2 == 0:
                parts.append(part)
                continue
            if own is None and parts:
                rows = pa.Table.from_batches(parts).combine_chunks()
                own = np.concatenate([_matrix(p) for p in parts]).T.copy()
                parts = []
            if own is not None:
                yield rows, own, part


def _dealt(index: DataFrame, queries: DataFrame, *extra: str) -> DataFrame:
    """Cells with their rows of the index (kind 0) and after them all queries (kind 1), both with the columns `extra`."""
    cells = cells_of(index)
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    rows = index.select(F.pmod(F.xxhash64("row_id"), F.lit(cells)).cast("int").alias("cell"), F.lit(0).alias("kind"), F.col("row_id").cast("bigint").alias("id"), *extra, vector)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("kind"), F.col("query_id").cast("bigint").alias("id"), *extra, vector)
    return rows.unionAll(asked).repartition(cells, "cell").sortWithinPartitions("cell", "kind", "id")


def _scan(index: DataFrame, queries: DataFrame, keep: Keep, settings: int = 0) -> DataFrame:
    """What `keep` takes of each cell for each query.

    With `settings` it does so once for each of them, over the rows whose column
    `mask` has the setting's bit, and rows tell their setting: one product of
    vectors serves all settings.
    """
    names = ["query_id", "row_id", "slug", "view", "cv", *(["setting"] if settings else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, codes, within = None, None, []
        for rows, own, part in _met(batches):
            if rows is not last:
                last = rows
                codes = rows.column("slug").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                mask = rows.column("mask").to_numpy()
                within = [np.flatnonzero(mask >> k & 1) for k in range(max(settings, 1))]
            vectors, ids = _matrix(part), part.column("id")
            for at in range(0, len(vectors), QUERY_BLOCK):
                similar = vectors[at : at + QUERY_BLOCK] @ own
                for setting, inside in enumerate(within):
                    if not len(inside):
                        continue
                    q, r = keep(similar[:, inside], codes[inside]) if len(inside) < similar.shape[1] else keep(similar, codes)
                    r = inside[r]
                    columns = [ids.take(pa.array(q + at)), *(rows.column(c).take(pa.array(r)).combine_chunks() for c in ("id", "slug", "view")), pa.array(similar[q, r])]
                    if settings:
                        columns.append(pa.array(np.full(len(q), setting, np.int32)))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = index.select("row_id", F.col("slug").cast("string").alias("slug"), F.col("view").cast("bigint").alias("view"), (F.col("mask").cast("bigint") if settings else F.lit(1).cast("bigint")).alias("mask"), "embedding")
    asked = queries.select("query_id", F.lit(None).cast("string").alias("slug"), F.lit(None).cast("bigint").alias("view"), F.lit(0).cast("bigint").alias("mask"), "embedding")
    return _dealt(rows, asked, "slug", "view", "mask").mapInArrow(run, SCHEMA + (", setting int" if settings else ""))


def rank_keys(values: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits in the order of finite numbers: their bits, those of negative ones turned over; -0 as 0."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def rank_value(key: int) -> float:
    """The number that has this key."""
    return float(np.array([key if key >= 0 else key ^ 0x7FFFFFFFFFFFFFFF], np.int64).view(np.float64)[0])


def similarity_spread(index: DataFrame, queries: DataFrame, names: list[str], quantiles: list[float]) -> list[tuple[str, int, float, list[float]]]:
    """(name, pairs, mean, quantiles) of the similarities of all pairs of a query and a row with another id, by kinship.

    Both tables have `kin`, an array<string> with the narrowest kin first. A pair
    is of the first name whose place has equal kin on both sides, else of the
    last name; null is nobody's kin, and names without a pair are left out.
    Quantiles lie between neighbouring values as `percentile` has them.

    No pair leaves its task. A pass over the cells counts 16 bits of the
    similarities' rank keys, by name and by the bits that the wanted ranks are
    known to begin with; four passes find the values to the last bit, however
    many pairs are equal. A pass sends DIGITS numbers a name and rank at most.
    """
    last = len(names) - 1

    def counted(active: list[tuple[int, int]] | None, depth: int) -> DataFrame:
        shift = 64 - DIGIT_BITS * (depth + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = len(names) if active is None else len(active)
            held, total = np.zeros(slots * DIGITS, np.int64), np.zeros(slots)
            seen, kin, codes = None, [], []
            for rows, own, part in _met(batches):
                if rows is not seen:
                    seen, kin = rows, [[k[level] for k in rows.column("kin").to_pylist()] for level in range(last)]
                    codes = [{k: i for i, k in enumerate(dict.fromkeys(k for k in level if k is not None))} for level in kin]
                    kin = [np.array([code.get(k, -1) for k in level]) for level, code in zip(kin, codes, strict=True)]
                    ids = rows.column("id").to_numpy()
                vectors, asked = _matrix(part), part.column("kin").to_pylist()
                theirs = [np.array([code.get(k[level], -2) for k in asked]) for level, code in enumerate(codes)]
                own_ids, step = part.column("id").to_numpy(), max(AREA // own.shape[1], 1)
                for at in range(0, len(vectors), step):
                    similar = vectors[at : at + step] @ own
                    name = np.full(similar.shape, last)
                    for level in reversed(range(last)):
                        name[theirs[level][at : at + step, None] == kin[level]] = level
                    pairs = own_ids[at : at + step, None] != ids
                    similar, name = similar[pairs], name[pairs]
                    keys = rank_keys(similar)
                    digit = (keys >> shift) + (DIGITS // 2 if active is None else 0) & (DIGITS - 1)
                    if active is None:
                        held += np.bincount(name * DIGITS + digit, minlength=len(held))
                        total += np.bincount(name, similar, minlength=slots)
                        continue
                    for slot, (own_name, prefix) in enumerate(active):
                        chosen = digit[(name == own_name) & (keys >> shift + DIGIT_BITS == prefix)]
                        held[slot * DIGITS : (slot + 1) * DIGITS] += np.bincount(chosen, minlength=DIGITS)
            some = np.flatnonzero(held)
            sums = np.where(np.r_[True, some[1:] // DIGITS != some[:-1] // DIGITS], total[some // DIGITS], 0.0) if len(some) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(some // DIGITS), pa.array(some % DIGITS), pa.array(held[some]), pa.array(sums)], names=["slot", "digit", "n", "total"])

        found = dealt.mapInArrow(run, "slot bigint, digit bigint, n bigint, total double")
        return found.groupBy("slot", "digit").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    dealt = _dealt(index, queries, "kin")
    whole = stored(counted(None, 0), "spread")
    first = {r["slot"]: (r["n"], r["total"]) for r in whole.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}  # a row a name
    # wanted: (name, rank from 0) -> the bits known and the pairs before them
    wanted = {(name, rank): (None, 0) for name, (n, _) in first.items() for q in quantiles for rank in (int(np.floor(q * (n - 1))), int(np.ceil(q * (n - 1))))}
    for depth in range(64 // DIGIT_BITS):
        active = None if depth == 0 else sorted({(name, prefix) for (name, _), (prefix, _) in wanted.items()})
        slot_of = {(name, None): name for name in first} if active is None else {x: i for i, x in enumerate(active)}
        before = F.sum("n").over(Window.partitionBy("slot").orderBy("digit")) - F.col("n")  # a window over DIGITS rows at most
        held = (whole if depth == 0 else counted(active, depth)).withColumn("before", before)
        asks = [(slot_of[name, prefix], rank - below) for (name, rank), (prefix, below) in wanted.items()]
        hit = F.lit(False)
        for slot, rank in asks:
            hit = hit | ((F.col("slot") == slot) & (F.col("before") <= rank) & (rank < F.col("before") + F.col("n")))
        rows = held.filter(hit).collect() if asks else []  # a row for each wanted rank at most
        for (name, rank), (prefix, below) in list(wanted.items()):
            r = next(r for r in rows if r["slot"] == slot_of[name, prefix] and r["before"] <= rank - below < r["before"] + r["n"])
            wanted[name, rank] = (r["digit"] - DIGITS // 2 if prefix is None else prefix << DIGIT_BITS | r["digit"], below + r["before"])
    found = []
    for name, (n, total) in sorted(first.items()):
        values = []
        for q in quantiles:
            at = q * (n - 1)
            low, high = (rank_value(wanted[name, int(f(at))][0]) for f in (np.floor, np.ceil))
            values.append(float(low + (high - low) * (at - np.floor(at))))
        found.append((names[name], n, total / n, values))
    return found


def top_rows(index: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """The `depth` nearest index rows of each query, ties by row_id, with their rank from 1."""
    nearest = Window.partitionBy("query_id").orderBy(F.desc("cv"), "row_id")
    found = _scan(index, queries, lambda similar, _: best_places(similar, depth))
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= depth)


def best_keys(limit: int | None) -> Keep:
    """Takes the nearest row of each key, with `limit` of that many nearest keys only; ties by row_id."""

    def keep(similar: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(codes, kind="stable")  # by key, then by id
        starts = np.flatnonzero(np.r_[True, codes[order][1:] != codes[order][:-1]])
        sorted_ = similar[:, order]
        best = np.maximum.reduceat(sorted_, starts, axis=1)
        hit = sorted_ == np.repeat(best, np.diff(np.r_[starts, len(order)]), axis=1)
        first = np.minimum.reduceat(np.where(hit, np.arange(len(order)), len(order)), starts, axis=1)
        places = order[first]
        if limit is None or places.shape[1] <= limit:
            return np.repeat(np.arange(len(similar)), places.shape[1]), places.ravel()
        ids = np.argsort(places, axis=1)  # ties between keys by their rows' ids
        q, k = best_places(np.take_along_axis(best, ids, axis=1), limit)
        return q, np.take_along_axis(places, ids, axis=1)[q, k]

    return keep


def best_by_key(index: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """The nearest row of each key (slug) for each query, ties by row_id; with `limit` of that many nearest keys only.

    Rows without key count for nothing. The nearest keys of the whole index are
    among the nearest of the cells that hold their best rows, so a cell gives
    `limit` keys a query.
    """
    found = _scan(index.filter("slug is not null"), queries, best_keys(limit))
    best = F.max_by(F.struct("row_id", "view", "cv"), F.struct("cv", -F.col("row_id")))
    rows = found.groupBy("query_id", "slug").agg(best.alias("best")).select("query_id", "slug", "best.row_id", "best.view", "best.cv")
    return rows if limit is None else placed(rows, limit).drop("place")


def under_settings(index: DataFrame, queries: DataFrame, settings: dict[str, Column], limit: int) -> DataFrame:
    """(setting, query_id, slug, row_id, cv, place) of the first `limit` keys of each query under each setting, in one pass over the index.

    A setting is a condition on the index's rows (views, scopes); 62 at most.
    """
    mask = sum((F.when(rule, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, rule in enumerate(settings.values())), F.lit(0).cast("bigint"))
    found = _scan(index.filter("slug is not null").withColumn("mask", mask), queries, best_keys(limit), len(settings))
    best = F.max_by(F.struct("row_id", "cv"), F.struct("cv", -F.col("row_id")))
    rows = found.groupBy("setting", "query_id", "slug").agg(best.alias("b")).select("setting", "query_id", "slug", "b.row_id", "b.cv")
    place = F.row_number().over(Window.partitionBy("setting", "query_id").orderBy(F.desc("cv"), "row_id")) - 1
    name = F.get(F.array(*map(F.lit, settings)), F.col("setting"))
    return rows.withColumn("place", place).filter(F.col("place") < limit).withColumn("setting", name)


def mapped(rows: DataFrame, left: np.ndarray, right: np.ndarray) -> DataFrame:
    """`rows` with each embedding v as the unit vector of v + (v left) right: a stored head of low rank."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                own = own + (own @ left) @ right
                own /= np.linalg.norm(own, axis=1, keepdims=True) + 1e-9
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1]), pa.int32()), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([flat if c == "embedding" else batch.column(c) for c in names], names=names)

    return rows.withColumn("embedding", F.col("embedding").cast("array<double>")).mapInArrow(run, rows.withColumn("embedding", F.col("embedding").cast("array<double>")).schema)


def placed(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates with their place from 0 by falling similarity, ties by row_id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cv"), "row_id")) - 1
    found = candidates.withColumn("place", place)
    return found if limit is None else found.filter(F.col("place") < limit)


def shortlist(index: DataFrame, queries: DataFrame, topk: int = 20, depth: int = 200) -> DataFrame:
    """The first `topk` different keys among the `depth` nearest rows; rows without key use up depth."""
    first = top_rows(index, queries, depth).filter("slug is not null").groupBy("query_id", "slug").agg(F.min_by(F.struct("row_id", "view", "cv"), "rank").alias("r"))
    return placed(first.select("query_id", "slug", "r.row_id", "r.view", "r.cv"), topk)
