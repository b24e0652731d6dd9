"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are the signs of the centred vectors after a rotation learned by iterative
quantisation on a bounded sample. They are cut into substrings of up to 16 bits
with a table each. If two codes differ in at most `radius` bits, some substring
differs in few (pigeonhole), so probing the buckets near a query's substrings
finds every code within the radius; those vectors are then ranked by their exact
distances. The radius is learned too: for a bounded set of sample queries, all
rows are read and it holds `HOLDS` of their true neighbours, so it shrinks as
the table fills. It is the same for all blocks.

Each table holds all vectors, so where substrings within reach would be many
(`FEW` of all codes read or more), only the first is made and asked, for whole codes.

A table's buckets lie on shelves by the first bits of the substring, as many
bits as make a shelf a block of rows; a bucket that is larger than a block takes
several. Shelves are written once. A query meets, by equi-joins, only the
shelves whose bits are near enough to its own, and on them probes only buckets
within reach. Queries that found too few rows in all ask again with a wider
radius, the last time with one that holds every code.

The driver gets the sample, drawn from few rows a task, and a line for each
block of the index; queries and what they meet stay on the executors.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchforge.llm.common import slices, stored, tidied

#: Vectors from which rotation and radius are learned at most, and queries among them.
SAMPLE, SAMPLE_QUERIES = 4_096, 256
HOLDS = 0.98
NEAREST = 10
TURNS = 30
PART = 16
#: Share of the codes that substrings within reach may hold before whole codes are compared instead.
FEW = 0.02
#: Vectors in a block, and at most in one of whole codes, where every query meets every block.
BLOCK, WIDE_BLOCK, WIDE_BLOCKS = 8_192, 65_536, 24


@dataclass
class Coder:
    """Scale and centre, rotation (dimension x bits, at most 64) and search radius; whether one table holds the whole codes."""

    scale: float
    centre: np.ndarray
    turn: np.ndarray
    radius: int
    whole: bool = False

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    @property
    def tables(self) -> int:
        return 1 if self.whole else math.ceil(self.bits / PART)

    def within(self, radius: int) -> Coder:
        """The coder at this radius, with only its first table and whole codes if tables of substrings would read many codes, were codes spread evenly."""
        parts = replace(self, radius=radius, whole=False)
        widths = [min(PART, self.bits - j * PART) for j in range(parts.tables)]
        read = sum(sum(math.comb(w, k) for k in range(reach + 1)) / 2**w for w, reach in zip(widths, parts.reaches(radius), strict=True))
        return replace(parts, whole=read >= FEW)

    def codes(self, x: np.ndarray) -> np.ndarray:
        signs = (x / self.scale - self.centre) @ self.turn > 0
        padded = np.zeros((len(x), 64), np.uint8)
        padded[:, : self.bits] = signs
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64).ravel()

    def reaches(self, radius: int) -> list[int]:
        """Bits in which each table's substrings may differ, below zero if the table needn't be asked: these and one for each table add up to more than the radius."""
        each, over = divmod(radius, self.tables)
        return [each if j <= over else each - 1 for j in range(self.tables)]

    def shelf_bits(self, rows: int, block: int) -> list[int]:
        """Bits of each table's substrings that name a shelf, so that shelves hold about `block` of `rows` rows."""
        wanted = max(0, math.ceil(math.log2(max(rows, 1) / block)))
        return [min(wanted, PART, self.bits - j * PART) for j in range(self.tables)]

    @classmethod
    def learned(cls, x: np.ndarray) -> Coder:
        """Iterative quantisation on principal axes; the radius is still all bits. Very large components are scaled down first."""
        scale = float(np.abs(x).max()) or 1.0
        centre = (x / scale).mean(axis=0)
        y = x / scale - centre
        bits = min(x.shape[1], 64)
        axes = np.linalg.svd(y.T @ y)[0][:, :bits]
        z = y @ axes
        turn = np.linalg.qr(np.random.default_rng(7).normal(size=(bits, bits)))[0]
        for _ in range(TURNS):
            u, _, v = np.linalg.svd(z.T @ np.where(z @ turn > 0, 1.0, -1.0))
            turn = u @ v
        return cls(scale, centre, axes @ turn, bits)


def with_radius(coder: Coder, rows: DataFrame, ids: np.ndarray, asked: np.ndarray) -> Coder:
    """The coder with the radius that holds `HOLDS` of the true neighbours of the sample queries among all rows.

    Each task sends ten rows a query; ten times `SAMPLE_QUERIES` numbers come to the driver.
    """
    codes, asked = coder.codes(asked), asked / coder.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), NEAREST), np.inf), np.zeros((len(ids), NEAREST), np.int64)
        for batch in (part for whole in batches for part in slices(whole, 2_000)):
            own, x = vectors_of(batch)
            y = x / coder.scale
            d = (asked**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * asked @ y.T
            d[ids[:, None] == own] = np.inf
            both = np.concatenate([best[0], d], axis=1)
            bits = np.concatenate([best[1], np.bitwise_count(codes[:, None] ^ coder.codes(x)).astype(np.int64)], axis=1)
            few = np.argpartition(both, NEAREST - 1, axis=1)[:, :NEAREST]
            best = np.take_along_axis(both, few, 1), np.take_along_axis(bits, few, 1)
        query, place = np.nonzero(np.isfinite(best[0]))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(best[0][query, place]), pa.array(best[1][query, place])], names=["query", "d", "bits"])

    found = rows.mapInArrow(run, "query bigint, d double, bits bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "bits"))
    far = found.withColumn("rank", rank).filter(F.col("rank") <= NEAREST).select("bits").toPandas()["bits"].to_numpy()
    return replace(coder, radius=int(np.quantile(far, HOLDS, method="higher")) if len(far) else coder.bits)


def vectors_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors as rows of doubles."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    return ids, batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)


def distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in doubles; where squares leave their range, they are taken of scaled differences."""
    apart = x.astype(np.float64) - query.astype(np.float64)
    with np.errstate(over="ignore", under="ignore"):
        d = np.sqrt((apart**2).sum(axis=1))
    most = np.abs(apart).max(axis=1, initial=0.0)
    odd = (d < 1e-150) & (most > 0) | ~np.isfinite(d) & np.isfinite(most)
    d[odd] = most[odd] * np.sqrt(((apart[odd] / most[odd, None]) ** 2).sum(axis=1))
    return d


class Shelf:
    """Rows of one table whose substrings begin with the same `shelf_bits` bits, by bucket (substring)."""

    def __init__(self, coder: Coder, table: int, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray):
        self.coder, self.table, self.ids, self.codes, self.vectors = coder, table, ids, codes, vectors
        values = self.part(codes, table)
        self.order = np.argsort(values, kind="stable")
        self.buckets, self.starts, self.sizes = np.unique(values[self.order], return_index=True, return_counts=True)

    @staticmethod
    def part(codes: np.ndarray, table: int) -> np.ndarray:
        return codes >> np.uint64(table * PART) & np.uint64((1 << PART) - 1)

    def probed(self, value: np.uint64, reach: int, fixed: int) -> np.ndarray:
        """Places of buckets that differ from `value` in at most `reach` bits; all here share the lowest `fixed` bits.

        Where the substrings within reach are fewer than the buckets, each is looked up.
        """
        own = np.uint64((1 << fixed) - 1)
        if not len(self.buckets) or (reach := reach - int(np.bitwise_count((self.buckets[0] ^ value) & own))) < 0:
            return np.zeros(0, np.int64)
        width = min(PART, self.coder.bits - self.table * PART) - fixed
        if sum(math.comb(width, k) for k in range(reach + 1)) >= len(self.buckets):
            return np.flatnonzero(np.bitwise_count((self.buckets ^ value) & ~own) <= reach)
        probes = (value & ~own | self.buckets[0] & own) ^ (flips(width, reach) << np.uint64(fixed))
        at = np.minimum(np.searchsorted(self.buckets, probes), len(self.buckets) - 1)
        return at[self.buckets[at] == probes]

    def within(self, code: np.uint64, radius: int, fixed: int = 0) -> tuple[np.ndarray, int]:
        """Rows whose code differs in at most `radius` bits and that no table before finds, and how many codes were read for that."""
        if self.coder.whole:
            return np.flatnonzero(np.bitwise_count(self.codes ^ code) <= radius), len(self.codes)
        reaches = self.coder.reaches(radius)
        near = self.probed(self.part(code, self.table), reaches[self.table], fixed)
        if not len(near):
            return np.zeros(0, np.int64), 0
        ends = np.cumsum(self.sizes[near])
        rows = self.order[np.arange(ends[-1]) + np.repeat(self.starts[near] - (ends - self.sizes[near]), self.sizes[near])]
        read = len(rows)
        apart = self.codes[rows] ^ code
        mine = np.bitwise_count(apart) <= radius
        for j in range(self.table):
            mine &= np.bitwise_count(self.part(apart, j)) > reaches[j] if reaches[j] >= 0 else True
        return np.sort(rows[mine]), read

    def nearest(self, query_id: int, query: np.ndarray, code: np.uint64, radius: int, fixed: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the nearest rows within the radius; `apart`: what `roughly` says of all rows, where it's known."""
        rows, _ = self.within(code, radius, fixed)
        rows = rows[self.ids[rows] != query_id]
        if len(rows) > 4 * NEAREST:
            x = self.vectors[rows] if apart is None else None
            squares = self.squares[rows]
            rows = rows[close(roughly(x, squares, query[None])[0] if apart is None else apart[rows], squares.max(), query)]
        d = distances(self.vectors[rows], query)
        if len(rows) > NEAREST:
            few = d <= np.partition(d, NEAREST - 1)[NEAREST - 1]
            rows, d = rows[few], d[few]
        order = np.lexsort((self.ids[rows], d))[:NEAREST]
        return self.ids[rows[order]], d[order]

    @functools.cached_property
    def squares(self) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.einsum("ij,ij->i", self.vectors, self.vectors)

    def answers(self, ids: np.ndarray, queries: np.ndarray, codes: np.ndarray, radius: int, fixed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, distances) of each query. Among whole codes most blocks have many rows within reach: rough distances come from one product for some queries at a time."""
        for at in range(0, len(ids), 32):
            few = slice(at, at + 32)
            apart = roughly(self.vectors, self.squares, queries[few]) if self.coder.whole else [None] * 32
            for q, x, code, a in zip(ids[few], queries[few], codes[few], apart, strict=False):
                yield q, *self.nearest(q, x, code, radius, fixed, a)


def roughly(x: np.ndarray, squares: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of rows from each query, but for the query's own square, in the vectors' precision."""
    with np.errstate(all="ignore"):
        return squares - 2 * (queries @ x.T)


def close(apart: np.ndarray, most: float, query: np.ndarray) -> np.ndarray:
    """Places of rough distances among which the ten nearest are, their error allowed for; all where squares leave their range. most: the largest square of a row."""
    kind = np.finfo(apart.dtype)
    with np.errstate(all="ignore"):
        error = 8 * len(query) * (kind.eps * (most + query @ query) + kind.tiny)
        bound = np.partition(apart, NEAREST)[NEAREST] + 2 * error
    return np.flatnonzero(apart <= bound) if np.isfinite(apart).all() and np.isfinite(bound) else np.arange(len(apart))


@functools.cache
def flips(width: int, reach: int) -> np.ndarray:
    """All numbers of `width` bits of which at most `reach` are set."""
    every = np.arange(1 << width, dtype=np.uint64)
    return every[np.bitwise_count(every) <= reach]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that take part: an id, and a non-zero vector of finite components and of the commonest size; components stay float or become double."""
    kept = "array<float>" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kept).alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))
    top = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("embedding") == (top["n"] if top else 0))


def coded(rows: DataFrame, coder: Coder) -> DataFrame:
    """(vec_id, code, vector): the code as a number, the vector's components as bytes."""
    single = rows.schema["embedding"].dataType.elementType == T.FloatType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2_000)):
            ids, x = vectors_of(batch)
            vector = pa.array([row.tobytes() for row in (x.astype(np.float32) if single else x)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(coder.codes(x).view(np.int64)), vector], names=["vec_id", "code", "vector"])

    return rows.mapInArrow(run, "vec_id bigint, code bigint, vector binary")


def packed(rows: DataFrame, keys: list[str], size: int, parts: int | None = None) -> DataFrame:
    """Rows (keys, vec_id, code, vector) as packs of at most `size` rows with equal keys: keys, pack (a new name), ids, codes, vectors.

    Ranges of keys and of a hash of the id are tasks, so a key with many rows
    takes several; each walks through its sorted rows and holds one pack. `parts`:
    the number of tasks, where packs should not be cut by more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            whole = pa.concat_batches(held)
            columns = [pa.array([value], whole.schema.field(name).type) for name, value in zip(keys, key, strict=True)] + [pa.array([uuid.uuid4().hex])]
            parts = [whole.column(name).to_numpy(zero_copy_only=False).tobytes() for name in ("vec_id", "code")] + [b"".join(whole.column("vector").to_pylist())]
            return pa.RecordBatch.from_arrays(columns + [pa.array([x], pa.binary()) for x in parts], names=[*keys, "pack", "ids", "codes", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            named = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            starts = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in named], axis=0)])
            for at, end in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
                own = tuple(x[at] for x in named)
                if held and own != key:
                    yield out()
                    held.clear()
                key = own
                while at < end:
                    more = min(end - at, size - sum(x.num_rows for x in held))
                    held.append(batch.slice(at, more))
                    at += more
                    if sum(x.num_rows for x in held) == size:
                        yield out()
                        held.clear()
        if held:
            yield out()

    own = [rows.schema[k] for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own) + ", pack string, ids binary, codes binary, vectors binary"
    by = [*keys, F.xxhash64("vec_id", "vector")]
    spread = rows.select(*keys, "vec_id", "code", "vector").repartitionByRange(*([parts] if parts else []), *by)
    return spread.sortWithinPartitions(*keys).mapInArrow(run, schema)


def shelf_of(code: Column, table: int, bits: int) -> Column:
    return F.shiftrightunsigned(code, table * PART).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def shelves_near(table: int, bits: int, reach: int) -> Column:
    """The table's shelves (t, shelf) whose bits differ from those of column code in at most `reach`."""
    flip = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit((1 << bits) - 1).cast("bigint")), lambda x: F.bit_count(x) <= reach)
    return F.transform(flip, lambda x: F.struct(F.lit(table).alias("t"), x.bitwiseXOR(shelf_of(F.col("code"), table, bits)).alias("shelf")))


def shelves(rows: DataFrame, coder: Coder, bits: list[int], block: int, n: int) -> DataFrame:
    """The index: all rows once for each table, in packs by table and shelf; of whole codes, one shelf in as many packs as it takes."""
    places = [F.struct(F.lit(t).alias("t"), shelf_of(F.col("code"), t, n).alias("shelf")) for t, n in enumerate(bits)]
    placed = rows.withColumn("place", F.explode(F.array(*places))).select("place.*", "vec_id", "code", "vector")
    return packed(placed, ["t", "shelf"], 2 * block, math.ceil(n / block)) if coder.whole else packed(placed, ["t", "shelf"], block)


def found_within(index: DataFrame, queries: DataFrame, coder: Coder, bits: list[int], single: bool) -> DataFrame:
    """The ten nearest rows within the coder's radius of each of `queries` (vec_id, code, vector): query_id, rank, vec_id, score.

    Queries travel to the packs that they meet, once each, and pass by them as a
    stream. What is broadcast is the list of packs: exploded queries look as small
    to the planner as before, and would be broadcast whole.
    """
    kind, radius = np.float32 if single else np.float64, coder.radius
    asked = [shelves_near(t, bits[t], reach) for t, reach in enumerate(coder.reaches(radius)) if reach >= 0]
    index = index.filter(F.col("t") < len(asked))
    probes = queries.withColumn("place", F.explode(F.concat(*asked))).select("place.*", "vec_id", "code", "vector")
    met = probes.join(F.broadcast(index.select("t", "shelf", "pack")), ["t", "shelf"]).select("pack", F.lit(True).alias("asks"), "t", "vec_id", "code", "vector")
    packs = index.select("pack", F.lit(False).alias("asks"), "t", "ids", "codes", F.col("vectors").alias("vector"))
    both = packs.unionByName(met, allowMissingColumns=True).repartition(max(12, index.count()), "pack").sortWithinPartitions("pack", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, shelf = (), None
        for batch in (part for whole in batches for part in slices(whole, 2_000)):
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            ends = np.r_[np.flatnonzero(~asks), len(asks)]
            out = []
            for at, end in zip(np.r_[-1, ends[:-1]], ends, strict=True):
                if at >= 0:
                    pack, shelf = [batch.column(c)[at].as_py() for c in ("t", "ids", "codes", "vector")], None
                if end - at > 1:
                    if shelf is None:
                        ids, codes, vectors = (np.frombuffer(raw, k) for raw, k in zip(pack[1:], (np.int64, np.uint64, kind), strict=True))
                        shelf = Shelf(coder, pack[0], ids, codes, vectors.reshape(len(ids), -1))
                    part = batch.slice(at + 1, end - at - 1)
                    x = np.frombuffer(b"".join(part.column("vector").to_pylist()), kind).reshape(part.num_rows, -1)
                    codes = part.column("code").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    out += shelf.answers(part.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64), x, codes, radius, bits[shelf.table])
            if out:
                columns = [np.repeat([q for q, _, _ in out], [len(d) for _, _, d in out]), np.concatenate([i for _, i, _ in out]), np.concatenate([d for _, _, d in out])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(tidied(run), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")


def sampled(rows: DataFrame, n: int) -> pd.DataFrame:
    """The `SAMPLE` rows with the smallest hashes of their ids, of `n` rows, or all if they are fewer.

    Only hashes below a bound that some four times as many rows keep are sorted, in
    few parts: sorted in place, every task would send `SAMPLE` vectors to the driver.
    """
    key = F.xxhash64("vec_id")
    edge = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 4 * SAMPLE // max(n, 1))
    for few in (rows.filter(key <= F.lit(edge)), rows):  # the second, if one id repeats so often that others lie beyond
        found = few.repartition(12, "vec_id", "embedding").orderBy(key, "vec_id").limit(SAMPLE).toPandas()
        if len(found) >= min(SAMPLE, n):
            break
    return found


def nearest_neighbours(vectors: DataFrame, every: int = 100, block: int = BLOCK) -> DataFrame:
    """The nearest found of each row whose id is divisible by `every`: query_id, rank, vec_id, score (Euclidean).

    Candidates are all rows with another id; ties go to the smaller id. Rows
    without id, and null, zero or not wholly finite vectors, and such of another
    size than the commonest, take no part. An id that repeats among the queries
    asks once, with its smallest vector; candidates that repeat count each. If a
    query has fewer candidates than ten, all of them are returned. An empty table
    gives an empty one; other columns are ignored. Distances beyond the range of
    squares are right as long as they are doubles themselves.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    n = rows.count()
    sample = sampled(rows, n)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    single = rows.schema["embedding"].dataType.elementType == T.FloatType()
    x = np.stack([np.asarray(v, np.float64) for v in sample["embedding"]])
    coder = with_radius(Coder.learned(x), rows, sample["vec_id"].to_numpy()[:SAMPLE_QUERIES], x[:SAMPLE_QUERIES])
    coder = coder.within(coder.radius)
    if coder.whole:
        block = max(block, min(WIDE_BLOCK, n // WIDE_BLOCKS))
    bits = [0] if coder.whole else coder.shelf_bits(n, block)
    index = stored(shelves(coded(rows, coder), coder, bits, block, n), "shelves")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    todo = stored(coded(asked, coder), "queries")
    done, wider = [], math.ceil(coder.bits / PART)
    while True:
        found = stored(found_within(index, todo, coder, bits, single), "found")
        if coder.radius >= coder.bits:
            return functools.reduce(DataFrame.unionByName, [*done, found])
        full = found.filter(F.col("rank") == NEAREST).select("query_id")
        done.append(found.join(full, "query_id", "left_semi"))
        todo = stored(todo.join(full, todo["vec_id"] == full["query_id"], "left_anti"), "queries")
        if todo.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        coder, wider = coder.within(min(coder.bits, coder.radius + wider)), 2 * wider
