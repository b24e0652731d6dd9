"""SimHash near-duplicates, found exactly by anchor points of a covering code.

Fingerprints that differ in at most `distance` bits differ in at most
`radius` = distance // blocks bits of one of several blocks (pigeonhole). Within
a block the anchors are the words of a covering code with radius 1: a perfect
Hamming code on the low bits, all values of the others. Every fingerprint has
one nearest anchor, its home, and is replicated to every anchor within covering
radius plus threshold, that is, to the homes of all values within `radius` bits.
Of two linked fingerprints the smaller one's home anchor in the first block
where they differ in `radius` bits at most therefore holds both, and they are
compared there and nowhere else. Blocks come first because one code over all 64
bits would need far more replicas for the same threshold.

`cover_for` chooses blocks and code by the number of different fingerprints: more
replicas, but smaller groups, the more there are. Every cover finds the same
links. An anchor's group is compared where its residents (fingerprints at home
there) meet its members; groups above `PART` rows are split: members are dealt
to parts, and the few residents go to every part. Equal fingerprints are made
one before, and each part gives a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm.common import slices, small_batches, stored, tidied
from matchforge.operators.components import connected_components

SEED = 42
#: Rows that are compared at once, and the size of an anchor's group from which residents meet members one by one.
CHUNK, LARGE = 250_000, 32
#: Rows of an anchor's group in one part at most.
PART = 200_000
#: Comparisons that sending one replica costs, its bytes on disk counted in.
SENDING = 10_000


@dataclass(frozen=True)
class Kind:
    """What a near-duplicate is: words in a shingle, differing bits of the first 64, and of all bits, at most.

    `halves` 2 makes fingerprints of 128 bits; anchors are looked for by the
    first 64, and all of them decide. Up to `few` different fingerprints the
    cover stays the same.
    """

    shingle: int = 4
    distance: int = 4
    halves: int = 1
    in_all: int = 4
    few: int = 10_000_000


#: Shingles of five words and a similarity of 0.8: two such sets differ in 19 of 128 bits on average.
SIMILAR = Kind(shingle=5, distance=11, halves=2, in_all=21, few=1_000_000)


def fingerprint(text: bytes | None, kind: Kind = Kind()) -> bytes:
    """The fingerprint of a text in UTF-8, most significant byte first; zero if it has no word."""
    words = (text or b"").lower().split()  # bytes: lower() and split() know A-Z and ASCII white space only
    if not words:
        return bytes(8 * kind.halves)
    digest = xxhash.xxh64_digest if kind.halves == 1 else xxhash.xxh3_128_digest
    joined = b" ".join(words)
    if len(words) <= kind.shingle:
        return digest(joined, SEED)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends]
    hashed = b"".join([digest(joined[i : j - 1], SEED) for i, j in zip(starts, ends[kind.shingle - 1 :], strict=False)])
    every = np.frombuffer(hashed, np.uint8).reshape(-1, 8 * kind.halves)
    ones = np.zeros(64 * kind.halves, np.int64)
    for at in range(0, len(every), CHUNK):
        ones += np.unpackbits(every[at : at + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(every)).tobytes()


def fingerprints(docs: DataFrame, kind: Kind = Kind(), *others: str) -> DataFrame:
    """(doc_id, fp binary) of each row, and the columns named in `others`."""
    names = ["doc_id", "fp", *others]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = pa.array([fingerprint(t, kind) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), fps, *map(batch.column, others)], names=names)

    schema = "doc_id bigint, fp binary" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return small_batches(docs).select("doc_id", "text", *others).mapInArrow(run, schema)


# ---- anchors -------------------------------------------------------------------------------------------------------


def ball(n: int, radius: int) -> int:
    return sum(comb(n, i) for i in range(radius + 1))


@dataclass(frozen=True)
class Cover:
    """Anchors for a distance: `parts` blocks of the 64 bits, each with a Hamming code on its low bits."""

    distance: int
    parts: int

    @cached_property
    def blocks(self) -> list[tuple[int, int]]:
        """(first bit, bits) of each block."""
        cuts = [round(64 * k / self.parts) for k in range(self.parts + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]

    @property
    def radius(self) -> int:
        return self.distance // self.parts

    def coded(self, bits: int) -> int:
        """Bits of the longest Hamming code (length 2**r - 1) within a block."""
        return (1 << (bits + 1).bit_length() - 1) - 1

    def replicas_of(self, bits: int) -> float:
        """Anchors within reach of a fingerprint in a block, on average: code words within radius + 1, by flips of free bits."""
        code = self.coded(bits)
        free = bits - code
        return sum(comb(free, j) * ball(code, self.radius - j + 1) / (code + 1) for j in range(min(free, self.radius) + 1))

    def cost(self, n: int) -> float:
        """Comparisons a fingerprint among `n`, the sending of replicas counted in."""
        return sum(self.replicas_of(bits) * (SENDING + n / 2 ** (bits - (self.coded(bits) + 1).bit_length() + 1)) for _, bits in self.blocks)

    @cached_property
    def flips(self) -> list[np.ndarray]:
        """All changes of up to `radius` bits of each block."""
        return [np.array([sum(1 << b for b in which) for k in range(self.radius + 1) for which in combinations(range(first, first + bits), k)], np.uint64) for first, bits in self.blocks]

    def homes(self, fps: np.ndarray, block: int) -> np.ndarray:
        """The home anchor of fingerprints in a block, numbered apart from the other blocks' anchors: the syndrome is the place of the wrong bit."""
        first, bits = self.blocks[block]
        value = (fps >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64)
        code = self.coded(bits)
        syndrome = np.zeros(value.shape, np.int64)
        for low in range(0, code, 8):
            syndrome ^= SYNDROMES[low // 8][value >> low & (0xFF if code - low >= 8 else (1 << code - low) - 1)]
        return np.where(syndrome > 0, value ^ np.left_shift(1, np.maximum(syndrome - 1, 0)), value) | block << 40

    def replicas(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, place of the fingerprint): each at the homes of all values within `radius` bits, block by block."""
        anchors, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for block, flips in enumerate(self.flips):
            step = max(1, 2_000_000 // len(flips))
            for at in range(0, len(fps), step):
                near = self.homes(fps[at : at + step, None] ^ flips, block)
                near.sort(axis=1)
                new = np.ones(near.shape, bool)
                new[:, 1:] = near[:, 1:] != near[:, :-1]
                anchors.append(near[new])
                who.append(at + np.nonzero(new)[0])
        return np.concatenate(anchors), np.concatenate(who)


#: Syndromes of each byte of a coded value: bit i (from 0) has the place i + 1.
SYNDROMES = np.zeros((8, 256), np.int64)
for _bit in range(64):
    SYNDROMES[_bit // 8] ^= np.where(np.arange(256) >> _bit % 8 & 1, _bit + 1, 0)


def cover_for(distance: int, n: int) -> Cover:
    """The cheapest cover for `n` different fingerprints; radii above three would need too many replicas."""
    return min((Cover(distance, k) for k in range(2, distance + 1) if distance // k <= 3), key=lambda c: c.cost(n))


# ---- comparing -----------------------------------------------------------------------------------------------------


@dataclass
class Group:
    """Rows at one anchor (or several): fingerprints as rows of 64-bit words, and which of them are members of this part."""

    kind: Kind
    cover: Cover

    def linked(self, x: np.ndarray, y: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Which pairs are links that this anchor has to find: home of the smaller one, first block with `radius` bits at most."""
        apart = x ^ y
        good = np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= self.kind.in_all
        good &= np.bitwise_count(apart[:, 0]) <= self.kind.distance
        at = np.flatnonzero(good)
        apart, x, y, anchor = apart[at, 0], x[at], y[at], np.broadcast_to(anchor, len(good))[at]
        least = np.where(less(x, y), x[:, 0], y[:, 0])
        first = np.full(len(at), len(self.cover.blocks) - 1)
        home = np.zeros(len(at), np.int64)
        for b in range(len(self.cover.blocks) - 1, -1, -1):
            low, bits = self.cover.blocks[b]
            first[np.bitwise_count(apart >> np.uint64(low) & np.uint64((1 << bits) - 1)) <= self.cover.radius] = b
        for b in range(len(self.cover.blocks)):
            own = first == b
            home[own] = self.cover.homes(least[own], b)
        good[at] = home == anchor
        return good

    def residents(self, anchor: int, fps: np.ndarray) -> np.ndarray:
        return self.cover.homes(fps[:, 0], anchor >> 40) == anchor

    def met(self, anchor: int, fps: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect what residents and members of one anchor's part link."""
        at_home = np.flatnonzero(self.residents(anchor, fps))
        members = np.flatnonzero(member)
        a, b, held = [], [], 0
        step = max(1, 1_000_000 // max(len(members), 1))
        for k in range(0, len(at_home), step):
            some = at_home[k : k + step]
            i, j = np.nonzero(np.bitwise_count(fps[some, :1] ^ fps[members, 0]) <= self.kind.distance)
            i, j = some[i], members[j]
            other = i != j
            i, j = i[other], j[other]
            good = self.linked(fps[i], fps[j], anchor)
            a.append(i[good])
            b.append(j[good])
            held += int(good.sum())
            if held > 4 * CHUNK:  # a dense group: keep what connects it
                p, q = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [p], [q], len(p)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def compared(self, keys: np.ndarray, fps: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spanning links, as places, of whole groups sorted by key; keys are anchors, with the number of the part above them."""
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(sizes > LARGE):
            s = slice(starts[k], starts[k] + sizes[k])
            i, j = self.met(int(keys[starts[k]] & ANCHOR), fps[s], member[s])
            a.append(i + starts[k])
            b.append(j + starts[k])
        at = np.flatnonzero(np.repeat(sizes <= LARGE, sizes))
        for shift in range(1, min(LARGE, len(at))):
            i, j = at[:-shift], at[shift:]
            near = (keys[i] == keys[j]) & (np.bitwise_count(fps[i, 0] ^ fps[j, 0]) <= self.kind.distance) & (member[i] | member[j])
            i, j = i[near], j[near]
            good = self.linked(fps[i], fps[j], keys[i] & ANCHOR)
            a.append(i[good])
            b.append(j[good])
        i, j = np.concatenate(a), np.concatenate(b)
        _, one = np.unique(fps, axis=0, return_inverse=True) if fps.shape[1] > 1 else np.unique(fps[:, 0], return_inverse=True)
        where = np.zeros(int(one.max()) + 1 if len(one) else 0, np.int64)
        where[one.ravel()] = np.arange(len(fps))
        p, q = forest(one.ravel()[i], one.ravel()[j])
        return where[p], where[q]


#: A key without the number of its part.
ANCHOR = (1 << 48) - 1


def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of words are smaller."""
    found = x[:, -1] < y[:, -1]
    for k in range(x.shape[1] - 2, -1, -1):
        found = (x[:, k] < y[:, k]) | (x[:, k] == y[:, k]) & found
    return found


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect the same nodes as the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[i], root[j]
        if (p == q).all():
            break
        least = np.minimum(p, q)
        np.minimum.at(root, p, least)
        np.minimum.at(root, q, least)
        while (root != root[root]).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys with the sums of their counts."""
    different, at = np.unique(keys, return_inverse=True)
    return different, np.bincount(at, weights=counts, minlength=len(different)).astype(np.int64)


def words_of(column: pa.Array, halves: int) -> np.ndarray:
    """Binary fingerprints as rows of 64-bit words."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)
    return raw.view(">u8").astype(np.uint64).reshape(-1, halves)


def binaries(words: np.ndarray) -> pa.Array:
    raw = words.astype(">u8").tobytes()
    size = 8 * words.shape[1]
    offsets = pa.py_buffer((np.arange(len(words) + 1) * size).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(words), [None, offsets, pa.py_buffer(raw)])


def fingerprint_links(distinct: DataFrame, kind: Kind = Kind(), cover: Cover | None = None) -> DataFrame:
    """Links (a, b) that connect the fingerprints fp of a table of different ones as all their links do."""
    cover = cover or cover_for(kind.distance, max(distinct.count(), kind.few))
    group = Group(kind, cover)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 10_000)):
            words = words_of(batch.column("fp"), kind.halves)
            anchors, who = cover.replicas(words[:, 0])
            order = np.argsort(anchors, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array(anchors[order]), binaries(words[who[order]])], names=["key", "fp"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in (part for whole in batches for part in slices(whole, 10_000)):
            anchors, _ = cover.replicas(words_of(batch.column("fp"), kind.halves)[:, 0])
            for own, more in zip(held, np.unique(anchors, return_counts=True), strict=True):
                own.append(more)
            if sum(map(len, held[0])) > 4 * CHUNK:
                keys, counts = added(*map(np.concatenate, held))
                if len(keys) > 2 * CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "rows"])
                    keys, counts = keys[:0], counts[:0]
                held = [keys], [counts]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, added(*map(np.concatenate, held)))), names=["key", "rows"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts = batch.column("key").to_numpy(), batch.column("parts").to_numpy()
            words = words_of(batch.column("fp"), kind.halves)
            own = (words[:, -1] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts
            home = np.zeros(len(keys), bool)
            for b in np.unique(keys >> 40):
                mine = keys >> 40 == b
                home[mine] = cover.homes(words[mine, 0], int(b)) == keys[mine]
            times = np.where(home, parts, 1)
            row = np.repeat(np.arange(len(keys)), times)
            part = np.where(home[row], np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times), own[row])
            columns = [pa.array(keys[row] | part << 48), binaries(words[row]), pa.array(part == own[row])]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "fp", "member"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            rows.append((batch.column("key").to_numpy(), words_of(batch.column("fp"), kind.halves), batch.column("member").to_numpy(zero_copy_only=False)))
            held += len(rows[-1][0])
            if held < CHUNK:
                continue
            keys, fps, member = map(np.concatenate, zip(*rows, strict=True))
            whole = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            rows, held = [(keys[whole:], fps[whole:], member[whole:])], 0
            if whole:
                yield out(keys[:whole], fps[:whole], member[:whole])
        if rows:
            yield out(*map(np.concatenate, zip(*rows, strict=True)))

    def out(keys: np.ndarray, fps: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
        a, b = group.compared(keys, fps, member)
        return pa.RecordBatch.from_arrays([binaries(fps[a]), binaries(fps[b])], names=["a", "b"])

    fps = distinct.select("fp")
    sizes = fps.mapInArrow(counted, "key bigint, rows bigint").groupBy("key").agg(F.sum("rows").alias("rows"))
    hot = stored(sizes.filter(F.col("rows") > PART).select("key", F.ceil(F.col("rows") / PART).alias("parts")), "hot-anchors")
    rows = fps.mapInArrow(spread, "key bigint, fp binary")
    if hot.isEmpty():
        rows = rows.withColumn("member", F.lit(True))
    else:
        cold = rows.join(hot, "key", "left_anti").withColumn("member", F.lit(True))
        rows = cold.unionByName(rows.join(hot, "key").select("key", "parts", "fp").mapInArrow(split, "key bigint, fp binary, member boolean"))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a binary, b binary")


# ---- documents -----------------------------------------------------------------------------------------------------


def components(fps: DataFrame, kind: Kind, cover: Cover | None = None) -> DataFrame:
    """(fp, group) of each different fingerprint fp; a group is named by its smallest fingerprint."""
    nodes = stored(fps.select("fp").distinct(), "nodes")
    found = connected_components(fingerprint_links(nodes, kind, cover)).withColumnsRenamed({"node": "fp", "component": "group"})
    return nodes.join(found, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group"))


def near_duplicates(docs: DataFrame, kind: Kind = Kind(), cover: Cover | None = None) -> DataFrame:
    """The component of each row of `docs` (doc_id, text): doc_id, fingerprint, component_id.

    component_id is the smallest doc_id that links reach. Null and empty texts
    have fingerprint zero and are linked like any other; very long texts count
    whole; rows that share a doc_id each keep their own row and links; a null
    doc_id never is a component_id unless its whole component has none. An empty
    table gives an empty one; other columns are ignored.
    """
    fps = stored(fingerprints(docs, kind), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = stored(components(fps, kind, cover).join(least, "fp"), "members")
    roots = member.groupBy("group").agg(F.min("least").alias("component_id"))
    known = member.join(roots, "group").select("fp", "component_id")
    return fps.join(known, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, kind: Kind = SIMILAR, cover: Cover | None = None) -> DataFrame:
    """One row of `docs` (doc_id, text, ...) for each component, with all its columns.

    It is the row with the smallest doc_id (null last), and of several such rows
    the one with the smallest fingerprint and hash of all columns. Rows that
    share a doc_id but not their text stand in components of their own; rows
    that are equal in every column count once. Null and empty texts are one
    component. An empty table stays empty.
    """
    keyed = docs.withColumn("__key", F.xxhash64(*docs.columns))
    fps = stored(fingerprints(keyed, kind, "__key"), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")
    first = fps.groupBy("fp").agg(F.min(rank).alias("first"))
    chosen = components(fps, kind, cover).join(first, "fp").groupBy("group").agg(F.min("first").alias("first")).select("first.doc_id", "first.__key")
    chosen = stored(chosen.distinct(), "chosen")
    same = [keyed["doc_id"].eqNullSafe(chosen["doc_id"]), keyed["__key"] == chosen["__key"]]
    again = fps.groupBy("doc_id", "__key").count().filter("count > 1").select("doc_id", "__key")
    kept = keyed.join(chosen, same, "left_semi")
    twice = stored(again, "repeats")
    if twice.isEmpty():
        return kept.drop("__key")
    repeated = [kept["doc_id"].eqNullSafe(twice["doc_id"]), kept["__key"] == twice["__key"]]
    once = kept.join(twice, repeated, "left_anti")
    return once.unionByName(kept.join(twice, repeated, "left_semi").dropDuplicates()).drop("__key")
