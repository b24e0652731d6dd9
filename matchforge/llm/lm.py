"""Scores of texts under a trigram model in Elias-Fano tries, learned from all training documents.

The corpus is cut into batches of a few megabytes, each with its own word table.
Three exchanges by key do the rest; everything that grows is dealt out, and only
a few totals come to the driver:

1. each batch sends its different words with their counts to vocabulary shards
   and gets back their ids and corpus counts;
2. it sends its different trigrams with their counts to the shard of the middle
   word, where all counts of the contexts that end in this word meet. A shard
   computes the smoothed probabilities, keeps them quantised in a memory-mapped
   Elias-Fano trie, and looks up every trigram asked for;
3. the answers go back to the batch, which sums them for each document.

A middle word that would fill a shard alone is split: its trigrams are dealt to
several shards by their outer words. Each trigram still has one shard, so what
the shards count of a pair adds up; they send these counts to one place for each
part of the pairs and get back the sums before they compute probabilities.

Smoothing is interpolated Kneser-Ney with one discount: trigram counts, then the
number of different words before a pair, then add-one unigrams over all tokens
and one unknown word.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm.common import remainder, slices, small_batches, stored, tidied
from matchforge.llm.eliasfano import Trie

FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.75
#: Ids that are no words.
UNKNOWN, START, END, FIRST = 0, 1, 2, 3
#: Bytes of text in a batch; words and trigrams that a shard gets about.
BATCH, SHARD_WORDS, SHARD_TRIGRAMS = 4_000_000, 400_000, 1_000_000
#: Places of a word in the training text beyond which the trigrams with it in the middle are split into as many parts.
PART = 1_000_000
#: Steps of a base-10 logarithm between shards and batches, finer than the trie's levels; below 10**-15 it is cut.
STEPS = 1024
LOCAL_BITS = 21


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, of one length, as compressed byte planes of the narrowest widths."""
    narrow = [a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(a) or int(a.max()) <= np.iinfo(t).max)) for a in arrays]
    planes = [a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in narrow]
    return bytes([len(narrow), *(a.itemsize for a in narrow)]) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    widths = list(blob[1 : blob[0] + 1])
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[blob[0] + 1 :]), np.uint8)
    n, at, out = len(raw) // sum(widths), 0, []
    for width in widths:
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(f"u{width}").ravel())
        at += n * width
    return out


def ascents(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs as differences: v from the one before, u from the one before with the same v."""
    dv, du = np.diff(v, prepend=0), np.diff(u, prepend=0)
    return dv, np.where((dv > 0) | (np.arange(len(v)) == 0), u, du)


def summed(dv: np.ndarray, du: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that `ascents` came from."""
    v, u = np.cumsum(dv, dtype=np.int64), np.cumsum(du, dtype=np.int64)
    starts = np.flatnonzero((dv > 0) | (np.arange(len(dv)) == 0))
    u -= np.repeat(u[starts] - du[starts].astype(np.int64), np.diff(np.r_[starts, len(dv)]))
    return v.astype(np.uint32 if v[-1] < 1 << 32 else np.int64), u.astype(np.uint32 if u.max() < 1 << 32 else np.int64)


def steps_of(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs * STEPS), 0, 15 * STEPS).astype(np.uint16)


def spread(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of 32 bits of two ids each."""
    a, b = (z.astype(np.uint64) * np.uint64(odd) for z, odd in ((x, 0x9E3779B97F4A7C15), (y, 0xC2B2AE3D27D4EB4F)))
    return ((a ^ b >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w, 5) for w in words), np.int64, len(words))


# ---- batches -------------------------------------------------------------------------------------------------------


def batch_columns(docs: list[tuple]) -> dict:
    """One batch of (doc_id, held out, words): its word table in the order of hashes, and the words' places in it."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    lengths = np.array([len(w) for _, _, w in docs], np.int32)
    held = np.array([bool(h) for _, h, _ in docs])
    places = np.fromiter(map(number.__getitem__, chain.from_iterable(w for _, _, w in docs)), np.int64, int(lengths.sum()))
    names = list(number)
    order = np.argsort(word_hashes(names), kind="stable")
    rank = np.empty(len(names), np.int32)
    rank[order] = np.arange(len(names))
    places = rank[places]
    counts = np.bincount(places[~np.repeat(held, lengths)], minlength=len(names)).astype(np.int64)
    return {
        "batch": uuid.uuid4().hex,
        "doc_ids": [i for i, _, _ in docs],
        "held": held.tobytes(),
        "lengths": pack(lengths),
        "places": pack(places),
        "words": zstandard.ZstdCompressor(level=3).compress(b" ".join(names[i] for i in order)),
        "counts": pack(counts),
        "n_words": len(names),
        "n_tokens": len(places) + len(docs),
        "n_trained": int((~held).sum()),
    }


BATCH_TYPES = pa.schema(
    [
        ("batch", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.binary()), ("lengths", pa.binary()), ("places", pa.binary()),
        ("words", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_trained", pa.int64()),
    ]
)
BATCH_SCHEMA = "batch string, doc_ids array<bigint>, held binary, lengths binary, places binary, words binary, counts binary, n_words bigint, n_tokens bigint, n_trained bigint"


def batched(docs: DataFrame) -> DataFrame:
    @tidied
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in (some for whole in parts for some in slices(whole)):
            for row in zip(part.column("doc_id").to_pylist(), part.column("held").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                text = row[2] or b""
                held.append((row[0], row[1], text.lower().split()))  # bytes: A-Z and ASCII white space only
                size += len(text)
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist([batch_columns(held)], schema=BATCH_TYPES)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([batch_columns(held)], schema=BATCH_TYPES)

    fold = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", fold.alias("held")).mapInArrow(run, BATCH_SCHEMA)


# ---- vocabulary ----------------------------------------------------------------------------------------------------


def word_list(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return raw.split(b" ") if raw else []


def vocabulary(batches: DataFrame, shards: int) -> DataFrame:
    """Ids and corpus counts for each batch and shard: shard, batch, ids, counts; and the shard's totals known, tokens on one of its rows."""

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                words = word_list(part.column("words")[k].as_py())
                (counts,) = unpack(part.column("counts")[k].as_py())
                ends = np.searchsorted(word_hashes(words) * shards >> 32, np.arange(shards + 1))  # shards are ranges of hashes
                rows = []
                for s in np.flatnonzero(np.diff(ends)).tolist():
                    i, j = ends[s], ends[s + 1]
                    rows.append({"shard": s, "batch": part.column("batch")[k].as_py(), "words": b" ".join(words[i:j]), "counts": pack(counts[i:j])})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("batch", pa.string()), ("words", pa.binary()), ("counts", pa.binary())]))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        lists = [np.fromiter(map(number.__getitem__, w.split(b" ")), np.int64) for w in rows["words"]]
        total = np.zeros(len(number), np.int64)
        for at, blob in zip(lists, rows["counts"], strict=True):
            total[at] += unpack(blob)[0].astype(np.int64)  # a batch names a word once
        order = np.argsort(-total, kind="stable")
        ids = np.zeros(len(number), np.int64)
        ids[order] = np.arange(len(number)) * shards + int(rows["shard"].iloc[0]) + FIRST  # commoner words get smaller ids
        ids[total == 0] = UNKNOWN
        out = pd.DataFrame({"shard": rows["shard"].to_numpy(), "batch": rows["batch"].to_numpy(), "ids": [pack(ids[at]) for at in lists], "counts": [pack(total[at]) for at in lists]})
        first = np.arange(len(out)) == 0
        return out.assign(known=np.where(first, int((total > 0).sum()), 0), tokens=np.where(first, int(total.sum()), 0))

    dealt = batches.select("batch", "words", "counts").mapInArrow(deal, "shard int, batch string, words binary, counts binary")
    return dealt.groupBy("shard").applyInPandas(count, "shard int, batch string, ids binary, counts binary, known bigint, tokens bigint")


# ---- trigrams ------------------------------------------------------------------------------------------------------


class Numbered:
    """A batch with corpus ids: its tokens, sums of the base score, and its different trigrams in the order of ids."""

    def __init__(self, row: dict, trigram_shards: int, tokens: int, known: int, trained: int, part: int):
        answers = sorted(row["answers"] or [], key=lambda a: a["shard"])  # shards are ranges of the word table
        ids = np.concatenate([np.zeros(0, np.int64), *(unpack(a["ids"])[0] for a in answers)]).astype(np.int64)
        counts = np.concatenate([np.zeros(0, np.int64), *(unpack(a["counts"])[0] for a in answers)]).astype(np.int64)
        self.ids, place = np.unique(np.r_[UNKNOWN, START, END, ids], return_inverse=True)
        count = np.zeros(len(self.ids), np.int64)
        count[place[3:]] = counts
        count[START] = count[END] = trained
        self.unigram = np.log10((count + 1) / (tokens + known + 1))
        (lengths,) = unpack(row["lengths"])
        (places,) = unpack(row["places"])
        held = np.frombuffer(row["held"], bool)
        self.lengths = lengths.astype(np.int64) + 1  # with the end
        first = np.r_[0, np.cumsum(self.lengths + 1)[:-1]]  # with the start
        line = np.zeros(int((self.lengths + 1).sum()), np.int64)
        inner = np.ones(len(line), bool)
        inner[first] = False
        inner[first + self.lengths] = False
        line[inner] = place[3:][places]
        line[first], line[first + self.lengths] = START, END
        at = np.flatnonzero(line != START)
        w, v = line[at], line[at - 1]
        u = np.where(v == START, START, line[at - 2])
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.base = np.add.reduceat(self.unigram[w], self.starts)
        self.n_known = np.add.reduceat((count[w] > 0).astype(np.int64), self.starts)
        if len(self.ids) < 1 << LOCAL_BITS:
            different, self.inverse = np.unique(v << 2 * LOCAL_BITS | u << LOCAL_BITS | w, return_inverse=True)
            mask = (1 << LOCAL_BITS) - 1
            self.v, self.u, self.w = different >> 2 * LOCAL_BITS, different >> LOCAL_BITS & mask, different & mask
        else:
            different, self.inverse = np.unique(np.stack([v, u, w], axis=1), axis=0, return_inverse=True)
            self.inverse = self.inverse.ravel()
            self.v, self.u, self.w = different.T
        self.counts = np.bincount(self.inverse, weights=~np.repeat(held, self.lengths), minlength=len(self.v)).astype(np.int64)
        self.parts = np.maximum(-(-count // part), 1)[self.v]
        shard = spread(self.ids[self.v], spread(self.ids[self.u], self.ids[self.w]) % self.parts) % trigram_shards
        shard[self.v == UNKNOWN] = trigram_shards  # nothing to ask for: no context
        self.order = np.argsort(shard, kind="stable")
        self.ends = np.searchsorted(shard[self.order], np.arange(trigram_shards + 1))

    def requests(self) -> Iterator[tuple[int, bool, bytes]]:
        for s in np.flatnonzero(np.diff(self.ends)).tolist():  # the shards that it has trigrams for, however many there are
            at = self.order[self.ends[s] : self.ends[s + 1]]
            columns = (*ascents(self.ids[self.v[at]], self.ids[self.u[at]]), self.ids[self.w[at]], self.counts[at], steps_of(self.unigram[self.w[at]]), self.parts[at])
            yield s, bool((self.parts[at] > 1).any()), pack(*columns)

    def scores(self, answers: list[dict]) -> np.ndarray:
        """The score of each document from the shards' answers."""
        logs = self.unigram[self.w].copy()
        for a in answers or []:
            logs[self.order[self.ends[a["shard"]] : self.ends[a["shard"] + 1]]] = unpack(a["logs"])[0] / -STEPS
        return np.add.reduceat(logs[self.inverse], self.starts)


def run_starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def sorted_by(bits: int, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rows by their columns (all but the first below 2**bits), and where a new row begins in it."""
    first = int(columns[0].max()) if len(columns[0]) else 0
    if first.bit_length() + bits * (len(columns) - 1) <= 63:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key << bits | c.astype(np.int64)
        order = np.argsort(key)
        key = key[order]
        return order, np.r_[True, key[1:] != key[:-1]][: len(key)]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, new


class Trigrams:
    """The different ones of the trigrams asked of a shard, sorted by v, u and w, with the sums of their counts.

    `requests` are the packed ones of batches; v is a place in `names`, whose
    words are split into `parts`. `inverse` leads back to what was asked.
    """

    def __init__(self, requests: Iterable[bytes], split_only: bool = False):
        asked = [(*summed(*r[:2]), *r[2:]) for r in map(unpack, requests)]
        if split_only:
            asked = [[x[a[5] > 1] for x in a] for a in asked]
        self.sizes = [len(a[0]) for a in asked]
        v, u, w, counts, unigram, parts = (np.concatenate(x) for x in zip(*asked, strict=True))
        del asked
        self.names, v = np.unique(v, return_inverse=True)
        self.parts = np.ones(len(self.names), np.int64)
        self.parts[v] = parts
        v = v.astype(np.uint32)
        self.bits = int(max(u.max(), w.max())).bit_length()
        order, new = sorted_by(self.bits, v, u, w)
        at = order[new]
        self.inverse = np.empty(len(order), np.uint32)
        self.inverse[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        del order, new
        self.v, self.u, self.w = (x[at].astype(np.uint32 if self.bits <= 32 else np.int64) for x in (v, u, w))
        self.one = unigram[at].astype(np.float32) / np.float32(-STEPS)
        self.counts = np.bincount(self.inverse, weights=counts, minlength=len(at))
        # pairs (v, w): where each one's first trigram is, the pair of each trigram, and in how many trigrams it was seen
        order, new = sorted_by(self.bits, self.v, self.w)
        self.vw, self.vw_of = order[new], np.empty(len(order), np.uint32)
        self.vw_of[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        del order, new
        self.before = np.bincount(self.vw_of, weights=self.counts > 0, minlength=len(self.vw))
        # pairs (u, v) alike: sums of counts, and by how many different words they were followed
        new = np.r_[True, (self.v[1:] != self.v[:-1]) | (self.u[1:] != self.u[:-1])]
        self.vu, self.vu_of = np.flatnonzero(new), np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        self.total = np.bincount(self.vu_of, weights=self.counts)
        self.after = np.bincount(self.vu_of, weights=self.counts > 0)
        # words v: trigrams seen with it, and different words that followed it
        self.all_v = np.bincount(self.v[self.vw], weights=self.before)
        self.n_v = np.bincount(self.v[self.vw], weights=self.before > 0)

    def split(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Place of each split word, part of its pairs, and the pairs (v, w) and (u, v) in that part, the outer words in their order."""
        first = np.r_[0, np.cumsum(np.where(self.parts > 1, self.parts, 0))]
        found = []
        for heads, outer in ((self.vw, self.w), (self.vu, self.u)):
            at = np.flatnonzero(self.parts[self.v[heads]] > 1)
            v, outer = self.v[heads[at]], outer[heads[at]]
            slot = first[v] + spread(outer, np.zeros_like(outer)) % self.parts[v]
            order = np.argsort(slot, kind="stable")
            found.append(np.split(at[order], np.searchsorted(slot[order], np.arange(1, first[-1]))))
        for v in np.flatnonzero(self.parts > 1).tolist():
            for part in range(int(self.parts[v])):
                yield v, part, found[0][first[v] + part], found[1][first[v] + part]

    def corrected(self, sums: dict[tuple[int, int], tuple]) -> None:
        """Put the sums over all shards of split words' pairs, by word and part, for this shard's own counts."""
        for v, part, vw, vu in self.split():
            if part == 0:
                self.all_v[v] = self.n_v[v] = 0
            all_v, n_v, before, both = sums[int(self.names[v]), part]
            self.all_v[v] += all_v
            self.n_v[v] += n_v
            (self.before[vw],), (self.total[vu], self.after[vu]) = unpack(before), unpack(both)

    def trie(self) -> Trie | None:
        """The trie of what was seen, with all pairs of split words that were asked for; none if there is nothing."""
        p2 = np.zeros(len(self.vw))
        known, v = self.before > 0, self.v[self.vw]
        weight_v = DISCOUNT * self.n_v / np.maximum(self.all_v, 1)
        p2[known] = (self.before[known] - DISCOUNT) / self.all_v[v[known]] + weight_v[v[known]] * 10.0 ** self.one[self.vw[known]]
        weight_u = DISCOUNT * self.after / np.maximum(self.total, 1)
        seen = np.flatnonzero(self.counts > 0)
        pair = self.vu_of[seen]
        p3 = (self.counts[seen] - DISCOUNT) / self.total[pair] + weight_u[pair] * p2[self.vw_of[seen]]
        contexts, extensions = np.flatnonzero(self.all_v > 0), np.flatnonzero(self.total > 0)
        if not len(contexts):
            return None
        logs = np.log10(np.r_[p2[known], p3]).astype(np.float32)
        del p2, p3, pair
        vw, vu = self.vw[known], self.vu[extensions]
        heads, _ = sorted_by(self.bits, np.r_[contexts, self.v[vu]], np.r_[np.zeros_like(contexts), self.u[vu]])
        backoff = np.log10(np.r_[weight_v[contexts], weight_u[extensions]])[heads]
        # lists of split words may have no word in this shard: the unknown word, which is never looked up, stands in all of them
        held_v, held_u = contexts[self.parts[contexts] > 1].astype(np.uint32), vu[self.parts[self.v[vu]] > 1]
        none = np.zeros(len(held_v) + len(held_u), self.u.dtype)
        tv = np.r_[self.v[vw], self.v[seen], held_v, self.v[held_u]]
        tu = np.r_[np.zeros(len(vw), self.u.dtype), self.u[seen], none[: len(held_v)], self.u[held_u]]
        tw = np.r_[self.w[vw], self.w[seen], none]
        logs = np.r_[logs, np.resize(logs, len(none))]  # levels are of what is there
        order, _ = sorted_by(self.bits, tv, tu, tw)
        return Trie(tv[order], tu[order], tw[order], logs[order], backoff).mapped()

    def answers(self) -> list[np.ndarray]:
        """Steps of the smoothed probability of each trigram asked for, by request."""
        logs = self.one.copy()
        trie = self.trie()
        if trie is not None:
            looked_up(trie, self.v, self.u, self.w, self.one, logs)
        return np.split(steps_of(logs)[self.inverse], np.cumsum(self.sizes)[:-1])


PAIRS = "v bigint, part int, deal int, before binary, both binary"
SUMS = "deal int, v bigint, part int, all_v bigint, n_v bigint, before binary, both binary"


def pair_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """What one shard counted of the pairs of its split words, a row for each word and part, also where there are none."""
    out: dict[str, list] = {k: [] for k in ("v", "part", "deal", "before", "both")}
    requests = rows["request"][rows["split"]]
    if len(requests):
        t = Trigrams(requests, split_only=True)
        for v, part, vw, vu in t.split():
            w, u = t.w[t.vw[vw]].astype(np.int64), t.u[t.vu[vu]].astype(np.int64)
            before, both = pack(np.diff(w, prepend=0), t.before[vw]), pack(np.diff(u, prepend=0), t.total[vu], t.after[vu])
            for k, value in zip(out, (int(t.names[v]), part, int(rows["deal"].iloc[0]), before, both), strict=True):
                out[k].append(value)
    return pd.DataFrame(out)


def pair_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the shards of one part of a split word's pairs, sent back to each in the order of its own pairs."""

    def added(blobs: pd.Series) -> tuple[list[np.ndarray], list[bytes]]:
        parts = [unpack(b) for b in blobs]
        ends = np.cumsum([len(p[0]) for p in parts])[:-1]
        _, place = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.int64) for p in parts]), return_inverse=True)
        sums = [np.bincount(place, weights=np.concatenate(c)).astype(np.int64) for c in list(zip(*parts, strict=True))[1:]]
        return sums, [pack(*x) for x in zip(*(np.split(s[place], ends) for s in sums), strict=True)]

    (before,), befores = added(rows["before"])
    _, both = added(rows["both"])
    return pd.DataFrame({"deal": rows["deal"], "v": rows["v"], "part": rows["part"], "all_v": int(before.sum()), "n_v": int((before > 0).sum()), "before": befores, "both": both})


def answered(rows: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    """One shard's answers to its batches."""
    t = Trigrams(rows["request"])
    t.corrected({(v, part): rest for v, part, *rest in zip(*(sums[c].tolist() for c in ("v", "part", "all_v", "n_v", "before", "both")), strict=True)})
    return pd.DataFrame({"batch": rows["batch"].to_numpy(), "shard": rows["deal"].to_numpy(), "logs": [pack(x) for x in t.answers()]})


def looked_up(trie: Trie, v: np.ndarray, u: np.ndarray, w: np.ndarray, one: np.ndarray, logs: np.ndarray) -> None:
    """Write the probabilities of sorted trigrams into `logs`: successors of v, then u, then w, each in the list of its context."""
    v, u, w = (x.astype(np.int64) for x in (v, u, w))
    starts = run_starts(v)
    context_at, has_context = trie.context(v[starts])
    sizes = np.diff(np.r_[starts, len(v)])
    context_at, has_context = np.repeat(context_at, sizes), np.repeat(has_context, sizes)
    own_u = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])])
    extension, found = np.zeros(len(own_u), np.int64), has_context[own_u] & (u[own_u] != UNKNOWN)
    hits = np.flatnonzero(found)
    extension[hits], found[hits] = trie.extension(context_at[own_u[hits]], u[own_u[hits]])
    sizes = np.diff(np.r_[own_u, len(v)])
    off = np.zeros(len(own_u))
    off[found] = trie.weight.logs(trie.weights[extension[found]])
    extension, found, off = np.repeat(extension, sizes), np.repeat(found, sizes), np.repeat(off, sizes)
    hits = np.flatnonzero(found)
    at, there = trie.word(extension[hits], w[hits])
    there &= w[hits] != UNKNOWN
    logs[hits[there]] = trie.probability.logs(trie.codes[at[there]])
    done = np.zeros(len(v), bool)
    done[hits[there]] = True
    rest = np.flatnonzero(has_context & ~done)  # shorter context: the list without extension comes first
    if len(rest):
        general, _ = trie.extension(context_at[rest], np.zeros(len(rest), np.int64))
        at, there = trie.word(general, w[rest])
        there &= w[rest] != UNKNOWN
        logs[rest] = off[rest] + trie.weight.logs(trie.weights[general]) + one[rest]
        logs[rest[there]] = off[rest[there]] + trie.probability.logs(trie.codes[at[there]])


def text_scores(docs: DataFrame, part: int = PART) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of `docs` (doc_id, text).

    A null text counts as empty: the end is its only token. Texts count whole,
    repeated rows count as often as they are there, a null doc_id isn't held out;
    without training documents every score is 0; an empty table gives an empty
    one; other columns are ignored. Words with more than `part` places in the
    training text are split, which changes scores by the rounding of levels only.
    """
    batches = stored(batched(small_batches(docs)), "batches")
    sums = batches.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_trained")).first()
    shards = max(1, math.ceil((sums[0] or 0) / SHARD_WORDS))
    deals = max(1, math.ceil((sums[1] or 0) / SHARD_TRIGRAMS))
    trained = int(sums[2] or 0)
    words = stored(vocabulary(batches, shards), "vocabulary")
    totals = words.agg(F.sum("known"), F.sum("tokens")).first()
    known, tokens = int(totals[0] or 0) + (trained > 0), int(totals[1] or 0) + trained
    answers = words.groupBy("batch").agg(F.collect_list(F.struct("shard", "ids", "counts")).alias("answers"))
    with_ids = batches.select("batch", "doc_ids", "held", "lengths", "places").join(answers, "batch", "left")

    def numbered(row: dict) -> Numbered:
        return Numbered(row, deals, tokens, known, trained, part)

    @tidied
    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("deal", pa.int32()), ("batch", pa.string()), ("split", pa.bool_()), ("request", pa.binary())])
        for part in parts:
            for k in range(part.num_rows):
                (row,) = part.slice(k, 1).to_pylist()
                yield pa.RecordBatch.from_pylist([{"deal": s, "batch": row["batch"], "split": p, "request": r} for s, p, r in numbered(row).requests()], schema=types)

    asked = with_ids.mapInArrow(ask, "deal int, batch string, split boolean, request binary").groupBy("deal")
    # both uses of what was asked read the same exchange
    sums = asked.applyInPandas(pair_counts, PAIRS).groupBy("v", "part").applyInPandas(pair_sums, SUMS)
    replies = asked.cogroup(sums.groupBy("deal")).applyInPandas(answered, "batch string, shard int, logs binary")
    back = replies.groupBy("batch").agg(F.collect_list(F.struct("shard", "logs")).alias("replies"))

    @tidied
    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                (row,) = part.slice(k, 1).to_pylist()
                own = numbered(row)
                n = len(own.lengths)
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(np.frombuffer(row["held"], bool)), pa.array(own.lengths), pa.array(own.n_known), pa.array(np.full(n, tokens, np.int64)), pa.array(own.base), pa.array(own.scores(row["replies"]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return with_ids.join(back, "batch", "left").mapInArrow(finish, schema)
