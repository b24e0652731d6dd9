"""Hashed word n-gram features of texts, and logistic models over them trained by FTRL-proximal updates."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm.common import remembers, slices, small_batches, stored, tidied

#: Weights of a model: a proven bound of what is sent to every task (1 MB for one class).
BITS = 18
#: Labelled rows from which a model is fitted at most, and the parts in which they are trained side by side.
SAMPLE, SHARDS = 8_000, 4
EPOCHS = 3
#: FTRL-proximal: learning rate, its smoothing, and the weights of the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 0.05, 0.002, 0.1
#: Different words that each of a worker's two generations of memory holds at most; a full young one becomes the old one.
MEMORY = 75_000

RUNS = ((re.compile(r"[a-zß-öø-ÿ]+"), "x"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[0-9]+"), "9"))
#: The same for ASCII words in one go: each byte's sign, then runs of a sign.
SIGNS = bytes(ord("x") if 97 <= c <= 122 else ord("X") if 65 <= c <= 90 else ord("9") if 48 <= c <= 57 else c for c in range(256))
REPEATS = re.compile(rb"([xX9])\1+")
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


@functools.lru_cache(4_096)
def shape_hash(signs: bytes) -> int:
    """Hash of the shape of a word whose bytes are signs already."""
    return xxhash.xxh32_intdigest(REPEATS.sub(rb"\1", signs)[:8], 2) & 0xFFFFFF


class Words(dict):
    """Word in UTF-8 to 64 bits: 40 of the whole word's hash over 24 of its shape's.

    A shape has letter and digit runs as one sign each; it is a feature of how a
    word begins, the first eight such signs of its first 64 bytes.
    """

    def __init__(self):
        self.old: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        if len(word) > 64:  # not worth remembering; bounds the memory in bytes
            return self.hashed(word)
        if word in self.old:
            found = self[word] = self.old[word]
            return found
        found = self[word] = self.hashed(word)
        return found

    def forget(self) -> None:
        self.clear()
        self.old.clear()

    @staticmethod
    def hashed(word: bytes) -> int:
        begin = word[:64]
        if begin.isascii():
            return xxhash.xxh64_intdigest(word, 1) >> 24 << 24 | shape_hash(begin.translate(SIGNS))
        shape = begin.decode("utf-8", "replace")
        for run, sign in RUNS:
            shape = run.sub(sign, shape)
        return xxhash.xxh64_intdigest(word, 1) >> 24 << 24 | xxhash.xxh32_intdigest(shape[:8].encode(), 2) & 0xFFFFFF


_WORDS = Words()


def features(text: bytes | None, pairs: bool = True) -> np.ndarray:
    """Places of the text's features, repeats included: words, word pairs, shapes, shape pairs (one place for a pair of equal words); place 0 is the constant. Without `pairs` single words and shapes only."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.uint32)
    both = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    word, shape = both >> np.uint64(24), both & np.uint64(0xFFFFFF)
    with np.errstate(over="ignore"):
        parts = [word * MIX[0], (shape + np.uint64(1)) * MIX[3]]
        if pairs:
            parts += [
                (word[:-1] * MIX[1] + word[1:]) * MIX[2],
                np.where(word[:-1] == word[1:], MIX[0], ((shape[:-1] + np.uint64(7)) * MIX[2] + shape[1:]) * MIX[1]),
            ]
    return ((np.concatenate(parts) >> np.uint64(64 - BITS)) | np.uint64(1)).astype(np.uint32)


def weighed(text: bytes | None, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The sparse vector of a text: places and values; values shrink with the root of the length."""
    found = features(text, pairs)
    places, counts = np.unique(found, return_counts=True)
    return np.r_[0, places.astype(np.int64)], np.r_[1.0, counts / np.sqrt(max(len(found), 1))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], marks: np.ndarray) -> np.ndarray:
    """Weights after `EPOCHS` passes over the vectors in their order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for (at, x), y in zip(vectors, marks, strict=True):
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (sigmoid(w @ x) - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    return weights(z, n)


def fit(docs: DataFrame, marks: DataFrame, sample: int = SAMPLE, pairs: bool = True) -> dict[str, np.ndarray]:
    """A model for each class of `marks` (doc_id, class string, mark double) from the texts of `docs`.

    At most `sample` labelled documents, chosen by the hash of their ids, are
    dealt to `SHARDS` tasks; each trains on its part, and the weights of the
    parts are averaged by Spark. What comes to the driver is bounded by 2**BITS
    weights a class. A labelled id that repeats in `docs` counts once, with its
    smallest text. No labelled text gives no models.
    """
    small_batches(docs)
    ids = marks.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = marks.join(F.broadcast(ids), "doc_id")  # at most `sample` ids
    chosen = docs.select("doc_id", "text").join(F.broadcast(rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("class", "mark"))).alias("marks"))), "doc_id")

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "doc_id", "text"], na_position="first")
        vectors = [weighed(t.encode() if t else b"", pairs) for t in part["text"]]
        out = []
        for name in sorted({k for m in part["marks"] for k, _ in entries(m)}):
            w = ftrl(vectors, np.array([dict(entries(m)).get(name, 0.0) for m in part["marks"]]))
            at = np.r_[0, 1 + np.flatnonzero(w[1:])]
            out.append(pd.DataFrame({"class": name, "place": at, "weight": w[at]}))
        return pd.concat(out)  # each row has marks, so there is a class

    def entries(m) -> list:
        return list(m.items()) if isinstance(m, dict) else list(m)

    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("marks").alias("marks"))
    dealt = chosen.withColumn("order", F.xxhash64("doc_id")).groupBy(F.pmod("order", F.lit(SHARDS)).alias("shard"))
    # Place 0 with weight 0 stands for a shard that had texts: weights are averaged over these.
    got = stored(dealt.applyInPandas(train, "class string, place int, weight double"), "weights")
    trained = got.filter("place = 0").groupBy("class").agg(F.count("*").alias("shards"))
    means = got.join(F.broadcast(trained), "class").groupBy("class", "place", "shards").agg(F.sum("weight").alias("weight"))  # at most one row a class
    means = means.select("class", "place", (F.col("weight") / F.col("shards")).cast("float").alias("weight")).toArrow()
    models: dict[str, np.ndarray] = {}
    names = means.column("class").combine_chunks().dictionary_encode()
    of, places, weights = names.indices.to_numpy(), means.column("place").to_numpy(), means.column("weight").to_numpy()
    for k, name in enumerate(names.dictionary.to_pylist()):
        models[name] = np.zeros(1 << BITS, np.float32)
        models[name][places[of == k]] = weights[of == k]
    return models


def scorer(models: dict[str, np.ndarray], pairs: bool = True):
    """A column function: text to struct<n_words bigint, scores array<double>>, the models' probabilities in the order of their names.

    Without models the one score is 0.5.
    """
    names = sorted(models)
    table = np.stack([models[n] for n in names], axis=1) if names else np.zeros((1 << BITS, 1), np.float32)
    per_word = 4 if pairs else 2

    @F.arrow_udf("struct<n_words: bigint, scores: array<double>>")
    @tidied
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        remembers("ngrams", _WORDS.forget)
        for texts in batches:
            found = np.empty((len(texts), table.shape[1]))
            words = np.empty(len(texts), np.int64)
            for i, text in enumerate(t for part in slices(texts) for t in part.cast(pa.binary()).to_pylist()):
                at = features(text, pairs)
                words[i] = -(-len(at) // per_word)  # n words give n or n - 1 places of each sort
                found[i] = table[at].sum(axis=0, dtype=np.float64) / np.sqrt(max(len(at), 1)) + table[0]
            flat = pa.array(sigmoid(found).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * table.shape[1], pa.int32()), flat)
            yield pa.StructArray.from_arrays([pa.array(words), lists], names=["n_words", "scores"])

    return score
