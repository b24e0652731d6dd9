"""Quality rules by line labelling: a linear-chain conditional random field marks each line as content or boilerplate.

Line labels vary within a document, and so do those that the field learns from.
Labelled documents are cut into runs of lines, and runs of good and of bad ones
are put together in turn: composites with real changes of label. Their labels are the
documents', but for lines that rules know (repeated lines, menus, notices of
rights), which are boilerplate in any document. Viterbi decoding gives the
likeliest labels of all lines of a text at once; a text is kept if enough of its
words stand in content lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import cycle, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm.common import slices, small_batches, tidied

#: Labelled documents from which the field is trained at most, and the parts in which they are trained side by side.
SAMPLE, SHARDS = 4_000, 4
STEPS, RATE, PENALTY = 120, 0.2, 1e-4
#: Lines in a run of a composite at most.
RUN = 12
#: A text is kept if at least this share of its words stands in content lines.
KEPT_SHARE = 0.5
MIN_WORDS = 50
BASE_SYMBOLS = b"#*$%&|<>"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
UPPER, DIGIT, LETTER = bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(97, 123))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-")
#: Signs between the entries of a menu, and phrases of notices (fixed values).
BARS = re.compile(rb"\s(?:\||>|/|-|\xc2\xb7|\xe2\x80\xa2|\xc2\xbb|\xe2\x80\xba)\s")
NOTICE = re.compile(
    rb"\(c\)|\xc2\xa9|copyright|rights? reserved|licen[sc]ed? (?:under|by)|terms of (?:use|service)|privacy policy|cookies?\b|sign (?:in|up)|log ?in\b|subscribe|click here|all rights",
    re.IGNORECASE,
)
FEATURES = 18


def line_features(line: bytes, words: list[bytes], again: bool) -> tuple:
    """What the field sees of a line: shares between 0 and 1."""
    size = len(line)
    n = len(words)
    different = set(words)
    twice = sum(map(bytes.__eq__, words, words[1:]))
    marks = size - len(line.translate(None, MARKS))
    upper = size - len(line.translate(None, UPPER))
    digits = size - len(line.translate(None, DIGIT))
    lower = size - len(line.translate(None, LETTER))
    return (
        1.0,
        min(n, 10) / 10,
        min(n, 100) / 100,
        len(different) / n,
        twice / n,
        min(1.0, marks / n),
        marks / size,
        upper / size,
        float(upper > lower),
        min(1.0, 4 * digits / size),
        float(line.rstrip()[-1:] in b".!?"),
        float(again),
        float(n <= 3),
        min(1.0, len(BARS.findall(line)) / 3),
        float(NOTICE.search(line) is not None),
        float(line.rstrip()[-1:] not in b".!?,;:\"'"),
        min(1.0, marks / 3),
        min(1.0, max(map(len, words)) / 40),
    )


def boilerplate_by_rule(features: tuple) -> bool:
    """Lines that are boilerplate whatever document they stand in: repeated lines, menus, short notices of rights."""
    again, menu, notice, words = features[11] > 0, features[13] > 0.5, features[14] > 0, features[2] * 100
    return again or menu or notice and words <= 20


def lines_of(text: bytes) -> tuple[list[tuple], list[int], int]:
    """Features and word counts of the lines that have words, and how many of them equal an earlier line."""
    seen: set[bytes] = set()
    found, sizes, dup = [], [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        again = line in seen
        dup += again
        seen.add(line)
        found.append(line_features(line, words, again))
        sizes.append(len(words))
    return found, sizes, dup


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair, pairs = ids[:-1] * len(number) + ids[1:], None
    if len(number) < 1_000_000:
        windows = pair[:-1] * len(number) + ids[2:]
    else:  # keep the products within 64 bits
        _, pairs = np.unique(pair, return_inverse=True)
        windows = pairs[:-1] * len(number) + ids[2:]
    _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
    often = counts[at] > 1
    marked = np.zeros(n, bool)
    for shift in range(3):
        marked[shift : shift + len(often)] |= often
    return int(marked.sum())


@dataclass
class Field:
    """Weights: lines (features x 2), steps (2 x 2) and starts (2); label 1 is content."""

    lines: np.ndarray
    steps: np.ndarray
    starts: np.ndarray

    @classmethod
    def zero(cls) -> Field:
        return cls(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.lines.ravel(), self.steps.ravel(), self.starts])

    @classmethod
    def of(cls, flat: np.ndarray) -> Field:
        k = 2 * FEATURES
        return cls(flat[:k].reshape(FEATURES, 2), flat[k : k + 4].reshape(2, 2), flat[k + 4 :])


def ordered(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by falling length, so that those with a line t stand first, and the first line of each."""
    order = np.argsort(-lengths, kind="stable")
    return order, np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)[order]


def viterbi(field: Field, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The likeliest labels of all lines of many texts, line t of all texts at once; ties go to content."""
    labels = np.ones(len(x), np.int8)
    order, first = ordered(lengths)
    long = lengths[order]
    active = int((long > 0).sum())
    if not active:
        return labels
    own = x @ field.lines
    best = own[first[:active]] + field.starts
    came = np.zeros((len(x), 2), np.int8)
    last = [None] * int(long[0])
    for t in range(1, int(long[0])):
        more = int(np.searchsorted(-long, -t, "left"))
        last[t - 1] = (more, best[more:])
        ways = best[:more, :, None] + field.steps
        came[first[:more] + t] = from_ = (ways[:, 1] >= ways[:, 0]).astype(np.int8)
        best = np.where(from_ == 1, ways[:, 1], ways[:, 0]) + own[first[:more] + t]
    last[int(long[0]) - 1] = (0, best)
    now = np.zeros(0, np.int8)
    for t in range(int(long[0]) - 1, -1, -1):
        ended = last[t][1]
        if t + 1 < int(long[0]):
            now = came[first[: len(now)] + t + 1, now]
        now = np.concatenate([now, (ended[:, 1] >= ended[:, 0]).astype(np.int8)])
        labels[first[: len(now)] + t] = now
    return labels


def sums(field: Field, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithms of the forward and backward sums of each line and label, and of the whole of each line's text."""
    order, first = ordered(lengths)
    long = lengths[order]
    own = x @ field.lines
    forward, backward = np.zeros_like(own), np.zeros_like(own)
    top = int(long[0])
    alive = [int(np.searchsorted(-long, -t, "left")) for t in range(top)]
    forward[first[: alive[0]]] = own[first[: alive[0]]] + field.starts
    for t in range(1, top):
        at = first[: alive[t]] + t
        forward[at] = np.logaddexp(forward[at - 1, :1] + field.steps[0], forward[at - 1, 1:] + field.steps[1]) + own[at]
    for t in range(top - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        after = backward[at + 1] + own[at + 1]
        backward[at] = np.logaddexp(after[:, :1] + field.steps[:, 0], after[:, 1:] + field.steps[:, 1])
    both = forward + backward
    return forward, backward, np.logaddexp(both[:, 0], both[:, 1])


def gradient(field: Field, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mean gradient of the log likelihood over lines, by forward and backward sums."""
    forward, backward, total = sums(field, x, lengths)
    own = x @ field.lines
    starting = np.r_[0, np.cumsum(lengths)[:-1]][lengths > 0]
    wrong = np.eye(2)[y] - np.exp(forward + backward - total[:, None])
    later = np.ones(len(x), bool)
    later[starting] = False
    at = np.flatnonzero(later)
    pair = np.exp(forward[at - 1][:, :, None] + field.steps + (own[at] + backward[at])[:, None, :] - total[at][:, None, None])
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[at - 1], y[at]), 1)
    return np.concatenate([(x.T @ wrong).ravel(), (pairs - pair.sum(axis=0)).ravel(), wrong[starting].sum(axis=0)]) / len(x)


def trained(x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> Field:
    """Adam steps on the whole part."""
    w = Field.zero().flat()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, STEPS + 1):
        g = gradient(Field.of(w), x, y, lengths) - PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field.of(w)


def composites(docs: list[tuple[np.ndarray, np.ndarray, bool]], seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of lines of good and bad documents put together by turns of chance: features, labels, lengths.

    Every line of the commoner sort is used once; the rarer sort is gone through
    as often as needed. Documents of one sort only stay in sequences of their own.
    """
    chance = np.random.default_rng(seed)
    runs: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
    for x, y, good in docs:
        at = 0
        while at < len(x):
            n = int(chance.integers(1, RUN + 1))
            runs[good].append((x[at : at + n], y[at : at + n]))
            at += n
    most = max(map(len, runs.values()))
    left = {sort: list(islice(cycle(own), most)) if own else [] for sort, own in runs.items()}
    found, lengths = [], []
    while any(left.values()):
        size = 0
        for _ in range(int(chance.integers(1, 5))):
            sort = bool(chance.integers(0, 2))
            sort = sort if left[sort] else not sort
            if left[sort]:
                found.append(left[sort].pop())
                size += len(found[-1][0])
        lengths.append(size)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), np.array(lengths)


def learned(docs: list[tuple[list[tuple], bool]]) -> Field:
    """The field of labelled documents (features of their lines, is good)."""
    parts = [(np.array(rows), good) for rows, good in docs]
    rule = [np.array([boilerplate_by_rule(r) for r in rows]) for rows, _ in docs]
    marks = [np.where(r, 0, int(good)) for r, (_, good) in zip(rule, parts, strict=True)]
    return trained(*composites([(x, y, good) for (x, good), y in zip(parts, marks, strict=True)]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Train on at most `sample` labelled documents, dealt to `SHARDS` tasks; Spark averages their weights.

    A labelled id that repeats in `docs` counts once, with its smallest text.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most `sample` ids
    dealt = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good"))
    dealt = small_batches(dealt).withColumn("order", F.xxhash64("doc_id"))

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "doc_id"])
        own = [(lines_of((text or "").encode())[0], bool(good)) for text, good in zip(part["text"], part["good"], strict=True)]
        own = [(rows, good) for rows, good in own if rows]
        if not own:
            return pd.DataFrame({"place": [], "weight": []})
        w = learned(own).flat()
        return pd.DataFrame({"place": np.arange(len(w)), "weight": w})

    got = dealt.groupBy(F.pmod("order", F.lit(SHARDS)).alias("shard")).applyInPandas(train, "place int, weight double")
    means = got.groupBy("place").agg(F.avg("weight").alias("weight")).toPandas()
    if not len(means):
        field = Field.zero()
        field.lines[0, 1] = 1.0  # nothing learned: all is content
        return field
    return Field.of(means.sort_values("place")["weight"].to_numpy())


def line_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Word and line counts of each row of `docs` (doc_id, text), and whether the field keeps it.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, then content_words: words in content lines. A null text
    counts as empty: no words, so base_failed. Texts count whole; repeated rows
    repeat; an empty table gives an empty one; without labels all lines are
    content; other columns are ignored.
    """
    field = fit(docs, labels)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            counts, rows, sizes, lengths = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                text = text or b""
                words = text.split()
                found, own, dup = lines_of(text)
                rows += found
                sizes += own
                lengths.append(len(own))
                points = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, SPACE_BYTES)))
                counts.append((len(words), points, len(text) - len(text.translate(None, BASE_SYMBOLS)), dup, repeated_words(words)))
            n = np.array(counts, np.int64).reshape(-1, 5)
            lengths = np.array(lengths, np.int64)
            content = np.zeros(len(n), np.int64)
            if rows:
                marked = viterbi(field, np.array(rows), lengths)
                np.add.at(content, np.repeat(np.arange(len(n)), lengths), marked * np.array(sizes))
            failed = (n[:, 0] < MIN_WORDS) | (100 * n[:, 4] > 50 * n[:, 0])
            kept = ~failed & (content >= KEPT_SHARE * n[:, 0])
            columns = [batch.column("doc_id").cast(pa.int64()), *map(pa.array, n.T), pa.array(failed), pa.array(kept), pa.array(content)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words"])

    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_words bigint"
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)
