"""Elias-Fano sequences and an n-gram trie of two context levels made of them.

A non-decreasing sequence of n numbers below u takes about 2 + log2(u / n) bits a
number: the low bits are packed, the high ones stand in unary in a bit vector
with a count for each word. All searches work on many queries at once.

The trie holds contexts v (the word before) and below each its extensions u (the
word before that; 0 for none), and below these the words w that follow, each
with a quantised probability. Extensions and words are stored relative to their
context (each list starts where the one before ended), so a search looks for the
successor of context base + value between two monotone pointers.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

ONE = np.uint64(1)
#: Queries that are worked on at once: small enough for the processor's cache.
BLOCK = 1 << 15
EACH = np.uint64(0x0101010101010101)
#: The place of the k-th one in a byte.
IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)


def select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each word, by sums of its bytes' ones side by side."""
    s = x - (x >> ONE & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + (s >> np.uint64(2) & np.uint64(0x3333333333333333))
    with np.errstate(over="ignore"):
        s = (s + (s >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * EACH
        full = ((k * EACH | EACH << np.uint64(7)) - s) & EACH << np.uint64(7)  # bytes that end before the k-th one
    place = np.minimum(np.bitwise_count(full), 7).astype(np.uint64) * np.uint64(8)
    before = s << np.uint64(8) >> place & np.uint64(255)
    return (place + IN_BYTE[x >> place & np.uint64(255), np.minimum(k - before, np.uint64(7))]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence; its arrays may lie in a memory-mapped file."""

    FIELDS = ("low", "high", "ranks")

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.width, self.low, self.high, self.ranks = n, width, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            packed = [np.packbits(((values[at : at + 65_536, None] >> np.arange(width, dtype=np.uint64)) & ONE).astype(np.uint8), axis=None, bitorder="little") for at in range(0, n, 65_536)]
            raw = np.concatenate(packed)  # 65 536 values always fill whole bytes
            low.view(np.uint8)[: len(raw)] = raw
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((((int(at[-1]) if n else 0) + 2) // 64 + 1) * 64, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ranks = np.r_[0, np.cumsum(np.bitwise_count(high).astype(np.int64))].astype(np.uint32)
        return cls(n, width, low, high, ranks)

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.int64)
        bit = at.astype(np.int64) * self.width
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        first = self.low[word] >> off
        second = np.where(off > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(off, ONE)), np.uint64(0))
        return ((first | second) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero in the unary part; zeros past the end lie beyond it."""
        counts = np.arange(len(self.ranks), dtype=np.int64) * 64 - self.ranks if zeros else self.ranks
        word = np.minimum(np.searchsorted(counts, k, "right") - 1, len(self.high) - 1)
        left = (k - counts[word].astype(np.int64)).astype(np.uint64)
        return word * 64 + select_in_word(~self.high[word] if zeros else self.high[word], left)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at places `at`."""
        out = np.zeros(len(at), np.int64)
        for i in range(0, len(at), BLOCK):
            part = at[i : i + BLOCK]
            out[i : i + BLOCK] = (self.select(part, False) - part) << self.width | self.lows(part)
        return out

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number that is at least x (n if there is none), and whether it is x."""
        at, hit = np.full(len(x), self.n), np.zeros(len(x), bool)
        if self.n:
            for i in range(0, len(x), BLOCK):
                at[i : i + BLOCK], hit[i : i + BLOCK] = self._successor(x[i : i + BLOCK])
        return at, hit

    def _successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = x >> self.width, x & (1 << self.width) - 1
        most = len(self.high) * 64 - int(self.ranks[-1])  # zeros that there are
        inside = high < most
        bound = np.minimum(high, most - 1)
        start = np.where(bound > 0, self.select(np.maximum(bound - 1, 0), True) - np.maximum(bound - 1, 0), 0)
        end = self.select(bound, True) - bound
        start, end = np.where(inside, start, self.n), np.where(inside, end, self.n)
        stop = end.copy()
        while True:  # binary search among the numbers with the same high bits
            open_ = np.flatnonzero(start < end)
            if not len(open_):
                break
            middle = (start[open_] + end[open_]) >> 1
            less = self.lows(middle) < low[open_]
            start[open_] = np.where(less, middle + 1, start[open_])
            end[open_] = np.where(less, end[open_], middle)
        hit = start < stop
        same = np.flatnonzero(hit)
        hit[same] = self.lows(start[same]) == low[same]
        return start, hit


def relative(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lists of increasing values, one after the other, made one increasing sequence: each starts after the end of the last."""
    sizes = np.diff(np.r_[starts, len(values)])
    values = values.astype(np.int64)
    last = values[starts + sizes - 1] + 1
    base = np.r_[0, np.cumsum(last)[:-1]]
    return values + np.repeat(base, sizes)


class Quantiser:
    """Base-10 logarithms as one byte each: 256 levels at equal shares of the values."""

    def __init__(self, logs: np.ndarray):
        self.levels = np.unique(np.quantile(logs, (np.arange(256) + 0.5) / 256).astype(np.float32)) if len(logs) else np.zeros(1, np.float32)

    def codes(self, logs: np.ndarray) -> np.ndarray:
        return np.searchsorted((self.levels[1:] + self.levels[:-1]) / 2, logs).astype(np.uint8)

    def logs(self, codes: np.ndarray) -> np.ndarray:
        return self.levels[codes].astype(np.float64)


class Trie:
    """Levels of contexts v, extensions (v, u) and words (v, u, w), with probability and back-off codes."""

    def __init__(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, logs: np.ndarray, backoff: np.ndarray):
        """Sorted by (v, u, w), all different; `backoff` has one number for each (v, u)."""
        new_v = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
        new_u = new_v | np.r_[True, u[1:] != u[:-1]] if len(v) else new_v
        at_u = np.flatnonzero(new_u)
        at_v = np.flatnonzero(new_v[at_u])
        self.parts = {
            "contexts": EliasFano.of(v[at_u][at_v]),
            "to_extensions": EliasFano.of(np.r_[at_v, len(at_u)]),
            "extensions": EliasFano.of(relative(u[at_u], at_v)),
            "to_words": EliasFano.of(np.r_[at_u, len(v)]),
            "words": EliasFano.of(relative(w, at_u)),
        }
        self.probability, self.weight = Quantiser(logs), Quantiser(backoff)
        self.codes, self.weights = self.probability.codes(logs), self.weight.codes(backoff)

    def mapped(self) -> Trie:
        """Move all levels to one file, mapped into memory; the file has no name any more and goes with the mapping."""
        arrays = [a for p in self.parts.values() for a in (p.low, p.high, p.ranks)] + [self.codes, self.weights]
        handle, path = tempfile.mkstemp(prefix="trie-")
        with os.fdopen(handle, "wb") as f:
            places = []
            for a in arrays:
                f.write(b"\0" * (-f.tell() % 8))
                places.append(f.tell())
                f.write(a.tobytes())
        whole = np.memmap(path, np.uint8, "r")
        os.unlink(path)
        views = [whole[at : at + a.nbytes].view(a.dtype) for at, a in zip(places, arrays, strict=True)]
        for k, p in enumerate(self.parts.values()):
            p.low, p.high, p.ranks = views[3 * k : 3 * k + 3]
        self.codes, self.weights = views[-2:]
        return self

    def below(self, level: str, pointers: str, context: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of `value` in the list of each context (by place), and whether it is there."""
        p, s = self.parts[pointers], self.parts[level]
        start, end = p.access(context), p.access(context + 1)
        base = np.zeros(len(context), np.int64)
        later = np.flatnonzero(start > 0)
        base[later] = s.access(start[later] - 1) + 1
        at, hit = s.successor(base + value)
        return at, hit & (at < end)

    def context(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.parts["contexts"].successor(v)

    def extension(self, context: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.below("extensions", "to_extensions", context, u)

    def word(self, extension: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.below("words", "to_words", extension, w)
