"""Exact SentencePiece encoding (merge type) by backtracking, and decoding.

A segmentation is the one that merging in score order would give if and only if
every two adjacent tokens stay apart when their joined text is merged anew.
So the encoder walks through longest matches (Aho-Corasick), keeps a token only
if it is compatible with the one before it, falls back to the next shorter
prefix token, and marks positions from which no way leads on in a bit field.

Texts are cut where no piece can reach across: before a run of spaces, and
around line ends, and between a letter and a point if no piece has such a pair.
Units repeat a lot, so each Python worker remembers their ids.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from matchforge.llm.common import remembers, slices, small_batches, tidied

SPACE = "▁"
#: Units that each of a worker's two generations of memory holds at most (a full young one becomes the old one), and signs of a remembered unit.
MEMORY, REMEMBERED = 150_000, 64


@dataclass
class PieceModel:
    """The parts of a merge-type model that encoding needs; small (about 1 MB) and sent with the task."""

    pieces: list[str]
    scores: list[float]
    normal: list[int]
    whole: list[int]
    bytes_at: list[int]
    byte_of: dict[int, int] = field(default_factory=dict)
    key: str = ""

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Read a model file on the driver. Raises ValueError for models that this encoder does not cover."""
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        p = sentencepiece.SentencePieceProcessor(model_proto=raw)
        kept = ("  a  b ", "Ａﬁ\u00a0é", "a\tb\n c")  # texts that other normalisers and space settings change
        if any(p.decode(p.encode(t)) != t for t in kept) or not p.encode("a", out_type=str)[0].startswith(SPACE):
            raise ValueError("the model changes texts or puts no space before them")
        ids = range(p.vocab_size())
        byte_of = {i: int(p.id_to_piece(i)[3:5], 16) for i in ids if p.is_byte(i)}
        if len(byte_of) != 256:
            raise ValueError("the model needs byte fallback")
        normal = [i for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        pieces = [p.id_to_piece(i) for i in ids]
        if any(SPACE in pieces[i].lstrip(SPACE) or "\n" in pieces[i] for i in normal):
            raise ValueError("a piece reaches across a word or line end")
        at = [0] * 256
        for i, b in byte_of.items():
            at[b] = i
        scores = [p.get_score(i) for i in ids]
        rank = {pieces[i]: scores[i] for i in normal}
        whole = [i for i in normal if len(merged(pieces[i], rank)) == 1]  # the others never are the outcome of merging
        return cls(pieces, scores, normal, whole, at, byte_of, hashlib.sha256(raw).hexdigest())


def merged(text: str, rank: dict[str, float]) -> list[str]:
    """Merge the characters of a short text in score order, leftmost first."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            score = rank.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Encodes units of text and remembers them."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.rank = {model.pieces[i]: model.scores[i] for i in model.normal}
        self.ids = {model.pieces[i]: i for i in model.normal}
        self.whole = {model.pieces[i] for i in model.whole}
        self.automaton = ahocorasick.Automaton()
        for piece in self.whole:
            self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()
        self.units = UNITS if any(map(TOGETHER.search, self.ids)) else FINER_UNITS
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memory: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.texts: dict[str, str] = {}
        self.old_texts: dict[str, str] = {}
        self.shorter: dict[str, str] = {}
        self.long: dict[str, str] = {}

    def forget(self) -> None:
        for memory in (self.pairs, self.memory, self.old, self.texts, self.old_texts):
            memory.clear()

    def prefix(self, piece: str) -> str:
        """The longest shorter token with which this one begins; "" after one character."""
        found = self.shorter.get(piece)
        if found is None:
            found = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.whole), "")
            self.shorter[piece] = found
        return found

    def compatible(self, left: str, right: str) -> bool:
        """Do the two stay apart when their joined text is merged anew?"""
        if len(self.pairs) >= MEMORY:
            self.pairs.clear()
        found = self.pairs[left, right] = merged(left + right, self.rank) == [left, right]
        return found

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text whose characters all are pieces."""
        n = len(text)
        longest = [""] * n
        for end, (size, piece) in self.automaton.iter(text):
            if size > len(longest[end + 1 - size]):
                longest[end + 1 - size] = piece
        failed = 0  # bit i: no way leads on from position i
        out: list[str] = []
        at, token, before, pairs = 0, longest[0], "", self.pairs
        while at < n:
            while token:
                if not (failed and failed >> (at + len(token)) & 1):
                    if not before:
                        break
                    fits = pairs.get((before, token))
                    if fits or fits is None and self.compatible(before, token):
                        break
                token = self.prefix(token)
            if token:
                out.append(token)
                at += len(token)
                before = token
                token = longest[at] if at < n else ""
            else:
                if not out:
                    raise ValueError(f"no segmentation of {text!r}")
                failed |= 1 << at
                token = self.prefix(out.pop())
                at -= len(before)
                before = out[-1] if out else ""
        return out

    def unit(self, text: str) -> list[int]:
        """Ids of one unit; characters that are no piece become their bytes."""
        ids = self.ids
        if all(map(ids.__contains__, text)):
            return [ids[t] for t in self.tokens(text)]
        out: list[int] = []
        for known, run in itertools.groupby(text, ids.__contains__):
            part = "".join(run)
            out += [ids[t] for t in self.tokens(part)] if known else [self.model.bytes_at[b] for b in part.encode("utf-8", "replace")]
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text of ids with spaces for their marks; runs of byte tokens are read as UTF-8, each wrong byte as U+FFFD."""
        pieces, byte_of = self.model.pieces, self.model.byte_of
        if byte_of.keys().isdisjoint(ids):
            return "".join([pieces[i] for i in ids]).replace(SPACE, " ")
        out = []
        for coded, run in itertools.groupby(ids, byte_of.__contains__):
            out.append(bytes(map(byte_of.__getitem__, run)).decode("utf-8", "replace") if coded else "".join(pieces[i] for i in run).replace(SPACE, " "))
        return "".join(out)

    def remember(self, unit: str) -> str:
        """The ids of a unit; `texts` gets what they decode to where that differs."""
        found = self.memory.get(unit)
        if found is not None:
            return found
        if len(unit) > REMEMBERED:  # not worth it; bounds the memory in bytes
            ids = self.unit(unit.replace(" ", SPACE))
            self.long[unit] = self.decoded(ids)
            return ",".join(map(str, ids))
        if len(self.memory) >= MEMORY:
            self.old, self.memory = self.memory, {}
            self.old_texts, self.texts = self.texts, {}
        found = self.old.get(unit)
        if found is None:
            ids = self.unit(unit.replace(" ", SPACE))
            found, text = ",".join(map(str, ids)), self.decoded(ids)
        else:
            text = self.old_texts.get(unit, unit)
        self.memory[unit] = found
        if text != unit:
            self.texts[unit] = text
        return found

    def encoded(self, text: str) -> tuple[str, str]:
        """Ids in decimal, joined by commas, and the text that they decode to."""
        if not text:
            return "", ""
        units = self.units.findall(" " + text.replace(SPACE, " "))
        memory, parts = self.memory, []
        for u in units:
            got = memory.get(u)
            parts.append(got if got is not None else self.remember(u))
        if self.texts or self.old_texts or self.long:
            units = [self.long[u] if len(u) > REMEMBERED else self.texts[u] if u in self.texts else self.old_texts.get(u, u) for u in units]
            self.long.clear()
        back = "".join(units)
        return ",".join(parts), back[1:]


#: Units of text: line ends, and runs of spaces with the word after them.
UNITS = re.compile(r"\n| *[^ \n]+| +")
#: The same, cut between a Latin letter and a point or comma too, where no piece has the two side by side.
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
FINER_UNITS = re.compile(rf"\n|(?: *(?:[^ \n.,]|(?<!{LETTER})[.,])|[.,])(?:[^ \n.,]+|(?<!{LETTER})[.,])*| +")
TOGETHER = re.compile(rf"{LETTER}[.,]")
#: One encoder for each model in a Python worker; workers live on between tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(model: PieceModel) -> Encoder:
    if model.key not in _ENCODERS:
        _ENCODERS[model.key] = Encoder(model)
    return _ENCODERS[model.key]


def piece_digests(docs: DataFrame, model: PieceModel, ids: bool = False) -> DataFrame:
    """Encode and decode each text of `docs` (doc_id, text): n_tokens, ids_sha256, decoded_sha256.

    With `ids`, a column ids array<int> with the ids themselves follows.
    A null text counts as empty: no ids, the digests of the empty text. Texts of
    any length are encoded whole, rows stay apart (repeated rows give repeated
    results), an empty table gives an empty one, other columns are ignored.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(model)
        remembers("pieces", enc.forget)
        for batch in (part for whole in batches for part in slices(whole)):
            n, one, two, all_ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                joined, back = enc.encoded(text or "")
                n.append(joined.count(",") + 1 if joined else 0)
                one.append(hashlib.sha256(joined.encode()).hexdigest())
                two.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                if ids:
                    all_ids.append([int(x) for x in joined.split(",")] if joined else [])
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)
