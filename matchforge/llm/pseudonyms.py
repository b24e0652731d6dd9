"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted by a keyed Feistel network.

Each value becomes another value of its own format: a card number another one
with a right check digit, a date another date written the same way. The
permutation depends on the key, the kind and the format only, so equal values
stay equal in all documents, different ones stay different, and the holder of
the key can turn them back. What doesn't validate is left alone. Of digits in
groups, the first and shortest groups that validate are the card, so numbers
before or after it don't hide it; where the pseudonym would make earlier groups
validate too, it is permuted once more. Dates with slashes are read month first,
and day first where that is no date.

Kinds: cards (Luhn), IBANs (mod 97), phones (international, North American, and
national ones with a leading zero), IPv4 and IPv6 addresses, social security
numbers, dates of the years 1 to 9999 (each within 1-1899, 1900-2099 or
2100-9999), email names, hexadecimal secrets and access key ids. Email domains
stay. Being a permutation, it leaves one value in as many as a format has as it
is. IPv6 addresses in mixed case are left alone. Keys of more than 64 bytes are
hashed first.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchforge.llm.common import slices, small_batches, tidied

ROUNDS = 8
#: First and last days that are permuted among themselves.
AGES = tuple((datetime.date(a, 1, 1).toordinal(), datetime.date(b, 12, 31).toordinal()) for a, b in ((1900, 2099), (1, 1899), (2100, 9999)))

KINDS = re.compile(
    r"""(?P<secret>(?<=[\s"'=:])[0-9a-f]{32,64}(?![0-9A-Za-z]))
    |(?P<email>(?<![\w.+-])[\w.+-]*\w@(?=[\w-]+(?:\.[\w-]+)+))
    |(?P<access>(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w))
    |(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?!\w))
    |(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.[0-9]))
    |(?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9]))
    |(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?!\w))
    |(?P<area>(?<![\w(])\([2-9][0-9]{2}\)[ ]?[2-9][0-9]{2}[ .-]?[0-9]{4}(?!\w)|(?<![\w.+-])[2-9][0-9]{2}(?P<mark>[.-])[2-9][0-9]{2}(?P=mark)[0-9]{4}(?![\w-]|\.[0-9]))
    |(?P<trunk>(?<![\w.+/-])0[1-9][0-9]{1,3}[ /-][1-9][0-9]{4,7}(?![\w-]|[ .]?[0-9]))
    |(?P<iso>(?<![\w-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?=[Tt][0-9]{2})|(?![\w-])))
    |(?P<day>(?<![\w.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?!\w|\.[0-9]))
    |(?P<month>(?<![\w/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![\w/]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?!\w|-(?![0-9])))""",
    re.VERBOSE,
)
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,18}(?!\w|-(?![0-9]))")
ANY = re.compile(r"[0-9@]|[0-9a-f]{32}")
DIGITS = re.compile(r"[0-9]")
#: What a number that doesn't validate is passed over by: another one may begin after its first digits.
LEAD = re.compile(r"\+?[0-9]+")
GROUP_END = re.compile(r"(?<=[0-9])(?![0-9])")
#: Digits of a card at least and at most, and the signs of the longest one with separators.
CARD_DIGITS, CARD_SIGNS = range(13, 20), 37
#: Signs of a name that are permuted together.
NAME = 64
#: Signs that email names are made of, by class; a sign stays within its class.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
CLASS_OF = {c: (k, i) for k, signs in enumerate(CLASSES) for i, c in enumerate(signs)}


def permuted(x: int, size: int, key: bytes, format_: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1 (or its inverse): Feistel on a square, walked until inside."""
    side = isqrt(size - 1) + 1
    while True:
        left, right = divmod(x, side)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            half = left if back else right
            f = int.from_bytes(hashlib.blake2b(f"{format_}|{side}|{r}|{half}".encode(), key=key, digest_size=16 + side.bit_length() // 8).digest(), "big")
            left, right = ((right - f) % side, left) if back else (right, (left + f) % side)
        x = left * side + right
        if x < size:
            return x


def check_digit(digits: str) -> str:
    """Luhn's check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 else d * 2 - 9 * (d > 4)
    return str(-total % 10)


def refilled(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in order."""
    new = iter(digits)
    return DIGITS.sub(lambda m: next(new), shape)


class Pseudonyms:
    """Replaces the values of a text under one key."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key if len(key) <= 64 else hashlib.blake2b(key).digest(), back
        self.value = lru_cache(100_000)(self._value)

    def of(self, digits: str, base: int, format_: str) -> str:
        """The permuted digit string of the same length."""
        n = len(digits)
        x = permuted(int(digits, base), base**n, self.key, f"{format_}{n}", self.back)
        if base == 16:
            return f"{x:0{n}x}"
        return f"{x:0{n}d}"

    def date(self, parts: list[str], order: tuple[int, int, int], kind: str, least_day: int = 1) -> list[str] | None:
        """Another date written the same way, from `least_day` of its month on: places that show a leading zero or its lack stay below ten."""
        year, month, day = (int(parts[i]) for i in order)
        try:
            n = datetime.date(year, month, day).toordinal()
        except ValueError:
            return None
        age = next(k for k, (first, last) in enumerate(AGES) if first <= n <= last)
        first, last = AGES[age]
        style = self.style(parts, order)
        while True:  # walk on to a date that can be written in this style
            n = first + permuted(n - first, last - first + 1, self.key, kind + style + (f"|{age}" if age else ""), self.back)
            d = datetime.date.fromordinal(n)
            new = list(parts)
            for i, x, bare in zip(order, (d.year, d.month, d.day), (False, style[0] == "b", style[1] == "b"), strict=True):
                new[i] = str(x) if bare else f"{x:0{len(parts[i]) if i == order[0] else 2}d}"
            if self.style(new, order) == style and d.day >= least_day:
                return new

    @staticmethod
    def style(parts: list[str], order: tuple[int, int, int]) -> str:
        """How month and day are written: z padded, b bare; two digits from ten on go with the other one."""
        seen = ["z" if parts[i][0] == "0" else "b" if len(parts[i]) == 1 else "-" for i in order[1:]]
        other = {"-": "z"} if seen == ["-", "-"] else {"-": next((x for x in seen if x != "-"), "z")}
        return "".join(other.get(x, x) for x in seen)

    def _value(self, kind: str, text: str) -> str | None:
        """The pseudonym of a value, or None if it doesn't validate."""
        digits = "".join(DIGITS.findall(text))
        if kind == "secret":
            return self.of(text, 16, kind)
        if kind == "card":
            if not valid_card(digits):
                return None
            while True:  # walk on to a number of which no shorter groups validate
                new = self.of(digits[:-1], 10, kind)
                digits = new + check_digit(new)
                new = refilled(text, digits)
                if first_card(new) == new:
                    return new
        if kind == "ip":
            parts = [int(x) for x in text.split(".")]
            if max(parts) > 255 or any(str(p) != x for p, x in zip(parts, text.split("."), strict=True)):
                return None
            x = permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, self.key, kind, self.back)
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "phone":
            land = len(re.match(r"\+[0-9]{1,3}?(?=[ .(-])|\+[0-9]", text)[0])
            own = "".join(DIGITS.findall(text[land:]))
            if not 8 <= len(digits) <= 15:
                return None
            return text[:land] + refilled(text[land:], self.of(own, 10, kind))
        if kind == "ssn":
            if not valid_ssn(digits):
                return None
            while True:  # walk on until the result is one that can have been given out
                digits = self.of(digits, 10, kind)
                if valid_ssn(digits):
                    return refilled(text, digits)
        if kind == "email":
            return self.name(text[:-1]) + "@"
        if kind == "access":
            return text[:4] + self.name(text[4:], kind)
        if kind == "iban":
            own = text.replace(" ", "")
            if len(own) < 15 or own[2:4] != iban_check(own[:2], own[4:]):
                return None
            new = self.name(own[4:], kind)
            signs = iter(own[:2] + iban_check(own[:2], new) + new)
            return "".join(c if c == " " else next(signs) for c in text)
        if kind == "ipv6":
            return self.ipv6(text)
        if kind in ("area", "trunk"):
            fixed = digits[:1] if kind == "trunk" else ""
            own = digits[len(fixed) :]
            groups = [len(g) for g in re.findall("[0-9]+", text)]
            leads = (0, groups[0] - 1) if kind == "trunk" else (0, 3)  # digits that begin a part can't be 0 (or 1)
            while True:
                own = self.of(own, 10, kind + "|".join(map(str, groups)))
                if all(own[i] not in ("0" if kind == "trunk" else "01") for i in leads):
                    return refilled(text, fixed + own)
        order = {"iso": (0, 1, 2), "day": (2, 1, 0), "month": (2, 0, 1)}[kind]
        parts = re.split(r"[-./]", text)
        new = self.date(parts, order, kind)
        if new is None and kind == "month":  # day first: these days are no months, so the pseudonym is read so too
            new = self.date(parts, (2, 1, 0), "slashed day", 13)
        return text[len(parts[0])].join(new) if new else None

    def ipv6(self, text: str) -> str | None:
        """Another address with groups of the same lengths."""
        own = text.replace(":", "")
        upper = own != own.lower()
        if upper and own != own.upper() or text.count(":") != 7 and "::" not in text:
            return None
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return None
        if not own:
            return None
        new = own.lower()
        while True:  # capitals show by a letter only
            new = self.of(new, 16, f"ipv6{upper}")
            if not upper or not new.isdigit():
                break
        signs = iter(new.upper() if upper else new)
        return "".join(c if c == ":" else next(signs) for c in text)

    def name(self, text: str, kind: str = "email") -> str:
        """An email's name or the like, sign by sign within its classes; long ones in pieces."""
        if len(text) > NAME:
            return "".join(self.name(text[i : i + NAME], f"{kind}{i}|{len(text)}|") for i in range(0, len(text), NAME))
        at = [CLASS_OF.get(c) for c in text]
        sizes = [len(CLASSES[k[0]]) for k in at if k]
        x, total = 0, 1
        for k in at:
            if k:
                x, total = x * len(CLASSES[k[0]]) + k[1], total * len(CLASSES[k[0]])
        if total < 2:
            return text
        x = permuted(x, total, self.key, kind + "".join(c if k is None else str(k[0]) for c, k in zip(text, at, strict=True)), self.back)
        new = []
        for size in reversed(sizes):
            x, i = divmod(x, size)
            new.append(i)
        return "".join(c if k is None else CLASSES[k[0]][new.pop()] for c, k in zip(text, at, strict=True))

    def text(self, text: str | None) -> tuple[str | None, int]:
        """The text with its values replaced, and how many were."""
        if not text or not ANY.search(text):
            return text, 0
        done: list[str] = []
        tried: list[int] = []  # where digits begin that are no card
        n = at = start = 0
        while m := KINDS.search(text, start):
            kind = m.lastgroup
            old = first_card(m[0]) if kind == "card" else m[0]
            new = None if old is None else self.value(kind, old)
            if new is None:
                if kind == "card":
                    tried.append(m.start())
                start = LEAD.match(m[0]).end() + m.start() if kind in ("card", "phone") else m.start() + 1 if kind in ("iban", "ipv6") else m.end()
                continue
            start = m.start() + len(old)
            if kind == "card":
                before = [text[i : m.start()] for i in tried if m.start() - i < CARD_SIGNS]
                while any(first_card(b + new + text[start : start + CARD_SIGNS]) for b in before):
                    new = self.value(kind, new)
            done += [text[at : m.start()], new]
            at = start
            n += 1
        return "".join([*done, text[at:]]), n


def first_card(text: str) -> str | None:
    """The shortest groups of digits from the beginning of a text on that are a card number."""
    m = CARD.match(text)
    for end in GROUP_END.finditer(m[0] if m else ""):
        digits = "".join(DIGITS.findall(m[0][: end.start()]))
        if len(digits) in CARD_DIGITS and valid_card(digits):
            return m[0][: end.start()]
    return None


def iban_check(country: str, own: str) -> str:
    """The check digits of an IBAN: letters count 10 to 35, remainder 1 of 97."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in own + country + '00')) % 97:02d}"


def valid_card(digits: str) -> bool:
    return check_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def valid_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def pseudonymizer(key: bytes, back: bool = False) -> Callable[[Column], Column]:
    """A column function: text -> struct<text string, n_values int>."""

    @F.arrow_udf("struct<text: string, n_values: int>")
    @tidied
    def replace(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Pseudonyms(key, back)
        for texts in batches:
            found = [own.text(t) for part in slices(texts) for t in part.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int32())], names=["text", "n_values"])

    return replace


def pseudonymized(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """`docs` with the values in `text` replaced, and n_values, how many were; with `back`, turned back.

    Null and empty texts stay as they are with n_values 0; texts count whole and
    of any length; equal values get equal pseudonyms in all rows, so repeated
    rows stay equal; all other columns stay, and one named n_values is
    overwritten. An empty table gives an empty one.
    """
    done = small_batches(docs).withColumn("__done", pseudonymizer(key, back)(F.col("text")))
    return done.withColumn("text", F.col("__done.text")).withColumn("n_values", F.col("__done.n_values")).drop("__done")
