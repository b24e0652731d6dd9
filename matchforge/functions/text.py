"""Text functions on columns: cleaning, tokens, transliteration, fuzzy equality, attributes of labels."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from matchforge.functions import words

YEAR = r"(?<![0-9A-Za-zА-Яа-яЁё_])(19[89][0-9]|20[0-3][0-9])(?![0-9A-Za-zА-Яа-яЁё_])"


def constant_map(pairs: dict[str, str]) -> Column:
    """A map literal, given as one expression: a call for each entry would cost more than most plans."""
    return F.expr("map(" + ", ".join(f"'{a}', '{b}'" for a, b in pairs.items()) + ")")


def first_of(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds, else null."""
    found = F.when(*cases[0])
    for condition, value in cases[1:]:
        found = found.when(condition, value)
    return found


def bound(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def clean(text: Column) -> Column:
    """Lower case, ё as е, all but a-z, а-я and 0-9 as single spaces, trimmed."""
    low = F.translate(F.lower(F.replace(text, F.lit("İ"), F.lit("I"))), "ё", "е")
    return F.trim(F.regexp_replace(low, "[^a-zа-я0-9]+", " "))


def translit(token: Column) -> Column:
    """A Latin token in Cyrillic, read greedily by letter groups."""
    groups = "|".join(a for a, _ in words.LATIN_TO_CYRILLIC)
    table = constant_map(dict(words.LATIN_TO_CYRILLIC))
    parts = F.regexp_extract_all(F.lower(token), F.lit(f"(?s)({groups}|.)"), 1)
    return F.array_join(F.transform(parts, lambda g: F.coalesce(F.try_element_at(table, g), g)), "")


def tokenize(text: Column, drop_stop: bool = False) -> Column:
    """Tokens of two signs or more in canonical letters; numbers stay."""
    found = F.filter(F.split(clean(text), " "), lambda t: F.length(t) >= 2)
    found = F.transform(found, lambda t: F.when(t.rlike("^[a-z0-9]+$") & ~t.rlike("^[0-9]+$"), translit(t)).otherwise(t))
    return F.filter(found, lambda t: ~t.isin(words.STOPWORDS)) if drop_stop else found


def years(text: Column) -> Column:
    """The different years 1980 to 2039 in a text, in their order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(YEAR), 1))


def trigrams(token: Column) -> Column:
    """The different trigrams of a token with two spaces before and one after it."""
    padded = F.concat(F.lit("  "), token, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def tokens_match(q: Column, d: Column) -> Column:
    """1 for equal tokens, 0.85 for a prefix, 0.7 for few edits, else 0."""
    longest = F.greatest(F.length(q), F.length(d))
    return (
        F.when(q == d, 1.0)
        .when((F.length(q) >= 4) & (d.startswith(q) | q.startswith(d)) & (F.abs(F.length(q) - F.length(d)) <= 3), 0.85)
        .when((longest >= 8) & (F.levenshtein(q, d, 2) >= 0), 0.7)
        .when((longest >= 5) & (F.levenshtein(q, d, 1) >= 0), 0.7)
        .otherwise(0.0)
    )


def homoglyphs(text: Column) -> Column:
    return F.translate(text, words.LOOKALIKE_LATIN, words.LOOKALIKE_CYRILLIC)


#: One row for each thing that a label may say: (kind, phrase, value), longer phrases first within a kind of which the longest counts.
LABEL_TERMS = [("sweetness", p, v) for n in range(40, 0, -1) for p, v in words.SWEETNESS.items() if len(p) == n] + [("colour", p, v) for p, v in words.COLOURS.items()]


def category_words() -> list[str]:
    """All words of the phrases and values of sweetness and colour."""
    return sorted(set(" ".join(f"{phrase} {value}" for _, phrase, value in LABEL_TERMS).replace("-", " ").split()))


def said(kind: str, low: Column) -> Column:
    """The value of the first phrase of a kind that stands in a cleaned text, its words whole."""
    own = [(phrase, value) for k, phrase, value in LABEL_TERMS if k == kind]
    terms = F.array(*(F.struct(F.lit(f" {phrase} ").alias("phrase"), F.lit(value).alias("value")) for phrase, value in own))
    some = f" (?:{'|'.join(re.escape(phrase) for phrase, _ in own)}) "  # one look at texts that say nothing
    return bound(F.concat(F.lit(" "), low, F.lit(" ")), lambda whole: F.when(whole.rlike(some), F.get(F.filter(terms, lambda t: F.contains(whole, t["phrase"])), F.lit(0))["value"]))


def canonical(token: Column) -> Column:
    """A Latin variety or name in Cyrillic; category and generic words stay."""
    plain = token.rlike("^[a-z]{5,}$") & ~token.isin(category_words() + words.GENERIC_WORDS)
    return F.coalesce(F.try_element_at(constant_map(words.ALIASES), token), F.when(plain, translit(token)), token)


def alphabet_variants(token: Column) -> Column:
    """The token, its Cyrillic look-alike, and the canonical forms of both."""
    return F.array_distinct(F.array(token, homoglyphs(token), canonical(token), canonical(homoglyphs(token))))


def best_match(token: Column, marked: Column, need: float | Column) -> Column:
    """Does a variant of the token match any of the marked ones well enough?"""
    return F.exists(alphabet_variants(token), lambda v: F.exists(marked, lambda m: tokens_match(v, m) >= need))


def sweetness(low: Column) -> Column:
    """Sweetness in a cleaned text; a torn «полу» belongs to the word behind it."""
    return said("sweetness", F.regexp_replace(low, r"(?<![a-zа-я0-9])полу\s+", "полу"))


def colour(low: Column) -> Column:
    """Colour in a cleaned text: the first word of the list that stands in it."""
    return said("colour", low)


def label_attributes(text: Column) -> Column:
    """struct<years, sweetness, colour, alcohol> of a label's text, read as it is and with look-alike letters folded; each text is cleaned and folded once."""
    alcohol = F.coalesce(
        F.try_to_number(F.regexp_replace(F.nullif(F.regexp_extract(text, r"(?<![0-9A-Za-z_])([0-9]{1,2}[.,][0-9])\s*%", 1), F.lit("")), ",", "."), F.lit("99.9")),
        F.nullif(F.regexp_extract(text, r"(?<![0-9A-Za-z_])([0-9]{1,2})\s*%", 1), F.lit("")).cast("decimal(3,1)"),
    ).cast("double")

    def told(low: Column) -> Column:
        return bound(homoglyphs(low), lambda folded: F.struct(
            years(low).alias("years"),
            F.coalesce(sweetness(low), sweetness(folded)).alias("sweetness"),
            F.coalesce(colour(low), colour(folded)).alias("colour"),
            alcohol.alias("alcohol"),
        ))

    return bound(clean(text), told)


def key_attributes(key: Column, category: Column) -> Column:
    """struct<sweetness, colour, alcohol> told by an item's key; a category wins over the key's colour."""
    tail = F.regexp_extract(key, "-([0-9]{2,3})$", 1)
    value = F.try_to_number(F.nullif(tail, F.lit("")), F.lit("999")).cast("double")
    return F.struct(
        first_of([(key.contains(t), F.lit(v)) for t, v in words.KEY_SWEETNESS]).alias("sweetness"),
        F.coalesce(F.nullif(clean(category), F.lit("")), first_of([(key.contains(t), F.lit(v)) for t, v in words.KEY_COLOURS])).alias("colour"),
        F.when((F.length(tail) == 3) & value.between(90, 200), value / 10).when((F.length(tail) == 2) & value.between(9, 20), value).alias("alcohol"),
    )


def substituted(token: Column, terms: list[str]) -> Column:
    """Terms of the same length that differ from the token in one letter at most."""
    at = F.split(token, "")
    return F.filter(
        F.array(*map(F.lit, terms)),
        lambda t: (F.length(t) == F.length(token)) & (F.size(F.filter(F.zip_with(at, F.split(t, ""), lambda a, b: a != b), lambda x: x)) <= 1),
    )


def corrected_sweetness(tokens: Column) -> Column:
    """The one sweetness that long tokens read with one wrong letter may mean; null if none or several."""
    terms = [t for t in words.SWEETNESS if " " not in t and len(t) >= 7]
    near = F.flatten(F.transform(F.filter(tokens, lambda t: F.length(t) >= 7), lambda t: F.flatten(F.transform(alphabet_variants(t), lambda v: substituted(v, terms)))))
    values = F.array_distinct(F.transform(near, lambda t: F.element_at(constant_map(words.SWEETNESS), t)))
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def category_parts(name: Column) -> Column:
    """struct<colour, sweetness> of a category such as «Белое сухое», each with one capital."""
    low = F.trim(F.lower(name))
    found = first_of([(low.startswith(c), F.lit(c)) for c in ("белое", "красное", "розовое", "оранжевое")])
    rest = F.trim(F.when(found.isNotNull(), F.substring(low, F.length(found) + 1, F.length(low))).otherwise(low))

    def capital(x: Column) -> Column:
        return F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.length(x)))

    return F.struct(F.coalesce(capital(found), F.lit("")).alias("colour"), capital(rest).alias("sweetness"))


def markup_text(html: Column, quote: str = '"') -> Column:
    """Text without tags, common entities read (`&quot;` as `quote`), white space squeezed, spaces of any script trimmed."""
    text = F.regexp_replace(html, "<[^>]+>", "")
    for name, sign in (("&nbsp;", " "), ("&quot;", quote), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\n\f\r]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")


def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    def distance(x: str, y: str) -> int:
        rows = [list(range(len(y) + 1))]
        for i, c in enumerate(x, 1):
            row = [i]
            for j, d in enumerate(y, 1):
                best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (c != d))
                if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == d:
                    best = min(best, rows[-2][j - 2] + 1)
                row.append(best)
            rows = [rows[-1], row]
        return rows[-1][-1]

    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def _file_key(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for names in parts:
        yield names.map(lambda x: None if x is None else re.sub(r"[^\w]+", "_", unicodedata.normalize("NFKD", x)).strip("_").lower())


def osa_distance(a: Column, b: Column) -> Column:
    """Edits with swaps of neighbours (optimal string alignment); Spark has no such function, so an Arrow one."""
    return F.pandas_udf(_osa, "int")(a, b)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Similarity of matching blocks, 0 to 1."""
    return F.pandas_udf(_ratio, "double")(a, b)


def name_closeness(name: Column, title: Column) -> Column:
    """The larger of the share of the name's words in the title and the block similarity of both, cleaned."""
    a, b = clean(name), clean(title)
    shared = F.size(F.array_intersect(F.split(a, " "), F.split(b, " "))) / F.greatest(F.size(F.array_distinct(F.split(a, " "))), F.lit(1))
    return F.greatest(shared, sequence_ratio(a, b))


def file_key(name: Column) -> Column:
    """A file name's key: compatibility letters, other signs as one _, lower case."""
    return F.pandas_udf(_file_key, "string")(name)


def latin(text: Column) -> Column:
    """Cyrillic text in Latin letters, sign by sign; a capital letter's whole group is in capitals."""
    table = words.CYRILLIC_TO_LATIN | {a.upper(): b.upper() for a, b in words.CYRILLIC_TO_LATIN.items()}
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), 1), lambda c: F.coalesce(F.try_element_at(constant_map(table), c), c)), "")


def clean_title(title: Column) -> Column:
    """A title without spaces before marks and without runs of spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+([.,!?;:])", "$1"), r"\s{2,}", " "))


def split_description(description: Column) -> Column:
    """struct<body, pairing>: a description cut at its paragraph on what the item goes with."""
    cut = F.split(F.coalesce(description, F.lit("")), r"(?iu)\s*(?:гастрономические\s+)?сочетания\s*[:—-]\s*", 2)
    two = F.size(cut) == 2
    return F.struct(F.when(two, F.trim(F.get(cut, F.lit(0)))).otherwise(F.coalesce(description, F.lit(""))).alias("body"), F.when(two, F.trim(F.get(cut, F.lit(1)))).otherwise("").alias("pairing"))
