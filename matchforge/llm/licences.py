"""Licence scan: text compared to licence templates by the Dice coefficient over word bigrams.

Whole texts, their single lines and runs of adjacent lines are compared. Only templates whose number of
different bigrams lies within the bounds that the least coefficient allows are
candidates. The same bounds say how many bigrams a match shares with a template
at least, so some of a few words of it must stand in the text: texts without any
of these are passed over unread. All of it is DataFrame functions over one row at a time: no shuffle,
no join, and the templates are a constant of the plan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = "[^a-z0-9.]+"

#: The notices and short texts of public licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def template_bigrams(text: str) -> list[str]:
    words = re.sub(NOT_WORD, " ", text.lower()).strip(" ").split(" ")
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, letters A-Z lower-cased, all but a-z, 0-9 and points taken as spaces; one empty word if there is none."""
    return F.split(F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NOT_WORD, " ")), " ")


def bigrams(words: Column) -> Column:
    """The different bigrams of some words."""
    pairs = bound(words, lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def size_bounds(size: int) -> tuple[int, int]:
    """Numbers of bigrams with which a coefficient of `LEAST` is possible: 2 min(a, b) >= LEAST (a + b)."""
    return next(n for n in range(1, size + 1) if 2 * n >= LEAST * (n + size)), max(n for n in range(size, 3 * size + 2) if 2 * size >= LEAST * (n + size))


#: Words too common to tell a licence.
COMMON = frozenset("a all and any at be by for in is not of on or that the this to under with".split())


def needed_words(text: str) -> list[str]:
    """Words of a template of which every match holds one: so few bigrams have none of them that a match can't do with those."""
    own = {tuple(b.split(" ")) for b in template_bigrams(text)}
    shared = math.ceil(LEAST / 2 * (size_bounds(len(own))[0] + len(own)))
    found: list[str] = []
    while len(own) >= shared:
        found.append(max(sorted({w for b in own for w in b}), key=lambda w: (w not in COMMON, min(len(w), 6), sum(w in b for b in own), len(w))))
        own = {b for b in own if found[-1] not in b}
    return found


def worth_reading(text: Column) -> Column:
    """Does a text hold a word that some template's matches need?"""
    every = sorted({w for t in TEMPLATES.values() for w in needed_words(t)})
    words = F.array(*[F.lit(w) for w in every if not any(o != w and o in w for o in every)])
    return bound(F.lower(text), lambda low: F.exists(words, lambda w: low.contains(w)))


def word_count(text: str) -> int:
    return len(re.sub(NOT_WORD, " ", text.lower()).strip(" ").split(" "))


def templates() -> Column:
    """The templates as a constant array of structs."""
    found = []
    for name, text in sorted(TEMPLATES.items()):
        own = template_bigrams(text)
        least, most = size_bounds(len(own))
        columns = {"name": F.lit(name), "words": F.lit(word_count(text)), "least": F.lit(least), "most": F.lit(most)}
        columns |= {"needed": F.array(*map(F.lit, needed_words(text))), "bigrams": F.array(*map(F.lit, own))}
        found.append(F.struct(*[c.alias(k) for k, c in columns.items()]))
    return F.array(*found)


def compared(own: Column, t: Column) -> Column:
    """Coefficient of bigrams and a template, its name and the number of bigrams; a coefficient of 0 outside the size bounds."""
    dice = F.when(F.size(own).between(t["least"], t["most"]), 2.0 * F.size(F.array_intersect(own, t["bigrams"])) / (F.size(own) + F.size(t["bigrams"])))
    return F.struct(F.coalesce(dice, F.lit(0.0)).alias("dice"), t["name"].alias("name"), F.size(own).alias("n"))


def no_match() -> Column:
    return F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("name"), F.lit(0).alias("n"))


def best(scored: Column) -> Column:
    """The largest coefficient, the first by name of equal ones."""
    return F.aggregate(scored, no_match(), lambda a, b: F.when(b["dice"] > a["dice"], b).otherwise(a))


def runs(lines: Column) -> Column:
    """For each line and template, the comparison of as many words as the template has, from that line on over the next ones."""
    most = max(map(word_count, TEMPLATES.values()))
    following = lambda i: F.flatten(F.transform(F.slice(lines, i, F.lit(most)), lambda x: x["words"]))
    none = F.array().cast("array<string>")
    return F.transform(
        F.sequence(F.lit(1), F.size(lines)),
        lambda i: bound(
            following(i),
            lambda w: F.transform(templates(), lambda t: bound(F.slice(w, F.lit(1), t["words"]), lambda r: bound(F.when(F.arrays_overlap(r, t["needed"]), bigrams(r)).otherwise(none), lambda own: compared(own, t)))),
        ),
    )


def licence_lines(docs: DataFrame) -> DataFrame:
    """Units of `docs` (doc_id, text) that match a licence: doc_id, line_no, licence, dice, n_bigrams.

    line_no counts the lines from 1; 0 is the whole text, compared too if it has
    more than one line. A line is compared alone and, for notices that are
    wrapped, together with the words that follow on the next lines, as many as
    the template has; such a run counts if the ones from the line with words
    before and after it are no better (the earlier of equal ones counts). Of
    several licences or runs of a line the one with the largest coefficient
    counts, the first by name of equal ones, the line alone before a run. Null
    and empty texts and units of fewer than two words match nothing; texts count
    whole; repeated rows repeat; an empty table gives an empty one; other columns
    are ignored.
    """
    worded = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("no"), words_of(x).alias("words"))), lambda x: x["words"][0] != "")
    # Generators keep what they made: what stands above them doesn't work it out again.
    lines = docs.filter(worth_reading(F.col("text"))).select("doc_id", "text", F.explode(F.array(worded)).alias("lines"))
    wrapped = lines.select("doc_id", "text", "lines", F.explode(F.array(F.when(F.size("lines") > 1, runs(F.col("lines"))))).alias("runs"))

    def peaks(i: Column) -> Column:
        """The runs from the line at place i (from 0) that no neighbour exceeds."""
        before, after = F.get(F.col("runs"), i - 1), F.get(F.col("runs"), i + 1)
        value = lambda x, k: F.coalesce(F.get(x, k)["dice"], F.lit(0.0))
        return F.filter(F.get(F.col("runs"), i), lambda r, k: (r["dice"] >= LEAST) & (r["dice"] > value(before, k)) & (r["dice"] >= value(after, k)))

    whole = F.struct(F.lit(0).alias("no"), F.when(F.col("text").contains("\n"), words_of(F.col("text"))).alias("words"), no_match().alias("run"))
    each = F.transform("lines", lambda x, i: F.struct(x["no"].alias("no"), x["words"].alias("words"), best(peaks(i)).alias("run")))
    units = wrapped.select("doc_id", F.explode(F.concat(F.array(whole), each)).alias("unit"))
    sized = units.select("doc_id", "unit.no", "unit.run", F.explode_outer(F.array(bigrams(F.col("unit.words")))).alias("own"))
    bounds = [size_bounds(len(template_bigrams(t))) for t in TEMPLATES.values()]
    sized = sized.filter(F.size("own").between(min(a for a, _ in bounds), max(b for _, b in bounds)) | (F.col("run.dice") >= LEAST))
    alone = best(F.transform(templates(), lambda t: compared(F.col("own"), t)))
    chosen = bound(alone, lambda a: F.when(F.col("run.dice") > a["dice"], F.col("run")).otherwise(a))
    found = sized.select("doc_id", F.col("no").alias("line_no"), F.explode_outer(F.array(chosen)).alias("best")).filter(F.col("best.dice") >= LEAST)
    return found.select("doc_id", "line_no", F.col("best.name").alias("licence"), F.round("best.dice", 6).alias("dice"), F.col("best.n").alias("n_bigrams"))


def oracle_sql() -> str:
    """The same in DuckDB."""
    rows = ", ".join("('{}', {}, {}, {}, [{}])".format(n, word_count(t), *size_bounds(len(template_bigrams(t))), ", ".join(f"'{x}'" for x in template_bigrams(t))) for n, t in sorted(TEMPLATES.items()))
    words = f"string_split(trim(regexp_replace(translate({{}}, '{UPPER}', '{LOWER}'), '{NOT_WORD}', ' ', 'g')), ' ')"
    pairs = "list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])"
    needed = " OR ".join(f"contains(lower(text), '{w}')" for w in sorted({w for t in TEMPLATES.values() for w in needed_words(t)}))
    return f"""
    WITH templates(name, size, least, most, bigrams) AS (VALUES {rows}),
    lined AS (SELECT doc_id, i AS line_no, {words.format("lines[i]")} AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE {needed}) t, unnest(range(1, len(lines) + 1)) u(i)),
    worded AS (SELECT doc_id, line_no, w FROM lined WHERE w[1] <> ''),
    placed AS (SELECT doc_id, line_no, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line_no) - len(w) AS start FROM worded),
    texts AS (SELECT doc_id, flatten(list(w ORDER BY line_no)) AS w FROM worded GROUP BY doc_id HAVING count(*) > 1),
    taken AS (SELECT doc_id, line_no, name, least, most, bigrams, texts.w[start + 1:start + size] AS w FROM placed JOIN texts USING (doc_id) CROSS JOIN templates),
    run AS (SELECT doc_id, line_no, name, least, most, bigrams, {pairs} AS own FROM taken WHERE len(w) > 1),
    valued AS (SELECT doc_id, line_no, name, len(own) AS n, CASE WHEN len(own) BETWEEN least AND most THEN 2.0 * len(list_intersect(own, bigrams)) / (len(own) + len(bigrams)) ELSE 0 END::DOUBLE AS dice FROM run),
    peaks AS (SELECT *, coalesce(lag(dice) OVER o, 0) AS before, coalesce(lead(dice) OVER o, 0) AS after FROM valued WINDOW o AS (PARTITION BY doc_id, name ORDER BY line_no)),
    units AS (SELECT * FROM worded UNION ALL SELECT doc_id, 0, {words.format("text")} FROM documents WHERE contains(text, chr(10))),
    sized AS (SELECT doc_id, line_no, {pairs} AS own FROM units WHERE len(w) > 1),
    scored AS (
      SELECT doc_id, line_no, name, len(own) AS n, (2.0 * len(list_intersect(own, bigrams)) / (len(own) + len(bigrams)))::DOUBLE AS dice, 0 AS kind
      FROM sized JOIN templates ON len(own) BETWEEN least AND most
      UNION ALL SELECT doc_id, line_no, name, n, dice, 1 FROM peaks WHERE dice >= {LEAST} AND dice > before AND dice >= after
    )
    SELECT doc_id, CAST(line_no AS INT) AS line_no, name AS licence, round(dice, 6) AS dice, CAST(n AS INT) AS n_bigrams FROM scored WHERE dice >= {LEAST}
    QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, kind, name) = 1
    """
