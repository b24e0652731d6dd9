"""Audit of how filters overlap: what each step removes under every order, from one count of failure masks.

Each document gets a mask of the conditions it fails. A part's documents are
counted by mask once (32 numbers of five filters); a subset-zeta transform turns
the counts into the survivors of every subset of filters. A step of any order
then is the difference between two neighbouring subsets, for all documents as
for labelled ones, so orders cost no further pass.

Texts are read once and reduced to a digest and a mask before anything is
shuffled. Equal texts meet by digest, counted within the tasks first, so a text
that a third of all documents share sends one row a task and part.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchforge.llm.common import stored

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ["n", "good", "toxic"]


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def own_failures(text: Column) -> Column:
    """The mask of the conditions that the text alone decides: few words, few different words, capitals, markup."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, points = F.size(words), F.length(text)
    capitals = points - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = {"A": n < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * n, "C": 100 * capitals > 10 * points, "D": text.rlike(r"[#$%&*|]")}
    return reduce(Column.__add__, (F.when(failed, bit(name)).otherwise(0) for name, failed in fails.items()))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the conditions they fail, with those labelled good and toxic.

    Documents with the least id of their text pass condition E; rows of that id
    all do, and rows without an id have no smaller one that is known, so they do too.
    """
    facts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    facts = facts.select("doc_id", "part", F.sha2("text", 256).alias("digest"), own_failures(F.col("text")).alias("own"))
    marks = labels.groupBy("doc_id").agg(*(F.coalesce(F.max((F.col(a) == 1).cast("int")), F.lit(0)).alias(b) for a, b in (("quality", "good"), ("toxic", "toxic"))))
    rows = facts.groupBy("doc_id", "part", "digest", "own").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    rows = rows.fillna(0, ["good", "toxic"])
    # Of a text, by part and labels: its rows, and those of its least id. The pairs (id, rows) are added up in the tasks.
    text = ["digest", "own"]
    ids = rows.groupBy(*text, "part", "good", "toxic", "doc_id").agg(F.sum("n").alias("n"))
    kinds = ids.groupBy(*text, "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unknown")
    )
    # One row for each text that has the same id as least in all its kinds.
    first = kinds.groupBy(*text).agg(F.min("least.doc_id").alias("first"), F.collect_list(F.struct("part", "good", "toxic", "n", "least", "unknown")).alias("kinds"))
    each = first.select("own", "first", F.inline("kinds"))
    passing = F.col("unknown") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = each.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("own").alias("mask"), passing.alias("n")), F.struct((F.col("own") + bit("E")).alias("mask"), (F.col("n") - passing).alias("n")))).alias("m"))
    sums = [F.sum("m.n").alias("n"), *(F.sum(F.col(c) * F.col("m.n")).alias(c) for c in COUNTS[1:])]
    return split.groupBy("part", F.col("m.mask").alias("mask")).agg(*sums)


def zeta(counts: Column) -> Column:
    """Sums over all subsets: element S of the result adds up the elements whose index is a subset of S, a filter at a time."""

    def with_bit(sums: Column, b: Column) -> Column:
        return F.transform(sums, lambda x, s: x + F.when(s.bitwiseAND(b) != 0, F.get(sums, s - b)).otherwise(F.lit(0)))

    return F.aggregate(F.array(*(F.lit(bit(f)) for f in FILTERS)), counts, with_bit)


def survivors(masks: DataFrame) -> DataFrame:
    """(part, exactly, left_n, left_good, left_toxic) from counts by mask.

    left_*[S]: documents that fail none of the filters in S, that is, the zeta
    transform at the complement of S; exactly[m]: documents whose mask is m.
    """
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS))))
    filled = masks.groupBy("part").agg(by_mask.alias("of"))
    every = F.sequence(F.lit(0), F.lit(ALL))

    def counted(c: str) -> Column:
        return F.transform(every, lambda m: F.coalesce(F.element_at("of", m)[c], F.lit(0).cast("bigint")))

    count = {c: counted(c) for c in COUNTS}
    left = [F.reverse(zeta(count[c])).alias(f"left_{c}") for c in COUNTS]
    return filled.select("part", count["n"].alias("exactly"), *left)


def steps(left: DataFrame) -> DataFrame:
    """One row a part, order and step: differences of neighbouring subsets."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    rows = left.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = F.create_map(*(F.lit(x) for f in FILTERS for x in (f, bit(f))))
    letters = F.split("filter_order", "")
    before = F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda s, f: s + F.element_at(bits, f))
    rows = rows.withColumn("own", F.element_at(bits, F.element_at(letters, F.col("step")))).withColumn("before", before)
    rows = rows.withColumn("after", F.col("before") + F.col("own"))

    def gone(c: str, s: Column) -> Column:
        """Of the survivors of the filters in `s`, those that this step's filter removes."""
        return F.get(c, s) - F.get(c, s + F.col("own"))

    weights = F.array(*(F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))))
    without = F.filter(F.sequence(F.lit(0), F.lit(ALL)), lambda s: s.bitwiseAND(F.col("own")) == 0)
    shapley = F.aggregate(without, F.lit(0).cast("bigint"), lambda total, s: total + F.get(weights, F.bit_count(s)) * gone("left_n", s))
    removed = gone("left_n", F.col("before"))
    return rows.select(
        "part", "filter_order", "step", F.get("left_n", F.col("after")).alias("kept"), removed.alias("removed"),
        (gone("left_n", F.lit(0)) - removed).alias("redundant"), F.get("exactly", F.col("own")).alias("unique_fails"),
        gone("left_good", F.col("before")).alias("good_lost"), gone("left_toxic", F.col("before")).alias("toxic_lost"), shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters removes at each step of all 120 orders, by part.

    docs: doc_id, text, lang, and others that are left out (their names don't
    matter); labels: doc_id, quality, toxic. Returns part, filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null and empty texts are the same text; a null lang is the part of the empty
    string. Repeated rows count as often as they stand there; rows of one id
    never fail E against each other, and neither do rows without an id. Of
    repeated labels one that says 1 is enough; null labels say nothing. An empty
    table gives no rows. Texts of any length are reduced to a digest and a mask
    in the task that reads them.
    """
    return steps(survivors(stored(mask_counts(docs, labels), "masks")))


def oracle_sql() -> str:
    """The same by walking through all orders, without subsets."""
    return r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         (CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 10 * length(d.t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN d.doc_id > first_id THEN 'E' ELSE '' END) AS fails
  FROM d JOIN firsts ON d.t = firsts.t LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
r AS (
  SELECT part, filter_order, step, filter_order[step] AS own, n, good, toxic,
         translate(filter_order[1:step - 1], fails, '') <> filter_order[1:step - 1] AS earlier,
         contains(fails, filter_order[step]) AS failing, fails = filter_order[step] AS only_this
  FROM s, m),
g AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT earlier AND NOT failing THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT earlier AND failing THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN earlier AND failing THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN only_this THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT earlier AND failing AND good THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT earlier AND failing AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""
