"""Evaluation of answers: shares with explicit denominators, F1 with rejection, credit rules, sweeps, bins, paired runs.

A case is a row with gold (null: nothing is to be found), correct, in_top3,
in_top5 and probability. Everything is a conditional aggregate in one pass; grids
of thresholds are constant lists that each case meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchforge.functions.statistics import mcnemar, share, wilson
from matchforge.operators import order

RULES = ("strict", "null_ok", "positives")


def f1_columns(positive: Column, hit: Column, shown: Column) -> list[Column]:
    """tp, fp, fn and precision, recall, F1: a shown case that is no hit is a false positive even without gold."""
    tp, n_shown, n_positive = F.count_if(shown & positive & hit), F.count_if(shown), F.count_if(positive)
    fp, fn = n_shown - tp, n_positive - tp
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), share(tp, n_shown).alias("precision"), share(tp, n_positive).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def f1_with_rejection(cases: DataFrame, show_p: float) -> DataFrame:
    """One row for each depth k: 1, 3, 5."""
    hits = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("hit")) for k, c in ((1, "correct"), (3, "in_top3"), (5, "in_top5"))]))
    rows = cases.withColumn("h", hits)
    return rows.groupBy(F.col("h.k").alias("k")).agg(*f1_columns(F.col("gold").isNotNull(), F.col("h.hit"), F.col("probability") >= show_p))


def credited(rule: str, threshold: Column | float) -> Column:
    """1 or 0 for a case under a rule, null where it doesn't count."""
    shown, absent = F.col("probability") >= threshold, F.col("gold").isNull()
    right = (shown & F.col("correct")).cast("int")
    if rule == "strict":
        return F.when(absent, 0).otherwise(right)
    if rule == "null_ok":
        return F.when(absent, (~shown).cast("int")).otherwise(right)
    return F.when(~absent, right)


def swept(cases: DataFrame, thresholds: list[float], rules: tuple[str, ...] = RULES) -> DataFrame:
    """Credit and cases by threshold and rule, in one pass."""
    grid = cases.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    sums = [x for r in rules for x in (F.sum(credited(r, F.col("threshold"))).alias(f"{r}_score"), F.count(credited(r, F.col("threshold"))).alias(f"{r}_n"))]
    return grid.groupBy("threshold").agg(*sums)


def best_threshold(sweep: DataFrame, score: str) -> DataFrame:
    """The threshold with the largest score, the smaller of equal ones."""
    return sweep.agg(F.max_by("threshold", F.struct(score, -F.col("threshold"))).alias("threshold"), F.max(score).alias("score"))


def reliability(cases: DataFrame, edges: list[float]) -> DataFrame:
    """Half-open bins of the probability: cases, mean probability, share that is right."""
    p = F.col("probability")
    found = None
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (p >= a) & (p < b)
        found = F.when(inside, k) if found is None else found.when(inside, k)
    binned = cases.withColumn("bin", found).filter("bin is not null")
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("probability").alias("declared"), F.avg(F.col("correct").cast("double")).alias("actual"))


def calibration(cases: DataFrame, shown: Column) -> DataFrame:
    """Precision, coverage, false refusals and false acceptances; denominators of at least 1. Columns present and correct."""

    def per(part: Column, whole: Column) -> Column:
        return F.count_if(part) / F.greatest(F.count_if(whole), F.lit(1))

    present, right = F.col("present"), F.col("correct")
    return cases.agg(
        per(shown & present & right, shown & present).alias("precision"), per(shown & present, present).alias("coverage"),
        per(present & right & ~shown, present).alias("false_refusal"), per(~present & shown, ~present).alias("false_accept"),
    )


def paired(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Cases fixed and broken between two runs over the same keys; raises if a key is in one of them only."""
    both = before.select(key, F.col("correct").alias("a")).join(after.select(key, F.col("correct").alias("b")), key, "full")
    whole = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.concat(F.lit("only in one run: "), F.col(key).cast("string")))).otherwise(F.col("a"))
    checked = both.withColumn("a", whole.cast("boolean"))
    counted = checked.agg(F.count("*").alias("n"), F.count_if(~F.col("a") & F.col("b")).alias("fixed"), F.count_if(F.col("a") & ~F.col("b")).alias("broken"), F.count_if("b").alias("right"))
    lo, hi = wilson(F.col("right"), F.col("n"))
    return counted.withColumns({"p_value": mcnemar(F.col("fixed"), F.col("broken")), "low": lo, "high": hi})


def nearest_rank(values: DataFrame, group: str, value: str, share_: float, half_even: bool = False) -> DataFrame:
    """The percentile by rank: ceil(share * n), or the rounded (half to even) rank."""
    return order.at_ranks(values, group, value, {"at_rank": order.nearest_rank(F.col("n"), share_, half_even)}).drop("n")
