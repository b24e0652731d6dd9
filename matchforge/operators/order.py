"""Order statistics of large groups and whole tables: ranks, medians, percentiles and running sums without a window or a buffer over a whole group.

Rows are dealt out by ranges of (group, value) and counted by range, so that a
running sum over a group's ranges, as many as there are partitions, tells which
range holds a rank. Only the ranges that hold a wanted rank are numbered, each
by itself: a group that has all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchforge.sources.shared import stored


def at_ranks(values: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """One row a group: `group`, n, and for each name the value at that rank from 1.

    Ranks are columns over `n`, the group's rows; a rank outside 1 to n gives
    null. Null values are left out; a null group is one too. Equal values share
    a range, and any of them is the value at their ranks.
    """
    rows = values.select(F.col(group).alias("__group"), F.col(value).alias("__value")).filter("__value is not null")
    dealt = stored(rows.repartitionByRange("__group", "__value").withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__group", "__range").agg(F.count("*").alias("k"))
    by_group = Window.partitionBy("__group").orderBy("__range")
    placed = counts.withColumn("before", F.sum("k").over(by_group) - F.col("k")).withColumn("n", F.sum("k").over(Window.partitionBy("__group")))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items())))
    asked = placed.select("__group", "__range", "before", "k", "n", wanted.alias("w"))
    asked = stored(asked.filter("w.rank > before and w.rank <= before + k").select("__group", "__range", F.col("w.name").alias("name"), (F.col("w.rank") - F.col("before")).alias("at")), "asked")
    held = asked.groupBy("__group", "__range").agg(F.collect_list(F.struct("name", "at")).alias("asked"))  # a few ranks
    met = dealt.join(held.withColumnRenamed("__group", "g").withColumnRenamed("__range", "r"), F.col("__group").eqNullSafe(F.col("g")) & (F.col("__range") == F.col("r")))
    numbered = met.withColumn("at", F.row_number().over(Window.partitionBy("__group", "__range").orderBy("__value")))
    found = numbered.withColumn("hit", F.explode(F.filter("asked", lambda a: a["at"] == F.col("at"))))
    totals = counts.groupBy("__group").agg(F.sum("k").alias("n"))
    wide = found.groupBy("__group").agg(*(F.max(F.when(F.col("hit.name") == name, F.col("__value"))).alias(name) for name in ranks))
    result = totals.withColumnRenamed("__group", "g").join(wide, F.col("g").eqNullSafe(F.col("__group")), "left")
    return result.select(F.col("g").alias(group), "n", *ranks)


def percentiles(values: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """One row a group: `group`, n, and linearly interpolated percentiles by name."""
    ranks: dict[str, Column] = {}
    for name, share in shares.items():
        place = (F.col("n") - 1) * share
        ranks |= {f"__low_{name}": F.floor(place) + 1, f"__high_{name}": F.ceil(place) + 1}
    found = at_ranks(values, group, value, ranks)

    def between(name: str, share: float) -> Column:
        low, high, place = F.col(f"__low_{name}"), F.col(f"__high_{name}"), (F.col("n") - 1) * share
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return found.select(group, "n", *(between(name, share) for name, share in shares.items()))


def nearest_rank(n: Column, share: float, half_even: bool = False) -> Column:
    """The rank of a percentile: ceil(share * n), or the rounded (half to even) one, 1 at least."""
    return F.greatest(F.lit(1), F.bround(n * share).cast("bigint") if half_even else F.ceil(n * share))


def summed_before(rows: DataFrame, by: Column, value: Column, name: str) -> DataFrame:
    """`rows` with `name`: the sum of `value`, a whole number, over all rows before this one in the order of `by`; with ones it numbers them from 0.

    Rows are dealt by ranges of `by`, which has few equal values by contract (an
    id or its digest), since these share a range; null comes first. Sums within
    a range and a sum a range give all places, so no task orders the whole table.
    """
    dealt = stored(rows.withColumn("__by", by).withColumn("__value", value.cast("bigint")).repartitionByRange("__by").withColumn("__range", F.spark_partition_id()), "dealt")
    held = dealt.groupBy("__range").agg(F.sum("__value").alias("__held"))
    earlier = held.select("__range", (F.sum("__held").over(Window.orderBy("__range")) - F.col("__held")).alias("__earlier"))  # a row a range
    within = F.sum("__value").over(Window.partitionBy("__range").orderBy("__by").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__value")
    return dealt.withColumn("__within", within).join(earlier, "__range").withColumn(name, F.col("__within") + F.col("__earlier")).drop("__by", "__value", "__range", "__within", "__earlier")
