"""Pairs of rows for training and comparison, without meeting all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a ring, on average at most.
RING = 8_192


def strangers(rows: DataFrame, key: str, stratum: str, group: str, k: int, seed: int = 17) -> DataFrame:
    """(key, stranger): for each row up to `k` rows of its stratum that belong to another group.

    Rows stand in rings by the hash of key and seed, and each takes the next `k`;
    those of its own group are left out. A stratum is cut into rings of some
    `RING` rows by the same hash, so none fills a task. The same on every run and
    for any partitions. Keys must differ; null strata are one, null groups are one.
    """
    hashed = rows.select(F.col(key).alias("a"), F.col(stratum).alias("s"), F.col(group).alias("g"), F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))).alias("hash"))
    sizes = hashed.groupBy("s").agg(F.count("*").alias("n")).select(F.col("s").alias("t"), F.ceil(F.col("n") / RING).cast("bigint").alias("rings"))
    dealt = hashed.join(sizes, F.col("s").eqNullSafe(F.col("t"))).withColumn("ring", F.shiftright(F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint") * F.col("rings"), 32))
    ring = Window.partitionBy("s", "ring")
    placed = dealt.withColumn("at", F.row_number().over(ring.orderBy("hash", "a"))).withColumn("size", F.count("*").over(ring)).select("a", "s", "g", "ring", "at", "size")
    ahead = placed.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")).filter(F.col("step") < F.col("size"))
    ahead = ahead.withColumn("next", (F.col("at") - 1 + F.col("step")) % F.col("size") + 1)
    other = placed.select(F.col("a").alias("b"), F.col("s").alias("s2"), F.col("g").alias("g2"), F.col("ring").alias("ring2"), F.col("at").alias("at2"))
    met = ahead.join(other, F.col("s").eqNullSafe(F.col("s2")) & (F.col("ring") == F.col("ring2")) & (F.col("next") == F.col("at2")))
    return met.filter(~F.col("g").eqNullSafe(F.col("g2"))).select(F.col("a").alias(key), F.col("b").alias("stranger"))


def against_the_right(rows: DataFrame, group: str, right: str, order: str, features: list[str], folds: int) -> DataFrame:
    """(group, fold, features): differences of each group's right row minus every other one; `right` is a boolean column.

    Of several right rows the first by `order` counts, and the others aren't
    compared with it. A group is in one fold, by the hash of its name.
    """
    best = rows.filter(right).groupBy(group).agg(F.min_by(F.struct(*features), order).alias("best"))
    fold = F.conv(F.substring(F.sha2(F.col(group).cast("string"), 256), 1, 8), 16, 10).cast("bigint") % folds
    return rows.filter(f"NOT {right}").join(best, group).select(group, fold.cast("int").alias("fold"), *((F.col(f"best.{f}") - F.col(f)).alias(f) for f in features))
