"""Replay of stored runs under stated rules: stage ranks, answers and states, a row for each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchforge.operators.rules import Rules


def stage_places(rows: DataFrame, rules: Rules) -> DataFrame:
    """`rows` (image, slug, cv, inliers, hard_conflicts, …) with the place of each candidate after each stage.

    retrieval: by similarity; geometry: by inliers where the leader is decisive,
    else by similarity (or by the floor share); text: the first candidates that
    contradict what was read go behind those that don't, as deep as the rules say.
    """
    by_image = Window.partitionBy("image")
    first = rows.withColumn("retrieval", F.row_number().over(by_image.orderBy(F.desc("cv"), "slug")) - 1)
    tops = F.sort_array(F.collect_list("inliers").over(by_image), asc=False)
    decisive = (F.size(tops) < 2) | (F.get(tops, F.lit(0)) >= F.get(tops, F.lit(1)) * (1 + rules.margin))
    low = F.lit(0) if rules.floor_share is None else (F.col("inliers") < rules.floor_share * F.get(tops, F.lit(0))).cast("int")
    second = first.withColumn("__key", F.when(decisive, -F.col("inliers")).otherwise(low))
    second = second.withColumn("geometry", F.row_number().over(by_image.orderBy("__key", F.desc("cv"), "retrieval")) - 1).drop("__key")
    struck = (F.col("hard_conflicts") > 0) & (F.col("geometry") < rules.depth) if rules.demote_contradicted else F.lit(False)
    inner = F.when(F.col("geometry") < rules.depth, struck.cast("int")).otherwise(2)
    return second.withColumn("text", F.row_number().over(by_image.orderBy(inner, "geometry")) - 1)


def image_report(placed: DataFrame) -> DataFrame:
    """(image, gold, top1, rank_retrieval, rank_geometry, rank_text, correct, in_top3, in_top5): a row for each image; -1 where the right card isn't there."""
    own = F.col("slug") == F.col("gold")

    def rank(stage: str) -> Column:
        return F.coalesce(F.min(F.when(own, F.col(stage))), F.lit(-1)).cast("int").alias(f"rank_{stage}")

    found = placed.groupBy("image").agg(F.max("gold").alias("gold"), F.min_by("slug", "text").alias("top1"), *map(rank, ("retrieval", "geometry", "text")))
    flags = {"correct": F.col("rank_text") == 0, "in_top3": F.col("rank_text").between(0, 2), "in_top5": F.col("rank_text").between(0, 4)}
    return found.withColumns(flags)
