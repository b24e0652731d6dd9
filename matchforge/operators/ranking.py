"""Orders, features and decisions over candidates: one row for each (query_id, slug), place from 0, evidence as columns.

Every window is over one query's candidates, a shortlist of bounded length; all
orders end in place, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from matchforge.functions.statistics import outcome_probabilities

MARGIN, CLOSE, DEMOTE_DEPTH, TAIL_FROM = 0.5, 0.8, 4, 5


def of_query() -> WindowSpec:
    return Window.partitionBy("query_id")


def per_query(c: Column) -> Column:
    return c.over(of_query())


def ranked(candidates: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """A new place from 0 by `order`, then by the old place."""
    return candidates.withColumn(name, F.row_number().over(of_query().orderBy(*order, "place")) - 1)


def decisive(margin: float = MARGIN) -> Column:
    """Is the most inliers at least (1 + margin) times the second most, or is there no second?"""
    counts = F.array_sort(per_query(F.collect_list(F.col("inliers").cast("int"))), lambda a, b: b - a)
    return (F.size(counts) < 2) | (F.get(counts, F.lit(0)) >= F.get(counts, F.lit(1)) * (1 + margin))


def margin_order(candidates: DataFrame, margin: float = MARGIN) -> DataFrame:
    """By inliers and similarity if the first is decisive, else by similarity alone."""
    flagged = candidates.withColumn("decisive", decisive(margin))
    return ranked(flagged, F.when(F.col("decisive"), F.col("inliers")).otherwise(0).desc(), F.desc("cv"))


#: Name of an order to the sort keys of a candidate; larger first.
SCHEMES: dict[str, Callable[[], list[Column]]] = {
    "cosine": lambda: [F.col("cv")],
    "inliers": lambda: [F.col("inliers"), F.col("cv")],
    "product": lambda: [F.col("inliers") * F.col("cv")],
    "cosine_in_close": lambda: [(F.col("inliers") >= CLOSE * per_query(F.max("inliers"))).cast("int"), F.col("cv")],
    "inside_five": lambda: [(F.col("place") < 5).cast("int"), F.when(F.col("place") < 5, F.col("inliers")).otherwise(0), F.col("cv")],
    "inliers_coverage": lambda: [F.col("inliers") * F.col("coverage"), F.col("cv")],
}


def all_schemes(candidates: DataFrame) -> DataFrame:
    """The first candidate of each query under each order."""
    out = None
    for name, keys in SCHEMES.items():
        order = of_query().orderBy(*[F.desc(f"__k{i}") for i in range(len(keys()))], "place")
        keyed = candidates.withColumns({f"__k{i}": k for i, k in enumerate(keys())})
        first = keyed.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(F.lit(name).alias("scheme"), "query_id", "slug")
        out = first if out is None else out.unionAll(first)
    return out


def leader_features(candidates: DataFrame) -> DataFrame:
    """The seven features of each query's leader against its rival: the first later one without reasons, else the first later one."""
    leader, later = F.col("place") == 0, F.col("place") > 0
    rival_clean = F.min_by(F.struct("cv", "inliers"), F.when(later & (F.col("reasons") == 0), F.col("place")))
    rival_any = F.min_by(F.struct("cv", "inliers"), F.when(later, F.col("place")))
    falling = candidates.withColumn("__rank", F.row_number().over(of_query().orderBy(F.desc("cv"), "place")) - 1)
    folded = falling.groupBy("query_id").agg(
        F.max(F.when(leader, F.struct("slug", "cv", "inliers", "coverage", "reasons"))).alias("l"),
        F.coalesce(F.when(F.count_if(later & (F.col("reasons") == 0)) > 0, rival_clean), F.when(F.count_if(later) > 0, rival_any)).alias("r"),
        F.coalesce(F.avg(F.when(F.col("__rank") >= TAIL_FROM, F.col("cv"))), F.avg("cv")).alias("tail"),
        F.max(F.when(later & (F.col("reasons") > 0), 1).otherwise(0)).alias("others"),
        F.first(F.col("conflicts")).alias("conflicts") if "conflicts" in candidates.columns else F.lit(0).alias("conflicts"),
    )
    li, ri = F.col("l.inliers").cast("double"), F.coalesce(F.col("r.inliers"), F.lit(0)).cast("double")
    return folded.select(
        "query_id",
        F.col("l.slug").alias("slug"),
        F.coalesce(F.try_divide(li, li + ri), F.lit(0.0)).alias("dominance"),
        F.log1p(li).alias("log_inliers"),
        F.coalesce(F.col("l.cv") - F.col("r.cv"), F.lit(0.0)).alias("cv_margin"),
        (F.col("l.cv") - F.col("tail")).alias("cv_lift"),
        F.col("l.coverage").alias("coverage"),
        ((F.col("l.reasons") == 0) & (F.col("others") == 1)).cast("double").alias("text_support"),
        (F.least(F.col("conflicts"), F.lit(3)) / 3.0).alias("text_conflict"),
    )


def with_outcomes(features: DataFrame) -> DataFrame:
    p1, p5 = outcome_probabilities({c: F.col(c) for c in features.columns})
    return features.withColumn("p_top1", p1).withColumn("p_top5", p5)


def close_groups(candidates: DataFrame, share: float = CLOSE) -> DataFrame:
    """Queries and whether two candidates or more come close to the most inliers."""
    close = candidates.withColumn("__close", F.col("inliers") >= share * per_query(F.max("inliers")))
    return close.groupBy("query_id").agg((F.count_if("__close") >= 2).alias("close_group"), F.max("inliers").alias("most"))


def geometry_backs(candidates: DataFrame) -> DataFrame:
    """Is a candidate near the best and well ahead of the leader by inliers?"""
    best = per_query(F.max("inliers"))
    lead = per_query(F.max(F.when(F.col("place") == 0, F.col("inliers"))))
    return candidates.withColumn("backed", (best > 0) & (F.col("inliers") >= CLOSE * best) & (F.col("inliers") >= 1.5 * lead))


def demoted(candidates: DataFrame, hard: str = "hard", depth: Column | None = None) -> DataFrame:
    """Move contradicted leaders behind the first clean candidate, `depth` (four) steps at most: the loop as one sort key."""
    i = F.col("place")
    k = per_query(F.min(F.when(~F.col(hard), i)))
    m = F.least(k, F.lit(DEMOTE_DEPTH) if depth is None else depth)
    key = F.when(k.isNull() | (k == 0), i).when(i < m, k - i).when(i < k, i - m).when(i == k, k - m).otherwise(i)
    keyed = candidates.withColumn("__key", key)
    return keyed.withColumn("place", F.row_number().over(of_query().orderBy("__key", "place")) - 1).drop("__key")


def own_first(candidates: DataFrame, own: Column) -> DataFrame:
    """A stable partition: own candidates first, each part in its old order."""
    return ranked(candidates.withColumn("__own", own.cast("int")), F.desc("__own")).drop("__own")


def by_reasons(candidates: DataFrame) -> DataFrame:
    """Fewer reasons against first."""
    return ranked(candidates, F.col("reasons"))


def vote_winner(candidates: DataFrame, least: int = 2) -> DataFrame:
    """The one candidate with most votes, more than the leader's and at least `least`, goes to the front."""
    most = per_query(F.max("votes"))
    alone = per_query(F.count_if(F.col("votes") == F.col("__most"))) == 1
    lead = per_query(F.max(F.when(F.col("place") == 0, F.col("votes"))))
    flagged = candidates.withColumn("__most", most).withColumn("__won", (F.col("votes") == F.col("__most")) & alone & (F.col("votes") > lead) & (F.col("votes") >= least))
    return ranked(flagged, F.desc("__won")).drop("__won", "__most")


def weighted_multiplicity(points: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Score of (query_id, slug): the sum over its points of the number of different slugs that have them, to the power -alpha."""
    distinct = points.select("query_id", "slug", "point").distinct()
    shared = distinct.groupBy("query_id", "point").agg(F.count("*").alias("m"))
    return distinct.join(shared, ["query_id", "point"]).groupBy("query_id", "slug").agg(F.sum(F.pow(F.col("m").cast("double"), F.lit(-alpha))).alias("weighted"), F.count("*").alias("points"))


def grid_coverage(points: DataFrame, grid: int = 4) -> DataFrame:
    """Share of grid cells that hold points x, y in 0 .. 1, and the share of the area that they span; 0 for fewer than three points."""
    cell = F.struct(F.least(F.floor(F.col("x") * grid), F.lit(grid - 1)), F.least(F.floor(F.col("y") * grid), F.lit(grid - 1)))
    span = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    enough = F.count("*") >= 3
    return points.groupBy("query_id").agg(
        F.when(enough, F.countDistinct(cell) / float(grid * grid)).otherwise(0.0).alias("coverage"), F.when(enough, F.least(span, F.lit(1.0))).otherwise(0.0).alias("spread")
    )


def capped(scored: DataFrame, group: list[str], cap: int, limit: int, *order: Column) -> DataFrame:
    """The best `limit` rows of each `group`'s query with at most `cap` of one maker."""
    within = F.row_number().over(Window.partitionBy(*group, "maker").orderBy(*order))
    few = scored.withColumn("__n", within).filter(F.col("__n") <= cap).drop("__n")
    if not group:
        few = few.orderBy(*order).limit(limit)  # the one window below sees no more than these
    place = F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order))
    return few.withColumn("rank", place).filter(F.col("rank") <= limit)


def fused(candidates: DataFrame, texts: DataFrame, text_weight: float, attribute_weight: float = 0.0, limit: int = 5) -> DataFrame:
    """(1 - w) * similarity scaled to 0 .. 1 within the query + w * text + attribute weight * agreement; text alone without candidates."""
    lo, hi = per_query(F.min("cv")), per_query(F.max("cv"))
    scaled = candidates.withColumn("norm", F.coalesce(F.try_divide(F.col("cv") - lo, hi - lo), F.lit(0.0)))
    both = scaled.join(texts, ["query_id", "slug"], "full")
    some = per_query(F.count("norm")) > 0
    score = (1 - text_weight) * F.coalesce("norm", F.lit(0.0)) + text_weight * F.coalesce("text", F.lit(0.0))
    if attribute_weight:
        score = score + attribute_weight * F.coalesce("agreement", F.lit(0.0))
    kept = both.withColumn("__some", some).filter(F.col("norm").isNotNull() | ~F.col("__some"))
    scored = kept.withColumn("score", F.when(F.col("__some"), score).otherwise(F.coalesce("text", F.lit(0.0))))
    return scored.withColumn("place", F.row_number().over(of_query().orderBy(F.desc("score"), "slug")) - 1).filter(F.col("place") < limit)
