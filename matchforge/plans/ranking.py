"""Ranking queries: candidates are the labels nearest to each query vector, evidence is worked out of row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchforge.functions import words
from matchforge.operators import knn, ranking
from matchforge.plans.registry import query
from matchforge.plans.vectors import BEST, index_rows, query_rows, r6
from matchforge.sources.tables import table

EVIDENCE = f"""{BEST}, cand AS (SELECT query_id, slug, row_id, cv, place, (row_id * 7 + query_id * 13) % 40 AS inliers, ((row_id * 3 + query_id) % 16) / 16.0::DOUBLE AS coverage,
CASE WHEN (row_id + query_id) % 4 = 0 THEN 1 ELSE 0 END AS reasons, (row_id + query_id) % 3 = 0 AS hard, slug::INT % 3 AS maker, (row_id * 5 + query_id) % 6 AS votes, query_id // 100 % 5 AS conflicts FROM best)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored-run replay: similarities with evidence columns."""
    best = knn.placed(knn.best_by_key(index_rows(spark, sf_dir), query_rows(spark, sf_dir)))
    row, q = F.col("row_id"), F.col("query_id")
    return best.select(
        "query_id", "slug", "row_id", "cv", "place", ((row * 7 + q * 13) % 40).alias("inliers"), (((row * 3 + q) % 16) / 16.0).alias("coverage"),
        F.when((row + q) % 4 == 0, 1).otherwise(0).alias("reasons"), ((row + q) % 3 == 0).alias("hard"), (F.col("slug").cast("int") % 3).alias("maker"),
        ((row * 5 + q) % 6).alias("votes"), (F.floor(q / 100) % 5).alias("conflicts"),
    )


@query(
    f"""WITH {EVIDENCE}, counts AS (SELECT query_id, list(inliers ORDER BY inliers DESC) AS c FROM cand GROUP BY 1),
    flagged AS (SELECT cand.*, len(c) < 2 OR c[1] >= c[2] * 1.5 AS decisive FROM cand JOIN counts USING (query_id))
    SELECT query_id, slug, decisive, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN decisive THEN inliers ELSE 0 END DESC, cv DESC, place) - 1 AS INT) AS place FROM flagged"""
)
def margin_conditional_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.margin_order(candidates(spark, sf_dir)).select("query_id", "slug", "decisive", "place")


@query(
    f"""WITH {EVIDENCE}, k AS (SELECT *, max(inliers) OVER (PARTITION BY query_id) AS most FROM cand), s AS (
    SELECT 'cosine' AS scheme, query_id, slug, place, cv AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM k
    UNION ALL SELECT 'inliers', query_id, slug, place, inliers, cv, 0 FROM k
    UNION ALL SELECT 'product', query_id, slug, place, inliers * cv, 0, 0 FROM k
    UNION ALL SELECT 'cosine_in_close', query_id, slug, place, (inliers >= 0.8 * most)::INT, cv, 0 FROM k
    UNION ALL SELECT 'inside_five', query_id, slug, place, (place < 5)::INT, CASE WHEN place < 5 THEN inliers ELSE 0 END, cv FROM k
    UNION ALL SELECT 'inliers_coverage', query_id, slug, place, inliers * coverage, cv, 0 FROM k)
    SELECT scheme, query_id, slug FROM s QUALIFY row_number() OVER (PARTITION BY scheme, query_id ORDER BY a DESC, b DESC, c DESC, place) = 1"""
)
def ordering_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.all_schemes(candidates(spark, sf_dir))


FEATURES_SQL = f"""{EVIDENCE}, lead AS (SELECT * FROM cand WHERE place = 0), rest AS (SELECT * FROM cand WHERE place > 0),
rival AS (SELECT query_id, cv, inliers FROM rest QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY reasons > 0, place) = 1),
tail AS (SELECT query_id, coalesce(avg(cv) FILTER (WHERE n > 5), avg(cv)) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cv DESC, place) AS n FROM cand) GROUP BY 1),
others AS (SELECT query_id, max(reasons) AS others FROM rest GROUP BY 1),
feat AS (SELECT l.query_id, l.slug, CASE WHEN l.inliers + coalesce(r.inliers, 0) = 0 THEN 0.0 ELSE l.inliers::DOUBLE / (l.inliers + coalesce(r.inliers, 0)) END AS dominance,
ln(1 + l.inliers) AS log_inliers, coalesce(l.cv - r.cv, 0) AS cv_margin, l.cv - t.tail AS cv_lift, l.coverage, (l.reasons = 0 AND coalesce(o.others, 0) = 1)::INT::DOUBLE AS text_support,
least(l.conflicts, 3) / 3.0::DOUBLE AS text_conflict FROM lead l LEFT JOIN rival r USING (query_id) JOIN tail t USING (query_id) LEFT JOIN others o USING (query_id))"""


@query(f"WITH {FEATURES_SQL} SELECT query_id, slug, {', '.join(f'round({c}, 6) AS {c}' for c in words.FEATURES)} FROM feat")
def leader_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = ranking.leader_features(candidates(spark, sf_dir))
    return features.select("query_id", "slug", *[r6(c).alias(c) for c in words.FEATURES])


def logit(j: int) -> str:
    return " + ".join(f"{c} * ({w[j]!r}::DOUBLE)" for c, w in zip([*words.FEATURES, "1"], words.OUTCOME_WEIGHTS, strict=True))


OUTCOME_SQL = f"""{FEATURES_SQL}, logits AS (SELECT *, {logit(0)} AS l0, {logit(1)} AS l1, {logit(2)} AS l2 FROM feat),
parts AS (SELECT *, exp(greatest(l0 - greatest(l0, l1, l2), -30)) AS e0, exp(greatest(l1 - greatest(l0, l1, l2), -30)) AS e1, exp(greatest(l2 - greatest(l0, l1, l2), -30)) AS e2 FROM logits),
prob AS (SELECT *, e0 / (e0 + e1 + e2) AS p_top1, (e0 + e1) / (e0 + e1 + e2) AS p_top5 FROM parts)"""


@query(f"WITH {OUTCOME_SQL} SELECT query_id, slug, round(p_top1, 6) AS p_top1, round(p_top5, 6) AS p_top5 FROM prob")
def outcome_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.with_outcomes(ranking.leader_features(candidates(spark, sf_dir)))
    return found.select("query_id", "slug", r6("p_top1").alias("p_top1"), r6("p_top5").alias("p_top5"))


@query(
    f"""WITH {OUTCOME_SQL}, crowd AS (SELECT query_id, count(*) FILTER (WHERE inliers >= 0.8 * most) >= 2 OR count(*) FILTER (WHERE place > 0 AND maker = lead_maker) >= 2 AS crowded
    FROM (SELECT *, max(inliers) OVER (PARTITION BY query_id) AS most, max(CASE WHEN place = 0 THEN maker END) OVER (PARTITION BY query_id) AS lead_maker FROM cand) GROUP BY 1)
    SELECT query_id, slug, CASE WHEN p_top1 < {words.SHOW_P} THEN 'unsure' WHEN p_top1 >= {words.CONFIDENT_P} AND query_id // 100 % 5 = 0 AND NOT crowded THEN 'confident' ELSE 'uncertain' END AS state
    FROM prob JOIN crowd USING (query_id)"""
)
def output_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsure below the first threshold; confident above the second if nothing speaks against it and no close rival crowds it."""
    rows = candidates(spark, sf_dir)
    most, lead_maker = ranking.per_query(F.max("inliers")), ranking.per_query(F.max(F.when(F.col("place") == 0, F.col("maker"))))
    flagged = rows.withColumn("near", F.col("inliers") >= 0.8 * most).withColumn("kin", (F.col("place") > 0) & (F.col("maker") == lead_maker))
    crowd = flagged.groupBy("query_id").agg(((F.count_if("near") >= 2) | (F.count_if("kin") >= 2)).alias("crowded"))
    found = ranking.with_outcomes(ranking.leader_features(rows)).join(crowd, "query_id")
    p = F.col("p_top1")
    may_drop = (F.col("text_conflict") == 0) & ~F.col("crowded")
    state = F.when(p < words.SHOW_P, "unsure").when((p >= words.CONFIDENT_P) & may_drop, "confident").otherwise("uncertain")
    return found.select("query_id", "slug", state.alias("state"))


@query(
    f"""WITH {EVIDENCE} SELECT query_id, count(*) FILTER (WHERE inliers >= 0.8 * most) >= 2 AS close_group, max(inliers) AS most
    FROM (SELECT *, max(inliers) OVER (PARTITION BY query_id) AS most FROM cand) GROUP BY 1"""
)
def close_group_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.close_groups(candidates(spark, sf_dir))


@query(
    f"""WITH {EVIDENCE}, m AS (SELECT *, max(inliers) OVER (PARTITION BY query_id) AS best, max(CASE WHEN place = 0 THEN inliers END) OVER (PARTITION BY query_id) AS led FROM cand)
    SELECT query_id, slug, best > 0 AND inliers >= 0.8 * best AND inliers >= 1.5 * led AS backed FROM m"""
)
def geometry_backs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.geometry_backs(candidates(spark, sf_dir)).select("query_id", "slug", "backed")


@query(
    f"""WITH {EVIDENCE}, k AS (SELECT *, min(CASE WHEN NOT hard THEN place END) OVER (PARTITION BY query_id) AS k FROM cand), m AS (SELECT *, least(k, 4) AS m FROM k)
    SELECT query_id, slug, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN k IS NULL OR k = 0 THEN place WHEN place < m THEN k - place WHEN place < k THEN place - m WHEN place = k THEN k - m ELSE place END, place) - 1 AS INT) AS place FROM m"""
)
def demote_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.demoted(candidates(spark, sf_dir)).select("query_id", "slug", "place")


@query(f"WITH {EVIDENCE} SELECT query_id, slug, CAST(row_number() OVER (PARTITION BY query_id ORDER BY (maker = query_id % 3)::INT DESC, place) - 1 AS INT) AS place FROM cand")
def own_brand_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.own_first(candidates(spark, sf_dir), F.col("maker") == F.col("query_id") % 3).select("query_id", "slug", "place")


@query(f"WITH {EVIDENCE} SELECT query_id, slug, CAST(row_number() OVER (PARTITION BY query_id ORDER BY reasons, place) - 1 AS INT) AS place FROM cand")
def order_by_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.by_reasons(candidates(spark, sf_dir)).select("query_id", "slug", "place")


@query(
    f"""WITH {EVIDENCE}, v AS (SELECT *, max(votes) OVER w AS most, max(CASE WHEN place = 0 THEN votes END) OVER w AS led FROM cand WINDOW w AS (PARTITION BY query_id)),
    w AS (SELECT *, votes = most AND count(*) FILTER (WHERE votes = most) OVER (PARTITION BY query_id) = 1 AND votes > led AND votes >= 2 AS won FROM v)
    SELECT query_id, slug, CAST(row_number() OVER (PARTITION BY query_id ORDER BY won DESC, place) - 1 AS INT) AS place FROM w"""
)
def text_vote_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.vote_winner(candidates(spark, sf_dir)).select("query_id", "slug", "place")


@query(
    """WITH d AS (SELECT DISTINCT l_orderkey AS query_id, l_suppkey AS slug, l_partkey % 50 AS point FROM lineitem), m AS (SELECT query_id, point, count(*) AS m FROM d GROUP BY 1, 2)
    SELECT query_id, slug, round(sum(1.0::DOUBLE / m), 6) AS weighted, count(*) AS points FROM d JOIN m USING (query_id, point) GROUP BY 1, 2"""
)
def weighted_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for queries, suppliers for keys, parts for points."""
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("slug"), (F.col("l_partkey") % 50).alias("point"))
    return ranking.weighted_multiplicity(points).withColumn("weighted", r6("weighted"))


@query(
    """WITH p AS (SELECT l_orderkey AS query_id, (l_partkey % 97) / 97.0::DOUBLE AS x, (l_suppkey % 89) / 89.0::DOUBLE AS y FROM lineitem)
    SELECT query_id, CASE WHEN count(*) >= 3 THEN count(DISTINCT (least(floor(x * 4), 3), least(floor(y * 4), 3))) / 16.0::DOUBLE ELSE 0 END AS coverage,
    round(CASE WHEN count(*) >= 3 THEN least((max(x) - min(x)) * (max(y) - min(y)), 1) ELSE 0 END, 6) AS spread FROM p GROUP BY 1"""
)
def grid_cell_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), ((F.col("l_partkey") % 97) / 97.0).alias("x"), ((F.col("l_suppkey") % 89) / 89.0).alias("y"))
    return ranking.grid_coverage(points).withColumn("spread", r6("spread"))


@query(
    f"""WITH {EVIDENCE}, t AS (SELECT query_id, slug, ((slug::INT * 3 + query_id) % 10) / 10.0::DOUBLE AS text, CASE WHEN maker = query_id % 3 THEN 1.0 ELSE -0.5 END AS agreement FROM cand),
    n AS (SELECT *, (cv - min(cv) OVER w) / nullif(max(cv) OVER w - min(cv) OVER w, 0) AS norm FROM cand WINDOW w AS (PARTITION BY query_id)),
    s AS (SELECT query_id, slug, 0.7 * coalesce(norm, 0) + 0.3 * text + 0.2 * agreement AS score FROM n JOIN t USING (query_id, slug))
    SELECT query_id, slug, round(score::DOUBLE, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) - 1 AS INT) AS place FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) <= 5"""
)
def late_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    text = ((F.col("slug").cast("int") * 3 + F.col("query_id")) % 10) / 10.0
    texts = rows.select("query_id", "slug", text.alias("text"), F.when(F.col("maker") == F.col("query_id") % 3, 1.0).otherwise(-0.5).alias("agreement"))
    return ranking.fused(rows.select("query_id", "slug", "cv"), texts, 0.3, 0.2).select("query_id", "slug", r6("score").alias("score"), "place")


@query(
    f"""WITH {OUTCOME_SQL}, vlm AS (SELECT query_id, slug, place, ((row_id * 11 + query_id * 3) % 100) / 100.0::DOUBLE AS p_yes FROM cand),
    led AS (SELECT query_id, slug AS leader, p_yes AS lead_yes FROM vlm WHERE place = 0),
    nxt AS (SELECT query_id, slug AS next_slug FROM vlm WHERE place IN (1, 2) AND p_yes >= 0.8 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) = 1)
    SELECT p.query_id, CASE WHEN p_top1 >= 0.1 THEN CASE WHEN p_top1 < 0.3 AND lead_yes < 0.05 THEN NULL ELSE leader END WHEN lead_yes >= 0.8 THEN leader ELSE next_slug END AS answer,
    CASE WHEN p_top1 >= 0.1 THEN CASE WHEN p_top1 < 0.3 AND lead_yes < 0.05 THEN 'vetoed' ELSE 'shown' END WHEN lead_yes >= 0.8 THEN 'confirmed' WHEN next_slug IS NOT NULL THEN 'replaced' ELSE 'unsure' END AS route
    FROM prob p JOIN led USING (query_id) LEFT JOIN nxt USING (query_id)"""
)
def arbitration_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second judge's yes-probability comes in as a column: it confirms, replaces or vetoes the leader."""
    rows = candidates(spark, sf_dir)
    judged = rows.withColumn("p_yes", ((F.col("row_id") * 11 + F.col("query_id") * 3) % 100) / 100.0)
    sides = judged.groupBy("query_id").agg(
        F.max(F.when(F.col("place") == 0, F.struct(F.col("slug").alias("leader"), F.col("p_yes").alias("yes")))).alias("lead"),
        F.min(F.when(F.col("place").isin(1, 2) & (F.col("p_yes") >= 0.8), F.struct("place", "slug"))).alias("next"),
    )
    found = ranking.with_outcomes(ranking.leader_features(rows)).join(sides, "query_id")
    shown, vetoed, sure = F.col("p_top1") >= 0.1, (F.col("p_top1") < 0.3) & (F.col("lead.yes") < 0.05), F.col("lead.yes") >= 0.8
    answer = F.when(shown & vetoed, None).when(shown | sure, F.col("lead.leader")).otherwise(F.col("next.slug"))
    route = F.when(shown & vetoed, "vetoed").when(shown, "shown").when(sure, "confirmed").when(F.col("next").isNotNull(), "replaced").otherwise("unsure")
    return found.select("query_id", answer.alias("answer"), route.alias("route"))
