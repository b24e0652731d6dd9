"""Evaluation queries: labels.quality is what is true, a score worked out of the document is what was said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchforge.functions.statistics import wilson
from matchforge.operators import calibration, evaluation, order, sampling
from matchforge.plans.registry import query
from matchforge.plans.vectors import r6
from matchforge.sources.tables import table

CASES = """cases AS (SELECT d.doc_id, source, lang, quality, (n_chars * 7 + d.doc_id * 13) % 101 / 100.0::DOUBLE AS probability, CASE WHEN quality = 1 THEN source END AS gold,
(n_chars + d.doc_id) % 3 <> 0 AND quality = 1 AS correct, (n_chars + d.doc_id) % 5 <> 0 AND quality = 1 AS in_top3, (n_chars + d.doc_id) % 7 <> 0 AND quality = 1 AS in_top5 FROM documents d JOIN labels USING (doc_id))"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    n, i, good = F.col("n_chars"), F.col("doc_id"), F.col("quality") == 1
    return d.select(
        "doc_id", "source", "lang", "quality", ((n * 7 + i * 13) % 101 / 100.0).alias("probability"), F.when(good, F.col("source")).alias("gold"),
        (((n + i) % 3 != 0) & good).alias("correct"), (((n + i) % 5 != 0) & good).alias("in_top3"), (((n + i) % 7 != 0) & good).alias("in_top5"),
    )


WILSON_SQL = "greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)) AS low, least(1, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)) AS high"


@query(f"WITH {CASES}, g AS (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (WHERE correct)::DOUBLE AS k FROM cases GROUP BY 1), w AS (SELECT lang, n, k, {WILSON_SQL} FROM g) SELECT lang, n::BIGINT AS n, k::BIGINT AS k, round(low::DOUBLE, 6) AS low, round(high::DOUBLE, 6) AS high FROM w")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = cases(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("correct").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return counted.select("lang", "n", "k", r6(low).alias("low"), r6(high).alias("high"))


@query(f"""WITH {CASES}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT correct AND in_top3) AS fixed, count(*) FILTER (WHERE correct AND NOT in_top3) AS broken, count(*) FILTER (WHERE in_top3) AS "right" FROM cases) SELECT n, fixed, broken, "right" FROM c""")
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    return evaluation.paired(rows, rows.withColumn("correct", F.col("in_top3")), "doc_id").select("n", "fixed", "broken", "right")


@query(f"""WITH {CASES}, h AS (SELECT 1 AS k, correct AS hit, gold, probability FROM cases UNION ALL SELECT 3, in_top3, gold, probability FROM cases UNION ALL SELECT 5, in_top5, gold, probability FROM cases),
c AS (SELECT k, count(*) FILTER (WHERE probability >= 0.1 AND gold IS NOT NULL AND hit) AS tp, count(*) FILTER (WHERE probability >= 0.1) AS shown, count(*) FILTER (WHERE gold IS NOT NULL) AS pos FROM h GROUP BY 1)
SELECT k, tp, shown - tp AS fp, pos - tp AS fn, tp / shown::DOUBLE AS precision, tp / pos::DOUBLE AS recall, 2 * tp / (2 * tp + shown - tp + pos - tp)::DOUBLE AS f1 FROM c""")
def f1_with_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.f1_with_rejection(cases(spark, sf_dir), 0.1)


CREDIT = """count(*) FILTER (WHERE gold IS NOT NULL AND probability >= t AND correct) AS strict_score, count(*) AS strict_n,
count(*) FILTER (WHERE (gold IS NULL AND probability < t) OR (gold IS NOT NULL AND probability >= t AND correct)) AS null_ok_score, count(*) AS null_ok_n,
count(*) FILTER (WHERE gold IS NOT NULL AND probability >= t AND correct) AS positives_score, count(gold) AS positives_n"""


@query(f"WITH {CASES}, g AS (SELECT cases.*, t FROM cases, (VALUES (0.0), (0.1), (0.4)) v(t)) SELECT t::DOUBLE AS threshold, {CREDIT} FROM g GROUP BY t")
def credited_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.swept(cases(spark, sf_dir), [0.0, 0.1, 0.4])


GRID = [round(0.02 * k, 2) for k in range(1, 30)]


@query(f"WITH {CASES}, g AS (SELECT cases.*, t FROM cases, (SELECT unnest({GRID}) AS t)) SELECT t::DOUBLE AS threshold, {CREDIT} FROM g GROUP BY t")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.swept(cases(spark, sf_dir), GRID)


@query(f"WITH {CASES}, g AS (SELECT cases.*, t FROM cases, (SELECT unnest({GRID}) AS t)), s AS (SELECT t::DOUBLE AS threshold, {CREDIT} FROM g GROUP BY t) SELECT threshold, null_ok_score AS score FROM s ORDER BY score DESC, threshold LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_threshold(evaluation.swept(cases(spark, sf_dir), GRID), "null_ok_score")


@query(f"WITH {CASES} SELECT CASE WHEN probability < 0.05 THEN 0 WHEN probability < 0.15 THEN 1 WHEN probability < 0.3 THEN 2 WHEN probability < 0.5 THEN 3 ELSE 4 END AS bin, count(*) AS n, round(avg(probability), 6) AS declared, round(avg(correct::INT::DOUBLE), 6) AS actual FROM cases GROUP BY 1")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.reliability(cases(spark, sf_dir), [0.0, 0.05, 0.15, 0.3, 0.5, 1.01])
    return found.select("bin", "n", r6("declared").alias("declared"), r6("actual").alias("actual"))


@query(f"""WITH {CASES}, c AS (SELECT *, gold IS NOT NULL AS present, probability >= 0.1 AS shown FROM cases)
SELECT count(*) FILTER (WHERE shown AND present AND correct) / greatest(count(*) FILTER (WHERE shown AND present), 1)::DOUBLE AS precision, count(*) FILTER (WHERE shown AND present) / greatest(count(*) FILTER (WHERE present), 1)::DOUBLE AS coverage,
count(*) FILTER (WHERE present AND correct AND NOT shown) / greatest(count(*) FILTER (WHERE present), 1)::DOUBLE AS false_refusal, count(*) FILTER (WHERE NOT present AND shown) / greatest(count(*) FILTER (WHERE NOT present), 1)::DOUBLE AS false_accept FROM c""")
def calibration_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibration(cases(spark, sf_dir).withColumn("present", F.col("gold").isNotNull()), F.col("probability") >= 0.1)


@query("""WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value) FILTER (WHERE i = ceil(0.95 * n)), 6) AS p95_rank, round(max(value) FILTER (WHERE i = n // 2 + 1), 6) AS upper_median, round(max(value), 6) AS most FROM n GROUP BY 1""")
def percentile_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "value")
    n = F.col("n")
    linear = order.percentiles(events, "event_type", "value", {"median": 0.5, "p95": 0.95})
    ranked = order.at_ranks(events, "event_type", "value", {"p95_rank": order.nearest_rank(n, 0.95), "upper_median": F.floor(n / 2) + 1, "most": n})
    return linear.drop("n").join(ranked, "event_type").select("event_type", *[r6(c).alias(c) for c in ("median", "p95", "p95_rank", "upper_median", "most")])


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS over, round(count(*) FILTER (WHERE value > 50) / count(*)::DOUBLE, 6) AS share FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def latency_over_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only events with a readable body are timed; the others are errors."""
    ok = table(spark, sf_dir, "events").filter(F.get_json_object("props", "$.k").isNotNull())
    over = F.count_if(F.col("value") > 50)
    return ok.groupBy("event_type").agg(F.count("*").alias("n"), over.alias("over"), r6(over / F.count("*")).alias("share"))


STAGE_SQL = "CASE WHEN gold IS NULL THEN 'absent' WHEN NOT in_top5 THEN 'retrieval' WHEN NOT in_top3 THEN 'geometry' WHEN NOT correct THEN 'text' WHEN probability < 0.1 THEN 'refused' ELSE 'right' END"


@query(f"WITH {CASES} SELECT {STAGE_SQL} AS stage, lang, count(*) AS n FROM cases GROUP BY 1, 2")
def stage_of_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage at which the right answer was lost."""
    stage = F.when(F.col("gold").isNull(), "absent").when(~F.col("in_top5"), "retrieval").when(~F.col("in_top3"), "geometry").when(~F.col("correct"), "text").when(F.col("probability") < 0.1, "refused").otherwise("right")
    return cases(spark, sf_dir).groupBy(stage.alias("stage"), "lang").agg(F.count("*").alias("n"))


@query(f"WITH {CASES} SELECT doc_id, CASE WHEN in_top3 THEN 'fixed' ELSE 'broken' END AS change FROM cases WHERE correct <> in_top3")
def paired_run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).filter(F.col("correct") != F.col("in_top3")).select("doc_id", F.when(F.col("in_top3"), "fixed").otherwise("broken").alias("change"))


@query(f"WITH {CASES} SELECT source, count(*) FILTER (WHERE in_top3 AND NOT correct) AS fixed, count(*) FILTER (WHERE correct AND NOT in_top3) AS broken, count(DISTINCT lang) AS langs FROM cases WHERE correct <> in_top3 GROUP BY 1")
def changes_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = cases(spark, sf_dir).filter(F.col("correct") != F.col("in_top3"))
    return changed.groupBy("source").agg(F.count_if("in_top3").alias("fixed"), F.count_if("correct").alias("broken"), F.countDistinct("lang").alias("langs"))


@query(f"WITH {CASES} SELECT lang, CASE WHEN GROUPING(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS n, count(*) FILTER (WHERE correct) AS right_n FROM cases GROUP BY GROUPING SETS ((lang, source), (lang))")
def part_by_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by source with a line for all sources: grouping sets in one pass."""
    rows = cases(spark, sf_dir)
    grouped = rows.groupingSets([["lang", "source"], ["lang"]], "lang", "source").agg(F.grouping("source").alias("g"), F.count("*").alias("n"), F.count_if("correct").alias("right_n"))
    return grouped.select("lang", F.when(F.col("g") == 1, "all").otherwise(F.col("source")).alias("source"), "n", "right_n")


@query()
def mcnemar_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact paired test of the two variants, with the interval of the second."""
    rows = cases(spark, sf_dir)
    return evaluation.paired(rows, rows.withColumn("correct", F.col("in_top3")), "doc_id")


FEATURES = ["dominance", "log_inliers", "cv_margin", "cv_lift", "coverage", "text_support", "text_conflict"]


def calibration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven features of an answer, made of an order's lines, and what became of it: 0 right, 1 among the first five, 2 neither."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.max(q) / F.sum(q)).alias("dominance"), F.log1p(F.max(q)).alias("log_inliers"), (F.max(d) - F.avg(d)).alias("cv_margin"), (F.max(d) - F.min(d)).alias("cv_lift"), F.avg(t).alias("coverage"),
        F.max((F.col("l_returnflag") == "A").cast("double")).alias("text_support"), (F.least(F.count_if(F.col("l_returnflag") == "R"), F.lit(3)) / 3.0).alias("text_conflict"), F.sum("l_partkey").alias("k"),
    )
    noise = F.pmod(F.xxhash64("l_orderkey"), F.lit(1000)) / 1000.0
    ease = F.col("dominance") + F.col("text_support") - F.col("text_conflict") + noise - 0.5
    return rows.withColumn("outcome", F.when(ease > 0.7, 0).when(ease > 0.2, 1).otherwise(2)).drop("k")


@query()
def softmax_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the three-way outcome model in the features' own units."""
    model = calibration.fitted(calibration_rows(spark, sf_dir), FEATURES, "outcome", "multinomial")
    return calibration.outcome_weights(spark, model, FEATURES).withColumn("weight", F.round("weight", 4))


@query()
def binary_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of the binary model of right answers: tenths of the probability with the share that was right."""
    rows = calibration_rows(spark, sf_dir).withColumn("right", (F.col("outcome") == 0).cast("int"))
    scored = calibration.with_probabilities(rows, calibration.fitted(rows, FEATURES, "right", "binomial"), FEATURES)
    tenth = F.least(F.floor(F.col("p")[1] * 10), F.lit(9)).alias("tenth")
    return scored.groupBy(tenth).agg(F.count("*").alias("n"), F.round(F.avg(F.col("p")[1]), 4).alias("expected"), F.round(F.avg("right"), 4).alias("observed"))


@query()
def pairwise_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's first right order against each of its other orders, ranked by models of other folds: how often the right one comes first."""
    scored = calibration.ranked_out_of_fold(ranker_pairs(spark, sf_dir), FEATURES, 5)
    return scored.groupBy("fold").agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("score") > 0).cast("double")), 4).alias("right_first"))


def ranker_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer"))
    rows = calibration_rows(spark, sf_dir).join(owners, "l_orderkey").withColumn("right", F.col("outcome") == 0)
    return sampling.against_the_right(rows, "customer", "right", "l_orderkey", FEATURES, 5)
