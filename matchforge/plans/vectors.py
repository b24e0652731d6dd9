"""Nearest-neighbour queries over `embeddings`: label stands for the key, vec_id for the row, its parity for the view."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchforge.operators import knn
from matchforge.plans.registry import query
from matchforge.sources.tables import table

#: The stated set of queries: rows whose id this number divides.
EVERY = 100


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("slug"), (F.col("vec_id") % 2).alias("view"), "embedding")


def query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % EVERY == 0)
    return e.select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("gold"), "embedding")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


RAW = f"""q AS (SELECT vec_id AS query_id, label AS gold, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % {EVERY} = 0),
raw AS (SELECT query_id, gold, vec_id AS row_id, label::VARCHAR AS slug, vec_id % 2 AS view, list_dot_product(qe, embedding::DOUBLE[]) AS cv FROM q, embeddings)"""
BEST = f"""{RAW}, best AS (SELECT query_id, slug, row_id, view, cv, row_number() OVER (PARTITION BY query_id ORDER BY cv DESC, row_id) - 1 AS place
FROM (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY query_id, slug ORDER BY cv DESC, row_id) = 1))"""


@query(f"WITH {BEST} SELECT query_id, slug, row_id, round(cv, 6) AS cv, CAST(place AS INT) AS place FROM best WHERE place < 20")
def knn_topk_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = knn.placed(knn.best_by_key(index_rows(spark, sf_dir), query_rows(spark, sf_dir), 20))
    return best.select("query_id", "slug", "row_id", r6("cv").alias("cv"), "place")


@query(f"""WITH {RAW}, folded AS (SELECT query_id // 200 AS item, slug, max(cv) AS cv FROM raw GROUP BY ALL)
SELECT item, slug, round(cv, 6) AS cv, CAST(row_number() OVER (PARTITION BY item ORDER BY cv DESC, slug) - 1 AS INT) AS place FROM folded""")
def knn_multiview_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views of each query: the larger similarity counts, then the best view of each key."""
    best = knn.best_by_key(index_rows(spark, sf_dir), query_rows(spark, sf_dir))
    folded = best.groupBy(F.floor(F.col("query_id") / (2 * EVERY)).alias("item"), "slug").agg(F.max("cv").alias("cv"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("cv"), "slug")) - 1
    return folded.select("item", "slug", r6("cv").alias("cv"), place.alias("place"))


@query(f"""WITH {RAW} SELECT query_id, view, round(cv, 6) AS cv FROM (SELECT query_id, view, max(cv) AS cv FROM raw WHERE row_id <> query_id GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cv DESC, view) = 1""")
def knn_pick_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with the most similar other row; the first of equal ones."""
    rows = knn.top_rows(index_rows(spark, sf_dir), query_rows(spark, sf_dir), 2).filter("row_id <> query_id")
    best = rows.groupBy("query_id").agg(F.max_by(F.struct("view", "cv"), F.struct("cv", -F.col("view"))).alias("b"))
    return best.select("query_id", "b.view", r6("b.cv").alias("cv"))


SHORT = """ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cv DESC, row_id) AS rank FROM raw),
firsts AS (SELECT * FROM ranked WHERE rank <= 200 AND {keyed} QUALIFY row_number() OVER (PARTITION BY query_id, slug ORDER BY rank) = 1)
SELECT query_id, slug, row_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS INT) AS place, round(cv, 6) AS cv FROM firsts
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5"""


@query(f"WITH {RAW}, {SHORT.format(keyed='true')}")
def knn_depth_then_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 raw rows first, then different keys, then five."""
    found = knn.shortlist(index_rows(spark, sf_dir), query_rows(spark, sf_dir), 5, 200)
    return found.select("query_id", "slug", "row_id", "place", r6("cv").alias("cv"))


@query(f"WITH {RAW}, {SHORT.format(keyed='row_id % 7 <> 3')}")
def scope_mask_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of items out of scope lose their key but still use up depth."""
    index = index_rows(spark, sf_dir)
    masked = index.withColumn("slug", F.when(F.col("row_id") % 7 != 3, F.col("slug")))
    found = knn.shortlist(masked, query_rows(spark, sf_dir), 5, 200)
    return found.select("query_id", "slug", "row_id", "place", r6("cv").alias("cv"))


@query(f"""WITH {RAW}, slots AS (SELECT query_id, row_id, cv, CASE WHEN row_id % 7 = 3 THEN '#' || row_id ELSE slug END AS slot FROM raw),
firsts AS (SELECT * FROM slots QUALIFY row_number() OVER (PARTITION BY query_id, slot ORDER BY cv DESC, row_id) = 1)
SELECT query_id, slot, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cv DESC, row_id) - 1 AS INT) AS place FROM firsts
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cv DESC, row_id) <= 10""")
def knn_garbage_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In index evaluation each row without key keeps a slot of its own."""
    index = index_rows(spark, sf_dir)
    slot = F.when(F.col("row_id") % 7 == 3, F.concat(F.lit("#"), F.col("row_id").cast("string"))).otherwise(F.col("slug"))
    found = knn.placed(knn.best_by_key(index.withColumn("slug", slot), query_rows(spark, sf_dir)), 10)
    return found.select("query_id", F.col("slug").alias("slot"), "place")


OTHERS = f"""{RAW}, others AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cv DESC, row_id) - 1 AS place
FROM (SELECT * FROM raw WHERE row_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id, slug ORDER BY cv DESC, row_id) = 1)),
ranks AS (SELECT q.query_id, coalesce(min(place) FILTER (WHERE slug = q.gold::VARCHAR), -1) AS rank FROM q LEFT JOIN others o ON o.query_id = q.query_id GROUP BY q.query_id)"""


def others_best(index: DataFrame, queries: DataFrame) -> DataFrame:
    """The nearest row of each key but the query's own row, at any depth: rows that are queries are kept apart from their keys until it is left out."""
    asked = queries.select(F.col("query_id").alias("row_id"), F.lit(True).alias("asked"))
    apart = index.join(asked, "row_id", "left").withColumn("slug", F.when(F.col("asked"), F.concat("slug", F.lit("\x01"), "row_id")).otherwise(F.col("slug")))
    found = knn.best_by_key(apart, queries).filter("row_id <> query_id").withColumn("slug", F.substring_index("slug", "\x01", 1))
    best = F.max_by(F.struct("row_id", "cv"), F.struct("cv", -F.col("row_id")))
    return found.groupBy("query_id", "slug").agg(best.alias("r")).select("query_id", "slug", "r.row_id", "r.cv")


def gold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each query's own key among the others' nearest rows; -1 if it isn't there."""
    queries = query_rows(spark, sf_dir)
    first = others_best(index_rows(spark, sf_dir), queries)
    gold = queries.select("query_id", "gold").join(knn.placed(first), ["query_id"], "left").filter("slug = gold").select("query_id", "place")
    return queries.select("query_id").join(gold, "query_id", "left").select("query_id", F.coalesce("place", F.lit(-1)).alias("rank"))


@query(f"""WITH {OTHERS} SELECT k.k, count(*) AS n, avg(CASE WHEN rank BETWEEN 0 AND k.k - 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS recall,
round(avg(CASE WHEN rank >= 0 THEN 1.0 / (rank + 1) ELSE 0 END)::DOUBLE, 6) AS reciprocal FROM ranks, (VALUES (1), (3), (5), (10)) k(k) GROUP BY k.k""")
def gold_rank_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at several depths in one pass: every rank meets a constant list of depths."""
    ranks = gold_ranks(spark, sf_dir).withColumn("k", F.explode(F.array(*map(F.lit, (1, 3, 5, 10)))))
    inside = F.avg((F.col("rank").between(0, F.col("k") - 1)).cast("double"))
    reciprocal = F.avg(F.when(F.col("rank") >= 0, 1.0 / (F.col("rank") + 1)).otherwise(0.0))
    return ranks.groupBy("k").agg(F.count("*").alias("n"), inside.alias("recall"), r6(reciprocal).alias("reciprocal"))


@query(f"""WITH {OTHERS}, masked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cv DESC, row_id) - 1 AS place
FROM (SELECT * FROM raw WHERE row_id <> query_id AND view = 0 QUALIFY row_number() OVER (PARTITION BY query_id, slug ORDER BY cv DESC, row_id) = 1)),
other AS (SELECT q.query_id, coalesce(min(place) FILTER (WHERE slug = q.gold::VARCHAR), -1) AS rank FROM q LEFT JOIN masked o ON o.query_id = q.query_id GROUP BY q.query_id)
SELECT count(*) FILTER (WHERE a.rank = 0 AND b.rank <> 0) AS gained, count(*) FILTER (WHERE a.rank <> 0 AND b.rank = 0) AS lost,
count(*) FILTER (WHERE a.rank = 0) AS top1, count(*) FILTER (WHERE b.rank = 0) AS base_top1 FROM ranks a JOIN other b USING (query_id)""")
def recall_gain_loss_vs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views against one: queries won and lost at the first place."""
    both = gold_ranks(spark, sf_dir)
    queries = query_rows(spark, sf_dir)
    first = others_best(index_rows(spark, sf_dir).filter("view = 0"), queries)
    gold = queries.join(knn.placed(first), "query_id").filter("slug = gold").select("query_id", F.col("place").alias("base"))
    pairs = both.join(gold, "query_id", "left").withColumn("base", F.coalesce("base", F.lit(-1)))
    return pairs.agg(
        F.count_if(F.expr("rank = 0 and base <> 0")).alias("gained"), F.count_if(F.expr("rank <> 0 and base = 0")).alias("lost"), F.count_if(F.expr("rank = 0")).alias("top1"), F.count_if(F.expr("base = 0")).alias("base_top1")
    )


@query(f"""WITH {RAW}, cases AS (SELECT r.*, p.present FROM raw r, (VALUES (true), (false)) p(present)),
masked AS (SELECT query_id, present, slug, row_id, CASE WHEN NOT present AND slug = gold::VARCHAR THEN -1.0 ELSE cv END AS cv FROM cases)
SELECT query_id, present, slug, round(cv, 6) AS cv FROM (SELECT * FROM masked QUALIFY row_number() OVER (PARTITION BY query_id, present, slug ORDER BY cv DESC, row_id) = 1)
QUALIFY row_number() OVER (PARTITION BY query_id, present ORDER BY cv DESC, row_id) <= 3""")
def struck_gold_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query twice: as it is, and with its own key struck out, for calibration."""
    queries = query_rows(spark, sf_dir)
    best = knn.best_by_key(index_rows(spark, sf_dir), queries).join(queries.select("query_id", "gold"), "query_id")
    cases = best.withColumn("present", F.explode(F.array(F.lit(True), F.lit(False))))
    cases = cases.withColumn("cv", F.when(~F.col("present") & (F.col("slug") == F.col("gold")), -1.0).otherwise(F.col("cv")))
    place = F.row_number().over(Window.partitionBy("query_id", "present").orderBy(F.desc("cv"), "row_id"))
    return cases.withColumn("place", place).filter("place <= 3").select("query_id", "present", "slug", r6("cv").alias("cv"))


#: Settings of retrieval by name: a condition in Spark's SQL and DuckDB's.
SETTINGS = {"both": "true", "first view": "view = 0", "second view": "view = 1", "scope": "row_id % 7 <> 3", "scope, first view": "row_id % 7 <> 3 AND view = 0", "scope, second view": "row_id % 7 <> 3 AND view = 1"}


def reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index without the rows that ask."""
    return index_rows(spark, sf_dir).filter(F.col("row_id") % EVERY != 0)


@query(f"""WITH {RAW}, s AS ({' UNION ALL '.join(f"SELECT '{name}' AS setting, * FROM raw WHERE row_id % {EVERY} <> 0 AND {rule}" for name, rule in SETTINGS.items())}),
first AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY setting, query_id, slug ORDER BY cv DESC, row_id) = 1), p AS (SELECT *, row_number() OVER (PARTITION BY setting, query_id ORDER BY cv DESC, row_id) - 1 AS place FROM first),
r AS (SELECT setting, query_id, coalesce(min(place) FILTER (WHERE slug = gold::VARCHAR AND place < 20), -1) AS rank FROM p GROUP BY 1, 2)
SELECT setting, k.k, count(*) AS n, count(*) FILTER (WHERE rank BETWEEN 0 AND k.k - 1) AS found FROM r, (VALUES (1), (5), (20)) k(k) GROUP BY 1, 2""")
def recall_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries find their key within 1, 5 and 20 keys under six settings, from one pass over the index."""
    queries = query_rows(spark, sf_dir)
    found = knn.under_settings(reference_rows(spark, sf_dir), queries, {name: F.expr(rule) for name, rule in SETTINGS.items()}, 20)
    gold = found.join(queries.select("query_id", "gold"), "query_id").groupBy("setting", "query_id").agg(F.coalesce(F.min(F.when(F.col("slug") == F.col("gold"), F.col("place"))), F.lit(-1)).alias("rank"))
    deep = gold.withColumn("k", F.explode(F.array(*map(F.lit, (1, 5, 20)))))
    return deep.groupBy("setting", "k").agg(F.count("*").alias("n"), F.count_if(F.col("rank").between(0, F.col("k") - 1)).alias("found"))


#: A stored head of rank four for vectors of 64 numbers, by rule.
DIM, RANK = 64, 4
LEFT = np.array([[((7 * i + 3 * r) % 11 - 5) / 20 for r in range(RANK)] for i in range(DIM)])
RIGHT = np.array([[((5 * i + r) % 13 - 6) / 10 for i in range(DIM)] for r in range(RANK)])


def head_sql() -> str:
    parts = [f"list_dot_product(v, {[float(x) for x in LEFT[:, r]]}::DOUBLE[])" for r in range(RANK)]
    moved = "list_transform(range(1, 65), lambda i: v[i] + " + " + ".join(f"z{r} * ({[float(x) for x in RIGHT[r]]}::DOUBLE[])[i]" for r in range(RANK)) + ")"
    return f"""z AS (SELECT vec_id, label, v, {', '.join(f'{p} AS z{r}' for r, p in enumerate(parts))} FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)),
moved AS (SELECT vec_id, label, v, {moved} AS m FROM z), sides AS (SELECT vec_id, label, v, list_transform(m, lambda x: x / (sqrt(list_dot_product(m, m)) + 1e-9)) AS w FROM moved),
pairs AS (SELECT a.vec_id AS query_id, a.label AS gold, b.vec_id AS row_id, b.label AS slug, list_dot_product(a.v, b.v) AS before, list_dot_product(a.w, b.w) AS after FROM sides a, sides b WHERE a.vec_id % {EVERY} = 0 AND b.vec_id % {EVERY} <> 0),
tops AS (SELECT query_id, arg_max(slug = gold, before) AS old, arg_max(slug = gold, after) AS new FROM pairs GROUP BY 1)"""


@query(f"WITH {head_sql()} SELECT count(*) AS n, count(*) FILTER (WHERE old) AS right_before, count(*) FILTER (WHERE new) AS right_after, count(*) FILTER (WHERE new AND NOT old) AS gained, count(*) FILTER (WHERE old AND NOT new) AS lost FROM tops")
def head_gain_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose nearest row has their key, before and after a stored head moves all vectors."""
    index, queries = reference_rows(spark, sf_dir), query_rows(spark, sf_dir)

    def right(i: DataFrame, q: DataFrame, name: str) -> DataFrame:
        first = knn.top_rows(i, q, 1).join(queries.select("query_id", "gold"), "query_id")
        return first.select("query_id", (F.col("slug") == F.col("gold")).alias(name))

    both = right(index, queries, "old").join(right(knn.mapped(index, LEFT, RIGHT), knn.mapped(queries, LEFT, RIGHT), "new"), "query_id")
    return both.agg(F.count("*").alias("n"), F.count_if("old").alias("right_before"), F.count_if("new").alias("right_after"), F.count_if(F.expr("new AND NOT old")).alias("gained"), F.count_if(F.expr("old AND NOT new")).alias("lost"))
