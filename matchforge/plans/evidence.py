"""Evidence queries: embeddings stand for descriptors, line items for points and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchforge.functions.statistics import share
from matchforge.operators import evidence, fitting, knn, order, ranking, sampling
from matchforge.plans.evaluation import CASES, cases
from matchforge.plans.ranking import EVIDENCE, candidates
from matchforge.plans.registry import query
from matchforge.plans.texts import ASKED_SQL, TOKENS_SQL, catalogue, label_texts
from matchforge.plans.vectors import RAW, index_rows, query_rows, r6
from matchforge.sources.tables import table


@query(f"""WITH {RAW}, n AS (SELECT query_id, row_id, sqrt(greatest(2 - 2 * cv, 0)) AS d, row_number() OVER (PARTITION BY query_id ORDER BY cv DESC, row_id) AS rank FROM raw WHERE row_id <> query_id),
f AS (SELECT query_id, max(CASE WHEN rank = 1 THEN row_id END) AS row_id, max(CASE WHEN rank = 1 THEN d END) AS d1, max(CASE WHEN rank = 2 THEN d END) AS d2 FROM n WHERE rank <= 2 GROUP BY 1)
SELECT query_id, row_id, round(d1, 6) AS distance FROM f WHERE d1 < 0.99 * d2 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d1, query_id) = 1""")
def keypoint_ratio_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nearest descriptors of each point, kept if clearly apart, one point a descriptor."""
    three = knn.top_rows(index_rows(spark, sf_dir), query_rows(spark, sf_dir), 3).filter("row_id <> query_id").drop("rank", "place")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cv"), "row_id"))
    two = three.withColumn("rank", rank).filter("rank <= 2")
    distances = two.withColumn("distance", F.sqrt(F.greatest(2 - 2 * F.col("cv"), F.lit(0.0))))
    return evidence.ratio_matches(distances, 0.99).withColumn("distance", r6("distance"))


@query("""WITH p AS (SELECT l_orderkey AS query_id, l_partkey % 100 AS x, l_suppkey % 100 AS y FROM lineitem), b AS (SELECT o_orderkey AS query_id, o_custkey % 40 AS x1, 0 AS y1, o_custkey % 40 + 50 AS x2, 80 AS y2 FROM orders)
SELECT query_id, round(avg((x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2)::INT::DOUBLE), 6) AS inside, CASE WHEN avg((x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2)::INT::DOUBLE) < 0.5 THEN 'frame' ELSE 'crop' END AS view FROM p JOIN b USING (query_id) GROUP BY 1""")
def points_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 100).alias("y"))
    left = F.col("o_custkey") % 40
    boxes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), left.alias("x1"), F.lit(0).alias("y1"), (left + 50).alias("x2"), F.lit(80).alias("y2"))
    return evidence.points_in_boxes(points, boxes).withColumn("inside", r6("inside"))


@query("""SELECT l_orderkey AS query_id, l_suppkey % 5 AS slug, arg_max(l_linenumber, l_partkey % 30 * 100 - l_linenumber) AS reference, max(l_partkey % 30) AS inliers, sum(l_quantity::BIGINT)::BIGINT AS points FROM lineitem GROUP BY 1, 2""")
def best_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 5).alias("slug"), F.col("l_linenumber").alias("reference"), (F.col("l_partkey") % 30).alias("inliers"), F.col("l_quantity").cast("bigint").alias("points")
    )
    return evidence.best_references(stats)


@query("WITH eq AS (SELECT * FROM (VALUES (1, 2), (3, 4), (7, 5)) v(a, b)), e AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi FROM eq) SELECT o_orderkey, e.lo IS NOT NULL AS same FROM orders LEFT JOIN e ON lo = least(o_custkey % 9, o_orderkey % 9) AND hi = greatest(o_custkey % 9, o_orderkey % 9)")
def equivalent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a curated list of unordered pairs counts as equal."""
    pairs = spark.sql("SELECT least(a, b) AS lo, greatest(a, b) AS hi, true AS same FROM VALUES (1, 2), (3, 4), (7, 5) AS v(a, b)")
    a, b = F.col("o_custkey") % 9, F.col("o_orderkey") % 9
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    return orders.join(pairs, ["lo", "hi"], "left").select("o_orderkey", F.coalesce("same", F.lit(False)).alias("same"))


@query(f"""WITH {RAW}, p AS (SELECT CASE WHEN slug = gold::VARCHAR THEN 'inside' WHEN slug::INT % 3 = gold % 3 THEN 'brand' ELSE 'stranger' END AS population, cv FROM raw WHERE row_id <> query_id)
SELECT population, count(*) AS n, round(avg(cv), 6) AS mean, round(quantile_cont(cv, 0.5), 6) AS median, round(quantile_cont(cv, 0.9), 6) AS p90 FROM p GROUP BY 1""")
def similarity_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How similar rows of the same key, of the same maker and of strangers are to the queries."""
    def kin(key: str) -> Column:
        return F.array(F.col(key), (F.col(key).cast("int") % 3).cast("string")).alias("kin")

    rows, asked = index_rows(spark, sf_dir).select("row_id", "embedding", kin("slug")), query_rows(spark, sf_dir).select("query_id", "embedding", kin("gold"))
    found = knn.similarity_spread(rows, asked, ["inside", "brand", "stranger"], [0.5, 0.9])
    return spark.createDataFrame([(name, n, mean, *values) for name, n, mean, values in found], "population string, n bigint, mean double, median double, p90 double").select("population", "n", *[r6(c).alias(c) for c in ("mean", "median", "p90")])


@query("""WITH d AS (SELECT l_returnflag, l_shipdate::DATE AS day, sum(l_quantity)::BIGINT AS e FROM lineitem GROUP BY 1, 2), s AS (SELECT l_returnflag, row_number() OVER w - 1 AS pos, sum(e) OVER (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)::BIGINT AS total FROM d WINDOW w AS (PARTITION BY l_returnflag ORDER BY day))
SELECT l_returnflag, CAST(pos - 29 AS INT) AS first, total FROM s WHERE pos >= 29 QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY total DESC, pos) = 1""")
def energy_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of thirty rows with most energy."""
    profile = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").cast("bigint").alias("e"))
    return evidence.sliding_maximum(profile, "l_returnflag", "day", "e", 30)


@query(f"""WITH {EVIDENCE}, y AS (SELECT query_id, slug, place, ((row_id * 11 + query_id * 3) % 100) / 100.0::DOUBLE AS p FROM cand), s AS (SELECT query_id, max(CASE WHEN place = 0 THEN p END) AS lead, max(p) AS best, arg_max(slug, p * 1000 - place) AS other, max(CASE WHEN place = 0 THEN slug END) AS leader FROM y GROUP BY 1),
g AS (SELECT s.*, d, g, (query_id // 100 % 10) / 20.0::DOUBLE AS prob FROM s, (VALUES (0.1), (0.3)) a(d), (VALUES (0.2), (0.4)) b(g))
SELECT d::DOUBLE AS d, g::DOUBLE AS g, count(*) FILTER (WHERE best - lead > d AND prob < g AND other <> leader) AS switched, count(*) AS n FROM g GROUP BY 1, 2""")
def rerank_rule_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second judge's answer takes over if it is surer by d and the first one surer than g isn't: all d and g in one pass."""
    judged = candidates(spark, sf_dir).withColumn("p", ((F.col("row_id") * 11 + F.col("query_id") * 3) % 100) / 100.0)
    sides = judged.groupBy("query_id").agg(
        F.max(F.when(F.col("place") == 0, F.col("p"))).alias("lead"), F.max("p").alias("best"), F.max_by("slug", F.struct("p", -F.col("place"))).alias("other"), F.max(F.when(F.col("place") == 0, F.col("slug"))).alias("leader")
    )
    grid = sides.withColumn("d", F.explode(F.array(F.lit(0.1), F.lit(0.3)))).withColumn("g", F.explode(F.array(F.lit(0.2), F.lit(0.4))))
    switch = (F.col("best") - F.col("lead") > F.col("d")) & (F.floor(F.col("query_id") / 100) % 10 / 20.0 < F.col("g")) & (F.col("other") != F.col("leader"))
    return grid.groupBy("d", "g").agg(F.count_if(switch).alias("switched"), F.count("*").alias("n"))


@query(f"WITH {CASES}, h AS (SELECT doc_id, quality, ntile(2) OVER (PARTITION BY quality ORDER BY doc_id) AS half FROM cases) SELECT doc_id, half = 1 AS train, copy FROM h, unnest(range(1, CASE WHEN quality = 1 THEN 2 ELSE 4 END)) u(copy)")
def resampled_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of each stratum trains; rare cases count three times."""
    rows = cases(spark, sf_dir)
    middle = order.at_ranks(rows, "quality", "doc_id", {"last": F.ceil(F.col("n") / 2)}).withColumnRenamed("quality", "stratum")
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.when(F.col("quality") == 1, 1).otherwise(3).cast("bigint")))
    halves = rows.join(middle, F.col("quality").eqNullSafe(F.col("stratum")))  # a row a stratum
    return halves.select("doc_id", (F.col("doc_id") <= F.col("last")).alias("train"), copies.alias("copy"))


@query(f"""WITH {EVIDENCE}, gold AS (SELECT * FROM cand WHERE slug::INT = query_id // 100 % 10), f AS (SELECT query_id, (row_number() OVER (ORDER BY sha256(query_id::VARCHAR)) - 1) % 5 AS fold FROM (SELECT DISTINCT query_id FROM cand))
SELECT query_id, o.slug, CAST(fold AS INT) AS fold, round(g.cv - o.cv, 6) AS d_cv, g.inliers - o.inliers AS d_inliers, round(g.coverage - o.coverage, 6) AS d_coverage FROM gold g JOIN cand o USING (query_id) JOIN f USING (query_id) WHERE o.slug <> g.slug""")
def pairwise_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right minus other features within each query, with five folds by the order of the queries' hashes."""
    rows = candidates(spark, sf_dir)
    gold = rows.filter(F.col("slug").cast("int") == F.floor(F.col("query_id") / 100) % 10).select("query_id", F.col("slug").alias("right"), *[F.col(c).alias(f"g_{c}") for c in ("cv", "inliers", "coverage")])
    numbered = order.summed_before(rows.select("query_id").distinct(), F.sha2(F.col("query_id").cast("string"), 256), F.lit(1), "place")
    folds = numbered.select("query_id", (F.col("place") % 5).cast("int").alias("fold"))
    pairs = rows.join(gold, "query_id").filter("slug <> right").join(folds, "query_id")
    return pairs.select("query_id", "slug", "fold", r6(F.col("g_cv") - F.col("cv")).alias("d_cv"), (F.col("g_inliers") - F.col("inliers")).alias("d_inliers"), r6(F.col("g_coverage") - F.col("coverage")).alias("d_coverage"))


@query("SELECT p_partkey FROM part ORDER BY md5(p_partkey::VARCHAR || '|17'), p_partkey LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred items by the hash of key and seed: the same on every run; sampling is the feature."""
    return table(spark, sf_dir, "part").select("p_partkey").orderBy(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("|17"))), "p_partkey").limit(100)


@query("SELECT l_orderkey, round(avg((sqrt(power(l_partkey % 40 - l_suppkey % 40, 2) + power(l_linenumber * 2, 2)) <= 18)::INT::DOUBLE), 6) AS agreement FROM lineitem GROUP BY 1")
def colour_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of matched points whose colours lie within a distance of 18."""
    near = F.hypot(F.col("l_partkey") % 40 - F.col("l_suppkey") % 40, F.col("l_linenumber") * 2) <= 18
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(r6(F.avg(near.cast("double"))).alias("agreement"))


BOX = "b AS (SELECT l_orderkey AS image, l_linenumber AS box, l_partkey % 500 AS x1, l_suppkey % 50 AS y1, l_partkey % 500 + 50 + l_suppkey % 100 AS x2, l_suppkey % 50 + 200 AS y2, (l_partkey % 90 + 10) / 100.0::DOUBLE AS score FROM lineitem)"


@query(f"""WITH {BOX}, s AS (SELECT image, box, score * (x2 - x1) * (y2 - y1) * (1 - abs((x1 + x2) / 2.0::DOUBLE - 350) / 700) * power(0.55, (x1 < 5)::INT + (x2 > 620)::INT + (y1 < 5)::INT) AS rank_score FROM b)
SELECT image, box, round(rank_score, 4) AS rank_score FROM s QUALIFY row_number() OVER (PARTITION BY image ORDER BY rank_score DESC, box) = 1""")
def box_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box that is large, sure, central and not cut off."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    x1, y1 = F.col("l_partkey") % 500, F.col("l_suppkey") % 50
    x2, y2 = x1 + 50 + F.col("l_suppkey") % 100, y1 + 200
    cut = (x1 < 5).cast("int") + (x2 > 620).cast("int") + (y1 < 5).cast("int")
    score = (F.col("l_partkey") % 90 + 10) / 100.0 * (x2 - x1) * (y2 - y1) * (1 - F.abs((x1 + x2) / 2.0 - 350) / 700) * F.pow(F.lit(0.55), cut)
    rows = l.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("box"), score.alias("rank_score"))
    best = rows.groupBy("image").agg(F.max_by(F.struct("box", "rank_score"), F.struct("rank_score", -F.col("box"))).alias("b"))
    return best.select("image", "b.box", F.round("b.rank_score", 4).alias("rank_score"))


@query("SELECT l_orderkey, l_linenumber, round(sin((l_partkey % 201 - 100) / 100.0::DOUBLE * 1.05) / sin(1.05), 6) AS flat, round(asin(sin((l_partkey % 201 - 100) / 100.0::DOUBLE * 1.05)) / 1.05, 6) AS back FROM lineitem")
def cylinder_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on a cylinder's label flattened and bent back."""
    u = (F.col("l_partkey") % 201 - 100) / 100.0
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(F.sin(u * 1.05) / F.sin(F.lit(1.05))).alias("flat"), r6(F.asin(F.sin(u * 1.05)) / 1.05).alias("back"))


@query(f"""WITH {TOKENS_SQL}, {ASKED_SQL}, known AS (SELECT query_id, q, coalesce(idf, 1.0) AS idf FROM kept LEFT JOIN idf ON token = q),
best AS (SELECT query_id, slug, k.q, max(m * weight * idf) AS part FROM known k JOIN near n ON k.q = n.q AND m > 0 JOIN tokens t ON t.token = n.d GROUP BY 1, 2, 3),
score AS (SELECT query_id, slug, round((sum(part) / any_value(total))::DOUBLE, 4) AS confidence FROM best JOIN (SELECT query_id, sum(idf) * 3 AS total FROM known GROUP BY 1) USING (query_id) GROUP BY 1, 2),
top AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, slug) = 1)
SELECT query_id, slug, confidence FROM top JOIN part ON p_partkey = slug JOIN queries USING (query_id) WHERE confidence >= 0.3 AND contains(lower(queries.text), lower(p_brand))""")
def catalogue_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of a label text, if it is sure enough and the text names its maker."""
    from matchforge.operators import textsearch

    items, asked = catalogue(spark, sf_dir), label_texts(spark, sf_dir)
    tokens = textsearch.document_tokens(items)
    hits = textsearch.fuzzy_search(tokens, textsearch.idf_table(tokens, items.agg(F.count("*").alias("n"))), asked, 1)
    met = hits.filter("confidence >= 0.3").join(items.select("slug", "manufacturer"), "slug").join(asked, "query_id")
    return met.filter(F.lower("text").contains(F.lower("manufacturer"))).select("query_id", "slug", "confidence")


@query("SELECT CASE WHEN o_custkey IN (1, 7) THEN 'test' ELSE 'tune' END AS split, count(*) AS n FROM orders GROUP BY 1")
def assigned_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer are a series and come into one split; two customers' splits are fixed."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").cast("string").alias("image"), F.col("o_custkey").cast("string").alias("series"), F.concat(F.lit("i"), F.col("o_orderkey")).alias("item"))
    locked = spark.sql("SELECT * FROM VALUES ('series:1', 'test'), ('series:7', 'test') AS v(node, split)")
    return evidence.assigned_splits(rows, locked).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_brand AS producer, CAST(NULL AS VARCHAR) AS name, 'красное' AS colour, CASE WHEN p_size % 2 = 0 THEN 'сухое' END AS sweetness, 'a,b' AS grapes FROM part")
def label_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free answers with a JSON object in them, made of parts, read into columns."""
    raw = F.concat(F.lit('Sure! ```json {"producer":"'), "p_brand", F.lit('","name":"none","color":"Red","sweetness":"'), F.when(F.col("p_size") % 2 == 0, "Dry").otherwise("odd"), F.lit('","grapes":["a","","b"]} ```'))
    return table(spark, sf_dir, "part").select("p_partkey", evidence.label_json(raw).alias("a")).select("p_partkey", "a.producer", "a.name", "a.colour", "a.sweetness", F.array_join("a.grapes", ",").alias("grapes"))


@query(f"WITH {CASES} SELECT lang, count(*) AS n, count(*) FILTER (WHERE probability >= 0.1) AS answered, round(count(*) FILTER (WHERE probability >= 0.1) / count(*)::DOUBLE, 6) AS share FROM cases GROUP BY 1")
def answered_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = F.count_if(F.col("probability") >= 0.1)
    return cases(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), answered.alias("answered"), r6(share(answered, F.count("*"))).alias("share"))


@query("""WITH h AS (SELECT p_partkey AS a, p_type AS s, p_brand AS g, md5(p_partkey::VARCHAR || '|17') AS hash, count(*) OVER (PARTITION BY p_type) AS n FROM part),
d AS (SELECT *, (('0x' || hash[1:8])::BIGINT * CAST(ceil(n / 8192.0) AS BIGINT)) >> 32 AS ring FROM h), p AS (SELECT *, row_number() OVER (PARTITION BY s, ring ORDER BY hash, a) AS place, count(*) OVER (PARTITION BY s, ring) AS size FROM d)
SELECT x.a AS p_partkey, y.a AS stranger FROM p x, range(1, 4) k(step), p y WHERE step < x.size AND y.s = x.s AND y.ring = x.ring AND y.place = (x.place - 1 + step) % x.size + 1 AND x.g <> y.g""")
def stranger_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three other items of the same type for each item, those of its own brand left out."""
    return sampling.strangers(table(spark, sf_dir, "part"), "p_partkey", "p_type", "p_brand", 3)


def matched_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as matched points, a pair of images for each supplier; five of seven lines follow the supplier's transform."""
    x, y, s = (F.col("l_partkey") % 397).cast("double"), (F.col("l_orderkey") % 293).cast("double"), F.col("l_suppkey") % 50
    w = 1 + x * 0.0004
    own = F.col("l_linenumber") <= 5
    u = F.when(own, (x * 1.1 + y * 0.1 + s) / w).otherwise((F.col("l_orderkey") * 7 % 401).cast("double"))
    v = F.when(own, (y * 0.9 - x * 0.1 + 60) / w).otherwise((F.col("l_partkey") * 11 % 307).cast("double"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pair_id"), key.alias("match_id"), x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))


@query("""WITH p AS (SELECT l_suppkey AS pair_id, (l_partkey % 397)::DOUBLE AS x, (l_orderkey % 293)::DOUBLE AS y, l_linenumber <= 5 AS own, (l_orderkey * 7 % 401)::DOUBLE AS ou, (l_partkey * 11 % 307)::DOUBLE AS ov, l_suppkey % 50 AS s FROM lineitem),
t AS (SELECT *, (x * 1.1 + y * 0.1 + s) / (1 + x * 0.0004) AS tu, (y * 0.9 - x * 0.1 + 60) / (1 + x * 0.0004) AS tv FROM p)
SELECT pair_id, count(*) AS matches, count(*) FILTER (WHERE own OR (ou - tu) ** 2 + (ov - tv) ** 2 <= 25) AS inliers FROM t GROUP BY 1""")
def transform_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that each pair's best transform explains: those that follow the true one, and others that happen to."""
    return fitting.fit_report(matched_points(spark, sf_dir))
