"""Files written to the shared folder and read again by the readers, replays of stored runs, and small functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchforge.functions import text, words
from matchforge.functions.statistics import logistic
from matchforge.operators import boxes, order, replay
from matchforge.plans import cards as label
from matchforge.plans.registry import query
from matchforge.plans.vectors import r6
from matchforge.sources import files
from matchforge.sources.shared import shared_dir
from matchforge.sources.tables import table


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/matchforge/{name}-{uuid.uuid4().hex}"


@query("SELECT p_partkey AS slug, p_name AS title, {'name': p_brand}.name AS maker FROM part")
def json_document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an array of cards each; a document a brand, so no document is the whole table."""
    path = new_path(spark, "document")
    p = table(spark, sf_dir, "part").select("p_brand", F.struct(F.col("p_partkey").alias("slug"), F.col("p_name").alias("title"), F.struct(F.col("p_brand").alias("name")).alias("manufacturer")).alias("w"))
    p.groupBy("p_brand").agg(F.collect_list("w").alias("wines")).select("wines").write.option("maxRecordsPerFile", 1).json(path)
    return files.json_document(spark, path, "wines", "slug: bigint, title: string, manufacturer: struct<name: string>").select("slug", "title", F.col("manufacturer.name").alias("maker"))


SCORES = "SELECT l_orderkey AS image, l_partkey::VARCHAR AS slug, l_discount AS p_yes, l_linenumber AS n FROM lineitem"


@query(f"SELECT image, count(*) AS n, round(max(p_yes), 6) AS best FROM (SELECT * FROM ({SCORES}) QUALIFY row_number() OVER (PARTITION BY image, slug ORDER BY n DESC, p_yes DESC) = 1) GROUP BY 1")
def json_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with a list of candidates a line; the lists are read as maps."""
    path = new_path(spark, "lines")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("slug"), F.col("l_discount").alias("p_yes")))).alias("candidates"))
    rows.write.json(path)
    back = files.json_lines(spark, path, "image bigint, candidates array<struct<slug: string, p_yes: double>>")
    own = back.select("image", files.candidate_map(F.col("candidates"), "p_yes").alias("m"))
    return own.select("image", F.size("m").cast("bigint").alias("n"), r6(F.array_max(F.map_values("m"))).alias("best"))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE o_custkey % 9 = 0) AS nulls, min(o_orderkey) AS first FROM orders GROUP BY 1")
def manifest_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions beside a tab-separated manifest that they have to cover."""
    path = new_path(spark, "manifest")
    o = table(spark, sf_dir, "orders")
    o.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("status")).write.csv(path, sep="\t", header=True)
    wanted = files.manifest(spark, path, "query_id bigint, status string")
    predictions = o.select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("slug"))
    done = files.complete(predictions, wanted, "query_id").join(wanted, "query_id")
    return done.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("slug").isNull()).alias("nulls"), F.min("query_id").alias("first"))


@query("SELECT s_suppkey AS slug, CASE WHEN s_suppkey % 4 <> 0 THEN 'f' || s_suppkey END AS file, s_name AS note FROM supplier")
def checked_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of overrides with comments, its keys and files checked on reading."""
    path = new_path(spark, "overrides")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slug"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("f"), "s_suppkey")).alias("file"), F.col("s_name").alias("note"))
    files.write_csv(s, path)
    there = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("file"), F.lit("").alias("sha256"))
    return files.checked_csv(spark, path, "slug bigint, file string, note string", "slug", there)


@query("""SELECT p_partkey AS image, trim(p_name) AS text, CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE p_size / 50.0 END::DOUBLE AS conf, trunc(x * 640 - 128)::INT AS x1, trunc(y * 480 - 8)::INT AS y1, trunc(x * 640 + 128)::INT AS x2, trunc(y * 480 + 8)::INT AS y2
FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN 0.5 ELSE p_partkey % 100 / 100.0::DOUBLE END AS x, CASE WHEN p_size % 4 = 0 THEN 0.7 ELSE p_partkey % 37 / 37.0::DOUBLE END AS y FROM part) WHERE p_size % 7 <> 0""")
def typed_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed lines in relative places as words in pixels."""
    key, size = F.col("p_partkey"), F.col("p_size")
    line = F.struct(
        F.concat(F.lit(" "), "p_name").alias("text"), F.when(size % 3 != 0, key % 100 / 100.0).alias("x"), F.when(size % 4 != 0, key % 37 / 37.0).alias("y"),
        F.lit(None).cast("double").alias("w"), F.when(size % 5 != 0, size / 50.0).alias("conf"), F.when(size % 7 == 0, True).alias("unreadable"),
    )
    blank = F.struct(F.lit(" ").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("x", "double"), ("y", "double"), ("w", "double"), ("conf", "double"), ("unreadable", "boolean"))])
    rows = table(spark, sf_dir, "part").select(key.alias("image"), F.array(line, blank).alias("lines"))
    return files.typed_words(rows, 640, 480).drop("word_id")


@query("SELECT vec_id % 2 AS view, count(*) AS n, min('data/' || vec_id || '.webp') AS first, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings GROUP BY 1")
def vector_index_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written by view with relative paths, and read again."""
    path = new_path(spark, "vectors")
    e = table(spark, sf_dir, "embeddings")
    files.write_vectors(e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("slug"), (F.col("vec_id") % 2).alias("view"), F.concat(F.lit("/srv/x/data/"), "vec_id", F.lit(".webp")).alias("path"), "embedding"), path)
    total = F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x))
    return spark.read.parquet(path).groupBy(F.col("view").cast("bigint").alias("view")).agg(F.count("*").alias("n"), F.min("path").alias("first"), F.round(total, 4).alias("total"))


@query("SELECT l_orderkey AS row_id, count(*)::INT AS points_n, sum(greatest(0, least(255, trunc(l_quantity * 9 - 40))))::BIGINT AS total, (sum(count(*)) OVER (ORDER BY l_orderkey) - count(*))::BIGINT AS start FROM lineitem GROUP BY 1")
def ragged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of different lengths as bytes, with the offsets of a flat layout: sums a partition, then the partitions' totals, so no task orders all rows."""
    path = new_path(spark, "ragged")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.collect_list(F.array(F.col("l_quantity") * 9 - 40)).alias("points"))
    files.write_ragged(rows, path)
    total = F.aggregate(F.flatten("points"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = spark.read.parquet(path).select("row_id", "points_n", total.alias("total"))
    return order.summed_before(rows, F.col("row_id"), F.col("points_n"), "start").select("row_id", "points_n", "total", "start")


@query("SELECT 'version' AS kind, 'format' AS name, '1' AS value UNION ALL SELECT 'input', 'nation', count(*)::VARCHAR FROM nation UNION ALL SELECT 'input', 'part', count(*)::VARCHAR FROM part")
def provenance_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run has read, by content; the digests are left out here, since only Spark has the hash."""
    found = files.provenance({n: table(spark, sf_dir, n) for n in ("part", "nation")}, {}, {"format": "1"})
    return found.select("kind", "name", F.element_at(F.split("value", ":"), -1).alias("value"))


RUN = f"""{label.CARDS}, run AS (SELECT query_id AS image, (SELECT s2.slug FROM shortlist s2 WHERE s2.query_id = s.query_id AND s2.place = s.query_id // 100 % 3) AS gold, slug, cv, inliers, CASE WHEN (slug + query_id // 100) % 4 = 0 THEN 1 ELSE 0 END AS hard FROM shortlist s),
r1 AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY cv DESC, slug::VARCHAR) - 1 AS retrieval FROM run), tops AS (SELECT image, list(inliers ORDER BY inliers DESC) AS t FROM run GROUP BY 1),
r2 AS (SELECT r1.*, row_number() OVER (PARTITION BY image ORDER BY CASE WHEN t[1] >= t[2] * 1.5 THEN -inliers ELSE 0 END, cv DESC, retrieval) - 1 AS geometry FROM r1 JOIN tops USING (image)),
placed AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY CASE WHEN geometry < 4 THEN (hard > 0)::INT ELSE 2 END, geometry) - 1 AS text FROM r2)"""


def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortlists as stored runs: written nested, read again with their schema."""
    path = new_path(spark, "runs")
    q = F.floor(F.col("query_id") / 100)
    rows = label.shortlist(spark, sf_dir)
    one = F.struct("place", F.col("slug").cast("string").alias("slug"), "cv", F.col("inliers").cast("int").alias("inliers"), F.lit(0.5).alias("coverage"), F.when((F.col("slug") + q) % 4 == 0, 1).otherwise(0).alias("hard_conflicts"))
    gold = F.max(F.when(F.col("place") == q % 3, F.col("slug"))).cast("string").alias("gold")
    rows.groupBy(F.col("query_id").cast("string").alias("image")).agg(gold, F.array_sort(F.collect_list(one)).alias("candidates")).write.parquet(path)
    return spark.read.schema(files.RUNS).parquet(path)


@query(f"""WITH {RUN} SELECT image::VARCHAR AS image, gold::VARCHAR AS gold, (SELECT slug::VARCHAR FROM placed p WHERE p.image = a.image AND text = 0) AS top1, max(CASE WHEN slug = gold THEN retrieval END)::INT AS rank_retrieval, max(CASE WHEN slug = gold THEN geometry END)::INT AS rank_geometry,
max(CASE WHEN slug = gold THEN text END)::INT AS rank_text, max(CASE WHEN slug = gold THEN text END) = 0 AS correct, max(CASE WHEN slug = gold THEN text END) <= 2 AS in_top3, max(CASE WHEN slug = gold THEN text END) <= 4 AS in_top5 FROM placed a GROUP BY image, gold""")
def field_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each image of a stored run, with the right card's place after each stage."""
    return replay.image_report(replay.stage_places(files.run_candidates(stored_runs(spark, sf_dir)), replay.Rules()))


@query(f"WITH {RUN} SELECT count(*) AS images, count(*) FILTER (WHERE slug = gold AND geometry = 0) AS after_geometry, count(*) FILTER (WHERE slug = gold AND text = 0) AS after_text FROM placed WHERE slug = gold")
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = replay.image_report(replay.stage_places(files.run_candidates(stored_runs(spark, sf_dir)), replay.Rules()))
    return report.agg(F.count("*").alias("images"), F.count_if(F.col("rank_geometry") == 0).alias("after_geometry"), F.count_if(F.col("rank_text") == 0).alias("after_text"))


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-greatest(-30, least(30, l_quantity - 25)))), 9) AS p FROM lineitem")
def legacy_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(logistic(F.col("l_quantity") - 25), 9).alias("p"))


LATIN_SQL = "title"
for _a, _b in words.CYRILLIC_TO_LATIN.items():
    LATIN_SQL = f"replace(replace({LATIN_SQL}, '{_a}', '{_b}'), '{_a.upper()}', '{_b.upper()}')"


@query(f"WITH {label.CARDS} SELECT slug, {LATIN_SQL} AS latin FROM cards")
def latin_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.cards(spark, sf_dir).select("slug", text.latin(F.col("title")).alias("latin"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(' ' || p_name || ' , ' || p_type || '  !', '\s+([.,!?;:])', '\1', 'g'), '\s{2,}', ' ', 'g')) AS title, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' Вкус.' END AS body, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS pairing FROM part")
def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without stray spaces, and descriptions cut at what the item goes with."""
    even = F.col("p_size") % 2 == 0
    raw = F.when(even, F.concat("p_name", F.lit("\n Гастрономические сочетания: "), "p_type")).otherwise(F.concat("p_name", F.lit(" Вкус.")))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.clean_title(F.concat(F.lit(" "), "p_name", F.lit(" , "), "p_type", F.lit("  !"))).alias("title"), text.split_description(raw).alias("d"))
    return rows.select("p_partkey", "title", "d.body", "d.pairing")


@query("""SELECT l_orderkey, l_linenumber, floor(least(x + 3, 120))::INT AS x1, floor(least(greatest(y, 0), 90))::INT AS y1, ceil(least(x + 23, 120))::INT AS x2, ceil(least(greatest(y + 10, 0), 90))::INT AS y2
FROM (SELECT *, l_quantity * 2.5 AS x, (l_discount * 500 - 5) AS y FROM lineitem)""")
def original_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes found in a scaled and shifted strip, back in the image."""
    x, y = F.col("l_quantity") * 5, F.col("l_discount") * 1000
    polygon = F.array(*[F.array(x + dx, y + dy) for dx, dy in ((0, 0), (40, 0), (40, 20), (0, 20))])
    inverse = F.array(F.array(*map(F.lit, (1.0, 0.0, 6.0))), F.array(*map(F.lit, (0.0, 1.0, -20.0))))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", polygon.alias("polygon"), inverse.alias("inverse"), F.lit(120).alias("width"), F.lit(90).alias("height"))
    return boxes.original_boxes(rows, 2.0, 5.0).drop("polygon", "inverse", "width", "height")


@query("SELECT l_orderkey, l_linenumber, round((2 * l_quantity + 1) / (l_discount + 1), 6) AS u, round((3 * l_discount - 1) / (l_discount + 1), 6) AS v FROM lineitem")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    found = boxes.projected(points, [[2.0, 0.0, 1.0], [0.0, 3.0, -1.0], [0.0, 1.0, 1.0]])
    return found.select("l_orderkey", "l_linenumber", r6("u").alias("u"), r6("v").alias("v"))


@query("""SELECT p_partkey, '{"slug":' || p_partkey || ',"title":"' || CASE WHEN p_size % 3 = 0 THEN 'other' ELSE p_name END || '"' || CASE WHEN p_size % 2 = 0 THEN ',"probability":0.5' ELSE '' END || '}' AS card FROM part""")
def card_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate's fields laid over its card as one JSON object; what neither has is left out."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 3 == 0, "other").alias("title"), F.when(F.col("p_size") % 2 == 0, 0.5).alias("probability"))
    return rows.select("p_partkey", F.to_json(F.struct(F.col("p_partkey").alias("slug"), F.coalesce("title", "p_name").alias("title"), "probability")).alias("card"))


@query("SELECT user_id, k, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last DESC, k) AS INT) AS place FROM (SELECT user_id, event_type || '/' || floor(value)::BIGINT AS k, max(ts) AS last FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last DESC, k) <= 64")
def recent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 keys that each user touched last: what a memory that drops the longest unused key holds."""
    key = F.concat_ws("/", "event_type", F.floor("value").cast("string"))
    last = table(spark, sf_dir, "events").groupBy("user_id", key.alias("k")).agg(F.max("ts").alias("last"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last"), "k"))
    return last.withColumn("place", place).filter("place <= 64").select("user_id", "k", "place")


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, strftime(ts, '%d.%m.%Y %H:%M') AS shown FROM events")
def client_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds as clients send them, as ISO 8601 and as shown to readers."""
    rows = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    at = F.timestamp_millis("ms")
    return rows.select("event_id", "ms", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), F.date_format(at, "dd.MM.yyyy HH:mm").alias("shown"))
