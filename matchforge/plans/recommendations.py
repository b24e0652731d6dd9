"""Recommender queries over `part`: brand is the maker, words of p_type are varieties, the first of them the colour, p_size the sweetness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchforge.operators import recommend
from matchforge.operators.ranking import capped
from matchforge.plans.registry import query
from matchforge.plans.vectors import r6
from matchforge.sources.tables import table

CAT = """cat AS (SELECT p_partkey AS slug, p_partkey AS row_id, p_name AS title, p_brand AS maker, string_split(p_type, ' ')[1] AS colour, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 's' || (p_size % 3) END AS sweetness,
p_size % 4 = 0 AS sparkling, 'r' || (p_partkey % 11) AS region, list_distinct(string_split(p_type || ' v' || (p_size % 5), ' ')) AS varieties, (p_partkey % 51) / 10.0::DOUBLE AS rating, ['d' || (p_partkey % 13), 'd' || (p_size % 13)] AS dishes FROM part)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")

    def named(letter: str, c: Column) -> Column:
        return F.concat(F.lit(letter), c.cast("string"))

    return table(spark, sf_dir, "part").select(
        key.alias("slug"), key.alias("row_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("maker"), F.element_at(F.split("p_type", " "), 1).alias("colour"),
        F.when(size % 7 != 0, named("s", size % 3)).alias("sweetness"), (size % 4 == 0).alias("sparkling"), named("r", key % 11).alias("region"),
        F.array_distinct(F.split(F.concat_ws(" ", "p_type", named("v", size % 5)), " ")).alias("varieties"), (key % 51 / 10.0).alias("rating"),
        F.array(named("d", key % 13), named("d", size % 13)).alias("dishes"),
    )


TITLE = r"trim(regexp_replace(regexp_replace(lower(title), '[^a-zа-яё0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
ANALOG = f"""{CAT}, src AS (SELECT * FROM cat WHERE slug % 100 = 0), kept AS (SELECT s.slug AS source, c.*, s.varieties AS sv, s.sweetness AS ss, s.region AS sr FROM cat c JOIN src s ON c.colour = s.colour AND c.slug <> s.slug AND c.maker <> s.maker AND c.sparkling = s.sparkling AND (s.sweetness IS NULL OR c.sweetness IS NULL OR c.sweetness = s.sweetness)),
firsts AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY source, maker, {TITLE} ORDER BY row_id) = 1),
scored AS (SELECT source, slug, maker, 3.0::DOUBLE * len(list_intersect(varieties, sv)) / len(list_distinct(varieties || sv)) + coalesce((sweetness = ss)::INT, 0) + coalesce((region = sr)::INT, 0) * 0.5::DOUBLE + least(rating, 5) / 5 AS score FROM firsts),
over AS (SELECT *, row_number() OVER (PARTITION BY source, maker ORDER BY round(score, 9) DESC, md5(source || '|' || slug)) AS n FROM scored WHERE score > 1)"""


@query(f"WITH {ANALOG} SELECT source, slug, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, md5(source || '|' || slug)) AS INT) AS rank FROM over WHERE n <= 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, md5(source || '|' || slug)) <= 6")
def analogs_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With md5 as the tie-break, which DuckDB knows too."""
    items = catalogue(spark, sf_dir)
    tie = F.md5(F.concat_ws("|", F.col("source").cast("string"), F.col("slug").cast("string")))
    return recommend.analogs(items, items.filter("slug % 100 = 0"), 6, tie).withColumn("score", r6("score"))


#: The checksum of a text of ASCII signs, bit by bit; the number is the reflected polynomial.
CRC_BITS = "list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(source || '|' || slug, ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: {CRC_BITS}), 4294967295)"


@query(f"WITH {ANALOG}, tied AS (SELECT *, {CRC} AS crc FROM scored WHERE score > 1), few AS (SELECT *, row_number() OVER (PARTITION BY source, maker ORDER BY round(score, 9) DESC, crc) AS m FROM tied) SELECT source, slug, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, crc) AS INT) AS rank FROM few WHERE m <= 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, crc) <= 6")
def analogs_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the checksum of salt and slug as the tie-break."""
    items = catalogue(spark, sf_dir)
    return recommend.analogs(items, items.filter("slug % 100 = 0"), 6).withColumn("score", r6("score"))


@query(f"WITH {CAT}, n AS (SELECT *, row_number() OVER (PARTITION BY colour, maker ORDER BY rating DESC, slug) AS n FROM cat) SELECT colour, slug, CAST(row_number() OVER (PARTITION BY colour ORDER BY rating DESC, slug) AS INT) AS rank FROM n WHERE n <= 2 QUALIFY row_number() OVER (PARTITION BY colour ORDER BY rating DESC, slug) <= 10")
def capped_per_maker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capped(catalogue(spark, sf_dir), ["colour"], 2, 10, F.desc("rating"), F.col("slug")).select("colour", "slug", "rank")


def sommelier_sql(dish: str) -> str:
    return f"""WITH {CAT}, fits AS (SELECT slug, maker, list_contains(dishes, '{dish}') AS fit, least(rating, 5) / 5 + CASE WHEN sparkling THEN 1.5 ELSE 0 END + 2.0 + CASE WHEN list_contains(dishes, '{dish}') THEN 3.0 ELSE 0 END AS score FROM cat WHERE sweetness = 's1'),
    used AS (SELECT * FROM fits WHERE fit = (SELECT max(fit) FROM fits)), n AS (SELECT *, row_number() OVER (PARTITION BY maker ORDER BY round(score, 9) DESC, md5(slug::VARCHAR)) AS n FROM used)
    SELECT slug, round(score::DOUBLE, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, md5(slug::VARCHAR)) AS INT) AS rank FROM n WHERE n <= 2 QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, md5(slug::VARCHAR)) <= 6"""


@query(sommelier_sql("d7"))
def sommelier_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recommend.sommelier(catalogue(spark, sf_dir), "d7", "s1", "party", 6, F.md5(F.col("slug").cast("string")))
    return found.withColumn("score", r6("score"))


@query(sommelier_sql("nothing"))
def sommelier_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No item fits the dish, so it is given up."""
    found = recommend.sommelier(catalogue(spark, sf_dir), "nothing", "s1", "party", 6, F.md5(F.col("slug").cast("string")))
    return found.withColumn("score", r6("score"))


@query(f"WITH {CAT} SELECT maker, slug, CAST(row_number() OVER (PARTITION BY maker ORDER BY CASE WHEN close >= 0.6 THEN close ELSE 0 END DESC, colour <> asked, rating DESC, row_id) AS INT) AS rank FROM (SELECT *, (slug % 10) / 10.0::DOUBLE AS close, 'SMALL' AS asked FROM cat) QUALIFY row_number() OVER (PARTITION BY maker ORDER BY CASE WHEN close >= 0.6 THEN close ELSE 0 END DESC, colour <> asked, rating DESC, row_id) <= 6")
def makers_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = catalogue(spark, sf_dir).withColumn("closeness", F.col("slug") % 10 / 10.0)
    asked = items.select("maker").distinct().withColumn("asked_colour", F.lit("SMALL"))
    return recommend.makers_items(items, asked).select("maker", "slug", "rank")


@query(f"WITH {CAT} SELECT slug, CAST(row_number() OVER (ORDER BY rating DESC, slug) AS INT) AS place FROM cat WHERE colour IN ('SMALL', 'STANDARD', 'ECONOMY') AND sweetness = 's1' AND list_contains(varieties, 'v1') QUALIFY row_number() OVER (ORDER BY rating DESC, slug) <= 40")
def facet_filter_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of forty: filters first, then the best rated; a limit is the feature."""
    hits = catalogue(spark, sf_dir).filter(F.col("colour").isin("SMALL", "STANDARD", "ECONOMY") & (F.col("sweetness") == "s1") & F.array_contains("varieties", "v1"))
    page = hits.orderBy(F.desc(F.coalesce("rating", F.lit(0.0))), "slug").limit(40)
    return page.select("slug", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.coalesce("rating", F.lit(0.0))), "slug")).alias("place"))


@query(f"WITH {CAT} SELECT 'variety' AS facet, v AS value, count(*) AS n FROM (SELECT unnest(varieties) AS v FROM cat) GROUP BY 2 UNION ALL SELECT 'sweetness', sweetness, count(*) FROM cat WHERE sweetness IS NOT NULL GROUP BY 2 UNION ALL SELECT 'region', region, count(*) FROM cat GROUP BY 2")
def facet_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facets in one pass: each row gives its facet values."""
    def pair(name: str, c: Column) -> Column:
        return F.struct(F.lit(name).alias("facet"), c.alias("value"))

    items = catalogue(spark, sf_dir)
    values = F.concat(F.transform("varieties", lambda v: pair("variety", v)), F.array(pair("sweetness", F.col("sweetness")), pair("region", F.col("region"))))
    return items.select(F.explode(values).alias("f")).filter("f.value is not null and f.value <> ''").groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
