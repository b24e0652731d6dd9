"""Queries of what cards, file names, hand-written lists and label lines say, and of the contents of a run's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchforge.functions import statistics, text, words
from matchforge.operators import catalogue, evidence, ranking
from matchforge.plans.files import new_path
from matchforge.plans.ranking import FEATURES_SQL, candidates
from matchforge.plans.registry import query
from matchforge.plans.texts import translit_sql
from matchforge.plans.vectors import r6
from matchforge.sources.tables import table

#: Example of stated weights: those of the right answer.
WEIGHTS = {name: w[0] for name, w in zip([*words.FEATURES, "bias"], words.OUTCOME_WEIGHTS, strict=True)}


@query(f"WITH {FEATURES_SQL} SELECT query_id, slug, round(1 / (1 + exp(-greatest(-30, least(30, {WEIGHTS['bias']!r}::DOUBLE + {' + '.join(f'({WEIGHTS[c]!r}::DOUBLE) * {c}' for c in words.FEATURES)})))), 6) AS p FROM feat")
def leader_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older two-way confidence in each leader: a constant and seven weighted features, clamped."""
    found = ranking.leader_features(candidates(spark, sf_dir))
    logit = sum((F.col(c) * WEIGHTS[c] for c in words.FEATURES), F.lit(WEIGHTS["bias"]))
    return found.select("query_id", "slug", r6(statistics.logistic(logit)).alias("p"))


def name_of(key: Column, size: Column) -> Column:
    """Names of uploaded files: three sizes, an unnamed one, and every tenth no such name."""
    prefix = F.element_at(F.array(*map(F.lit, ("", "large_", "thumbnail_", "medium_"))), (size % 4 + 1).cast("int"))
    return F.when(key % 10 == 0, F.concat(F.lit("note-"), key.cast("string"), F.lit(".txt"))).otherwise(F.concat(prefix, F.lit("item_"), key.cast("string"), F.lit("_"), F.substring(F.md5(key.cast("string")), 1, 10), F.lit(".jpeg")))


@query("""WITH f AS (SELECT p_partkey, p_partkey % 10 <> 0 AS ok, p_size % 4 AS k FROM part)
SELECT p_partkey, CASE WHEN ok THEN CASE k WHEN 0 THEN 'original' WHEN 1 THEN 'large' WHEN 2 THEN 'thumbnail' ELSE 'medium' END END AS size, CASE WHEN ok THEN 'item_' || p_partkey END AS stem, CASE WHEN ok THEN md5(p_partkey::VARCHAR)[1:10] END AS hash, CASE WHEN ok THEN '.jpeg' END AS extension FROM f""")
def file_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, key, hash and extension that file names tell; nulls for other names."""
    rows = table(spark, sf_dir, "part").select("p_partkey", catalogue.file_parts(name_of(F.col("p_partkey"), F.col("p_size"))).alias("f"))
    return rows.select("p_partkey", "f.size", "f.stem", "f.hash", "f.extension")


@query("""SELECT 'f' || p_partkey AS name, CASE WHEN p_partkey % 5 > 2 THEN 's' || p_size END AS slug, CASE p_partkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'dropped' WHEN 2 THEN 'negative' ELSE 'labelled' END AS state,
CASE WHEN p_size % 2 = 0 THEN 'shelf' ELSE 'field' END AS kind, CASE WHEN p_size % 4 = 0 THEN 'back' ELSE 'front' END AS frame, CASE WHEN p_size % 3 = 0 THEN 'seen # twice' ELSE '' END AS note FROM part WHERE p_partkey % 7 <> 0""")
def manual_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hand-written list, made of parts, as lines of a text file: every seventh line is a comment."""
    key, size = F.col("p_partkey"), F.col("p_size")
    label = F.element_at(F.array(F.lit("?"), F.lit("x"), F.lit("-"), F.concat(F.lit("s"), size), F.concat(F.lit("s"), size)), (key % 5 + 1).cast("int"))
    line = F.concat_ws("  ", F.concat(F.lit(" f"), key), label, F.when(size % 2 == 0, "shelf"), F.when(size % 4 == 0, "back"), F.when(size % 3 == 0, "# seen # twice"))
    path = new_path(spark, "decisions")
    table(spark, sf_dir, "part").select(F.when(key % 7 == 0, F.concat(F.lit("# line "), key)).otherwise(line).alias("value")).write.text(path)
    return catalogue.decisions(spark.read.text(path))


@query("""SELECT p_partkey::VARCHAR AS slug, coalesce(CASE WHEN p_size % 6 <> 0 THEN p_name END, '') AS title, CASE WHEN p_size % 5 <> 0 THEN p_brand ELSE '' END AS manufacturer, CASE WHEN p_size % 3 <> 0 THEN string_split(p_type, ' ')[1] ELSE '' END AS grapes FROM part""")
def nested_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested cards, made of parts and read from JSON, as flat rows."""
    def named(c: str | Column) -> Column:
        return F.named_struct(F.lit("name"), F.col(c) if isinstance(c, str) else c)

    size = F.col("p_size")
    first = F.when(size % 3 != 0, F.element_at(F.split("p_type", " "), 1))
    card = F.struct(
        F.col("p_partkey").cast("string").alias("slug"), F.when(size % 6 != 0, F.col("p_name")).alias("title"), F.when(size % 5 != 0, named("p_brand")).alias("manufacturer"), named("p_type").alias("region"),
        F.lit(None).cast("struct<name:string>").alias("category"), F.array(named(first), named(F.lit(""))).alias("grapes"), F.lit(None).cast("array<struct<name:string>>").alias("dishes"),
    )
    path = new_path(spark, "cards")
    table(spark, sf_dir, "part").select(card.alias("c")).select("c.*").write.json(path)
    name = "struct<name:string>"
    found = catalogue.flat_cards(spark.read.schema(f"slug string, title string, manufacturer {name}, region {name}, category {name}, grapes array<{name}>, dishes array<{name}>").json(path))
    return found.select("slug", "title", "manufacturer", F.array_join("grapes", ",").alias("grapes"))


@query("""WITH c AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Белое' WHEN 1 THEN 'Красное' ELSE '' END AS colour, CASE WHEN p_size % 2 = 0 THEN 'Сухое' ELSE 'Полусладкое' END AS sweetness FROM part) SELECT p_partkey, colour, sweetness FROM c""")
def category_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories such as «Белое сухое» in two."""
    size = F.col("p_size")
    whole = F.concat_ws(" ", F.when(size % 3 == 0, " БЕЛОЕ").when(size % 3 == 1, "красное"), F.when(size % 2 == 0, "сухое").otherwise("ПОЛУСЛАДКОЕ "))
    return table(spark, sf_dir, "part").select("p_partkey", text.category_parts(whole).alias("c")).select("p_partkey", "c.colour", "c.sweetness")


@query(r"SELECT p_partkey, lower(trim(regexp_replace(p_name || ' (' || p_brand || ').JPG', '[^\w]+', '_', 'g'), '_')) AS key FROM part")
def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under which differently written file names meet."""
    return table(spark, sf_dir, "part").select("p_partkey", text.file_key(F.concat(F.lit("  "), "p_name", F.lit(" ("), "p_brand", F.lit(").JPG"))).alias("key"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN string_split(p_type, ' ')[1] WHEN 1 THEN 'КРАСНOE сухое' WHEN 2 THEN 'ПОЛУСЛАДКОЕ' ELSE p_name END AS line FROM part")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter-spaced lines and torn words of sweetness and colour, put together; other lines stay."""
    size = F.col("p_size")
    spaced = F.concat_ws(" ", F.split(F.element_at(F.split("p_type", " "), 1), ""))
    line = F.when(size % 4 == 0, F.trim(spaced)).when(size % 4 == 1, "КРАСН OE сухое").when(size % 4 == 2, "ПОЛУ СЛАДКОЕ").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", evidence.joined_spaces(line).alias("line"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'полусухое' WHEN 1 THEN 'полусладкое' END AS sweetness FROM part")
def corrected_sweetness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweetness of tokens read with one wrong letter: two that can be told, one with two wrong letters, a short one, and two that contradict each other."""
    size = F.col("p_size") % 5
    tokens = F.when(size == 0, F.array(F.lit("полусухае"), F.lit("x"))).when(size == 1, F.array(F.lit("полусладкос"))).when(size == 2, F.array(F.lit("налусухое"))).when(size == 3, F.array(F.lit("сухае")))
    return table(spark, sf_dir, "part").select("p_partkey", text.corrected_sweetness(tokens.otherwise(F.array(F.lit("полусухае"), F.lit("полусладкос")))).alias("sweetness"))


def fingerprint_sql(name: str, columns: list[str]) -> str:
    """A table's content fingerprint: what rows' hashes sum up to, hashed with their number."""
    row = ", ".join(f"{c} := {c}" for c in sorted(columns))
    return f"SELECT '{name}' AS name, sha256(concat_ws('|', count(*), sum(('0x' || sha256(CAST(to_json(struct_pack({row})) AS VARCHAR))[1:15])::BIGINT)))[1:12] AS fingerprint, count(*) AS n FROM {name}"


@query(" UNION ALL ".join([fingerprint_sql("orders", ["o_orderkey", "o_custkey"]).replace("FROM orders", "FROM (SELECT o_orderkey, o_custkey FROM orders)"), fingerprint_sql("labels", ["doc_id", "quality", "toxic"])]))
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests by which a run's record tells its inputs."""
    inputs = {"orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "labels": table(spark, sf_dir, "labels")}
    parts = [catalogue.fingerprint(rows, "").select(F.lit(name).alias("name"), "fingerprint", "n") for name, rows in inputs.items()]
    return parts[0].unionByName(parts[1])


@query("""WITH d AS (SELECT l_suppkey, (year(l_shipdate) * 12 + month(l_shipdate))::INT AS month, sum(l_quantity)::BIGINT AS e FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY l_suppkey) AS height, sum(e) OVER (PARTITION BY l_suppkey ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)::BIGINT AS total FROM d WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)),
b AS (SELECT l_suppkey, pos - 11 AS first, total / 12.0::DOUBLE * 0.35 AS least_ FROM n WHERE pos >= 11 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY total DESC, pos) = 1),
x AS (SELECT l_suppkey, height, coalesce(max(pos + 1) FILTER (WHERE pos < first AND e <= least_), 0) AS top, coalesce(min(pos) FILTER (WHERE pos >= first + 12 AND e <= least_), height) AS bottom FROM n JOIN b USING (l_suppkey) GROUP BY 1, 2)
SELECT l_suppkey, CAST(greatest(0, top - floor((bottom - top) * 0.12)) AS INT) AS top, CAST(least(height, bottom + floor((bottom - top) * 0.12)) AS INT) AS bottom FROM x""")
def label_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of twelve rows with most energy, widened while rows hold a third of its mean, and padded."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int").alias("month")
    profile = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", month).agg(F.sum("l_quantity").cast("bigint").alias("e"))
    return evidence.widened_band(profile, "l_suppkey", "month", "e", 12)


@query(f"SELECT DISTINCT word, {translit_sql('word')} AS canonical FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS word FROM part) WHERE length(word) >= 2 AND regexp_full_match(word, '[A-Za-z]+')")
def canonical_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latin words of names and types in canonical letters."""
    found = table(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("word")).distinct().filter("word RLIKE '^[A-Za-z]{2,}$'")
    return found.select("word", F.concat_ws(" ", text.tokenize(F.col("word"))).alias("canonical"))


@query("""SELECT p_partkey, ['2019', '', '2015,2018', ''][p_size % 4 + 1] AS years, ['экстра брют', 'полусухое', NULL, NULL][p_size % 4 + 1] AS sweetness, ['розовое', 'красное', 'красное', NULL][p_size % 4 + 1] AS colour,
CASE p_size % 4 WHEN 0 THEN 12.5::DOUBLE WHEN 1 THEN 11.0::DOUBLE END AS alcohol FROM part""")
def label_line_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What label lines state, made of parts: in either alphabet, torn, in look-alike letters, or nothing."""
    size = F.col("p_size") % 4
    line = F.when(size == 0, "Extra Brut ROSE 2019, 12,5 % vol").when(size == 1, "ПОЛУ СУХОЕ Красное 11%").when(size == 2, F.concat(F.lit("KPACHOE 2015 2018 "), "p_name")).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.label_attributes(line).alias("a"))
    return rows.select("p_partkey", F.array_join("a.years", ",").alias("years"), "a.sweetness", "a.colour", "a.alcohol")
