"""Text queries: `part` is the catalogue (p_name title, p_brand maker, words of p_type varieties), `documents` and `benchmark` are label texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchforge.functions import text, words
from matchforge.operators import textsearch
from matchforge.plans.registry import query
from matchforge.plans.vectors import r6
from matchforge.sources.shared import stored
from matchforge.sources.tables import table

STOP = ", ".join(f"'{w}'" for w in words.STOPWORDS)
YEAR_SQL = r"(?:^|[^0-9A-Za-zА-Яа-яЁё_])(19[89][0-9]|20[0-3][0-9])(?:$|[^0-9A-Za-zА-Яа-яЁё_])"


def clean_sql(c: str) -> str:
    return f"trim(regexp_replace(translate(lower(replace({c}, 'İ', 'I')), 'ё', 'е'), '[^a-zа-я0-9]+', ' ', 'g'))"


def translit_sql(c: str) -> str:
    """Letter groups are marked longest first by private signs, so that a later rule can't touch an earlier one's outcome."""
    out = f"lower({c})"
    for latin, cyrillic in words.LATIN_TO_CYRILLIC:
        out = f"replace({out}, '{latin}', '{cyrillic}')"
    return out


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("slug"), F.col("p_name").alias("title"), F.col("p_brand").alias("manufacturer"), F.col("p_type").alias("grapes"), F.col("p_size").cast("string").alias("extra")
    )


@query(f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_different, md5({clean_sql('text')}) AS digest FROM (SELECT doc_id, text, list_filter(string_split({clean_sql('text')}, ' '), lambda x: length(x) >= 2) AS w FROM documents)")
def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("clean"))
    found = F.filter(F.split("clean", " "), lambda t: F.length(t) >= 2)
    return docs.select("doc_id", F.size(found).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(found)).cast("bigint").alias("n_different"), F.md5("clean").alias("digest"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || p_type, ' ')) AS word FROM part), c AS (SELECT word, {clean_sql('word')} AS c FROM w)
SELECT word, CASE WHEN length(c) < 2 THEN '' WHEN regexp_full_match(c, '[0-9]+') THEN c ELSE {translit_sql('c')} END AS canonical FROM c""")
def translit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names and types in canonical letters."""
    p = table(spark, sf_dir, "part")
    found = p.select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("word")).distinct()
    return found.select("word", F.concat_ws(" ", text.tokenize(F.col("word"))).alias("canonical"))


@query("SELECT w AS word, len(list_distinct([substring('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)])) AS n, list_sort(list_distinct([substring('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)]))[1] AS first FROM (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS w FROM part)")
def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("word")).distinct()
    return found.select("word", F.size(text.trigrams(F.col("word"))).cast("bigint").alias("n"), F.array_min(text.trigrams(F.col("word"))).alias("first"))


TOKENS_SQL = f"""fields AS (SELECT p_partkey AS slug, p_name AS f, 3.0::DOUBLE AS weight, true AS stop FROM part UNION ALL SELECT p_partkey, p_brand, 2.0, true FROM part
UNION ALL SELECT p_partkey, p_type, 1.0, true FROM part UNION ALL SELECT p_partkey, p_size::VARCHAR, 0.5, false FROM part),
words AS (SELECT slug, weight, stop, unnest(list_filter(string_split({clean_sql('f')}, ' '), lambda x: length(x) >= 2)) AS t FROM fields),
canon AS (SELECT slug, weight, stop, CASE WHEN regexp_full_match(t, '[a-z0-9]+') AND NOT regexp_full_match(t, '[0-9]+') THEN {translit_sql('t')} ELSE t END AS token FROM words),
tokens AS (SELECT slug, token, max(weight) AS weight FROM canon WHERE NOT (stop AND token IN ({STOP})) GROUP BY 1, 2),
idf AS (SELECT token, count(*) AS df, 0.5 + ln((SELECT count(*) FROM part) / count(*)) / ln((SELECT count(*) FROM part)) AS idf FROM tokens GROUP BY 1)"""


@query(f"WITH {TOKENS_SQL} SELECT token, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = catalogue(spark, sf_dir)
    found = textsearch.idf_table(textsearch.document_tokens(items), items.agg(F.count("*").alias("n")))
    return found.withColumn("idf", r6("idf"))


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A noisy label text for every hundredth part: names of parts with a letter lost, one word of the type, and the brand."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 100 = 0")
    noisy = F.concat(F.substring("p_name", 1, 3), F.expr("substring(p_name, 5)"))
    return p.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", noisy, F.element_at(F.split("p_type", " "), 1), F.col("p_brand")).alias("text"))


#: DuckDB's levenshtein counts bytes, so letters are written as single bytes first.
def byte(c: str) -> str:
    return f"translate({c}, 'абвгдежзийклмнопрстуфхцчшщъыьэюя', 'abcdefghijklmnopqrstuvwxyzABCDEF')"


MATCH_SQL = f"""CASE WHEN q = d THEN 1.0 WHEN length(q) >= 4 AND (starts_with(d, q) OR starts_with(q, d)) AND abs(length(q) - length(d)) <= 3 THEN 0.85
WHEN greatest(length(q), length(d)) >= 8 AND levenshtein({byte('q')}, {byte('d')}) <= 2 THEN 0.7 WHEN greatest(length(q), length(d)) >= 5 AND levenshtein({byte('q')}, {byte('d')}) <= 1 THEN 0.7 ELSE 0 END"""
LABELS_SQL = "SELECT p_partkey AS query_id, substring(p_name, 1, 3) || substring(p_name, 5) || ' ' || string_split(p_type, ' ')[1] || ' ' || p_brand AS text FROM part WHERE p_partkey % 100 = 0"
ASKED_SQL = f"""queries AS ({LABELS_SQL}),
qwords AS (SELECT query_id, unnest(list_filter(string_split({clean_sql('text')}, ' '), lambda x: length(x) >= 2)) AS t FROM queries),
asked AS (SELECT DISTINCT query_id, CASE WHEN regexp_full_match(t, '[a-z0-9]+') AND NOT regexp_full_match(t, '[0-9]+') THEN {translit_sql('t')} ELSE t END AS q FROM qwords),
kept AS (SELECT * FROM asked WHERE q NOT IN ({STOP}) AND NOT regexp_full_match(q, '[0-9]+')),
near AS (SELECT q, d, {MATCH_SQL} AS m FROM (SELECT DISTINCT q FROM kept), (SELECT DISTINCT token AS d FROM tokens))"""


@query(
    f"""WITH {TOKENS_SQL}, {ASKED_SQL}, known AS (SELECT query_id, q, coalesce(idf, 1.0) AS idf FROM kept LEFT JOIN idf ON token = q),
    best AS (SELECT query_id, slug, k.q, max(m * weight * idf) AS part FROM known k JOIN near n ON k.q = n.q AND m > 0 JOIN tokens t ON t.token = n.d GROUP BY 1, 2, 3),
    score AS (SELECT query_id, slug, round((sum(part) / any_value(total))::DOUBLE, 4) AS confidence FROM best JOIN (SELECT query_id, sum(idf) * 3 AS total FROM known GROUP BY 1) USING (query_id) GROUP BY 1, 2)
    SELECT query_id, slug, confidence, CAST(row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, slug) AS INT) AS rank FROM score WHERE confidence > 0.02
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, slug) <= 5"""
)
def fuzzy_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = catalogue(spark, sf_dir)
    tokens = textsearch.document_tokens(items)
    years = items.select("slug", text.years(F.col("title")).alias("years"))
    return textsearch.fuzzy_search(tokens, textsearch.idf_table(tokens, items.agg(F.count("*").alias("n"))), label_texts(spark, sf_dir), 5, years)


@query(f"WITH {TOKENS_SQL}, {ASKED_SQL} SELECT q, d, m::DOUBLE AS match FROM near WHERE m > 0")
def token_match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = textsearch.document_tokens(catalogue(spark, sf_dir)).select(F.col("token").alias("d")).distinct()
    asked = label_texts(spark, sf_dir).select(F.explode(text.tokenize(F.col("text"), drop_stop=True)).alias("q")).filter(~F.col("q").rlike("^[0-9]+$")).distinct()
    return textsearch.matched_tokens(asked, tokens)


OWNED_SQL = "owned AS (SELECT DISTINCT p_brand AS brand, p_size % 5 AS grp, lower(w) AS token FROM (SELECT p_brand, p_size, unnest(string_split(p_name || ' ' || p_type || ' lot' || p_partkey % 977, ' ')) AS w FROM part))"


def owned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, lot = table(spark, sf_dir, "part"), F.concat(F.lit("lot"), F.col("p_partkey") % 977)
    return p.select(F.col("p_brand").alias("brand"), (F.col("p_size") % 5).alias("grp"), F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", lot)), " ")).alias("token")).distinct()


@query(f"WITH {OWNED_SQL} SELECT grp, token, min(brand) AS brand FROM owned GROUP BY 1, 2 HAVING count(DISTINCT brand) = 1")
def unique_token_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.unique_owners(owned_tokens(spark, sf_dir), "grp", "brand", "token")


@query(f"WITH {OWNED_SQL} SELECT grp, brand, token FROM owned QUALIFY count(*) OVER (PARTITION BY grp, token) < (SELECT count(DISTINCT brand) FROM owned o WHERE o.grp = owned.grp)")
def discriminating_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.discriminating(owned_tokens(spark, sf_dir), "grp", "brand", "token")


@query(f"WITH {OWNED_SQL}, lead AS (SELECT grp, min(brand) AS brand FROM owned GROUP BY 1) SELECT o.grp, o.brand, o.token FROM owned o JOIN lead USING (grp, brand) WHERE NOT EXISTS (SELECT 1 FROM owned r WHERE r.grp = o.grp AND r.token = o.token AND r.brand <> o.brand)")
def distinguishing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = owned_tokens(spark, sf_dir)
    lead = owned.groupBy("grp").agg(F.min("brand").alias("leader"))
    return textsearch.distinguishing(owned.join(lead, "grp"), "grp", "brand", "token", F.col("brand") == F.col("leader"))


@query("SELECT lower(p_brand) AS brand, lower(p_name) AS name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def near_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that only the key tells apart: the same maker and name but for capitals."""
    grouped = table(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("brand"), F.lower("p_name").alias("name"))
    return grouped.agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).filter("n > 1")


SERIES_SQL = "series AS (SELECT p_partkey, p_brand || ' ' || trim(regexp_replace(lower(p_name), '(^| )(a|in|of|the|[0-9]+)( |$)', ' ', 'g')) AS series FROM part)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("p_brand", F.lit(" "), F.trim(F.regexp_replace(F.lower("p_name"), r"(^| )(a|in|of|the|[0-9]+)( |\z)", " ")))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("series"))


@query(f"WITH {SERIES_SQL} SELECT series, count(*) AS n, string_agg(p_partkey, ',' ORDER BY p_partkey) AS members FROM series GROUP BY 1 HAVING count(*) > 1")
def series_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series(spark, sf_dir).groupBy("series").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("members"))
    return found.filter("n > 1")


#: Items of a series that a task pairs with their siblings at most.
SERIES_ITEMS = 2_000


@query(f"WITH {SERIES_SQL} SELECT a.p_partkey AS a, b.p_partkey AS b FROM series a JOIN series b ON a.series = b.series AND a.p_partkey < b.p_partkey")
def sibling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs within a series; the first items of a large series are dealt to several parts, each of which meets all second ones."""
    s = series(spark, sf_dir)
    kin = s.groupBy("series").agg(F.count("*").alias("n")).filter("n > 1").select("series", F.ceil(F.col("n") / SERIES_ITEMS).alias("parts"))
    kept = s.join(kin, "series")
    first = kept.select(F.col("p_partkey").alias("a"), "series", F.pmod(F.xxhash64("p_partkey"), "parts").alias("part"))
    second = kept.select(F.col("p_partkey").alias("b"), "series", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    return first.join(second, ["series", "part"]).filter("a < b").select("a", "b")


@query(f"""WITH queries AS ({LABELS_SQL}), read AS (SELECT DISTINCT query_id, unnest(string_split({clean_sql('text')}, ' ')) AS token FROM queries), cards AS (SELECT DISTINCT p_partkey AS slug, unnest(string_split({clean_sql("p_name || ' ' || p_type")}, ' ')) AS word FROM part),
near AS (SELECT token, word FROM (SELECT DISTINCT token FROM read WHERE length(token) >= 4), (SELECT DISTINCT word FROM cards WHERE length(word) >= 4) WHERE damerau_levenshtein(token, word) <= floor(greatest(length(token), length(word)) * 0.2 + 1e-9)),
votes AS (SELECT query_id, slug, count(DISTINCT token) AS votes FROM read JOIN near USING (token) JOIN cards USING (word) GROUP BY 1, 2)
SELECT query_id, slug, votes FROM votes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, slug) <= 5""")
def text_votes_osa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five cards of each label with most votes: different read words within a fifth of their length of a word of the card, by optimal string alignment.

    Labels of the same words are asked once; cards are told apart only by the words that any label is near.
    """
    read = label_texts(spark, sf_dir).select("query_id", F.explode(F.array_distinct(F.split(text.clean(F.col("text")), " "))).alias("token")).filter("length(token) >= 4")
    titles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    spelled = titles.select("title").distinct().select("title", F.explode(F.array_distinct(F.split(text.clean(F.col("title")), " "))).alias("word")).filter("length(word) >= 4")
    cards = titles.join(spelled, "title").select("slug", "word")
    near = stored(textsearch.near_tokens(read.select("token").distinct(), cards.select("word").distinct(), 0.2), "near")
    members = textsearch.questions(read.groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias("tokens")), "query_id")
    known = cards.join(near.select("word").distinct(), "word", "left_semi").groupBy("slug").agg(F.array_sort(F.collect_set("word")).alias("words"))
    kept = stored(textsearch.first_alike(known, "slug", 5), "alike")
    asked = members.filter("query_id = question").select("question", F.explode("tokens").alias("token"))
    kinds = kept.filter("slug = alike").select("alike", F.explode("words").alias("word"))
    votes = asked.join(near, "token").join(kinds, "word").groupBy("question", "alike").agg(F.countDistinct("token").alias("votes"))
    return textsearch.best_of_alike(votes, "votes", kept, members, 5).drop("rank")


@query()
def sequence_ratio_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest spelling of each label's words among the catalogue's type words: equal, or the largest block similarity from 0.8."""
    known = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("word")).distinct()
    asked = label_texts(spark, sf_dir).select(F.explode(F.split(text.clean(F.col("text")), " ")).alias("token")).filter("token <> ''").distinct()
    close = textsearch.close_spellings(asked, known)
    return close.groupBy("token").agg(F.max_by("word", F.struct("ratio", "word")).alias("closest"), r6(F.max("ratio")).alias("ratio"))


@query()
def label_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, sweetness, colour and strength read from documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.label_attributes(F.col("text")).alias("a")).select("doc_id", F.array_join("a.years", ",").alias("years"), "a.sweetness", "a.colour", "a.alcohol")
