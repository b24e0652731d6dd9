"""Evidence of label words for and against cards: cards, shortlists and read words are made of `part`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchforge.functions import text, words
from matchforge.operators import cards as evidence
from matchforge.operators import resolution, textsearch
from matchforge.operators.rules import Rules
from matchforge.plans.registry import query
from matchforge.plans.texts import YEAR_SQL, clean_sql, translit_sql
from matchforge.plans.vectors import r6
from matchforge.sources.shared import stored
from matchforge.sources.tables import table

MAKERS = ["Поместье Голубицкое", "Golubitskoe Estate", "Inkerman", "Chateau Tamagne", "В2Р"]
VARIETIES = ["Chardonnay", "Мерло", "Рислинг", "Cabernet Franc"]
SWEET, COLOUR = ["брют", "сухое", "полусухое"], ["белое", "красное"]
#: Title words: three that tell nothing on cards, and two names that several cards share.
EXTRA = ["Крым", "игристое", "года", "Алушта", "портвейн"]


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")

    def one(of: list[str], n: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, of)), (n % len(of) + 1).cast("int"))

    name = F.concat(F.lit("vin"), F.translate(key.cast("string"), "0123456789", "abcdefghij"))
    year = F.when(key % 3 == 0, F.concat(F.lit("20"), (10 + key % 20).cast("string")))
    title = F.concat_ws(" ", "p_name", name, year, F.when(key % 4 == 0, one(MAKERS, size)), F.when(key % 2 == 0, one(EXTRA, F.floor(key / 2))))
    return table(spark, sf_dir, "part").select(
        key.alias("slug"), title.alias("title"), one(MAKERS, size).alias("manufacturer"), F.array(one(VARIETIES, key)).alias("grapes"),
        F.when(key % 7 != 0, one(SWEET, size)).alias("sweetness"), F.when(key % 5 != 0, one(COLOUR, size)).alias("colour"), (9 + size % 12 / 2.0).alias("alcohol"),
    )


def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five cards for every hundredth part."""
    p = table(spark, sf_dir, "part")
    n = p.agg(F.count("*").alias("n"))  # one row
    asked = p.filter("p_partkey % 100 = 0").join(F.broadcast(n)).select("p_partkey", "n", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("place"))
    q = F.floor(F.col("p_partkey") / 100)
    return asked.select(
        F.col("p_partkey").alias("query_id"), ((F.col("p_partkey") + F.col("place") * (17 + q % 5)) % F.col("n")).alias("slug"), "place",
        ((q * 7 + F.col("place") * 13) % 40 + 1).alias("inliers"), ((q * 3 + F.col("place") * 5) % 11 / 10.0).alias("cv"), ((q + F.col("place") * 3) % 16 / 16.0).alias("coverage"),
    )


def read_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, …): the card of which each query's label is."""
    rows = shortlist(spark, sf_dir).filter(F.col("place") == F.floor(F.col("query_id") / 100) % 3)
    return rows.select("query_id", "slug").join(cards(spark, sf_dir), "slug")


def read_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, token, conf): words of the label, on every third the maker's too; those with an even number of letters are read surely."""
    rows = read_cards(spark, sf_dir)
    maker = F.when(F.floor(F.col("query_id") / 100) % 3 == 0, F.col("manufacturer"))
    found = rows.select("query_id", F.explode(F.split(text.clean(F.concat_ws(" ", "title", F.array_join("grapes", " "), maker)), " ")).alias("token"))
    return found.withColumn("conf", F.when(F.length("token") % 2 == 0, 0.9).otherwise(0.7))


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def canonical_sql(c: str) -> str:
    aliases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words.ALIASES.items())
    return f"coalesce(CASE {c} {aliases} END, CASE WHEN regexp_full_match({c}, '[a-z]{{5,}}') AND {c} NOT IN ({quoted(text.category_words() + words.GENERIC_WORDS)}) THEN {translit_sql(c)} ELSE {c} END)"


def single(c: str) -> str:
    """Cyrillic letters as single bytes that no Latin token has: DuckDB's levenshtein counts bytes."""
    return f"translate({c}, 'абвгдежзийклмнопрстуфхцчшщъыьэюя', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*')"


MATCH = f"""CASE WHEN q = d THEN 1.0 WHEN length(q) >= 4 AND (starts_with(d, q) OR starts_with(q, d)) AND abs(length(q) - length(d)) <= 3 THEN 0.85
WHEN greatest(length(q), length(d)) >= 8 AND levenshtein({single('q')}, {single('d')}) <= 2 THEN 0.7 WHEN greatest(length(q), length(d)) >= 5 AND levenshtein({single('q')}, {single('d')}) <= 1 THEN 0.7 ELSE 0 END"""
CARDS = f"""cards AS (SELECT p_partkey AS slug, concat_ws(' ', p_name, 'vin' || translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij'), CASE WHEN p_partkey % 3 = 0 THEN '20' || (10 + p_partkey % 20) END,
CASE WHEN p_partkey % 4 = 0 THEN [{quoted(MAKERS)}][p_size % 5 + 1] END, CASE WHEN p_partkey % 2 = 0 THEN [{quoted(EXTRA)}][p_partkey // 2 % 5 + 1] END) AS title, [{quoted(MAKERS)}][p_size % 5 + 1] AS manufacturer, [{quoted(VARIETIES)}][p_partkey % 4 + 1] AS variety,
CASE WHEN p_partkey % 7 <> 0 THEN [{quoted(SWEET)}][p_size % 3 + 1] END AS sweetness, CASE WHEN p_partkey % 5 <> 0 THEN [{quoted(COLOUR)}][p_size % 2 + 1] END AS colour, 9 + (p_size % 12) / 2.0::DOUBLE AS alcohol FROM part),
shortlist AS (SELECT p_partkey AS query_id, (p_partkey + k * (17 + p_partkey // 100 % 5)) % (SELECT count(*) FROM part) AS slug, k AS place, (p_partkey // 100 * 7 + k * 13) % 40 + 1 AS inliers,
(p_partkey // 100 * 3 + k * 5) % 11 / 10.0::DOUBLE AS cv, (p_partkey // 100 + k * 3) % 16 / 16.0::DOUBLE AS coverage FROM part, range(5) r(k) WHERE p_partkey % 100 = 0),
read_cards AS (SELECT query_id, cards.* FROM shortlist JOIN cards USING (slug) WHERE place = query_id // 100 % 3),
read AS (SELECT query_id, token, CASE WHEN length(token) % 2 = 0 THEN 0.9 ELSE 0.7 END AS conf FROM (SELECT query_id, unnest(string_split({clean_sql("concat_ws(' ', title, variety, CASE WHEN query_id // 100 % 3 = 0 THEN manufacturer END)")}, ' ')) AS token FROM read_cards))"""
BRAND = f"""maker_words AS (SELECT slug, unnest(string_split({clean_sql('manufacturer')}, ' ')) AS t FROM cards), brand1 AS (SELECT slug, {canonical_sql('t')} AS t FROM maker_words WHERE length(t) >= 4 AND t NOT IN ({quoted(words.GENERIC_WORDS)})),
brand AS (SELECT DISTINCT slug, CASE WHEN regexp_full_match(t, '[a-z0-9]+') AND NOT regexp_full_match(t, '[0-9]+') THEN {translit_sql('t')} ELSE t END AS word FROM brand1)"""
FEATURES = f"""{CARDS}, {BRAND}, producer AS (SELECT DISTINCT slug, {canonical_sql('t')} AS word FROM maker_words WHERE length(t) >= 4),
varieties AS (SELECT DISTINCT slug, {canonical_sql('t')} AS word FROM (SELECT slug, unnest(string_split({clean_sql('variety')}, ' ')) AS t FROM cards) WHERE length(t) >= 3),
title_words AS (SELECT DISTINCT slug, t, {canonical_sql('t')} AS word FROM (SELECT slug, unnest(string_split({clean_sql('title')}, ' ')) AS t FROM cards) WHERE length(t) >= 3),
spelled AS (SELECT slug, t, t AS q FROM title_words UNION SELECT slug, t, word FROM title_words UNION SELECT slug, t, {translit_sql('t')} FROM title_words WHERE regexp_full_match(t, '[a-z]+')),
of_maker AS (SELECT DISTINCT slug, t FROM (SELECT s.slug, t, q, k.word AS d FROM spelled s JOIN (SELECT * FROM producer UNION SELECT * FROM brand) k USING (slug)) WHERE q = d OR length(d) >= 5 AND {MATCH} >= 0.7),
name AS (SELECT DISTINCT slug, word FROM title_words w WHERE NOT EXISTS (SELECT 1 FROM of_maker m WHERE m.slug = w.slug AND m.t = w.t) AND word NOT IN ({quoted(sorted({*words.CARD_STOPWORDS, *text.category_words()}))})
EXCEPT SELECT * FROM producer EXCEPT SELECT * FROM varieties), years AS (SELECT DISTINCT slug, t AS word FROM title_words WHERE regexp_full_match(t, '19[89][0-9]|20[0-3][0-9]'))"""


def listed(kind: str) -> str:
    return f"coalesce((SELECT string_agg(word, ' ' ORDER BY word) FROM {kind} k WHERE k.slug = c.slug), '') AS {kind}"


@query(f"WITH {CARDS} SELECT slug, unnest(list_distinct(regexp_extract_all(title, '{YEAR_SQL}', 1))) AS year FROM cards")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).select("slug", F.explode(text.years(F.col("title"))).alias("year"))


@query(f"WITH {FEATURES} SELECT c.slug, {', '.join(map(listed, ('producer', 'name', 'varieties', 'years')))} FROM cards c")
def card_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.features(cards(spark, sf_dir))
    return found.select("slug", *[F.array_join(F.array_sort(c), " ").alias(c) for c in ("producer", "name", "varieties", "years")])


@query(f"WITH {CARDS}, {BRAND}, keys AS (SELECT c.slug, c.manufacturer, coalesce((SELECT string_agg(word, ' ' ORDER BY word) FROM brand b WHERE b.slug = c.slug), {clean_sql('manufacturer')}) AS key FROM cards c) SELECT key, count(DISTINCT manufacturer) AS spellings, count(*) AS n FROM keys GROUP BY 1")
def brand_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makers by what makes two spellings of them one."""
    keyed = cards(spark, sf_dir).select("manufacturer", evidence.brand_key(F.col("manufacturer")).alias("key"))
    return keyed.groupBy("key").agg(F.countDistinct("manufacturer").alias("spellings"), F.count("*").alias("n"))


@query(f"WITH {CARDS}, v AS (SELECT DISTINCT slug, t FROM (SELECT slug, unnest(string_split({clean_sql('title || chr(32) || variety || chr(32) || manufacturer')}, ' ')) AS t FROM cards) WHERE length(t) >= 4 AND t NOT IN ({quoted(words.GENERIC_WORDS + words.CARD_STOPWORDS)})) SELECT slug, string_agg(t, ' ' ORDER BY t) AS vocabulary FROM v GROUP BY 1")
def card_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.vocabulary(F.concat_ws(" ", "title", F.array_join("grapes", " "), "manufacturer"))
    return cards(spark, sf_dir).select("slug", F.array_join(F.array_sort(found), " ").alias("vocabulary"))


READ = f"""{CARDS}, labels_read AS (SELECT query_id, sweetness, colour, alcohol + 0.3 * (query_id // 100 % 3) AS alcohol, list_distinct(regexp_extract_all(title, '(?:19[89]|20[0-3])[0-9]')) AS years FROM read_cards),
met AS (SELECT s.query_id, s.slug, r.sweetness AS rs, r.colour AS rc, r.alcohol AS ra, r.years AS ry, c.sweetness AS cs, c.colour AS cc, c.alcohol AS ca, list_distinct(regexp_extract_all(c.title, '(?:19[89]|20[0-3])[0-9]')) AS cy
FROM shortlist s JOIN labels_read r USING (query_id) JOIN cards c ON c.slug = s.slug)"""


def met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, slug, read, card): attributes of labels beside those of the shortlisted cards."""
    rows = read_cards(spark, sf_dir)
    strength = F.col("alcohol") + 0.3 * (F.floor(F.col("query_id") / 100) % 3)
    read = rows.select("query_id", F.struct(text.years(text.clean(F.col("title"))).alias("years"), "sweetness", "colour", strength.alias("alcohol")).alias("read"))
    own = cards(spark, sf_dir).select("slug", F.struct("title", "sweetness", "colour", "alcohol").alias("card"))
    return shortlist(spark, sf_dir).select("query_id", "slug").join(read, "query_id").join(own, "slug")


@query(f"""WITH {READ}, votes AS (SELECT query_id, slug, list_filter([CASE WHEN rs = cs THEN 1.0 WHEN rs <> cs THEN -1.0 END, CASE WHEN rc = cc THEN 1.0 WHEN rc <> cc THEN -1.0 END, CASE WHEN abs(ra - ca) < 0.35 THEN 1.0 ELSE -0.5 END,
CASE WHEN len(list_intersect(ry, cy)) > 0 THEN 1.0 END]::DOUBLE[], lambda v: v IS NOT NULL) AS v FROM met) SELECT query_id, slug, round(list_sum(v) / len(v), 6) AS score FROM votes""")
def attribute_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return met(spark, sf_dir).select("query_id", "slug", r6(evidence.agreement(F.col("read"), F.col("card"))).alias("score"))


def years_sql(c: str) -> str:
    return f"'[' || array_to_string(list_transform({c}, lambda y: '''' || y || ''''), ', ') || ']'"


@query(f"""WITH {READ}, found AS (SELECT query_id, slug, list_filter([CASE WHEN rs <> cs THEN 'сладость ' || rs || ' против ' || cs END, CASE WHEN rc <> cc THEN 'цвет ' || rc || ' против «' || cc || '»' END,
CASE WHEN len(ry) > 0 AND len(cy) > 0 AND len(list_intersect(ry, cy)) = 0 THEN 'год ' || {years_sql('list_sort(ry)')} || ' против ' || {years_sql('cy')} END], lambda v: v IS NOT NULL) AS r FROM met)
SELECT query_id, slug, array_to_string(r, '; ') AS reasons FROM found WHERE len(r) > 0""")
def contradiction_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = met(spark, sf_dir).select("query_id", "slug", evidence.reasons(F.col("read"), F.col("card")).alias("r")).filter(F.size("r") > 0)
    return found.select("query_id", "slug", F.array_join("r", "; ").alias("reasons"))


def variants_sql(c: str) -> str:
    fold = f"translate({c}, '{words.LOOKALIKE_LATIN}', '{words.LOOKALIKE_CYRILLIC}')"
    return f"list_distinct([{c}, {fold}, {canonical_sql(c)}, {canonical_sql(fold)}])"


CATEGORY = quoted(text.category_words())


def named_sql(least: int) -> str:
    """named_N: cards whose own name of N letters was read surely and exactly, and is no other card's."""
    return f"""lone_{least} AS (SELECT query_id, word, min(slug) AS slug FROM shortlist JOIN name USING (slug) WHERE length(word) >= {least} AND word NOT IN ({quoted(words.GENERIC_WORDS + words.CARD_STOPWORDS)}) GROUP BY 1, 2 HAVING count(DISTINCT slug) = 1),
spoken_{least} AS (SELECT DISTINCT query_id, token, unnest({variants_sql('token')}) AS word FROM read WHERE conf >= 0.85 AND length(token) >= {least} AND token NOT IN ({CATEGORY})),
named_{least} AS (SELECT DISTINCT query_id, slug FROM (SELECT query_id, min(slug) AS slug FROM spoken_{least} JOIN lone_{least} USING (query_id, word) GROUP BY query_id, token HAVING count(DISTINCT slug) = 1))"""


OWNERS = f"""{FEATURES}, {named_sql(5)}, {named_sql(7)},
owners AS (SELECT n.query_id, n.slug FROM named_5 n JOIN shortlist s USING (query_id, slug) JOIN (SELECT query_id, max(inliers) AS best FROM shortlist GROUP BY 1) USING (query_id) WHERE inliers >= 0.4 * best OR (n.query_id, n.slug) IN (SELECT query_id, slug FROM named_7))"""


@query(f"WITH {OWNERS} SELECT query_id, slug FROM owners")
def name_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.name_owners(shortlist(spark, sf_dir), cards(spark, sf_dir), read_words(spark, sf_dir))


@query(f"WITH {OWNERS} SELECT s.query_id, s.slug, s.inliers >= 0.8 * max(s.inliers) OVER (PARTITION BY s.query_id) OR o.slug IS NOT NULL AS in_group FROM shortlist s LEFT JOIN owners o USING (query_id, slug)")
def comparison_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shortlist(spark, sf_dir)
    owners = evidence.name_owners(rows, cards(spark, sf_dir), read_words(spark, sf_dir))
    return evidence.comparison_group(rows, owners).select("query_id", "slug", "in_group")


OWN = """SELECT s.query_id, s.slug, k.word FROM {rows} s JOIN (SELECT slug, word, false AS maker FROM name UNION SELECT slug, word, false FROM varieties UNION SELECT slug, word, false FROM years UNION SELECT slug, word, true FROM producer) k USING (slug)
JOIN (SELECT query_id, count(DISTINCT p) > 1 AS differ FROM {rows} JOIN (SELECT c.slug, coalesce((SELECT string_agg(word, ' ' ORDER BY word) FROM producer p WHERE p.slug = c.slug), '') AS p FROM cards c) USING (slug) GROUP BY 1) d USING (query_id) WHERE NOT k.maker OR d.differ"""


def leader_sql(rows: str) -> str:
    """checks (query_id, slug, conflicts, confirmed) of the leaders of a table of shortlists."""
    return f"""lead AS (SELECT query_id, slug, manufacturer, inliers FROM {rows} JOIN cards USING (slug) WHERE place = 0), own AS (SELECT DISTINCT * FROM ({OWN.format(rows=rows)})),
marks AS (SELECT * FROM own WHERE (query_id, word) NOT IN (SELECT query_id, word FROM own GROUP BY 1, 2 HAVING count(DISTINCT slug) = 5)),
mine AS (SELECT query_id, word FROM marks JOIN lead USING (query_id, slug) UNION SELECT query_id, word FROM lead JOIN (SELECT * FROM name UNION SELECT * FROM varieties UNION SELECT * FROM producer) USING (slug)),
looked AS (SELECT DISTINCT query_id, token FROM read WHERE length(token) >= 3 AND token NOT IN ({CATEGORY})), ways AS (SELECT query_id, token, unnest({variants_sql('token')}) AS q FROM (SELECT query_id, token, max(conf) FROM read WHERE length(token) >= 3 GROUP BY 1, 2)),
excused AS (SELECT DISTINCT query_id, token FROM (SELECT query_id, token, q, word AS d FROM ways JOIN mine USING (query_id)) WHERE {MATCH} >= 0.7),
others AS (SELECT m.query_id, m.slug, m.word FROM marks m JOIN cards c USING (slug) JOIN lead l ON l.query_id = m.query_id WHERE m.slug <> l.slug AND c.manufacturer <> l.manufacturer),
against AS (SELECT query_id, token FROM looked JOIN ways USING (query_id, token) JOIN others USING (query_id) WHERE q = word AND (query_id, token) NOT IN (SELECT query_id, token FROM excused) GROUP BY 1, 2 HAVING count(DISTINCT others.slug) = 1),
kin AS (SELECT s.query_id, s.slug FROM {rows} s JOIN cards c USING (slug) JOIN lead l ON l.query_id = s.query_id AND l.manufacturer = c.manufacturer WHERE s.place > 0 AND s.inliers >= 0.5 * (SELECT max(inliers) FROM {rows} b WHERE b.query_id = s.query_id)),
near AS (SELECT s.query_id, s.slug FROM {rows} s JOIN lead l USING (query_id) WHERE s.slug <> l.slug AND s.inliers >= 0.8 * l.inliers UNION SELECT * FROM kin), group_ AS (SELECT * FROM near UNION SELECT query_id, slug FROM lead WHERE query_id IN (SELECT query_id FROM near)),
own_near AS (SELECT DISTINCT * FROM ({OWN.format(rows='group_')})), lone AS (SELECT query_id, word FROM own_near o JOIN lead l USING (query_id) GROUP BY 1, 2 HAVING bool_and(o.slug = l.slug)),
sure AS (SELECT DISTINCT query_id, token FROM (SELECT query_id, token, conf, q, word AS d FROM (SELECT query_id, token, max(conf) AS conf FROM read GROUP BY 1, 2) JOIN ways USING (query_id, token) JOIN lone USING (query_id)) WHERE {MATCH} >= CASE WHEN conf >= 0.85 THEN 0.7 ELSE 0.85 END),
checks AS (SELECT query_id, slug, (SELECT count(*) FROM against a WHERE a.query_id = l.query_id) AS conflicts, (SELECT count(*) FROM sure a WHERE a.query_id = l.query_id) AS confirmed FROM lead l)"""


@query(f"WITH {FEATURES}, {leader_sql('shortlist')} SELECT * FROM checks")
def leader_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that speak against and for the first card of each shortlist; of the catalogue only shortlisted cards are looked at."""
    rows, read = stored(shortlist(spark, sf_dir), "shortlist"), stored(read_words(spark, sf_dir), "read")
    return evidence.leader_evidence(rows, resolution.listed(cards(spark, sf_dir), rows), read)


#: Is a spelling q within a fifth of the longer length of a word d? DuckDB's distance lets edits follow on a swap, which these words don't need.
NEAR = f"damerau_levenshtein({single('q')}, {single('d')}) <= floor(greatest(length(q), length(d)) * 0.2 + 1e-9)"
PLAIN = quoted(words.GENERIC_WORDS + words.CARD_STOPWORDS)
VOCABULARY = f"""vocabulary AS (SELECT DISTINCT query_id, slug, place, d FROM (SELECT query_id, slug, place, unnest(string_split({clean_sql('title || chr(32) || variety || chr(32) || manufacturer')}, ' ')) AS d FROM ROWS JOIN cards USING (slug)) WHERE length(d) >= 4 AND d NOT IN ({PLAIN}))"""


@query(f"""WITH {CARDS}, {VOCABULARY.replace('ROWS', 'shortlist')}, t AS (SELECT DISTINCT query_id, token, unnest({variants_sql('token')}) AS q FROM read WHERE conf >= 0.85 AND length(token) >= 5 AND token NOT IN ({PLAIN})),
met AS (SELECT DISTINCT query_id, token, slug, place FROM t JOIN vocabulary USING (query_id) WHERE {NEAR})
SELECT DISTINCT query_id, slug, place FROM met WHERE place > 0 AND (query_id, token) NOT IN (SELECT query_id, token FROM met WHERE place = 0)""")
def text_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with a word that was read surely and that the leader's card lacks, with their places."""
    rows, read = stored(shortlist(spark, sf_dir), "shortlist"), stored(read_words(spark, sf_dir), "read")
    own = stored(cards(spark, sf_dir).join(rows.select("slug").distinct(), "slug", "left_semi"), "listed")
    known = evidence.vocabulary(F.concat_ws(" ", "title", F.array_join("grapes", " "), "manufacturer"))
    near = stored(textsearch.near_spellings(read.select("token").distinct(), own.select(F.explode(known).alias("word")).distinct(), 0.2), "near")
    return evidence.contradicted(rows, own, read, near).join(rows.select("query_id", "slug", "place"), ["query_id", "slug"])


NEED = "CASE WHEN conf >= 0.85 THEN 0.7 ELSE 0.85 END"
HARDS = ["rs IS NOT NULL AND cs IS NOT NULL AND rs <> cs", "rc IS NOT NULL AND cc IS NOT NULL AND NOT contains(cc, rc)", "len(ry) > 0 AND len(cy) > 0 AND len(list_intersect(ry, cy)) = 0"]
HARD = " OR ".join(f"({h})" for h in HARDS)


def place_sql(order: str) -> str:
    return f"CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}, place) - 1 AS INT) AS place"


#: From `start` (a shortlist) to `settled` (… reasons, hard, place): brand, missing words, votes, contradicted leaders.
SETTLED = f"""keyed AS (SELECT c.slug, coalesce((SELECT string_agg(word, ' ' ORDER BY word) FROM brand b WHERE b.slug = c.slug), {clean_sql('manufacturer')}) AS key FROM cards c),
brand_known AS (SELECT s.query_id, s.slug, b.word AS d, key FROM shortlist s JOIN brand b USING (slug) JOIN keyed USING (slug) WHERE length(b.word) >= 5 QUALIFY count(DISTINCT key) OVER (PARTITION BY s.query_id, b.word) = 1),
brand_read AS (SELECT query_id, token, max(conf) AS conf FROM read WHERE length(token) >= 5 GROUP BY 1, 2),
brand_ways AS (SELECT query_id, token, conf, unnest(list_distinct(list_append({variants_sql('token')}, CASE WHEN regexp_full_match(token, '[a-z0-9]+') AND NOT regexp_full_match(token, '[0-9]+') THEN {translit_sql('token')} ELSE token END))) AS q FROM brand_read),
brand_found AS (SELECT DISTINCT query_id, slug, key FROM brand_ways JOIN brand_known USING (query_id) WHERE {MATCH} >= {NEED}),
brand_own AS (SELECT query_id, slug FROM brand_found WHERE query_id IN (SELECT query_id FROM brand_found GROUP BY 1 HAVING count(DISTINCT key) = 1)),
by_brand AS (SELECT * EXCLUDE (place), {place_sql('((query_id, slug) IN (SELECT query_id, slug FROM brand_own)) DESC')} FROM start),
flags AS (SELECT *, (query_id, slug) IN (SELECT query_id, slug FROM owners) AS kin, (query_id, slug) IN (SELECT query_id, slug FROM named_7) AS strong, max(inliers) OVER w AS best FROM by_brand WINDOW w AS (PARTITION BY query_id)),
inside AS (SELECT query_id, slug FROM (SELECT *, inliers >= 0.8 * best OR kin OR coalesce(place < max(CASE WHEN strong THEN place END) OVER w, false) OR strong AND place > 0 AS i,
  count(*) FILTER (WHERE inliers >= 0.8 * best) OVER w >= 2 OR count(*) FILTER (WHERE kin AND place > 0) OVER w > 0 AS several FROM flags WINDOW w AS (PARTITION BY query_id)) WHERE i AND several),
compared AS (SELECT * FROM inside QUALIFY count(*) OVER (PARTITION BY query_id) > 1), own_c AS (SELECT DISTINCT * FROM ({OWN.format(rows='compared')})),
marks_c AS (SELECT * FROM own_c WHERE (query_id, word) NOT IN (SELECT query_id, word FROM own_c o GROUP BY 1, 2 HAVING count(DISTINCT slug) = (SELECT count(*) FROM compared c WHERE c.query_id = o.query_id))),
read_c AS (SELECT row_number() OVER () AS n, query_id, token, conf FROM read WHERE length(token) >= 3 AND token NOT IN ({CATEGORY}) AND token NOT IN ({quoted(words.GENERIC_WORDS)})),
ways_c AS (SELECT n, query_id, conf, unnest({variants_sql('token')}) AS q FROM read_c),
owns_c AS (SELECT DISTINCT n, query_id, slug FROM (SELECT n, query_id, slug, conf, q, word AS d FROM ways_c JOIN marks_c USING (query_id)) WHERE {MATCH} >= {NEED}),
split_c AS (SELECT n, query_id FROM owns_c GROUP BY 1, 2 HAVING count(*) < (SELECT count(*) FROM compared c WHERE c.query_id = owns_c.query_id)),
lacks AS (SELECT query_id, slug, count(*)::INT AS reasons FROM split_c JOIN compared USING (query_id) WHERE (n, query_id, slug) NOT IN (SELECT n, query_id, slug FROM owns_c) GROUP BY 1, 2),
reasoned AS (SELECT b.*, coalesce(l.reasons, 0) AS reasons FROM by_brand b LEFT JOIN lacks l USING (query_id, slug)), by_words AS (SELECT * EXCLUDE (place), {place_sql('reasons')} FROM reasoned),
{VOCABULARY.replace('ROWS', 'by_words')}, vote_ways AS (SELECT DISTINCT query_id, token, unnest({variants_sql('token')}) AS q FROM read WHERE length(token) >= 4 AND token NOT IN ({PLAIN})),
vote_counts AS (SELECT query_id, slug, count(DISTINCT token) AS votes FROM vote_ways JOIN vocabulary USING (query_id) WHERE {NEAR} GROUP BY 1, 2),
voted AS (SELECT b.*, coalesce(v.votes, 0) AS votes FROM by_words b LEFT JOIN vote_counts v USING (query_id, slug)),
won AS (SELECT *, votes = most AND votes >= 2 AND votes > lead_votes AND count(*) FILTER (WHERE votes = most) OVER (PARTITION BY query_id) = 1 AS wins FROM (SELECT *, max(votes) OVER w AS most, max(CASE WHEN place = 0 THEN votes END) OVER w AS lead_votes FROM voted WINDOW w AS (PARTITION BY query_id))),
by_votes AS (SELECT * EXCLUDE (place, votes, most, lead_votes, wins), {place_sql('wins DESC')} FROM won),
struck AS (SELECT b.*, CASE WHEN {HARD} THEN 1 ELSE 0 END AS hard FROM by_votes b JOIN met USING (query_id, slug)),
depths AS (SELECT *, least(k, 4) AS m FROM (SELECT *, min(CASE WHEN hard = 0 THEN place END) OVER (PARTITION BY query_id) AS k FROM struck)),
settled AS (SELECT * EXCLUDE (place, k, m), {place_sql('CASE WHEN k IS NULL OR k = 0 THEN place WHEN place < m THEN k - place WHEN place < k THEN place - m WHEN place = k THEN k - m ELSE place END')} FROM depths)"""
#: `labels_read` and `met` of READ, after the CTEs of OWNERS.
LABELS = READ.removeprefix(f"{CARDS}, ")
RULES = Rules(text_vote=0.2)


def label_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, read): attributes that the labels state."""
    strength = F.col("alcohol") + 0.3 * (F.floor(F.col("query_id") / 100) % 3)
    return read_cards(spark, sf_dir).select("query_id", F.struct(text.years(text.clean(F.col("title"))).alias("years"), "sweetness", "colour", strength.alias("alcohol")).alias("read"))


@query(f"WITH {OWNERS}, {LABELS}, start AS (SELECT * FROM shortlist), {SETTLED} SELECT query_id, slug, reasons, hard, place FROM settled")
def settled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that changes the answer, in turn: the read maker first, words that cards lack, votes, contradicted leaders."""
    found = resolution.settled(shortlist(spark, sf_dir), cards(spark, sf_dir), read_words(spark, sf_dir), label_reads(spark, sf_dir), RULES)
    return found.select("query_id", "slug", "reasons", (F.col("hard") > 0).cast("int").alias("hard"), "place")


@query(f"WITH {OWNERS}, {LABELS}, start AS (SELECT * FROM shortlist), {SETTLED} SELECT query_id, slug FROM brand_own")
def brand_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the one maker whose name was read."""
    return resolution.brand_owners(shortlist(spark, sf_dir), cards(spark, sf_dir), read_words(spark, sf_dir))


@query(f"WITH {FEATURES}, {leader_sql('shortlist')} SELECT query_id, slug FROM kin")
def series_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the leader's maker with half of the best inliers."""
    return evidence.series_rivals(shortlist(spark, sf_dir), cards(spark, sf_dir))


def logit_sql(j: int) -> str:
    return " + ".join(f"{c} * ({w[j]!r}::DOUBLE)" for c, w in zip([*words.FEATURES, "1"], words.OUTCOME_WEIGHTS, strict=True))


def outcome_sql(name: str, conflicts: str) -> str:
    """`name` (query_id, slug, p_top1, p_top5) of the settled leaders, with a number of conflicts against each."""
    return f"""{name} AS (SELECT query_id, slug, e0 / (e0 + e1 + e2) AS p_top1, (e0 + e1) / (e0 + e1 + e2) AS p_top5 FROM (SELECT query_id, slug, exp(greatest(l0 - greatest(l0, l1, l2), -30)) AS e0, exp(greatest(l1 - greatest(l0, l1, l2), -30)) AS e1, exp(greatest(l2 - greatest(l0, l1, l2), -30)) AS e2
FROM (SELECT query_id, slug, {logit_sql(0)} AS l0, {logit_sql(1)} AS l1, {logit_sql(2)} AS l2 FROM (SELECT f.*, least({conflicts}, 3) / 3.0::DOUBLE AS text_conflict FROM feats f JOIN checks USING (query_id)))))"""


@query(f"""WITH {OWNERS}, {LABELS}, tops AS (SELECT query_id, list(inliers ORDER BY inliers DESC) AS t FROM shortlist GROUP BY 1),
start AS (SELECT query_id, slug, inliers, cv, coverage, {place_sql('CASE WHEN t[1] >= t[2] * 1.5 THEN inliers ELSE 0 END DESC, cv DESC')} FROM shortlist JOIN tops USING (query_id)), {SETTLED}, {leader_sql('settled')},
rival AS (SELECT query_id, cv, inliers FROM settled WHERE place > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY reasons > 0, place) = 1), mean AS (SELECT query_id, avg(cv) AS tail FROM settled GROUP BY 1), beaten AS (SELECT query_id, max((place > 0 AND reasons > 0)::INT) AS others FROM settled GROUP BY 1),
feats AS (SELECT l.query_id, l.slug, l.inliers::DOUBLE / (l.inliers + r.inliers) AS dominance, ln(1 + l.inliers) AS log_inliers, l.cv - r.cv AS cv_margin, l.cv - tail AS cv_lift, l.coverage, (l.reasons = 0 AND others = 1)::INT::DOUBLE AS text_support, l.hard
FROM settled l JOIN rival r USING (query_id) JOIN mean USING (query_id) JOIN beaten USING (query_id) WHERE l.place = 0),
{outcome_sql('first_out', '0')}, counted AS (SELECT query_id, CASE WHEN p_top1 >= 0.05 THEN checks.conflicts + hards ELSE 0 END AS conflicts, CASE WHEN p_top1 >= 0.05 THEN confirmed ELSE 0 END AS confirmed FROM first_out JOIN checks USING (query_id) JOIN (SELECT query_id, {' + '.join(f'CASE WHEN {h} THEN 1 ELSE 0 END' for h in HARDS)} AS hards FROM met JOIN lead USING (query_id, slug)) USING (query_id)),
{outcome_sql('last_out', '(SELECT conflicts FROM counted k WHERE k.query_id = f.query_id)')},
crowd AS (SELECT query_id, count(*) FILTER (WHERE inliers >= 0.8 * most) >= 2 OR (SELECT count(*) FROM kin WHERE kin.query_id = m.query_id) >= 2 AS crowded FROM (SELECT *, max(inliers) OVER (PARTITION BY query_id) AS most FROM settled) m GROUP BY 1)
SELECT query_id, slug, round(p_top1, 6) AS p_top1, round(p_top5, 6) AS p_top5, conflicts::INT AS conflicts, confirmed::INT AS confirmed,
CASE WHEN p_top1 < {words.SHOW_P} THEN 'unsure' WHEN p_top1 >= {words.CONFIDENT_P} AND conflicts = 0 AND (NOT crowded OR confirmed > 0) THEN 'confident' ELSE 'uncertain' END AS state FROM last_out JOIN counted USING (query_id) JOIN crowd USING (query_id)""")
def retrieve_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortlists to answers in one plan: order, settle, check, calibrated outcome, state."""
    found = resolution.answered(shortlist(spark, sf_dir), cards(spark, sf_dir), read_words(spark, sf_dir), label_reads(spark, sf_dir), RULES)
    return found.select("query_id", "slug", r6("p_top1").alias("p_top1"), r6("p_top5").alias("p_top5"), "conflicts", "confirmed", "state")


RESCUE = f"""{CARDS}, refused AS (SELECT l.query_id, CASE WHEN l.query_id // 100 % 4 <> 0 THEN l.slug END AS gold, v.variant, CASE WHEN l.query_id // 100 % 3 <> 0 THEN m.slug END AS maker_slug, m.cv AS maker_close, m.inliers / 41.0 AS maker_p, g.slug AS global_slug, g.cv AS global_close, g.inliers / 41.0 AS global_p
FROM shortlist l JOIN shortlist m ON m.query_id = l.query_id AND m.place = l.query_id // 100 % 2 JOIN shortlist g ON g.query_id = l.query_id AND g.place = l.query_id // 100 % 3, (VALUES ('full'), ('short')) v(variant) WHERE l.place = 0)"""


@query(f"""WITH {RESCUE}, own AS (SELECT variant, scope, close, p, gold, CASE WHEN w THEN global_slug ELSE maker_slug END AS s, CASE WHEN w THEN global_close ELSE maker_close END AS c, CASE WHEN w THEN global_p ELSE maker_p END AS y
FROM (SELECT *, scope = 'global' AND maker_slug IS NULL AS w FROM refused, (VALUES ('maker'), ('global')) a(scope), (VALUES (0.5), (0.7)) b(close), (VALUES (0.0), (0.5)) d(p)))
SELECT variant, scope, close::DOUBLE AS close, p::DOUBLE AS p, count(*) FILTER (WHERE s IS NOT NULL AND c >= close AND y >= p AND s = gold) AS "right", count(*) FILTER (WHERE s IS NOT NULL AND c >= close AND y >= p AND gold IS NULL) AS absent,
count(*) FILTER (WHERE s IS NOT NULL AND c >= close AND y >= p AND gold <> s) AS wrong FROM own GROUP BY 1, 2, 3, 4""")
def label_rescue_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = shortlist(spark, sf_dir), F.floor(F.col("query_id") / 100)
    maker = rows.filter(F.col("place") == q % 2).select("query_id", F.when(q % 3 != 0, F.col("slug")).alias("maker_slug"), F.col("cv").alias("maker_close"), (F.col("inliers") / 41.0).alias("maker_p"))
    whole = rows.filter(F.col("place") == q % 3).select("query_id", F.col("slug").alias("global_slug"), F.col("cv").alias("global_close"), (F.col("inliers") / 41.0).alias("global_p"))
    lead = rows.filter("place = 0").select("query_id", F.when(q % 4 != 0, F.col("slug")).alias("gold"), F.explode(F.array(F.lit("full"), F.lit("short"))).alias("variant"))
    return evidence.rescued(lead.join(maker, "query_id").join(whole, "query_id"), [0.5, 0.7], [0.0, 0.5])


TOPS = f"""{CARDS}, tops AS (SELECT query_id, list(inliers ORDER BY inliers DESC) AS t FROM shortlist GROUP BY 1)"""


@query(f"""WITH {TOPS}, f AS (SELECT s.*, t[1] < t[2] * 1.5 AND t[1] > 0 AS ruled, inliers < 0.5 * t[1] AS low FROM shortlist s JOIN tops USING (query_id))
SELECT query_id, slug, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ruled THEN low::INT ELSE 0 END, CASE WHEN ruled THEN -cv ELSE 0 END, place) - 1 AS INT) AS place FROM f""")
def floor_share_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.floor_share_order(shortlist(spark, sf_dir), 0.5, 0.5).select("query_id", "slug", "place")


@query(f"""WITH {TOPS}, d AS (SELECT s.*, CASE WHEN s.slug % 4 <> 0 THEN (s.slug % 9) * 2.0 END AS dist, t FROM shortlist s JOIN tops USING (query_id)),
g AS (SELECT *, t[1] > 0 AND t[1] < t[2] * 1.5 AS tied, inliers >= t[1] / 1.5 AS grp FROM d), m AS (SELECT *, min(CASE WHEN grp THEN dist END) OVER w AS least_, count(CASE WHEN grp THEN dist END) OVER w AS known FROM g WINDOW w AS (PARTITION BY query_id)),
k AS (SELECT *, grp AND (dist IS NULL OR dist <= least_ + 5) AS kept FROM m), r AS (SELECT *, tied AND known >= 2 AND count(*) FILTER (WHERE kept) OVER w < count(*) FILTER (WHERE grp) OVER w AS ruled FROM k WINDOW w AS (PARTITION BY query_id))
SELECT query_id, slug, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ruled THEN (NOT kept)::INT ELSE 0 END, CASE WHEN ruled THEN -cv ELSE 0 END, place) - 1 AS INT) AS place FROM r""")
def colour_tie_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shortlist(spark, sf_dir).withColumn("colour_distance", F.when(F.col("slug") % 4 != 0, F.col("slug") % 9 * 2.0))
    return evidence.colour_tie_order(rows, 0.5, 5.0).select("query_id", "slug", "place")
