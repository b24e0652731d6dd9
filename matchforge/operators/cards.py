"""Evidence of label words for and against catalogue cards.

Cards are (slug, title, manufacturer, grapes array, sweetness, colour, alcohol);
a shortlist is (query_id, slug, place, inliers), words are (query_id, token,
conf) with tokens already cleaned and in the central band. All operators join by
keys; a query's shortlist is some dozen cards, so no join widens with the
catalogue. Different read tokens and different card words are compared once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchforge.functions import text, words
from matchforge.sources.shared import stored

#: Least similarity of a word read surely and of one read vaguely, and the confidence that divides them.
SURE_MATCH, VAGUE_MATCH, SURE_CONF = 0.7, 0.85, 0.85
#: Letters of a name that is evidence whatever the geometry says, and the share of the best inliers that others need.
STRONG_NAME, FLOOR = 7, 0.4


def forms(token: Column) -> Column:
    """A token of a title in the ways in which a maker's name may be written."""
    latin = F.when(token.rlike("^[a-z]+$"), text.translit(token))
    return F.array_compact(F.array(token, text.canonical(token), latin))


def brand_tokens(name: Column) -> Column:
    """Words of a maker's name in canonical letters, without words that name any maker."""
    own = F.filter(F.split(text.clean(name), " "), lambda t: (F.length(t) >= 4) & ~t.isin(words.GENERIC_WORDS))
    canon = F.transform(own, text.canonical)
    return F.transform(canon, lambda t: F.when(t.rlike("^[a-z0-9]+$") & ~t.rlike("^[0-9]+$"), text.translit(t)).otherwise(t))


def brand_key(name: Column) -> Column:
    """What makes two spellings of a maker one: the set of its tokens, or the cleaned name if it has none."""
    tokens = F.array_sort(F.array_distinct(brand_tokens(name)))
    return F.when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise(text.clean(name))


def vocabulary(card_text: Column) -> Column:
    """The words by which a card is known, from its title, varieties and maker in one text."""
    plain = words.GENERIC_WORDS + words.CARD_STOPWORDS
    return F.array_distinct(F.filter(F.split(text.clean(card_text), " "), lambda t: (F.length(t) >= 4) & ~t.isin(plain)))


def features(cards: DataFrame) -> DataFrame:
    """(slug, producer, name, varieties, years): sets of canonical words of each card, each word in one of them.

    Title words that write the maker's name, in either alphabet and with few
    wrong letters, are no name. Cards that have these columns keep them.
    """
    if "producer" in cards.columns:
        return cards.select("slug", "producer", "name", "varieties", "years")

    def split(c: Column, least: int) -> Column:
        return F.array_distinct(F.transform(F.filter(F.split(text.clean(F.coalesce(c, F.lit(""))), " "), lambda t: F.length(t) >= least), text.canonical))

    title = text.clean(F.coalesce("title", F.lit("")))
    base = cards.select(
        "slug", title.alias("title"), split(F.col("manufacturer"), 4).alias("producer"), split(F.array_join("grapes", " "), 3).alias("varieties"),
        brand_tokens(F.coalesce("manufacturer", F.lit(""))).alias("brand"), text.years(title).alias("years"),
    )
    known = F.array_union("producer", "brand")

    def of_maker(token: Column) -> Column:
        return F.exists(forms(token), lambda f: F.array_contains(known, f) | F.exists(known, lambda k: (F.length(k) >= 5) & (text.tokens_match(f, k) >= SURE_MATCH)))

    left = F.filter(F.split("title", " "), lambda t: (F.length(t) >= 3) & ~of_maker(t))
    plain = F.array(*map(F.lit, sorted({*words.CARD_STOPWORDS, *text.category_words()})))
    name = F.array_except(F.array_except(F.array_distinct(F.transform(left, text.canonical)), F.array_union("producer", "varieties")), plain)
    return base.select("slug", "producer", name.alias("name"), "varieties", "years")


def agreement(read: Column, card: Column) -> Column:
    """How far read attributes and a card's agree, -1 to 1: the mean of the votes of those that both have, 0 without any."""
    def vote(both: Column, agree: Column, against: float) -> Column:
        return F.when(both, F.when(agree, F.lit(1.0)).otherwise(F.lit(against)))

    years = F.exists(read["years"], lambda y: F.contains(text.clean(card["title"]), y))
    votes = F.array_compact(F.array(
        vote(read["sweetness"].isNotNull() & card["sweetness"].isNotNull(), read["sweetness"] == card["sweetness"], -1.0),
        vote(read["colour"].isNotNull() & card["colour"].isNotNull(), read["colour"] == card["colour"], -1.0),
        vote((read["alcohol"] != 0) & (card["alcohol"] != 0), F.abs(read["alcohol"] - card["alcohol"]) < 0.35, -0.5),
        F.when(F.coalesce(years, F.lit(False)), F.lit(1.0)),
    ))
    return F.when(F.size(votes) > 0, F.aggregate(votes, F.lit(0.0), lambda a, b: a + b) / F.size(votes)).otherwise(F.lit(0.0))


def reasons(read: Column, card: Column) -> Column:
    """Why a card can't be what was read: attributes that it has otherwise, as sentences."""
    own_years = text.years(text.clean(card["title"]))

    def listed(years: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(years, lambda y: F.concat(F.lit("'"), y, F.lit("'"))), ", "), F.lit("]"))

    return F.array_compact(F.array(
        F.when(read["sweetness"] != card["sweetness"], F.format_string("сладость %s против %s", read["sweetness"], card["sweetness"])),
        F.when(~F.contains(card["colour"], read["colour"]), F.format_string("цвет %s против «%s»", read["colour"], card["colour"])),
        F.when((F.size(read["years"]) > 0) & (F.size(own_years) > 0) & ~F.arrays_overlap(read["years"], own_years), F.concat(F.lit("год "), listed(F.array_sort(read["years"])), F.lit(" против "), listed(own_years))),
    ))


def own_words(shortlist: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, slug, word): name, varieties and years of each card of a shortlist, and its maker's words where makers differ."""
    rows = shortlist.select("query_id", "slug").join(found, "slug")
    by_query = Window.partitionBy("query_id")
    makers = F.size(F.collect_set(F.array_sort("producer")).over(by_query))
    every = F.when(makers > 1, F.array_union(F.array_union("name", "varieties"), F.array_union("years", "producer"))).otherwise(F.array_union(F.array_union("name", "varieties"), "years"))
    return rows.withColumn("words", every).select("query_id", "slug", F.explode("words").alias("word"))


def telling(own: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Words of a shortlist that not all its cards have; a card without any word has none of them."""
    cards = shortlist.groupBy("query_id").agg(F.countDistinct("slug").alias("cards"))
    shared = own.groupBy("query_id", "word").agg(F.countDistinct("slug").alias("with_word"))
    kept = shared.join(cards, "query_id").filter("with_word < cards").select("query_id", "word")
    return own.join(kept, ["query_id", "word"])


def matches(read: DataFrame, known: DataFrame, spellings: Callable[[Column], Column] = text.alphabet_variants) -> DataFrame:
    """(token, word, match) of different read tokens and known words of the same query, by the best of the token's spellings."""
    pairs = read.select("query_id", "token").distinct().join(known.select("query_id", "word").distinct(), "query_id").select("token", "word").distinct()
    best = F.array_max(F.transform(spellings(F.col("token")), lambda v: text.tokens_match(v, F.col("word"))))
    return pairs.withColumn("match", best).filter("match > 0")


def worth_a_look(read: DataFrame) -> DataFrame:
    """Tokens that can be evidence of a name: three letters at least, no word of colour or sweetness."""
    return read.filter((F.length("token") >= 3) & ~F.col("token").isin(text.category_words()))


def leader_evidence(shortlist: DataFrame, cards: DataFrame, read: DataFrame, window: float = 0.8) -> DataFrame:
    """(query_id, slug, conflicts, confirmed): words that speak against and for the first card of each shortlist.

    A word is a conflict if no spelling of it matches the leader's words and it
    is exactly a telling word of one rival alone, of another maker. It confirms
    if it matches a word that the leader has and no close rival has; one read
    surely may have wrong letters. Close are rivals within `window` of the
    leader's inliers, and those of its maker with half of the best inliers.

    Words that are looked at several times are written to the shared folder;
    else each look would plan and work them out of the catalogue anew.
    """
    found = features(cards)
    maker = shortlist.join(cards.select("slug", "manufacturer"), "slug")
    lead = maker.filter("place = 0").select("query_id", F.col("slug").alias("leader"), F.col("manufacturer").alias("own_maker"), F.col("inliers").alias("own_inliers"))
    own = own_words(shortlist, found)
    marks = stored(telling(own, shortlist), "marks")
    card_words = found.select("slug", F.explode(F.array_union(F.array_union("name", "varieties"), "producer")).alias("word"))
    of_leader = lead.join(marks, (marks["query_id"] == lead["query_id"]) & (marks["slug"] == lead["leader"])).select(lead["query_id"], "word")
    of_leader = stored(of_leader.unionByName(lead.join(card_words, F.col("leader") == F.col("slug")).select("query_id", "word")).distinct(), "of-leader")
    tokens = worth_a_look(read).select("query_id", "token").distinct()

    excused = tokens.join(of_leader, "query_id").join(matches(tokens, of_leader).filter(F.col("match") >= SURE_MATCH), ["token", "word"]).select("query_id", "token").distinct()
    others = marks.join(maker.select("query_id", "slug", "manufacturer"), ["query_id", "slug"]).join(lead, "query_id").filter((F.col("slug") != F.col("leader")) & ~F.col("manufacturer").eqNullSafe(F.col("own_maker")))
    others = stored(others.select("query_id", "slug", "word"), "others")
    claimed = tokens.join(others, "query_id").join(matches(tokens, others).filter("match = 1"), ["token", "word"])
    against = claimed.join(excused, ["query_id", "token"], "left_anti").groupBy("query_id", "token").agg(F.countDistinct("slug").alias("owners")).filter("owners = 1")
    conflicts = against.groupBy("query_id").agg(F.count("*").alias("conflicts"))

    of_series = series_rivals(shortlist, cards).select("query_id", "slug")
    rivals = shortlist.join(lead, "query_id").filter((F.col("slug") != F.col("leader")) & (F.col("inliers") >= F.col("own_inliers") * window)).select("query_id", "slug").union(of_series).distinct()
    near = rivals.unionByName(lead.join(rivals.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.col("leader").alias("slug")))
    words_near = own_words(near, found).join(lead.select("query_id", "leader"), "query_id")
    only = words_near.groupBy("query_id", "word").agg(F.bool_and(F.col("slug") == F.col("leader")).alias("only")).filter("only").select("query_id", "word")
    only = stored(only, "only")
    sure = worth_a_look_any(read).join(only, "query_id").join(matches(worth_a_look_any(read), only), ["token", "word"])
    sure = sure.filter(F.col("match") >= F.when(F.col("conf") >= SURE_CONF, SURE_MATCH).otherwise(VAGUE_MATCH))
    confirmed = sure.groupBy("query_id").agg(F.countDistinct("token").alias("confirmed"))
    zero = {"conflicts": 0, "confirmed": 0}
    return lead.select("query_id", F.col("leader").alias("slug")).join(conflicts, "query_id", "left").join(confirmed, "query_id", "left").na.fill(zero)


def worth_a_look_any(read: DataFrame) -> DataFrame:
    """Tokens of three letters and more, each with the confidence of its surest reading."""
    return read.filter(F.length("token") >= 3).groupBy("query_id", "token").agg(F.max("conf").alias("conf"))


def series_rivals(shortlist: DataFrame, cards: DataFrame, share: float = 0.5) -> DataFrame:
    """(query_id, slug) of cards of the leader's maker that have a share of the best inliers: their labels look alike, so inliers don't decide."""
    rows = shortlist.select("query_id", "slug", "place", "inliers").join(cards.select("slug", "manufacturer"), "slug")
    by_query = Window.partitionBy("query_id")
    lead = F.max(F.when(F.col("place") == 0, F.col("manufacturer"))).over(by_query)
    best = F.max("inliers").over(by_query)
    near = (best > 0) & (F.col("inliers") >= share * best) & (lead != "") & (F.col("manufacturer") == lead)
    return rows.withColumn("near", near).filter("near and place > 0").select("query_id", "slug")


def named(shortlist: DataFrame, cards: DataFrame, read: DataFrame, least: int) -> DataFrame:
    """(query_id, slug) of cards of whose own names a word of `least` letters was read surely and exactly, and is no other card's in the shortlist."""
    own = shortlist.select("query_id", "slug").join(features(cards).select("slug", F.explode("name").alias("word")), "slug")
    names = own.filter((F.length("word") >= least) & ~F.col("word").isin(words.GENERIC_WORDS + words.CARD_STOPWORDS))
    lone = names.groupBy("query_id", "word").agg(F.countDistinct("slug").alias("owners"), F.min("slug").alias("slug")).filter("owners = 1")
    tokens = read.filter((F.col("conf") >= SURE_CONF) & (F.length("token") >= least) & ~F.col("token").isin(text.category_words()))
    spelled = tokens.select("query_id", "token", F.explode(text.alphabet_variants(F.col("token"))).alias("word")).distinct()
    hits = spelled.join(lone, ["query_id", "word"]).groupBy("query_id", "token").agg(F.countDistinct("slug").alias("hits"), F.min("slug").alias("slug")).filter("hits = 1")
    return hits.select("query_id", "slug").distinct()


def name_owners(shortlist: DataFrame, cards: DataFrame, read: DataFrame) -> DataFrame:
    """(query_id, slug) of cards whose own name of five letters was read surely and exactly, and is no other card's in the shortlist.

    Such a card joins the group that text compares. It needs `FLOOR` of the best
    inliers, unless the name has `STRONG_NAME` letters.
    """
    best = shortlist.withColumn("best", F.max("inliers").over(Window.partitionBy("query_id"))).filter(F.col("inliers") >= FLOOR * F.col("best"))
    enough = best.select("query_id", "slug").unionByName(named(shortlist, cards, read, STRONG_NAME)).distinct()
    return named(shortlist, cards, read, 5).join(enough, ["query_id", "slug"])


def comparison_group(shortlist: DataFrame, owners: DataFrame, window: float = 0.8) -> DataFrame:
    """`shortlist` with in_group: near the best in inliers, or owner of a name that was read."""
    best = F.max("inliers").over(Window.partitionBy("query_id"))
    flagged = shortlist.join(owners.select("query_id", "slug", F.lit(True).alias("named")), ["query_id", "slug"], "left")
    return flagged.withColumn("in_group", (F.col("inliers") >= window * best) | F.coalesce("named", F.lit(False))).drop("named")


def contradicted(shortlist: DataFrame, cards: DataFrame, read: DataFrame, near: DataFrame) -> DataFrame:
    """(query_id, slug) of cards that have a word, read surely, that the leader's card lacks.

    `near` are pairs (token, word) close enough; `read` tokens have five letters
    and more and a confidence of 0.85.
    """
    vocab = cards.select("slug", F.explode(vocabulary(F.concat_ws(" ", "title", F.array_join("grapes", " "), "manufacturer"))).alias("word"))
    plain = words.GENERIC_WORDS + words.CARD_STOPWORDS
    tokens = read.filter((F.col("conf") >= 0.85) & (F.length("token") >= 5) & ~F.col("token").isin(plain)).select("query_id", "token").distinct()
    lead = shortlist.filter("place = 0").select("query_id", "slug")
    known = tokens.join(lead, "query_id").join(vocab, "slug").join(near, ["token", "word"]).select("query_id", "token").distinct()
    foreign = tokens.join(known, ["query_id", "token"], "left_anti")
    others = shortlist.filter("place > 0").select("query_id", "slug").join(vocab, "slug")
    return foreign.join(others, "query_id").join(near, ["token", "word"]).select("query_id", "slug").distinct()


def rescued(refused: DataFrame, close: list[float], p: list[float]) -> DataFrame:
    """Counts of right, absent and wrong answers that a label-reading rule would give where the engine refused.

    `refused` is (query_id, gold, variant, maker_slug, maker_close, maker_p,
    global_slug, global_close, global_p): the first card of the read maker, and
    of the whole catalogue. Every scope and threshold is a row of the grid.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(c).alias("close"), F.lit(q).alias("p")) for s in ("maker", "global") for c in close for q in p]))
    rows = refused.withColumn("g", grid).select("*", "g.*")
    whole = (F.col("scope") == "global") & F.col("maker_slug").isNull()
    for name in ("slug", "close", "p"):
        rows = rows.withColumn(f"own_{name}", F.when(whole, F.col(f"global_{name}")).otherwise(F.col(f"maker_{name}")))
    given = F.col("own_slug").isNotNull() & (F.col("own_close") >= F.col("close")) & (F.coalesce("own_p", F.lit(0.0)) >= F.col("p"))
    right = F.col("own_slug") == F.col("gold")
    return rows.groupBy("variant", "scope", "close", "p").agg(
        F.count_if(given & right).alias("right"), F.count_if(given & F.col("gold").isNull()).alias("absent"), F.count_if(given & F.col("gold").isNotNull() & ~right).alias("wrong")
    )


def floor_share_order(rows: DataFrame, margin: float, share: float) -> DataFrame:
    """`rows` (query_id, slug, place, inliers, cv) in the order of a replay rule: without a decisive leader, cards below `share` of the best go last, the rest by similarity."""
    by_query = Window.partitionBy("query_id")
    tops = F.sort_array(F.collect_list("inliers").over(by_query), asc=False)
    decisive = (F.size(tops) < 2) | (F.get(tops, F.lit(0)) >= F.get(tops, F.lit(1)) * (1 + margin))
    ruled = ~decisive & (F.get(tops, F.lit(0)) > 0)
    flagged = rows.withColumn("__ruled", ruled).withColumn("__low", F.col("inliers") < share * F.get(tops, F.lit(0)))
    order = [F.when(F.col("__ruled"), F.col("__low").cast("int")).otherwise(0), F.when(F.col("__ruled"), -F.col("cv")).otherwise(0.0), F.col("place")]
    return flagged.withColumn("place", F.row_number().over(by_query.orderBy(*order)) - 1).drop("__ruled", "__low")


def colour_tie_order(rows: DataFrame, margin: float, delta: float) -> DataFrame:
    """`rows` (… colour_distance) in the order of a replay rule: where several cards tie in inliers, those nearest in colour come first, then by similarity."""
    by_query = Window.partitionBy("query_id")
    tops = F.sort_array(F.collect_list("inliers").over(by_query), asc=False)
    best, second = F.get(tops, F.lit(0)), F.get(tops, F.lit(1))
    tied = (F.size(tops) >= 2) & (best > 0) & (best < second * (1 + margin))
    one = rows.withColumn("__tied", tied).withColumn("__group", F.col("inliers") >= best / (1 + margin))
    own = F.when(F.col("__group"), F.col("colour_distance"))
    one = one.withColumn("__least", F.min(own).over(by_query)).withColumn("__known", F.count(own).over(by_query))
    kept = F.col("__group") & (F.col("colour_distance").isNull() | (F.col("colour_distance") <= F.col("__least") + delta))
    one = one.withColumn("__kept", kept)
    less = F.count_if("__kept").over(by_query) < F.count_if("__group").over(by_query)
    one = one.withColumn("__ruled", F.col("__tied") & (F.col("__known") >= 2) & less)
    order = [F.when(F.col("__ruled"), (~F.col("__kept")).cast("int")).otherwise(0), F.when(F.col("__ruled"), -F.col("cv")).otherwise(0.0), F.col("place")]
    return one.withColumn("place", F.row_number().over(by_query.orderBy(*order)) - 1).drop("__tied", "__group", "__least", "__known", "__kept", "__ruled")
