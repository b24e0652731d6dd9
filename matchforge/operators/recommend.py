"""Recommendations over a catalogue with facets: slug, row_id, title, maker, colour, sweetness, sparkling, region, varieties, rating, dishes.

An unknown facet (null) is silent: it filters nothing and scores nothing. Ties
are broken by a hash of salt and slug, equal on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchforge.operators.ranking import capped

MAX_PER_MAKER = 2


def tie(salt: Column | str, slug: str = "slug") -> Column:
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.crc32(F.concat_ws("|", salt, F.col(slug).cast("string")).cast("binary"))


def title_key(title: Column) -> Column:
    """A title without years and signs: items that differ in those only are one series."""
    plain = F.regexp_replace(F.lower(title), r"(?<![0-9])(19|20)[0-9]{2}(?![0-9])|[^a-zа-яё0-9\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


#: Rows of one style that a task takes at most, on average.
STYLE_ROWS = 200_000
STYLE = ("colour", "sparkling", "sweetness")


def known(facet: str) -> Column:
    return F.concat(F.lit("="), F.col(facet).cast("string"))


def styles_met(sources: DataFrame) -> Column:
    """The keys under which these sources may ask for an item: each facet as it is or left open (*); unknown sweetness has a name (?).

    Which facets are left open together is looked up: eight rows at most.
    """
    item = [known("colour"), known("sparkling"), F.coalesce(known("sweetness"), F.lit("?"))]
    left_open = sorted(tuple(r) for r in sources.select(*(F.col(c).isNull() for c in STYLE)).distinct().collect())
    keys = [F.array(*(F.lit("*") if free else c for c, free in zip(item, shape, strict=True))) for shape in left_open]
    return F.filter(F.array(*keys).cast("array<array<string>>"), lambda key: ~F.exists(key, lambda x: x.isNull()))


def analogs(catalogue: DataFrame, sources: DataFrame, limit: int = 6, tie_of: Column | None = None) -> DataFrame:
    """Items of other makers in the style of each source: (source, slug, score, rank).

    `sources` is a stated set of catalogue rows, whose key is the slug. The first catalogue row of a
    series counts, judged after the filters; scores up to 1 are no analogs.

    Rows of one series and style give the two first of them before anything is
    joined (two, since a source isn't its own analog). Items and sources meet by
    one key of colour, sparkling and sweetness, with open facets as keys of their
    own; styles with many items are dealt to parts, which all sources of the
    style visit, and Spark cuts each part to the best rows before it sends them.
    """
    s = sources.select(*[F.col(c).alias(f"s_{c}") for c in ("slug", "maker", *STYLE, "region", "varieties")])
    named = catalogue.withColumn("__series", title_key(F.col("title")))
    age = F.row_number().over(Window.partitionBy("maker", "__series", *STYLE).orderBy("row_id"))
    folded = named.withColumn("__age", age).filter("__age <= 2").drop("__age")
    parts = -(-catalogue.count() // STYLE_ROWS) or 1
    items = folded.withColumn("__part", F.pmod(F.xxhash64("slug"), F.lit(parts))).withColumn("__style", F.explode(styles_met(sources)))
    colour, sparkling = (F.coalesce(known(f"s_{c}"), F.lit("*")) for c in STYLE[:2])
    sweet = F.when(F.col("s_sweetness").isNull(), F.array(F.lit("*"))).otherwise(F.array(known("s_sweetness"), F.lit("?")))
    keys = F.transform(sweet, lambda t: F.array(colour, sparkling, t))
    asked = s.withColumn("__style", F.explode(keys)).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = items.join(asked.withColumn("__part", F.col("__part").cast("bigint")), ["__style", "__part"])
    kept = met.filter((F.col("slug") != F.col("s_slug")) & (F.col("s_maker").isNull() | (F.col("maker") != F.col("s_maker"))))
    first = F.row_number().over(Window.partitionBy("s_slug", "maker", "__series").orderBy("row_id"))
    series = kept.withColumn("__n", first).filter("__n = 1")
    common, union = F.size(F.array_intersect("varieties", "s_varieties")), F.size(F.array_union("varieties", "s_varieties"))
    score = (
        F.when(common > 0, 3.0 * common / union).otherwise(0.0)
        + F.coalesce((F.col("sweetness") == F.col("s_sweetness")).cast("double"), F.lit(0.0))
        + F.coalesce((F.col("region") == F.col("s_region")).cast("double"), F.lit(0.0)) * 0.5
        + F.least(F.coalesce("rating", F.lit(0.0)), F.lit(5.0)) / 5.0
    )
    scored = series.withColumn("score", score).filter("score > 1.0").withColumn("source", F.col("s_slug"))
    return capped(scored, ["source"], MAX_PER_MAKER, limit, F.desc("score"), (tie_of if tie_of is not None else tie(F.col("source").cast("string"))).asc()).select("source", "slug", "score", "rank")


def sommelier(catalogue: DataFrame, dish: str | None, taste: str | None, occasion: str | None, limit: int = 6, tie_of: Column | None = None) -> DataFrame:
    """Items for a dish, a taste and an occasion; if none fits the dish, the dish is given up."""
    rating = F.coalesce("rating", F.lit(0.0))
    base = F.least(rating, F.lit(5.0)) / 5.0
    if occasion == "party":
        base = base + F.when(F.col("sparkling"), 1.5).otherwise(0.0)
    elif occasion == "gift":
        base = base + F.when(rating >= 4.8, 1.5).otherwise(0.0)
    elif occasion == "solo":
        base = base + F.when(rating >= 4.5, 0.8).otherwise(0.0)
    fits = catalogue
    if taste:
        fits, base = fits.filter(F.col("sweetness") == taste), base + 2.0
    salt = "|".join(f"{k}={v or ''}" for k, v in sorted({"dish": dish, "taste": taste, "occasion": occasion}.items()))
    order = (F.desc("score"), (tie_of if tie_of is not None else tie(salt)).asc())
    if not dish:
        return capped(fits.withColumn("score", base), [], MAX_PER_MAKER, limit, *order).select("slug", "score", "rank")
    with_dish = fits.withColumn("fit", F.array_contains("dishes", dish)).withColumn("score", base + F.when(F.col("fit"), 3.0).otherwise(0.0))
    best = capped(with_dish.withColumn("maker", F.struct("fit", "maker")), ["fit"], MAX_PER_MAKER, limit, *order)  # both answers, each of `limit` rows at most
    any_fit = F.max("fit").over(Window.partitionBy(F.lit(0)))
    return best.withColumn("any", any_fit).filter("fit = any").select("slug", "score", "rank")


def makers_items(catalogue: DataFrame, asked: DataFrame, limit: int = 6) -> DataFrame:
    """Each asked maker's items: close names first (from 0.6 on, closeness to one decimal), then the asked colour, then rating."""
    close = F.round("closeness", 1)
    met = catalogue.join(asked, "maker")
    order = [F.when(close >= 0.6, close).otherwise(0.0).desc(), (F.col("colour") != F.col("asked_colour")).cast("int"), F.coalesce("rating", F.lit(0.0)).desc(), F.col("row_id")]
    rank = F.row_number().over(Window.partitionBy("maker").orderBy(*order))
    return met.withColumn("rank", rank).filter(F.col("rank") <= limit)
