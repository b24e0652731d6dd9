"""Crawled pages: links in order, embedded payloads whose numbers point to other places of one flat array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def links(pages: DataFrame) -> DataFrame:
    """(page_id, link) of all references, in no order, repeats included."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("link"))


#: Wrappers of values in payloads (fixed values): a list of the wrapper's name and a place.
WRAPPERS = ("ShallowReactive", "Reactive", "Ref", "ShallowRef")
DEPTH = 8


class Payload:
    """Columns out of a flat payload: an array of JSON values in which numbers within objects and lists are places of others."""

    def __init__(self, flat: Column):
        self.flat = flat

    def at(self, place: Column) -> Column:
        """The value at a place, out of up to `DEPTH` wrappers; deeper ones stay wrapped."""

        def out_of(value: Column, _: Column) -> Column:
            inner = F.from_json(value, "array<string>")
            return F.when(F.get(inner, F.lit(0)).isin(*WRAPPERS), F.get(self.flat, F.get(inner, F.lit(1)).cast("int"))).otherwise(value)

        return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.get(self.flat, place.cast("int")), out_of)

    def member(self, value: Column, name: str) -> Column:
        """A member of an object; a number is the place of the member's value."""
        own = F.get_json_object(value, f"$.{name}")
        return F.when(own.rlike("^[0-9]+$"), self.at(own)).otherwise(own)

    def named(self, value: Column, name: str) -> Column:
        """The name of a member that is an object with a name, or the member itself."""
        own = self.member(value, name)
        return F.when(own.startswith("{"), self.member(own, "name")).otherwise(own)

    def names(self, value: Column, name: str) -> Column:
        """The names of a member that is a list of objects."""
        found = F.transform(F.from_json(self.member(value, name), "array<string>"), lambda i: self.member(self.at(i), "name"))
        return F.coalesce(F.filter(found, lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>"))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(key, changed) of the pages that sitemaps list: the last part of each address, and when it changed."""
    rows = spark.read.schema("loc string, lastmod string").option("rowTag", "url").format("xml").load(path)
    key = F.regexp_extract(F.trim("loc"), r"([^/]+)/?$", 1)
    return rows.filter(key != "").groupBy(key.alias("key")).agg(F.max(F.try_to_timestamp(F.trim("lastmod"))).alias("changed"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, kind) of what two snapshots (key, changed) differ in: new, removed or changed; one full join by key."""
    old, new = (s.select("key", F.col("changed").alias(name), F.lit(True).alias(f"in_{name}")) for s, name in ((before, "was"), (after, "now")))
    kind = F.when(F.col("in_was").isNull(), "new").when(F.col("in_now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return old.join(new, "key", "full").select("key", kind.alias("kind")).filter("kind is not null")


def payload_cards(rows: DataFrame) -> DataFrame:
    """(page_id, slug, title, maker, region, grapes) of the card of each row (page_id, slug, payload).

    The card is the first object with slug, title and a maker whose slug is the
    row's; payloads without it, or that can't be read, give nulls. The payload
    may be the JSON itself or the page that holds it in its data script.
    """
    script = F.regexp_extract("payload", r'(?s)<script[^>]*id="__NUXT_DATA__"[^>]*>(.*?)</script>', 1)
    parsed = rows.withColumn("flat", F.from_json(F.coalesce(F.nullif(script, F.lit("")), "payload"), "array<string>"))
    p = Payload(F.col("flat"))

    def is_card(v: Column) -> Column:
        complete = v.startswith("{") & F.get_json_object(v, "$.slug").isNotNull() & F.get_json_object(v, "$.title").isNotNull()
        return F.coalesce(complete & (p.member(v, "slug") == F.col("slug")) & (F.coalesce(p.member(v, "manufacturer"), F.lit("")) != ""), F.lit(False))

    found = parsed.withColumn("card", F.get(F.filter("flat", is_card), F.lit(0)))
    card = F.col("card")
    return found.select(
        "page_id", p.member(card, "slug").alias("slug"), F.trim(p.member(card, "title")).alias("title"), F.trim(p.named(card, "manufacturer")).alias("maker"),
        F.trim(p.named(card, "region")).alias("region"), p.names(card, "grapes").alias("grapes"),
    )
