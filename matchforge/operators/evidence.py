"""Evidence beside similarity: key-point matches, points in boxes, best references, label words, splits that may not mix."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchforge.functions import text, words
from matchforge.operators.components import connected_components


def ratio_matches(nearest: DataFrame, ratio: float = 0.75, one_to_one: bool = True) -> DataFrame:
    """Matches (query_id, row_id, distance) that are clearly nearer than the second nearest; one query a row if `one_to_one`.

    `nearest` is (query_id, row_id, distance, rank) with ranks 1 and 2.
    """
    folded = nearest.groupBy("query_id").agg(F.min_by(F.struct("row_id", "distance"), "rank").alias("first"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"))
    good = folded.filter(F.col("first.distance") < ratio * F.col("second")).select("query_id", "first.row_id", "first.distance")
    if not one_to_one:
        return good
    best = F.row_number().over(Window.partitionBy("row_id").orderBy("distance", "query_id"))
    return good.withColumn("__n", best).filter("__n = 1").drop("__n")


def points_in_boxes(points: DataFrame, boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """Share of each query's points x, y inside its box, and which view that calls for: the crop, or the whole frame below `least`."""
    inside = F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))
    share = points.join(boxes, "query_id").groupBy("query_id").agg(F.avg(inside.cast("double")).alias("inside"))
    return share.withColumn("view", F.when(F.col("inside") < least, "frame").otherwise("crop"))


def best_references(stats: DataFrame) -> DataFrame:
    """The reference with most inliers of each (query_id, slug), the first of equal ones; all references' points count together."""
    best = F.max_by(F.struct("reference", "inliers"), F.struct("inliers", -F.col("reference")))
    return stats.groupBy("query_id", "slug").agg(best.alias("b"), F.sum("points").alias("points")).select("query_id", "slug", "b.reference", "b.inliers", "points")


def sliding_maximum(profile: DataFrame, group: str, order: str, value: str, width: int) -> DataFrame:
    """The window of `width` rows with the largest sum, the first of equal ones; rows before are numbered from 0."""
    ordered = Window.partitionBy(group).orderBy(order)
    summed = profile.withColumn("total", F.sum(value).over(ordered.rowsBetween(-(width - 1), 0))).withColumn("at", F.row_number().over(ordered) - 1)
    whole = summed.filter(F.col("at") >= width - 1)
    return whole.groupBy(group).agg(F.max_by(F.struct("at", "total"), F.struct("total", -F.col("at"))).alias("b")).select(group, (F.col("b.at") - (width - 1)).alias("first"), "b.total")


def widened_band(profile: DataFrame, group: str, order: str, value: str, width: int, share: float = 0.35, pad: float = 0.12) -> DataFrame:
    """(group, top, bottom): the window of `width` rows with the largest sum, widened while rows hold more than `share` of its mean, and padded.

    Rows are numbered from 0 by `order`, `bottom` is the row after the last.
    Groups of fewer rows than the window have no band.
    """
    ordered = Window.partitionBy(group).orderBy(order)
    numbered = profile.withColumn("at", F.row_number().over(ordered) - 1)
    best = sliding_maximum(profile, group, order, value, width).withColumn("least", F.col("total") / width * share)
    weak = F.col(value) <= F.col("least")
    edges = numbered.join(best, group).groupBy(group).agg(
        F.coalesce(F.max(F.when((F.col("at") < F.col("first")) & weak, F.col("at") + 1)), F.lit(0)).alias("upper"),
        F.min(F.when((F.col("at") >= F.col("first") + width) & weak, F.col("at"))).alias("lower"), F.count("*").alias("height"),
    )
    lower = F.coalesce("lower", "height")
    extra = F.floor((lower - F.col("upper")) * pad)
    return edges.select(group, F.greatest(F.lit(0), F.col("upper") - extra).cast("int").alias("top"), F.least("height", lower + extra).cast("int").alias("bottom"))


def category_word(token: Column) -> Column:
    """Does a token, but for its signs and look-alike letters, name a colour or sweetness? Long ones may have one wrong letter."""
    terms = [t for t in (*words.SWEETNESS, *words.COLOURS) if " " not in t and len(t) >= 4]
    long = [t for t in terms if len(t) >= 7]
    low = F.regexp_replace(text.clean(token), " ", "")
    return F.exists(F.array(low, text.homoglyphs(low)), lambda form: form.isin(terms) | (F.size(text.substituted(form, long)) > 0))


def joined_spaces(line: Column) -> Column:
    """A line put together again where it is letter-spaced or where a colour or sweetness word is torn in two.

    Three parts or more of which three in five are single letters are one word.
    Else neighbours that together name a category are joined, from left to right.
    """
    parts = F.split(F.trim(line), r"\s+")
    letters = F.size(F.filter(parts, lambda p: F.length(p) == 1))

    def step(state: Column, part: Column) -> Column:
        whole = state["waiting"].isNotNull() & category_word(F.concat(state["waiting"], part))
        done = F.when(whole, F.array_append(state["done"], F.concat(state["waiting"], part))).when(state["waiting"].isNotNull(), F.array_append(state["done"], state["waiting"])).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(~whole, part).alias("waiting"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("waiting"))
    pairs = F.aggregate(parts, start, step, lambda s: F.array_compact(F.array_append(s["done"], s["waiting"])))
    spaced = (F.size(parts) >= 3) & (letters >= 0.6 * F.size(parts))
    return F.when(~F.trim(line).contains(" "), line).when(spaced, F.array_join(parts, "")).otherwise(F.array_join(pairs, " "))


def label_json(raw: Column) -> Column:
    """struct<producer, name, colour, sweetness, grapes> of a model's free answer: the first JSON object in it; null if it can't be read.

    Empty and unknown-like values are null, classes are mapped to the vocabulary,
    and of the grapes four names are kept.
    """
    schema = "producer string, name string, color string, sweetness string, grapes array<string>"
    found = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), schema)

    def value(name: str) -> Column:
        v = F.trim(found[name])
        return F.when(~F.lower(v).isin("", "null", "none", "unknown", "n/a"), v)

    def mapped(name: str, table: dict[str, str]) -> Column:
        return F.try_element_at(text.constant_map(table), F.lower(value(name)))

    sweet = {"dry": "сухое", "semi-dry": "полусухое", "semi-sweet": "полусладкое", "sweet": "сладкое", "extra brut": "экстра брют"} | words.SWEETNESS
    colours = {"white": "белое", "red": "красное", "pink": "розовое"} | words.COLOURS
    grapes = F.slice(F.filter(F.coalesce(found["grapes"], F.array().cast("array<string>")), lambda g: g.isNotNull() & (F.trim(g) != "")), 1, 4)
    out = F.struct(value("producer").alias("producer"), value("name").alias("name"), mapped("color", colours).alias("colour"), mapped("sweetness", sweet).alias("sweetness"), grapes.alias("grapes"))
    broken = found.isNull() | F.coalesce(F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0)).isNull(), F.lit(True))
    return F.when(~broken, out)


def assigned_splits(rows: DataFrame, locked: DataFrame, default: str = "tune") -> DataFrame:
    """The split of each image, so that images that share a series or item never part.

    `rows` is (image, series, item), `locked` (node, split) with nodes such as
    image:…, series:… and item:…; a component with two locked splits raises.
    """
    nodes = F.filter(F.array(F.concat(F.lit("image:"), "image"), F.concat(F.lit("series:"), "series"), F.concat(F.lit("item:"), "item")), lambda n: n.isNotNull())
    named = rows.select("image", nodes.alias("nodes"))
    edges = named.select(F.get("nodes", F.lit(0)).alias("a"), F.explode("nodes").alias("b"))
    found = connected_components(edges)
    fixed = found.join(locked, "node").groupBy("component").agg(F.max("split").alias("split"), F.countDistinct("split").alias("n"), F.min("node").alias("meeting"))
    sure = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two splits meet at "), F.col("meeting")))).otherwise(F.col("split"))
    by_node = found.join(fixed, "component", "left").select("node", sure.cast("string").alias("split"))
    own = named.select("image", F.get("nodes", F.lit(0)).alias("node")).join(by_node, "node", "left").join(locked.withColumnRenamed("split", "own"), "node", "left")
    return own.select("image", F.coalesce("split", "own", F.lit(default)).alias("split")).distinct()
