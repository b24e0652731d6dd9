"""Catalogue building: last row of a key, cascades of sources, claims of files, layers of attributes, files and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIZES = ("thumbnail", "small", "medium", "large")


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; blank keys go. Combined before the shuffle, so a key with very many rows is no hot spot."""
    named = rows.filter(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    last = named.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("__row"))
    return last.select(key, "__row.*").select(*rows.columns)


def cascade(positions: DataFrame, sources: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """The first source that names a position's value; the first source wins even with a null (a gap on purpose)."""
    found = positions
    for name, source in sources:
        found = found.join(source.select(key, F.col(value).alias(f"__{name}"), F.lit(True).alias(f"__has_{name}")), key, "left")
    first = sources[0][0]
    rest = F.coalesce(*[F.col(f"__{name}") for name, _ in sources[1:]])
    origin = F.when(F.col(f"__has_{first}"), first)
    for name, _ in sources[1:]:
        origin = origin.when(F.col(f"__{name}").isNotNull(), name)
    picked = found.withColumn(value, F.when(F.col(f"__has_{first}"), F.col(f"__{first}")).otherwise(rest)).withColumn("origin", origin)
    return picked.drop(*[f"__{p}{name}" for name, _ in sources for p in ("", "has_")])


def claimed_files(keys: DataFrame, files: DataFrame, taken: DataFrame) -> DataFrame:
    """The file of each position by its first key that has a free file; keys that several positions come to are skipped.

    `keys` is (slug, pos, key), `files` (key, file, original, size), `taken` (file).
    Of a key's files the best has the original and is the largest.
    """
    free = files.join(taken.distinct(), "file", "left_anti")
    best = free.groupBy("key").agg(F.max_by("file", F.struct("original", "size", "file")).alias("file"))
    first = keys.join(best, "key").groupBy("slug").agg(F.min_by(F.struct("key", "file"), "pos").alias("k")).select("slug", "k.key", "k.file")
    single = first.groupBy("key").agg(F.count("*").alias("__n")).filter("__n = 1").select("key")
    return first.join(single, "key").select("slug", "key", "file")


def layered(base: DataFrame, card: DataFrame, verified: DataFrame, key: str, value: str, allowed: list[str]) -> DataFrame:
    """Verified facts overrule, cards fill gaps only; a verified value outside the vocabulary raises."""
    v = F.when(F.col("__v").isNull() | F.col("__v").isin(allowed), F.col("__v")).otherwise(F.raise_error(F.concat(F.lit("unknown value: "), F.col("__v"))))
    joined = base.join(card.select(key, F.col(value).alias("__c")), key, "left").join(verified.select(key, F.col(value).alias("__v")), key, "left")
    return joined.withColumn(value, F.coalesce(v.cast("string"), F.col(value), F.col("__c"))).drop("__c", "__v")


def file_parts(name: Column) -> Column:
    """struct<size, stem, hash, extension> of an uploaded file's name; nulls if it isn't one."""
    size = F.regexp_extract(name, f"^({'|'.join(SIZES)})_", 1)
    rest = F.regexp_replace(name, f"^({'|'.join(SIZES)})_", "")
    pattern = r"^(.*)_([0-9a-f]{10})(\.[0-9A-Za-z_]+)$"
    ok = rest.rlike(pattern)
    return F.when(ok, F.struct(F.when(size == "", "original").otherwise(size).alias("size"), F.regexp_extract(rest, pattern, 1).alias("stem"), F.regexp_extract(rest, pattern, 2).alias("hash"), F.regexp_extract(rest, pattern, 3).alias("extension")))


def flat_cards(cards: DataFrame) -> DataFrame:
    """Nested cards as flat rows: names out of objects, arrays of names, empty text for what is missing."""

    def name(c: str) -> Column:
        return F.coalesce(F.col(f"{c}.name"), F.lit(""))

    def names(c: str) -> Column:
        return F.coalesce(F.filter(F.transform(c, lambda x: x["name"]), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))

    return cards.select("slug", F.coalesce("title", F.lit("")).alias("title"), name("manufacturer").alias("manufacturer"), name("region").alias("region"), name("category").alias("category"), names("grapes").alias("grapes"), names("dishes").alias("dishes"))


def decisions(lines: DataFrame, column: str = "value") -> DataFrame:
    """Hand-written decisions «name label [kind] [frame] # note»: label ? is pending, x dropped, - a negative."""
    body, note = F.trim(F.split_part(F.col(column), F.lit("#"), F.lit(1))), F.trim(F.regexp_extract(column, "#(.*)$", 1))
    parts = F.split(body, r"\s+")
    label = F.get(parts, F.lit(1))
    state = F.when(label == "?", "pending").when(label == "x", "dropped").when(label == "-", "negative").otherwise("labelled")
    return lines.filter(body != "").select(
        F.get(parts, F.lit(0)).alias("name"), F.when(state == "labelled", label).alias("slug"), state.alias("state"),
        F.coalesce(F.get(parts, F.lit(2)), F.lit("field")).alias("kind"), F.coalesce(F.get(parts, F.lit(3)), F.lit("front")).alias("frame"), note.alias("note"),
    )


def commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and # comments."""
    return spark.read.option("comment", "#").csv(path, header=True, schema=schema)


def must_be_empty(rows: DataFrame, what: str) -> None:
    """Raise with an example if there is any row: leaks, duplicates and missing files abort a run."""
    for r in rows.limit(1).collect():
        raise ValueError(f"{what}: {r.asDict()}")


def fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """Twelve hex digits of the content: the sum of the rows' hashes, equal in any order and summed before the shuffle."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.substring(F.sha2(F.concat_ws("|", F.count("*"), F.coalesce(F.sum(row), F.lit(0))), 256), 1, 12).alias("fingerprint"), F.count("*").alias("n"))


def write_if_changed(rows: DataFrame, path: str, key: str) -> bool:
    """Write a table with its fingerprint, unless the same content is there already; `current` reads it.

    Content goes to a folder of its own and only then into the list of versions,
    so a run that breaks off leaves the version before in place. `key` must
    differ in all rows.
    """
    spark = rows.sparkSession
    now = fingerprint(rows, key).first()["fingerprint"]
    try:
        number, before = spark.read.parquet(f"{path}/versions").agg(F.max("number"), F.max_by("fingerprint", "number")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        number, before = 0, None
    if before == now:
        return False
    must_be_empty(rows.groupBy(key).count().filter("count > 1"), "repeated key")
    rows.write.mode("overwrite").parquet(f"{path}/{now}")
    spark.createDataFrame([(number + 1, now)], "number bigint, fingerprint string").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return True


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of a table that `write_if_changed` wrote."""
    now = spark.read.parquet(f"{path}/versions").agg(F.max_by("fingerprint", "number")).first()[0]
    return spark.read.parquet(f"{path}/{now}")


def inverted_index(catalogue: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(token, slug, field, weight)."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight"), F.col(f).alias("text")) for f, w in fields.items()]))
    rows = catalogue.select("slug", parts.alias("p"))
    tokens = F.explode(F.array_distinct(F.filter(F.split(F.lower("p.text"), "[^a-z0-9]+"), lambda t: t != "")))
    return rows.select(tokens.alias("token"), "slug", "p.field", "p.weight")


def round_robin(rows: DataFrame, group: str, best: Column, *order: Column) -> DataFrame:
    """First of each group, then second of each, groups in the order of their best."""
    depth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    lead = F.max(best).over(Window.partitionBy(group))
    return rows.withColumn("depth", depth).withColumn("lead", lead)
