"""Readers of catalogue, run and label files, with the checks that abort a run, and the sinks beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchforge.operators.catalogue import fingerprint, must_be_empty

#: Nested candidates and words of a stored run, by image.
RUNS = """image string, gold string, kind string, frame string,
candidates array<struct<slug:string, cv:double, inliers:int, coverage:double, hard_conflicts:int, text_conflicts:int, text_support:int>>,
words array<struct<text:string, conf:double, box:array<int>>>"""
TRANSCRIPTS = "image string, lines array<struct<text:string, x:double, y:double, w:double, conf:double, unreadable:boolean>>"


def json_document(spark: SparkSession, path: str, rows: str, schema: str) -> DataFrame:
    """Rows of the array `rows` of whole JSON documents."""
    whole = spark.read.schema(f"{rows} array<struct<{schema}>>").option("multiLine", True).json(path)
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; a broken line aborts the run."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def candidate_map(candidates: Column, value: str) -> Column:
    """map<slug, value> of an array of candidates; of repeated slugs the last one counts."""
    last = F.filter(candidates, lambda c, i: ~F.exists(F.slice(candidates, i + 2, F.size(candidates)), lambda d: d["slug"] == c["slug"]))
    return F.map_from_entries(F.transform(last, lambda c: F.struct(c["slug"], c[value])))


def checked_csv(spark: SparkSession, path: str, schema: str, key: str, files: DataFrame | None = None) -> DataFrame:
    """A CSV file with # comments, whose keys must differ.

    With `files` (file, sha256), every named file must be there and have the
    stated digest; an empty name is a deliberate gap. Raises ValueError.
    """
    rows = spark.read.option("comment", "#").option("nullValue", "").csv(path, header=True, schema=schema)
    must_be_empty(rows.groupBy(key).count().filter("count > 1"), "repeated key")
    if files is not None:
        named = rows.filter("file is not null")
        must_be_empty(named.join(files, "file", "left_anti").select("file"), "missing file")
        if "sha256" in rows.columns:
            known = files.withColumnRenamed("sha256", "found")
            must_be_empty(named.filter("sha256 is not null").join(known, "file").filter("lower(sha256) <> lower(found)").select("file", "sha256", "found"), "other content")
    return rows


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, length, sha256) of the files in a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def complete(predictions: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """`predictions`, if they are as many as the manifest's rows and name them all. Raises ValueError otherwise."""
    must_be_empty(manifest.join(predictions, key, "left_anti").select(key), "not predicted")
    must_be_empty(predictions.join(manifest, key, "left_anti").select(key), "not in the manifest")
    must_be_empty(predictions.groupBy(key).count().filter("count > 1"), "predicted twice")
    return predictions


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated manifest with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def typed_words(transcripts: DataFrame, width: int, height: int) -> DataFrame:
    """(image, word_id, text, conf, x1, y1, x2, y2): typed lines as words in pixels of a crop; unreadable and blank ones are left out."""
    rows = transcripts.select("image", F.posexplode("lines").alias("word_id", "l"))
    rows = rows.filter(~F.coalesce("l.unreadable", F.lit(False)) & (F.trim(F.coalesce("l.text", F.lit(""))) != ""))
    x, y = F.coalesce("l.x", F.lit(0.5)) * width, F.coalesce("l.y", F.lit(0.7)) * height
    half = F.coalesce("l.w", F.lit(0.4)) * width / 2
    return rows.select(
        "image", "word_id", F.trim("l.text").alias("text"), F.coalesce("l.conf", F.lit(1.0)).alias("conf"),
        (x - half).cast("int").alias("x1"), (y - 8).cast("int").alias("y1"), (x + half).cast("int").alias("x2"), (y + 8).cast("int").alias("y2"),
    )


def run_candidates(runs: DataFrame) -> DataFrame:
    """(image, gold, slug, place, cv, inliers, coverage, …): a stored run's candidates as rows, in their order."""
    rows = runs.select("image", "gold", F.posexplode("candidates").alias("place", "c"))
    return rows.select("image", "gold", "place", "c.*")


# ---- sinks


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header, one for each partition; the reader names the folder."""
    rows.write.mode("overwrite").csv(path, header=True)


def write_vectors(rows: DataFrame, path: str) -> None:
    """An index of vectors (row_id, slug, view, path, embedding) by view; paths are kept relative to the data folder."""
    relative = F.regexp_replace("path", r"^(?:[A-Za-z0-9+.-]+:/+|/)?(?:.*/)?data/", "data/")
    rows.withColumn("path", relative).repartition("view").sortWithinPartitions("row_id").write.mode("overwrite").partitionBy("view").parquet(path)


def write_ragged(rows: DataFrame, path: str) -> None:
    """Features of rows (row_id, points array<array<double>>) cut to bytes 0 to 255, with the count of points of each row.

    Offsets into a flat list are running sums of `points_n` in the order of ids; readers that need none read the arrays.
    """
    cut = F.transform("points", lambda p: F.transform(p, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v.cast("int"))).cast("smallint")))
    rows.select("row_id", cut.alias("points"), F.size("points").alias("points_n")).write.mode("overwrite").parquet(path)


def provenance(inputs: dict[str, DataFrame], switches: dict[str, str], versions: dict[str, str]) -> DataFrame:
    """(kind, name, value): content digests of the inputs, and the switches and versions of a run, to lie beside its results."""
    spark = next(iter(inputs.values())).sparkSession
    stated = [("switch", k, v) for k, v in sorted(switches.items())] + [("version", k, v) for k, v in sorted(versions.items())]
    rows = spark.createDataFrame(stated, "kind string, name string, value string")
    for name, frame in sorted(inputs.items()):
        own = fingerprint(frame, "").select(F.lit("input").alias("kind"), F.lit(name).alias("name"), F.concat_ws(":", "fingerprint", "n").alias("value"))
        rows = rows.unionByName(own)
    return rows


def append_rest(rows: DataFrame, path: str, order: str) -> int:
    """Append to an observation log the rows after those it has; returns how many rows were there.

    What is there must be the beginning of `rows` (by `order`, from 0 without
    gaps) with the same content: else ValueError, since another run wrote it.
    """
    spark = rows.sparkSession
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("digest")
    try:
        log = spark.read.schema(rows.schema).parquet(path)
        there = log.count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log, there = rows.limit(0), 0
    own, new = log.select(order, digest), rows.select(order, digest)
    must_be_empty(own.exceptAll(new), "not of this run")
    must_be_empty(own.filter(F.col(order) >= there), "not a beginning")
    rows.filter(F.col(order) >= there).write.mode("append").parquet(path)
    return there
