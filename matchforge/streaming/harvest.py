"""Incremental harvest with Structured Streaming: files as they land, each key once, resumable by its checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchforge.sources.shared import shared_dir

#: Parts of the target by key: a batch meets only the rows of its own keys' parts.
PARTS = 64


def landed(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of a folder, or of one file, as a stream."""
    folder, _, name = path.rstrip("/").rpartition("/")
    glob = name if name.endswith(".parquet") and not name.startswith("part-") else "*.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(folder)


def appended_once(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """A sink for batches: the rows of keys that no other batch of the target has, under the batch's own id.

    Nothing is kept in the stream's state; what is known stands in the target.
    A batch that runs again writes its own folder anew with the same rows, since
    it leaves itself out of what is known. Of repeated keys in a batch the least
    row counts; rows without a key are left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        others = [F.col(c) for c in batch.columns if c != key]
        once = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*others)).alias("row")).select(key, "row.*").select(*batch.columns)
        once = once.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
        try:
            known = spark.read.schema(f"`{key}` {batch.schema[key].dataType.simpleString()}, part int, batch bigint").parquet(target)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        if known is not None:
            parts = once.select("part").distinct()  # `PARTS` rows at most
            earlier = known.filter(F.col("batch") != batch_id).join(F.broadcast(parts), "part", "left_semi").select(key, "part")
            once = once.join(earlier, [key, "part"], "left_anti")
        once.write.mode("overwrite").partitionBy("part").parquet(f"{target}/batch={batch_id}")

    return write


def harvested(spark: SparkSession, path: str, target: str, key: str, checkpoint: str) -> None:
    """Append the rows of new files to `target`, one row of each key; what a run has done the next one skips."""
    run = landed(spark, path).writeStream.foreachBatch(appended_once(target, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def summed(spark: SparkSession, path: str) -> DataFrame:
    """Events by user after a harvest of the table at `path`."""
    folder = f"{shared_dir(spark)}/matchforge/harvest-{uuid.uuid4().hex}"
    harvested(spark, path, f"{folder}/rows", "event_id", f"{folder}/checkpoint")
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("types"))
