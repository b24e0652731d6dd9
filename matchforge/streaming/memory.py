"""Bounded memory by group as a stateful stream: the keys that were touched last, the longest untouched one goes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from matchforge.sources.shared import shared_dir
from matchforge.streaming.harvest import landed

KEPT = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Recent(StatefulProcessor):
    """Map state of a group: key to the time of its last touch, `kept` entries at most."""

    def __init__(self, group: str, key_type: str, group_type: str, kept: int):
        self.group, self.key_type, self.group_type, self.kept = group, key_type, group_type, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.touched = handle.getMapState("touched", f"key {self.key_type}", "at bigint")

    def handleInputRows(self, of, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = {k[0]: v[0] for k, v in self.touched.iterator()} if self.touched.exists() else {}
        known = dict(held)
        for frame in rows:
            for key, at in zip(frame["key"].tolist(), frame["at"].tolist(), strict=True):
                known[key] = max(at, known.get(key, at))
            if len(known) > 16 * self.kept:
                known = self.newest(known)
        known = self.newest(known)
        for key in held.keys() - known.keys():
            self.touched.removeKey((key,))
        for key, at in known.items():
            if held.get(key) != at:
                self.touched.updateValue((key,), (at,))
        yield pd.DataFrame({"group": [of[0]] * len(known), "key": list(known), "at": list(known.values()), "place": range(1, len(known) + 1)})

    def newest(self, known: dict) -> dict:
        """The entries touched last, newest first; of equal times the smaller key."""
        return dict(sorted(sorted(known.items()), key=lambda e: -e[1])[: self.kept])

    def close(self) -> None:
        pass


def remembered(events: DataFrame, group: str, key: str, at: str, kept: int = KEPT) -> DataFrame:
    """A stream of events to the memory of each group that a batch touched: rows (group, key, at, place), newest first.

    `at` counts as a whole number. What comes late is old: an event older than
    all that a full memory holds changes nothing. Rows with a null group, key or
    time touch nothing.
    """
    rows = events.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(at).cast("bigint").alias("at")).dropna()
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = rows.groupBy("group").transformWithStateInPandas(Recent(group, types["key"], types["group"], kept), f"group {types['group']}, key {types['key']}, at bigint, place int", "update", "none")
    return found


def memory_after(spark: SparkSession, events: DataFrame, group: str, key: str, at: str, kept: int = KEPT) -> DataFrame:
    """(group, key, at, place) once a stream of what has landed is worked off, from the last batch that touched each group."""
    folder = f"{shared_dir(spark)}/matchforge/memory-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    stream = remembered(events, group, key, at, kept)
    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    last = rows.groupBy("group").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["group", "batch"]).select(F.col("group").alias(group), F.col("key").alias(key), F.col("at").alias(at), "place")


def recent_events(spark: SparkSession, path: str) -> DataFrame:
    """The keys that each user touched last, of a table of events read as a stream."""
    events = landed(spark, path).select("user_id", F.concat_ws("/", "event_type", F.floor("value").cast("string")).alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("touched"))
    return memory_after(spark, events, "user_id", "k", "touched")
