"""Queries over users' events: spreads, recent items, sessions, and the streaming form of a harvest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchforge.operators import catalogue
from matchforge.plans.registry import query
from matchforge.sources.tables import table
from matchforge.streaming import harvest, memory


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS depth, max(value) OVER (PARTITION BY user_id) AS lead FROM events")
def round_robin_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item of each user, then the second of each: sort by depth, then by the user's best."""
    spread = catalogue.round_robin(table(spark, sf_dir, "events"), "user_id", F.col("value"), F.desc("value"), F.col("event_id"))
    return spread.select("event_id", "depth", "lead")


@query("WITH firsts AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2) SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS INT) AS place FROM firsts QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) <= 5")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five items a user touched last, each once."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_type"))
    return last.withColumn("place", place).filter("place <= 5").select("user_id", "event_type", "place")


@query("WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY 1, 2")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with gaps of half an hour at most."""
    of_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(of_user)
    flagged = table(spark, sf_dir, "events").withColumn("new", F.when(gap <= F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1))
    return flagged.withColumn("session", F.sum("new").over(of_user)).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - l_quantity AS BIGINT) AS offset_ FROM lineitem")
def ragged_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each list of a ragged column starts: running sums within a partition key."""
    before = F.sum(F.col("l_quantity").cast("bigint")).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (before - F.col("l_quantity").cast("bigint")).alias("offset_"))


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS types FROM events GROUP BY 1")
def harvest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, each key once, summed as they come."""
    return harvest.summed(spark, f"{sf_dir}/events.parquet")


@query("""WITH last AS (SELECT user_id, event_type || '/' || floor(value)::BIGINT AS k, max(epoch_us(ts)) AS touched FROM events GROUP BY 1, 2)
SELECT user_id, k, touched, CAST(row_number() OVER (PARTITION BY user_id ORDER BY touched DESC, k) AS INT) AS place FROM last QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY touched DESC, k) <= 64""")
def remembered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 keys in each user's memory after a stateful stream of the events."""
    return memory.recent_events(spark, f"{sf_dir}/events.parquet")
