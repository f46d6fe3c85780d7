"""Streams whose state is bounded: a watermark ends sessions and forgets ids; counts that take back; metrics of each step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.storage import fresh_folder
from lodestone.streaming.events import GAP, drained, landed

#: How late an event may come and still count.
LATE = "1 hour"


def _appended(rows: DataFrame, name: str) -> DataFrame:
    """Rows that a stream has appended; the file sink's log makes a batch that runs again leave no rows twice."""
    spark, folder = rows.sparkSession, fresh_folder(rows.sparkSession, name)
    stream = rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def closed_sessions(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """Sessions that the watermark has closed, each appended once; state holds open sessions only.

    Events without a time belong to no session; those later than LATE behind the newest are left out; a session that may
    still grow is not there yet.
    """
    timed = landed(spark, sf_dir, **options).where("ts IS NOT NULL").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE)
    rows = timed.groupBy("user_id", F.session_window("at", GAP).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return _appended(rows.select("user_id", "first_ts", "last_ts", "n"), "closed")


def unique(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """Events by type, each event_id once however often it lands within LATE; ids older than that are forgotten."""
    timed = landed(spark, sf_dir, **options).where("ts IS NOT NULL").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE)
    once = timed.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")
    return _appended(once, "unique").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def net(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """Standing events of each user: an error takes back one event, its value too; a user whose events are all taken back stays with 0."""
    sign = F.when(F.col("event_type") == "error", -1).otherwise(1)
    rows = landed(spark, sf_dir, **options).groupBy("user_id").agg(F.sum(sign).alias("standing"), F.count_if(sign < 0).alias("taken_back"))
    return drained(rows, "net", ["user_id"])


def steps(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """What each micro-batch read, and whether all that had landed was read: rows, files' worth of steps, complete."""
    folder = fresh_folder(spark, "steps")
    rows = landed(spark, sf_dir, **options)
    query = rows.writeStream.format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    told = [(int(p["batchId"]), int(p["numInputRows"])) for p in query.recentProgress]
    read = spark.createDataFrame(told, "batch long, rows long").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    there = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.count(F.lit(1)).alias("there"))
    return read.crossJoin(there).select("rows", (F.col("rows") == F.col("there")).alias("complete"))


QUERIES = {"stm_closed_sessions": closed_sessions, "stm_unique": unique, "stm_net": net, "stm_steps": steps}
ORACLES = {
    "stm_closed_sessions": """
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS head FROM events),
n AS (SELECT user_id, ts, sum(head) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM n GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stm_unique": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type",
    "stm_net": "SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS BIGINT) AS standing, count(*) FILTER (WHERE event_type = 'error') AS taken_back FROM events GROUP BY user_id",
    "stm_steps": "SELECT count(*) AS rows, true AS complete FROM events",
}
