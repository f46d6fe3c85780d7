"""The event log as a stream: day windows, sessions, and the latest event of each user.

Each query drains what has landed (available-now trigger). A micro-batch overwrites its own folder, so a batch
that runs again after a failure leaves no rows twice; a reader takes the last state of each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.sources.storage import fresh_folder

GAP = "30 minutes"


def landed(spark: SparkSession, sf_dir: str, table: str = "events", **options: str) -> DataFrame:
    """A file stream over a table that is one file or a folder of files; options go to the file source."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.options(**options).schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def drained(rows: DataFrame, name: str, keys: list[str], mode: str = "update") -> DataFrame:
    """The final state of a stream's rows by key: the row of the last micro-batch that named it.

    A null key is a key like any other; an empty stream gives no rows.
    """
    spark, folder = rows.sparkSession, fresh_folder(rows.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch_={number}")

    stream = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
    stream.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch_=-1")  # so that there is a folder to read
    kept = spark.read.schema(StructType([*rows.schema.fields]).add("batch_", "long")).parquet(f"{folder}/rows")
    if mode == "complete":  # each batch holds all rows, and earlier ones rows that have since merged
        return kept.where(F.col("batch_") == kept.agg(F.max("batch_")).first()[0]).drop("batch_")
    values = [c for c in rows.columns if c not in keys]
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_").alias("last_")).select(*keys, "last_.*")


def tumbling(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """Events and their sum by day and type; state holds one row for each of these."""
    day = F.window("ts", "1 day")
    rows = landed(spark, sf_dir, **options).groupBy(day.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    return drained(rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "least", "most"), "tumbling", ["day", "event_type"])


def sessions(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """Sessions of each user, ended by a gap of more than 30 minutes."""
    at = F.session_window("ts", GAP)
    rows = landed(spark, sf_dir, **options).groupBy("user_id", at.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return drained(rows.select("user_id", "first_ts", "last_ts", "n"), "sessions", ["user_id", "first_ts"], mode="complete")


def latest(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """The latest event of each user, ties to the larger event_id."""
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("l")
    rows = landed(spark, sf_dir, **options).groupBy("user_id").agg(last, F.count(F.lit(1)).alias("seen"))
    return drained(rows.select("user_id", "l.event_id", "l.event_type", "seen"), "latest", ["user_id"])


QUERIES = {"stm_tumbling": tumbling, "stm_session": sessions, "stm_dedupe": latest}
ORACLES = {
    "stm_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2",
    "stm_session": """
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS head FROM events),
n AS (SELECT user_id, ts, sum(head) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM n GROUP BY user_id, k""",
    "stm_dedupe": """
SELECT user_id, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(event_type, row(ts, event_id)) AS event_type, count(*) AS seen FROM events GROUP BY user_id""",
}
