"""Queries over the event log: point-in-time status and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUTOFF = "2024-01-15 00:00:00"


def status_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each item just before the cut-off: one aggregate, no self-join."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    before = F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz")
    at = F.struct("ts", "event_id")
    return ev.groupBy("user_id").agg(
        F.max_by(F.when(before, F.col("event_type")), F.when(before, at)).alias("status"),
        F.count_if(before).cast("long").alias("changes_before"),
        F.count_if(~before).cast("long").alias("changes_after"),
    )


QUERIES = {"joi12_status_at": status_at}
ORACLES = {
    "joi12_status_at": f"""
SELECT user_id, arg_max(event_type, row(ts, event_id)) FILTER (ts < TIMESTAMP '{CUTOFF}') AS status,
       CAST(count(*) FILTER (ts < TIMESTAMP '{CUTOFF}') AS BIGINT) AS changes_before,
       CAST(count(*) FILTER (NOT ts < TIMESTAMP '{CUTOFF}') AS BIGINT) AS changes_after
FROM events GROUP BY user_id"""
}
