"""State by item over a stream: status intervals that are right whatever order events come in, and step metrics by listener."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from lodestone.sources.storage import fresh_folder
from lodestone.streaming.events import landed

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SPELLS = "item long, valid_from timestamp, valid_to timestamp, status string"


class Spells(StatefulProcessor):
    """Keeps the changes of an item under their event ids, and gives all its spells anew whenever one comes.

    A change that comes twice is one; a late one splits the spell that it falls into. Changes at one time
    count by event id, the last one holds; the newest spell is open.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.changes = handle.getListState("changes", "event_id long, ts timestamp, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        known = {event: (ts, status) for event, ts, status in self.changes.get()}
        fresh = {}
        for frame in rows:
            fresh |= zip(frame["event_id"].tolist(), zip((t.to_pydatetime() for t in frame["ts"]), frame["status"].tolist(), strict=True), strict=True)
        again = not known.keys().isdisjoint(fresh)
        known |= fresh
        # one call for all changes of a batch; the list is written anew only where an event has come again
        (self.changes.put if again else self.changes.appendList)([(event, *change) for event, change in (known if again else fresh).items()])
        held = sorted((ts, event, status) for event, (ts, status) in known.items())
        last = [x for x, y in zip(held, [*held[1:], (None,)], strict=True) if x[0] != y[0]]
        ends = [x[0] for x in last[1:]] + [None]
        yield pd.DataFrame({"item": [key[0]] * len(last), "valid_from": [x[0] for x in last], "valid_to": pd.Series(ends, dtype="datetime64[us]"), "status": [x[2] for x in last]})

    def close(self) -> None:
        pass


def spells(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """The spells of every item (user) of the event log: item, valid_from, valid_to, status; those of its last micro-batch count.

    Events without an item, an id, a time or a type change nothing.
    """
    folder, before = fresh_folder(spark, "spells"), spark.conf.get(_PROVIDER, None)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch_={number}")

    rows = landed(spark, sf_dir, **options).where("user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL")
    rows = rows.select(F.col("user_id").cast("long").alias("item"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        kept = rows.groupBy("item").transformWithStateInPandas(Spells(), outputStructType=_SPELLS, outputMode="Update", timeMode="None")
        kept.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    spark.createDataFrame([], _SPELLS).write.mode("overwrite").parquet(f"{folder}/rows/batch_=-1")
    found = spark.read.schema(_SPELLS + ", batch_ long").parquet(f"{folder}/rows")
    newest = found.groupBy("item").agg(F.max("batch_").alias("batch_"))
    return found.join(newest, ["item", "batch_"], "left_semi").drop("batch_")


class Steps(StreamingQueryListener):
    """Sums over the steps of one query as they end, however many there are: steps, and rows at the points "landed" and "passed".

    Rows are counted where they are observed, since a filter that the scan takes over hides rows from the source's own number.
    """

    def __init__(self, name: str) -> None:
        self.name, self.steps, self.rows, self.passed, self.over = name, 0, 0, 0, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name:
            self.steps += 1
            landed_, passed = (event.progress.observedMetrics.get(point) for point in ("landed", "passed"))
            self.rows += landed_["n"] if landed_ is not None else 0
            self.passed += passed["n"] if passed is not None else 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.over.set()


def steps(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """What the steps of a drain read and let pass, by listener; complete: all that had landed was read."""
    folder = fresh_folder(spark, "steps")
    listener = Steps(folder.rsplit("/", 1)[-1])
    spark.streams.addListener(listener)
    n = F.count(F.lit(1)).alias("n")
    try:
        rows = landed(spark, sf_dir, **options).observe("landed", n).where("event_type <> 'error'").observe("passed", n)
        stream = rows.writeStream.queryName(listener.name).format("noop").option("checkpointLocation", folder).trigger(availableNow=True)
        stream.start().awaitTermination()
        listener.over.wait(60)
    finally:
        spark.streams.removeListener(listener)
    there = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    return spark.createDataFrame([(listener.rows, listener.passed, listener.rows == there)], "rows long, passed long, complete boolean")


QUERIES = {"stm_spells": spells, "stm_listened": steps}
ORACLES = {
    "stm_spells": """
WITH c AS (SELECT user_id AS item, ts AS valid_from, event_type AS status FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
SELECT item, valid_from, lead(valid_from) OVER (PARTITION BY item ORDER BY valid_from) AS valid_to, status FROM c""",
    "stm_listened": "SELECT count(*) AS rows, count(*) FILTER (WHERE event_type <> 'error') AS passed, true AS complete FROM events",
}
