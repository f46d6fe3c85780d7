"""Keyed sinks: a table is what its newest manifest lists, so a write is seen whole or not at all and a batch that runs again changes nothing.

Rows lie in BUCKETS by their key. A write makes new folders for the buckets that it touches and reads only those; then one
rename puts a manifest in place that names the folder of each bucket. Folders that no manifest names are what killed writes have left.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.sources.storage import fresh_folder
from lodestone.streaming.events import landed

#: Buckets of a table; the bound of what a manifest lists.
BUCKETS = 32


class Snapshots:
    """A table under path with these keys: rows of one key are one row."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path, keys
        self.schema = StructType.fromDDL(schema)

    def _files(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def manifest(self) -> dict:
        """version, the last batch, and the folder of each bucket that has rows."""
        fs, at = self._files("manifest")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        names = [n for n in names if n.endswith(".json")]
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{names[-1]}", wholetext=True).first()[0]) if names else {"version": 0, "batch": -1, "folders": {}}

    def publish(self, before: dict, folders: dict, batch: int | None) -> None:
        """The manifest after before; refused if another writer was first."""
        told = json.dumps({"version": before["version"] + 1, "batch": before["batch"] if batch is None else batch, "folders": folders})
        fs, draft = self._files(f"manifest/draft-{uuid.uuid4().hex}")
        _, final = self._files(f"manifest/{before['version'] + 1:012d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(told.encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"{self.path} was changed by another writer")

    def read(self, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        folders = (self.manifest() if manifest is None else manifest)["folders"]
        wanted = sorted({f for b, f in folders.items() if buckets is None or int(b) in buckets})
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in wanted))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")

    def _replace(self, before: dict, rows: DataFrame, touched: list[int], batch: int | None) -> None:
        """These rows are all that the touched buckets hold from now on."""
        write = uuid.uuid4().hex
        rows.withColumn("bucket_", self._bucket()).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/data/{write}")
        fs, at = self._files(f"data/{write}")
        made = {s.getPath().getName().split("=")[1] for s in fs.listStatus(at) if "=" in s.getPath().getName()}
        folders = {b: f for b, f in before["folders"].items() if int(b) not in touched}
        self.publish(before, folders | {b: f"{write}/bucket_={b}" for b in made}, batch)

    def merge(self, rows: DataFrame, order: list[str], batch: int | None = None) -> bool:
        """Rows set what they know: of each property the last value by order that is not null, else it stays. False: this batch was here before.

        Rows with a null key are left out; columns that the table does not have are ignored.
        """
        before = self.manifest()
        if batch is not None and batch <= before["batch"]:
            return False
        known = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in self.keys))
        values = [f.name for f in self.schema if f.name not in self.keys]
        last = [F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(v) for v in values]
        fresh = known.groupBy(*self.keys).agg(*last) if values else known.select(*self.keys).distinct()
        touched = [r[0] for r in fresh.select(self._bucket()).distinct().collect()]  # at most BUCKETS
        new = fresh.select(*self.keys, *(F.col(v).alias(f"new_{v}") for v in values))
        both = self.read(before, touched).join(new, self.keys, "full")
        self._replace(before, both.select(*(F.col(f.name) if f.name in self.keys else F.coalesce(f"new_{f.name}", f.name).alias(f.name) for f in self.schema)), touched, batch)
        return True

    def delete(self, test: str | None = None) -> None:
        """All rows go, or those for which test is true: a layer, a slice; a test that is null keeps its row."""
        before = self.manifest()
        if test is None:
            self.publish(before, {}, None)
        else:
            self._replace(before, self.read(before).where(f"NOT coalesce({test}, false)"), list(range(BUCKETS)), None)


def merge_edges(edges: Snapshots, nodes: Snapshots, rows: DataFrame, order: list[str], batch: int | None = None) -> bool:
    """Edges (src, dst, ...) of which both ends are nodes; others are left out."""
    ends = nodes.read().select(F.col(nodes.keys[0]).alias("end_"))
    held = rows.join(ends, rows["src"] == ends["end_"], "left_semi")
    return edges.merge(held.join(ends, held["dst"] == ends["end_"], "left_semi"), order, batch)


_USERS = "user_id long, event_type string, value double, ts timestamp"


def users(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """The event log merged into one node a user, batch by batch, each batch sent twice as if the first had been cut off."""
    table = Snapshots(spark, fresh_folder(spark, "users"), _USERS, ["user_id"])

    def write(batch: DataFrame, number: int) -> None:
        for _ in range(2):
            table.merge(batch, ["ts", "event_id"], number)

    rows = landed(spark, sf_dir, **options).select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    rows.writeStream.foreachBatch(write).option("checkpointLocation", fresh_folder(spark, "users-state")).trigger(availableNow=True).start().awaitTermination()
    return table.read()


QUERIES = {"src17_snapshots": users}
ORACLES = {
    "src17_snapshots": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events WHERE user_id IS NOT NULL GROUP BY user_id"
}
