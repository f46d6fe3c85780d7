"""Global order without a single task: range partitions, their counts, and offsets; percentiles and strides are places in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans import census, full, more
from lodestone.sources.storage import fresh_folder

#: Rows of an even-stride sample.
STRIDE = 50


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """rows with their place from 0 in the order of these columns, nulls first; equal rows get different places.

    Rows are dealt by ranges and sorted in each; only the number of rows of each range is summed up in one place. Columns that
    are unique together give the same places in every run and let a frequent value be dealt to several tasks.
    """
    path = fresh_folder(rows.sparkSession, "ranges")
    keys = [F.col(c) for c in order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.withColumn("range_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
    kept = rows.sparkSession.read.parquet(path)
    sizes = kept.groupBy("range_").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = sizes.select("range_", F.coalesce(F.sum("n").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    return kept.join(F.broadcast(before), "range_").withColumn(name, F.col("before_") + F.col("at_")).drop("range_", "at_", "before_")


def places_in_groups(rows: DataFrame, groups: list[str], *order: str) -> DataFrame:
    """rows with their place from 0 in their group and the group's size n; a group is as many tasks as it needs."""
    placed = numbered(rows, *groups, *order, name="all_")
    firsts = placed.groupBy(*groups).agg(F.min("all_").alias("first_"), F.count(F.lit(1)).alias("n")).withColumnsRenamed({g: f"{g}_of" for g in groups})
    same = [F.col(g).eqNullSafe(F.col(f"{g}_of")) for g in groups]
    return placed.join(firsts, same).withColumn("place", F.col("all_") - F.col("first_")).drop("all_", "first_", *(f"{g}_of" for g in groups))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest ranks int(q (n - 1) + 0.5) of the sizes of parts, and fixed buckets."""
    sizes = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(sizes, "n", "l_partkey")
    last = placed.agg(F.max("place")).first()[0] or 0
    nearest = [F.max(F.when(F.col("place") == int(q * last + 0.5), F.col("n"))).alias(name) for q, name in ((0.5, "p50"), (0.95, "p95"))]
    buckets = [F.count(F.when(test, 1)).alias(name) for test, name in ((F.col("n") < 10, "under_10"), (F.col("n").between(10, 24), "under_25"), (F.col("n").between(25, 49), "under_50"), (F.col("n") >= 50, "more"))]
    return placed.agg(*nearest, F.max("n").alias("most"), *buckets)


def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th turns of all conversations before the next ones."""
    turns = _table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round")
    return numbered(turns, "round", "conv_id").select("conv_id", "turn", (F.col("place") + 1).alias("place"))


def stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at even distances over the whole order, not the first ones."""
    placed = numbered(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    n = placed.count()
    return placed.where(F.col("place").isin(sorted({k * n // STRIDE for k in range(min(STRIDE, n))}))).select("doc_id")


def minted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first batch that cites a key owns it, and keys are minted in order."""
    first = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("first_batch"))
    return numbered(first, "l_partkey").select("l_partkey", "first_batch", (F.col("place") + 1).alias("minted"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = numbered(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return placed.groupBy(F.floor(F.col("place") / more.BATCH).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and p90 by index of each kind of event; a kind may hold most of the events."""
    placed = places_in_groups(_table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_type", "value", "event_id"), ["event_type"], "value", "event_id")
    middle = (F.col("place") == F.floor((F.col("n") - 1) / 2)) | (F.col("place") == F.floor(F.col("n") / 2))
    ninth = F.col("place") == F.greatest(F.floor(F.col("n") * 0.9) - 1, F.lit(0))
    return placed.groupBy("event_type").agg(F.round(F.avg(F.when(middle, F.col("value"))), 6).alias("median"), F.round(F.max(F.when(ninth, F.col("value"))), 6).alias("p90"))


QUERIES = {"agg14_distribution": distribution, "win11_order": interleaved, "win16_stride": stride, "sec03_owner": minted, "src19_batches": batches, "sec24_latency": latency}
ORACLES = {name: next(m.ORACLES[name] for m in (full, census, more) if name in m.ORACLES) for name in QUERIES}
