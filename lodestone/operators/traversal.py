"""Bounded breadth-first traversal of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.storage import fresh_folder


def reach(edges: DataFrame, anchors: DataFrame, hops: int) -> DataFrame:
    """Rows (anchor, node, hops): each node within so many hops of an anchor, at its least distance.

    edges has src and dst and is followed from src to dst; anchors has the column anchor. Null ends and null
    anchors reach nothing; repeated edges or anchors change nothing; an anchor is not a row of its own. Each
    level is written to the shared folder and read again by the next.
    """
    spark = edges.sparkSession
    folder = fresh_folder(spark, "reach")
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    start = anchors.select("anchor", F.col("anchor").alias("node"), F.lit(0).alias("hops")).where("anchor IS NOT NULL").distinct()
    start.write.parquet(f"{folder}/level_=0")
    for h in range(1, hops + 1):
        seen = spark.read.schema(start.schema).parquet(*(f"{folder}/level_={i}" for i in range(h)))
        edge = spark.read.schema(start.schema).parquet(f"{folder}/level_={h - 1}")
        step = edge.join(edges, edge.node == edges.src).select("anchor", F.col("dst").alias("node")).distinct()
        step.join(seen, ["anchor", "node"], "left_anti").withColumn("hops", F.lit(h)).write.parquet(f"{folder}/level_={h}")
    return spark.read.schema(start.schema).parquet(*(f"{folder}/level_={i}" for i in range(hops + 1))).where("hops > 0")
