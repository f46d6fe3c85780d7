"""Connected components of a pair table by alternating stars (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.storage import fresh_folder


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table in the shared folder, and a digest of their set."""
    path = fresh_folder(edges.sparkSession, "stars")
    edges.write.parquet(path)
    kept = edges.sparkSession.read.parquet(path)
    digest = kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return kept, tuple(digest)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node moves to the node's least neighbour."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours move to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (node, component) for each value of the two columns; the component is its least node.

    A pair with a null end links nothing and gives no node; repeated pairs count once; a node paired only with
    itself is its own component; no pairs give no rows. Each round writes its edges to the shared folder, so
    lineage stays short. Minima are partial aggregates joined back to the edges: the neighbours of a hub are
    never collected.
    """
    ends = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    ends, _ = _written(ends.distinct())
    nodes = ends.select(F.col("u").alias("node")).union(ends.select("v")).distinct()
    edges, now = _written(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while now != before:
        before = now
        edges, now = _written(_small_star(_large_star(edges)))
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
