"""Packing under a budget: greedy bins in order, largest first onto the lightest bin, and items that fit a context."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a clipped string, characters of a token in a budget, tokens of a context.
CLIP, CHARS, BUDGET = 600, 3.49, 4000
#: Items of a shard; bins of a shard; size of a bin.
SHARD, BINS, BIN = 1000, 8, 60_000


def clip(text: Column, size: int = CLIP) -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.rtrim(F.substring(text, 1, size - 1)), F.lit("…"))).otherwise(text)


def clip_nested(value: Column, kind, size: int = CLIP) -> Column:
    """value with every string in its arrays, maps and structs clipped; kind is its data type."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StringType):
        return clip(value, size)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: clip_nested(x, kind.elementType, size))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: clip_nested(x, kind.valueType, size))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[clip_nested(value[f.name], f.dataType, size).alias(f.name) for f in kind.fields]))
    return value


def in_order(items: DataFrame, limit: int) -> DataFrame:
    """items (shard, place, size) with a bin: a running size per shard that starts anew where the next item would pass limit.

    A shard is a bounded batch by design and fits a task. An item above the limit has a bin of its own; null sizes are 0.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place", kind="stable")
        bins, at, held = [], -1, None
        for size in g["size"].fillna(0):
            if held is None or held + size > limit:
                at, held = at + 1, 0
            held += size
            bins.append(at)
        return g.assign(bin=bins)

    rows = items.select("shard", "place", F.col("size").cast("long").alias("size"))
    return rows.groupBy("shard").applyInPandas(run, rows.schema.simpleString()[7:-1] + ", bin int")


def lightest(items: DataFrame, bins: int) -> DataFrame:
    """items (shard, place, size) with a bin: the largest first, each onto the bin that holds least, the first of equals."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(size=g["size"].fillna(0)).sort_values(["size", "place"], ascending=[False, True], kind="stable")
        load, took = [(0, b) for b in range(bins)], []
        for size in g["size"]:
            held, b = heapq.heappop(load)
            took.append(b)
            heapq.heappush(load, (held + size, b))
        return g.assign(bin=took)

    rows = items.select("shard", "place", F.col("size").cast("long").alias("size"))
    return rows.groupBy("shard").applyInPandas(run, rows.schema.simpleString()[7:-1] + ", bin int")


def fit(items: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Items (query, kind, id, score, text) that a context of budget tokens holds: query, id, tokens, place.

    Texts are clipped; the best item of each kind comes first, then all others by score; an item that does not fit is
    skipped and smaller ones may follow. At most budget / n items of n tokens can be in a context, so no query sends
    more than these to its task, whatever it holds.
    """
    size = F.greatest(F.lit(1), F.floor(F.char_length(clip(F.coalesce("text", F.lit("")))) / CHARS + 0.999)).cast("int")
    given = dict(items.dtypes)["id"]  # pandas would make floats of ids with nulls, so they travel as text
    rows = items.select("query", "kind", F.struct(F.col("id").isNull().alias("none"), "id").alias("id"), "score", size.alias("tokens"))
    best = F.row_number().over(Window.partitionBy("query", "kind").orderBy(F.col("score").desc_nulls_last(), "id"))
    same = F.row_number().over(Window.partitionBy("query", "tokens").orderBy(F.col("score").desc_nulls_last(), "id"))
    rows = rows.withColumn("first", best == 1).withColumn("nth", same).where((F.col("nth") <= F.floor(F.lit(budget) / F.col("tokens"))) | F.col("first"))

    order = F.row_number().over(Window.partitionBy("query").orderBy(F.col("first").desc(), F.col("score").desc_nulls_last(), "id"))
    rows = rows.withColumn("rank", order).select("query", F.col("id.id").cast("string").alias("id"), "tokens", "rank")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        left, took = budget, []
        for n in g["tokens"]:
            took.append(n <= left)
            left -= n if took[-1] else 0
        kept = g[took]
        return kept[["query", "id", "tokens"]].assign(place=range(len(kept)))

    made = rows.groupBy("query").applyInPandas(run, f"query {dict(rows.dtypes)['query']}, id string, tokens int, place int")
    return made.withColumn("id", F.col("id").cast(given))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in shards of about SHARD, in order of their ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.floor(F.col("doc_id") / SHARD).alias("shard"), F.col("doc_id").alias("place"), F.char_length("text").cast("long").alias("size"))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("source").alias("query"), F.col("lang").alias("kind"), F.col("doc_id").alias("id"), (F.col("n_chars") % 97 / 97.0).alias("score"), "text")


#: The same packing in recursive SQL: each step takes the next item of every shard.
_ORDERED = "SELECT CAST(floor(doc_id / CAST(1000 AS DOUBLE)) AS BIGINT) AS shard, doc_id AS place, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY floor(doc_id / CAST(1000 AS DOUBLE)) ORDER BY doc_id) AS k FROM documents"
QUERIES = {
    "win09_bins": lambda spark, sf_dir: in_order(_items(spark, sf_dir), BIN),
    "win10_lightest": lambda spark, sf_dir: lightest(_items(spark, sf_dir), BINS).groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("load")),
    "top14_context": lambda spark, sf_dir: fit(_contexts(spark, sf_dir)),
    "arr02_clipped": lambda spark, sf_dir: _texts_clipped(spark, sf_dir),
}
ORACLES = {
    "win09_bins": f"""
WITH RECURSIVE o AS ({_ORDERED}),
p AS (SELECT shard, place, size, k, CAST(0 AS INT) AS bin, size AS held FROM o WHERE k = 1
  UNION ALL SELECT o.shard, o.place, o.size, o.k, CASE WHEN held + o.size > {BIN} THEN bin + 1 ELSE bin END, CASE WHEN held + o.size > {BIN} THEN o.size ELSE held + o.size END FROM p JOIN o ON o.shard = p.shard AND o.k = p.k + 1)
SELECT shard, place, CAST(size AS BIGINT) AS size, bin FROM p""",
    "arr02_clipped": f"SELECT doc_id, CASE WHEN length(text) > {CLIP} THEN rtrim(substr(text, 1, {CLIP - 1})) || '…' ELSE text END AS clipped, [CASE WHEN length(source) > 3 THEN rtrim(substr(source, 1, 2)) || '…' ELSE source END, lang][1] AS tag FROM documents",
}


def _texts_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.struct("text", F.array("source", "lang").alias("tags")).alias("props"))
    kinds = docs.schema["props"].dataType
    return docs.select("doc_id", clip_nested(F.col("props.text"), kinds["text"].dataType).alias("clipped"), clip_nested(F.col("props"), kinds, 3)["tags"][0].alias("tag"))
