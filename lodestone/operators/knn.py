"""Nearest neighbours through an inverted file: rows lie under their nearest centre, a search looks under several centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that centres are fitted on at most; rows under a centre on average; trial searches that say under how many centres to look, and the
#: share of their nearest rows that must lie there; least such centres.
SAMPLE, LIST, TRIALS, RECALL, LEAST = 20_000, 64, 128, 0.96, 8
ROUNDS, NEAREST, DEAL = 8, 10, 4096


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float32) if len(column) else np.zeros((0, 1), np.float32)


def centres(vectors: DataFrame, many: int, seed: int = 3) -> np.ndarray:
    """Centres by k-means on at most SAMPLE rows, those least by a hash of their ids."""
    picked = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(SAMPLE).select("e").toPandas()["e"]
    rows = _unit(np.array(picked.tolist(), np.float32))
    at = rows[: max(1, min(many, len(rows)))].copy()
    for _ in range(ROUNDS):
        near = (rows @ at.T).argmax(1)
        total = np.zeros_like(at)
        np.add.at(total, near, rows)
        at = np.where(np.bincount(near, minlength=len(at))[:, None] > 0, _unit(total), at)
    return at


def looks_for(vectors: DataFrame, at, nearest: int, recall: float) -> int:
    """Under how many centres a search must look, by the nearest rows of TRIALS rows among all rows: one pass, brute force.

    Where vectors lie in groups a few centres are enough; where they are spread evenly it takes most of them.
    """
    picked = vectors.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(TRIALS).toPandas()
    own, asked = picked["vec_id"].to_numpy(), _unit(np.array(picked["e"].tolist(), np.float32))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, e = batch.column(0).to_numpy(), _unit(_matrix(batch.column(1)))
            lists, scores = (e @ at.value.T).argmax(1), asked @ e.T
            scores[own[:, None] == ids[None]] = -2
            top = np.argsort(-scores, axis=1, kind="stable")[:, :nearest]
            trial = np.repeat(np.arange(len(own)), top.shape[1])
            columns = [pa.array(trial), pa.array(ids[top.ravel()]), pa.array(np.take_along_axis(scores, top, 1).ravel().astype(np.float64)), pa.array(lists[top.ravel()])]
            yield pa.RecordBatch.from_arrays(columns, names=["trial", "vec_id", "score", "list"])

    found = vectors.mapInArrow(near, "trial long, vec_id long, score double, list long").where("score > -2")
    best = found.selectExpr("*", "row_number() OVER (PARTITION BY trial ORDER BY score DESC, vec_id) AS rn").where(F.col("rn") <= nearest).toPandas()  # at most TRIALS * nearest rows
    order = np.argsort(np.argsort(-(asked @ at.value.T), axis=1, kind="stable"), axis=1)
    depth = np.sort(order[best["trial"].to_numpy(np.int64), best["list"].to_numpy(np.int64)])
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1 if len(depth) else 1


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, recall: float = RECALL) -> DataFrame:
    """The nearest rows of vectors for each row of queries (vec_id, embedding both): a_id, b_id, score = (1 + cosine) / 2.

    Every row is indexed and scores are exact; what a search may miss lies under centres that it does not look under. How many it looks
    under is measured on trial searches against all rows, so that the share recall of their nearest rows is found.
    Long lists are dealt to several groups, so no task holds one whole; each sends its best, which are merged. Null ids and
    vectors have no score; a row is not its own neighbour; an empty table has no neighbours.
    """
    spark = vectors.sparkSession
    sound = lambda df: df.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("e"))
    vectors, queries = sound(vectors), sound(queries)
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "a_id long, b_id long, score double")
    many = max(1, n // LIST)
    at = spark.sparkContext.broadcast(centres(vectors, many))
    looks = min(len(at.value), max(LEAST, looks_for(vectors, at, nearest, recall)))

    def place(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    scores = _unit(_matrix(batch.column(1))) @ at.value.T
                    top = np.argsort(-scores, axis=1, kind="stable")[:, :count]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(top.astype(np.int64)), pa.list_(pa.int64()))], names=["vec_id", "e", "lists"])

        return run

    schema = "vec_id long, e array<float>, lists array<long>"
    rows = vectors.mapInArrow(place(1), schema).select("vec_id", "e", F.col("lists")[0].alias("list"))
    sizes = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), "vec_id", "e", F.lit(False).alias("asks"))
    asked = queries.mapInArrow(place(looks), schema).select("vec_id", "e", F.explode("lists").alias("list")).join(F.broadcast(sizes), "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "e", F.lit(True).alias("asks"))

    def best(table: pa.Table) -> pa.Table:
        ids, asks = table.column("vec_id").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        e = _unit(_matrix(table.column("e").combine_chunks()).astype(np.float64))
        q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        a, b, s = [], [], []
        for i in range(0, len(q), 256):
            scores = np.round((1 + e[q[i : i + 256]] @ e[r].T) / 2, 6)
            scores[ids[q[i : i + 256]][:, None] == ids[r][None]] = -1
            for k, row in enumerate(scores):
                top = np.lexsort((ids[r], -row))[:nearest]
                top = top[row[top] >= 0]
                a.append(np.full(len(top), ids[q[i + k]]))
                b.append(ids[r][top])
                s.append(row[top])
        join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        return pa.table([join(a, pa.int64()), join(b, pa.int64()), join(s, pa.float64())], names=["a_id", "b_id", "score"])

    found = asked.unionByName(rows).groupBy("list", "part").applyInArrow(best, "a_id long, b_id long, score double")
    ranked = found.selectExpr("*", "row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rn")
    return ranked.where(F.col("rn") <= nearest).drop("rn")


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"joi21_lists": _query}
ORACLES: dict[str, str] = {}
