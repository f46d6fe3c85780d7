"""Toxicity: a character n-gram linear classifier on naive-Bayes-scaled presence features.

Each text is the set of its hashed character n-grams (bytes, A-Z lower-cased, MIN_N to MAX_N long) over the
whole text. A feature is scaled by its naive Bayes log-count ratio between toxic and clean training texts; a
logistic model is fitted to the scaled features and its weights times the ratios are what scoring sums up.

Training reads at most TRAIN_ROWS labelled documents (the bound on what one task holds), half of them toxic and half
clean where there are as many; they are picked by a hash of doc_id among all labelled rows whose crc32(doc_id) mod 5
is not 0. Both classes weigh the same in the fit, so that 0.5 is the score of a text that fits either class as well.

Defined results: null texts are empty and score what the intercept gives; null labels teach nothing; a doc_id
that is labelled both ways is left out; of several texts under one labelled doc_id one teaches; without training rows of both classes the score is the smoothed share
of toxic labels; equal texts have equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, doc_slices, documents, free_names, lower_bytes, mix, prefix_sums, powers, text_buffer, tidy

MIN_N, MAX_N = 3, 5
BUCKETS = 1 << 18
TRAIN_ROWS = 6_000
ROUNDS = 150
_U = np.uint64


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each document its number and the buckets of its n-grams, each once."""
    last = np.empty(BUCKETS, np.int32)  # only places written for a document are read for it
    for i, j in doc_slices(offsets):
        part = lower_bytes(data[offsets[i] : offsets[j]])
        sums, (_, down) = prefix_sums(part), powers(len(part) + 1)
        bounds = offsets[i : j + 1] - offsets[i]
        grams = []
        for n in range(MIN_N, MAX_N + 1):
            m = max(0, len(sums) - n)
            h = (sums[n:] - sums[:m]) * down[:m]
            grams.append((mix(h + _U(n)) & _U(BUCKETS - 1)).astype(np.int32))
        for k in range(j - i):
            a, b = bounds[k], bounds[k + 1]
            own = np.concatenate([g[a : max(a, b - n + 1)] for n, g in zip(range(MIN_N, MAX_N + 1), grams, strict=True)])
            seen = np.arange(len(own), dtype=np.int32)
            last[own] = seen  # of equal buckets the last one stays
            yield i + k, own[last[own] == seen]


def _fit(rows: pd.DataFrame) -> tuple[np.ndarray, float]:
    """Scaled weights and intercept from rows (toxic, grams)."""
    y = rows["toxic"].to_numpy().astype(np.float64)
    weights = np.zeros(BUCKETS)
    if len(y) == 0 or y.min() == y.max():
        return weights, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    grams = [np.frombuffer(g, np.int32) for g in rows["grams"]]
    p, q = np.ones(BUCKETS), np.ones(BUCKETS)
    for label, own in zip(y, grams, strict=True):
        (p if label else q)[own] += 1  # a bucket is at most once in a document
    p, q = p / (y.sum() + 2), q / (len(y) - y.sum() + 2)
    ratio = np.log(p / q)
    ratio[np.abs(ratio) < 0.7] = 0  # as frequent in either class
    grams = [own[ratio[own] != 0] for own in grams]
    flat = np.concatenate(grams)
    owner = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
    values = ratio[flat]
    scale = np.sqrt(np.maximum(np.bincount(owner, values * values, len(y)), 1.0)).mean()
    values = values / scale
    positive = y.mean()
    cost = np.where(y == 1, 0.5 / positive, 0.5 / (1 - positive)) / len(y)
    w, b = np.zeros(BUCKETS), 0.0
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = np.bincount(owner, values * w[flat], len(y)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cost
        g = np.bincount(flat, values * err[owner], BUCKETS) + 1e-5 * w
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 - 0.9**t)
        fix = 1 - 0.999**t
        w -= rate * m / (np.sqrt(v / fix) + 1e-8)
        b -= rate * mb / (np.sqrt(vb / fix) + 1e-8)
    return w * ratio / scale, b


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most limit labelled documents, in one task that holds only their n-gram sets."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    place = (F.xxhash64(F.lit(11), "doc_id"), "doc_id")
    of = [known.where("(toxic = 1) = " + toxic).select("doc_id", "toxic").orderBy(*place).limit(limit // 2) for toxic in ("true", "false")]
    picked = of[0].unionAll(of[1]).collect()  # at most limit rows
    chosen = F.broadcast(spark.createDataFrame([(r[0], int(r[1])) for r in picked], "doc_id long, toxic int"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            own = [g.tobytes() for _, g in features(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], names=["doc_id", "toxic", "grams"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            weights, bias = _fit(pd.concat(parts).sort_values("doc_id", kind="stable"))
            yield pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "bias": [bias]})

    # a labelled doc_id may be on many rows: one of its texts teaches, so that the task that fits gets at most limit rows
    one = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = one.mapInArrow(tidy(grams), "doc_id long, toxic int, grams binary")
    model = found.repartition(1).mapInPandas(fit, "weights binary, bias double").collect()
    if not model:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(model[0][0], np.float32), model[0][1]


def score(docs: DataFrame, model: tuple[np.ndarray, float], as_: str = "score_") -> DataFrame:
    """docs with a column named as_ (0 to 1) that scores its column text; the other columns pass through, so docs must not have as_."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            for i, j in doc_slices(offsets):
                out = np.zeros(j - i)
                for k, own in features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    out[k] = w[own].sum(dtype=np.float64)
                out = 1 / (1 + np.exp(-np.clip(out + b, -500, 500)))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(out)], names=[*batch.schema.names, as_])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{as_}` double"
    return docs.mapInArrow(tidy(run), schema)


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The documents that score below 0.5, with the columns of docs, under whatever names."""
    (name,) = free_names(docs, "score")
    return score(docs, model, name).where(F.col(name) < 0.5).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("score_").alias("score"),
        (F.col("score_") >= 0.5).cast("int").alias("predicted"),
    )
