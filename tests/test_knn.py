"""Searches through lists against brute force: recall, exact scores, ties, repeats, nulls, no rows."""

import numpy as np
import pytest

from lodestone.operators import knn


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    held = vectors.toPandas()
    e = np.stack(held.embedding.to_numpy()).astype(float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    ids, hits, n = held.vec_id.to_numpy(), 0, 0
    got = {}
    for r in knn.search(vectors, vectors.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.a_id, {})[r.b_id] = r.score
    for i in np.flatnonzero(ids % 20 == 0):
        score = np.round((1 + e @ e[i]) / 2, 6)
        score[i] = -1
        want = ids[np.lexsort((ids, -score))[:10]]
        hits += len(set(want) & set(got[ids[i]]))
        n += 10
        assert all(abs(s - (1 + e[np.flatnonzero(ids == b)[0]] @ e[i]) / 2) < 1e-5 for b, s in got[ids[i]].items())
    assert hits / n >= 0.9


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (None, [1.0, 1.0]), (4, None), (5, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.a_id, r.b_id): r.score for r in knn.search(frame, frame.where("vec_id = 1"), 5).collect()}
    assert got == {(1, 2): 1.0, (1, 3): 0.5, (1, 5): 0.0}
    assert knn.search(frame.limit(0), frame).count() == 0


@pytest.mark.parametrize(("n", "groups", "share"), [(4000, None, 1.0), (20_000, 400, 0.1)], ids=["even", "grouped"])
def test_recall_is_measured(spark, n, groups, share):
    rng = np.random.default_rng(3)
    e = rng.standard_normal((n, 64)) if groups is None else 4 * rng.standard_normal((groups, 64))[rng.integers(0, groups, n)] + rng.standard_normal((n, 64))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(e.round(6).tolist())], "vec_id long, embedding array<float>")
    at = spark.sparkContext.broadcast(knn.centres(vectors.withColumnRenamed("embedding", "e"), n // knn.LIST))
    assert knn.looks_for(vectors.withColumnRenamed("embedding", "e"), at, 10, knn.RECALL) <= share * len(at.value)
    got = {}
    for r in knn.search(vectors, vectors.where("vec_id % 40 = 0")).collect():
        got.setdefault(r.a_id, set()).add(r.b_id)
    hits = 0
    for i in range(0, n, 40):
        score = e @ e[i]
        score[i] = -2
        hits += len(set(np.argsort(-score)[:10].tolist()) & got[i])
    assert hits >= 0.9 * 10 * len(got)
