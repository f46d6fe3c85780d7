"""Walks, shortest paths, shared runs and global places against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import paths, ranks, runs

EDGES = "src string, dst string, rel string"


def _edges(seed, n=14, m=26):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(("A", "B", "C", None))) for _ in range(m)] + [("n1", "n1", "A"), (None, "n2", "A"), ("n3", None, "B"), ("x", "y", "A"), ("x", "y", "A")]


def _near(edges):
    near = {}
    for k, (a, b, rel) in enumerate(sorted({e for e in edges if None not in e[:2]}, key=repr)):
        for x, y in {(a, b), (b, a)}:
            near.setdefault(x, []).append((y, rel, k))
    return near


def test_walks(spark):
    edges, weights = _edges(1), {"A": 1.0, "B": 0.7}
    near, want, front = _near(edges), [], [(a, a, [], [a], 1.0) for a in ("n1", "x", "gone")]
    for hops in (1, 2, 3):
        front = [(a, y, [*used, k], [*path, y], w * weights.get(rel, 0.5) * 0.55) for a, node, used, path, w in front for y, rel, k in near.get(node, []) if k not in used]
        want += [(a, y, hops, path, round(w, 9)) for a, y, _, path, w in front]
    anchors = spark.createDataFrame([("n1",), ("n1",), ("x",), ("gone",), (None,)], "anchor string")
    found = paths.walks(spark.createDataFrame(edges, EDGES), anchors, 3, weights)
    assert sorted((r.anchor, r.node, r.hops, r.path, round(r.weight, 9)) for r in found.collect()) == sorted(want)
    for r in paths.weighed(found).collect():
        own = [w for w in want if w[:2] == (r.anchor, r.node)]
        assert r.node != r.anchor and r.paths == len(own) and r.hops == min(w[2] for w in own) and abs(r.weight - sum(w[4] for w in own)) < 1e-8


@pytest.mark.parametrize("most", [1, 2, 3])
def test_shortest(spark, most):
    edges = [e for e in _edges(2, 20, 24) if e[2] is not None]
    near, names = _near(edges), [f"n{k}" for k in range(20)] + ["x", "y", "gone"]
    want = []
    for a in names:
        front = [([a], [])]
        best = {a: (0, [a], [])} if a in near or a == "gone" else {a: (0, [a], [])}
        for hops in range(1, most + 1):
            front = [([*p, y], [*r, rel]) for p, r in front for y, rel, _ in near.get(p[-1], [])]
            for p, r in sorted(front):
                best.setdefault(p[-1], (hops, p, r))
        want += [(a, b, *best[b]) for b in names if b in best]
    pairs = [(a, b) for a in names for b in names] * 2 + [(None, "n1")]
    got = paths.shortest(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(edges, EDGES), most)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_longest_runs(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))
    left = [(k, text()) for k in range(12)] + [(50, None), (None, "a b c a b c a b c"), (51, "A, b! c"), (51, "a b c a a a b")]
    right = [(k, text()) for k in range(12)] + [(60, "x y a b c z"), (60, ""), (61, "a b c a a a b " * 3)]
    for least in (1, 3):
        want = {}
        for i, s in left:
            for j, t in right:
                if i is None or s is None:
                    continue
                p, q = ("".join(c if c.isalnum() else " " for c in x.lower()).split() for x in (s, t))
                length = {}
                for x in range(len(p)):
                    for y in range(len(q)):
                        if p[x] == q[y]:
                            length[x, y] = length.get((x - 1, y - 1), 0) + 1
                best = max(length.values(), default=0)
                if best >= least:
                    want[i, j] = max(best, want.get((i, j), 0))
        got = runs.longest_runs(spark.createDataFrame(left, "left_id long, text string"), spark.createDataFrame(right, "right_id long, text string"), least).collect()
        assert {(r.left_id, r.right_id): r.longest for r in got} == want
        for r in got:
            if r.left_id < 12 and r.right_id < 12:
                p, q = left[r.left_id][1].split(), right[r.right_id][1].split()
                assert p[r.left_at : r.left_at + r.longest] == q[r.right_at : r.right_at + r.longest]


def test_places(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("aab") if k % 3 else None, rng.choice((1.0, 1.0, 2.0, None))) for k in range(300)]
    frame = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    first = lambda x: (x is not None, x or 0)
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (first(r[2]), r[0])))}
    assert {r.id: r.place for r in ranks.numbered(frame, "v", "id").collect()} == want
    for r in ranks.places_in_groups(frame, ["g"], "v", "id").collect():
        own = sorted((x for x in rows if x[1] == r.g), key=lambda x: (first(x[2]), x[0]))
        assert r.n == len(own) and own[r.place][0] == r.id
    assert ranks.numbered(frame.limit(0), "id").count() == 0
    plan = ranks.numbered(frame, "v", "id")._jdf.queryExecution().executedPlan().toString()
    assert frame.count() == 300 and "Window" in plan
    assert ranks.numbered(frame.withColumn("v", F.lit(1.0)), "v").agg(F.count_distinct("place")).first()[0] == 300
