"""Links and shared touches over every row: pairs that no anchor of 20 reaches, hot labels and parts, missing values."""

import random

import duckdb

from lodestone.plans import catalogue, evidence, graph, links, sql
from test_scale import most_rows


def test_nearest(spark):
    deal = random.Random(5)
    rows = [(i, "hot" if i % 3 else "x", [deal.uniform(-1, 1) for _ in range(6)]) for i in range(1, 120)]
    rows += [(201, "two", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (202, "two", [1.0, 0.1, 0.0, 0.0, 0.0, 0.0]), (203, "two", [0.0] * 6), (204, None, [1.0] * 6), (205, "two", None), (None, "two", [1.0] * 6)]
    sound = [(i, label, v) for i, label, v in rows if i and label and v and any(v)]
    want = set()
    for i, label, v in sound:
        scored = []
        for j, other, w in sound:
            if label == other and i != j:
                dot = sum(x * y for x, y in zip(v, w, strict=True))
                scored.append((-round((1 + dot / (sum(x * x for x in v) * sum(y * y for y in w)) ** 0.5) / 2, 6), j))
        want |= {(i, j, -s) for s, j in sorted(scored)[:3]}
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    for block in (16, 1024):
        assert {tuple(r) for r in links.nearest(frame, block).collect()} == want
    assert (201, 202) in {(i, j) for i, j, _ in want}


def test_touches(spark, tmp_path):
    lines = [(o, 1) for o in range(1, 601)] + [(o, 2) for o in (3, 7, 300, 599)] + [(7, 2), (7, 5), (3, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in links.QUERIES["joi11_cotouch_all"](spark, str(tmp_path)).collect()}
    four = (3, 7, 300, 599)
    assert got == {(a, b, 3 if {a, b} == {3, 7} else 2) for a in four for b in four if a != b}
    shared = [tuple(r) for r in links.QUERIES["joi10_shared_all"](spark, str(tmp_path)).collect()]
    assert len(shared) == len(set(shared)) == 600 * 599 + 12 + 2


def _embeddings(spark, tmp_path, rows) -> str:
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_search_pairs_no_rows(spark, tmp_path):
    deal = random.Random(8)
    rows = [(i, [deal.gauss(0, 1) for _ in range(8)], i % 2) for i in range(800)] + [(900 + i, [1.0] * 8, 0) for i in range(100)]
    made = _embeddings(spark, tmp_path, rows)
    vectors = spark.read.parquet(f"{made}/embeddings.parquet")
    df = catalogue.QUERIES["joi21_knn"](spark, made)
    want = sorted(map(tuple, sql.query(graph._PAIRS["joi21_knn"][0])(spark, made).collect()))
    assert sorted(map(tuple, df.collect())) == want and len(want) == 45 * 3
    assert most_rows(df) <= 3 * len(rows)
    recall = catalogue.QUERIES["grf28_recall"](spark, made)
    assert sorted(map(tuple, recall.collect())) == sorted(map(tuple, sql.query(evidence._PAIRS["grf28_recall"][0])(spark, made).collect()))
    assert most_rows(recall) <= 3 * len(rows)
    for block in (64, 300):
        assert sorted(map(tuple, links.nearest(vectors, block, vectors.vec_id % 20 == 0).collect())) == want


def test_search_of_odd_vectors(spark, tmp_path):
    deal = random.Random(2)
    some = lambda n=4: [deal.gauss(0, 1) for _ in range(n)]
    nan, inf = float("nan"), float("inf")
    rows = [(i, some(), 1) for i in range(30)] + [(40, None, 1), (41, [1.0, None, 1.0, 1.0], 1), (60, some(3), 1), (61, some(3), 1), (20, some(), 1), (20, some(), 2), (3, some(), 1)]
    rows += [(100, some(), 2), (101, [nan, 1.0, 0.0, 0.0], 2), (102, [inf, 1.0, 0.0, 0.0], 2), (120, [nan] * 4, 2), (103, some(), 2), (140, some(), 3), (140, some(), 3), (141, None, 3), (141, None, 3)]
    rows += [(160, some(), None), (None, some(), 1), (180, some(), 4), (200, None, 5), (201, some(), 5), (202, None, 5), (203, some(), 5), (204, some(), 5)]
    made = _embeddings(spark, tmp_path, rows)
    for name, plain in (("joi21_knn", graph._PAIRS["joi21_knn"][0]), ("grf28_recall", evidence._PAIRS["grf28_recall"][0])):
        got, want = (sorted(map(repr, f(spark, made).collect())) for f in (catalogue.QUERIES[name], sql.query(plain)))
        assert got == want and len(got) >= 4


def test_vectors_of_length_zero_come_first_as_in_duckdb(spark, tmp_path):
    rows = [(i, [1.0, float(i)], 1) for i in range(18, 30)] + [(2, [0.0, 0.0], 1), (40, [0.0, 0.0], 1)]
    made = _embeddings(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{made}/embeddings.parquet/*.parquet'")
    got = sorted(repr(tuple(r)) for r in catalogue.QUERIES["joi21_knn"](spark, made).collect())
    assert got == sorted(map(repr, con.execute(catalogue.ORACLES["joi21_knn"]).fetchall())) and sum("nan" in r for r in got) == 5
