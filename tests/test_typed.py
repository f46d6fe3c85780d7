"""Typed relations against the general walks, paths and reach over named nodes, and the queries that stand on them."""

import random

import pytest

from lodestone.operators import paths, traversal, typed
from lodestone.plans import resolution

EDGES = "src long, dst long"
KINDS = (("A", "x", "y"), ("B", "y", "z"), ("C", "z", "z"), ("D", "x", "y"), ("E", "x", "x"))


def _graph(spark, seed, few, monkeypatch):
    monkeypatch.setattr(typed, "FEW", few)
    monkeypatch.setattr(typed, "TASK_ROWS", 1000)
    rng = random.Random(seed)
    rows = [[(rng.randrange(5), rng.randrange(5)) for _ in range(6)] + [(2, 2), (2, 2), (None, 1), (1, None), (-1, 1)] for _ in KINDS]
    relations = [typed.Relation(*k, spark.createDataFrame(r, EDGES).coalesce(1)) for k, r in zip(KINDS, rows, strict=True)]
    named = [(f"{s}{a}", f"{d}{b}", name) for (name, s, d), r in zip(KINDS, rows, strict=True) for a, b in r if None not in (a, b)]
    return relations, spark.createDataFrame(named, "src string, dst string, rel string")


@pytest.mark.parametrize("few", [0, 100])
def test_typed_walks(spark, few, monkeypatch):
    relations, named = _graph(spark, 1, few, monkeypatch)
    anchors = spark.createDataFrame([(1,), (1,), (2,), (77,), (None,)], "anchor long")
    got = typed.weighed(relations, anchors, "x", 3, {"A": 1.0, "B": 0.7}, paths.DEFAULT, paths.PER_HOP)
    want = paths.weighed(paths.walks(named, spark.createDataFrame([("x1",), ("x2",), ("x77",)], "anchor string"), 3, {"A": 1.0, "B": 0.7}))
    plain = lambda df: sorted((r.anchor, r.node, r.hops, r.paths, round(r.weight, 8)) for r in df.collect())
    assert plain(got) == plain(want) and got.count()


@pytest.mark.parametrize("few", [0, 100])
def test_typed_reach(spark, few, monkeypatch):
    relations, named = _graph(spark, 2, few, monkeypatch)
    both = named.select("src", "dst").union(named.select("dst", "src"))
    for hops in (1, 3):
        got = typed.reach(relations, spark.createDataFrame([(1,), (3,), (3,), (77,), (None,)], "anchor long"), "x", hops)
        want = traversal.reach(both, spark.createDataFrame([("x1",), ("x3",), ("x77",)], "anchor string"), hops)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("few, kinds", [(0, "xz"), (100, "xz"), (0, "xx"), (100, "xy")])
def test_typed_shortest(spark, few, kinds, monkeypatch):
    relations, named = _graph(spark, 3, few, monkeypatch)
    pairs = [(a, b) for a in (-1, 0, 1, 2, 3, 77) for b in (0, 1, 2, 3, 4, 77)]
    got = typed.shortest(relations, spark.createDataFrame([*pairs, *pairs, (None, 1)], "a long, b long"), tuple(kinds), 3)
    want = paths.shortest(spark.createDataFrame([(f"{kinds[0]}{a}", f"{kinds[1]}{b}") for a, b in pairs], "a string, b string"), named, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _tables(spark, tmp_path):
    rng = random.Random(5)
    orders = [(o, rng.randrange(1, 50)) for o in range(200)] + [(7, 20), (7, 20), (8, None)]
    lines = [(rng.randrange(200), rng.randrange(30), rng.randrange(9)) for _ in range(500)] + [(7, 3, 2), (7, 3, 2), (7, None, 4), (None, 3, 4)]
    customers = [(c, c % 3) for c in range(1, 60)] + [(60, None)]
    for name, rows, schema in (("orders", orders, "o_orderkey long, o_custkey long"), ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long"), ("customer", customers, "c_custkey long, c_nationkey int"), ("nation", [(n,) for n in range(4)], "n_nationkey int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _refused(*_):
    raise AssertionError("all edges, both ways, through each hop")


def test_walks_of_customers_take_relations_one_by_one(spark, tmp_path, monkeypatch):
    tables = _tables(spark, tmp_path)
    anchors = spark.createDataFrame([("c20",), ("c40",), ("c60",)], "anchor string")
    want = {(r.anchor, r.node): (r.hops, r.paths, round(r.weight, 6)) for r in paths.weighed(paths.walks(paths.graph(spark, tables), anchors, 3)).collect()}
    monkeypatch.setattr(paths, "_both_ways", _refused)
    got = {(r.anchor, r.node): (r.hops, r.paths, r.weight) for r in paths.QUERIES["joi16_walks"](spark, tables).collect()}
    assert want and got == {k: (h, n, pytest.approx(w, abs=1e-6)) for k, (h, n, w) in want.items()}


def test_paths_to_suppliers_take_relations_one_by_one(spark, tmp_path, monkeypatch):
    tables = _tables(spark, tmp_path)
    orders, lines = (spark.read.parquet(f"{tables}/{t}.parquet").collect() for t in ("orders", "lineitem"))
    pairs = {(f"c{o.o_custkey}", f"s{x.l_suppkey}") for o in orders for x in lines if o.o_orderkey % 20 == 0 and o.o_orderkey == x.l_orderkey and None not in (o.o_custkey, x.l_suppkey)}
    want = paths.shortest(spark.createDataFrame(sorted(pairs), "a string, b string"), paths.graph(spark, tables))
    want = sorted((r.a, r.b, r.hops, ">".join(r.path), ">".join(r.rels)) for r in want.collect())
    monkeypatch.setattr(paths, "_both_ways", _refused)
    assert want and sorted(map(tuple, paths.QUERIES["top24_paths"](spark, tables).collect())) == want


def test_hops_from_nations_take_relations_one_by_one(spark, tmp_path, monkeypatch):
    tables = _tables(spark, tmp_path)
    read = lambda name, *ends: spark.read.parquet(f"{tables}/{name}.parquet").selectExpr(*ends)
    edges = read("customer", "concat('n:', c_nationkey) AS src", "concat('c:', c_custkey) AS dst").union(read("orders", "concat('c:', o_custkey)", "concat('o:', o_orderkey)")).union(read("lineitem", "concat('o:', l_orderkey)", "concat('p:', l_partkey)"))
    want = sorted(map(tuple, traversal.reach(edges.union(edges.select("dst", "src")), read("nation", "concat('n:', n_nationkey) AS anchor"), 3).collect()))
    monkeypatch.setattr(resolution, "reach", _refused, raising=False)
    assert want and sorted(map(tuple, resolution.QUERIES["joi17_shortest"](spark, tables).collect())) == want
