"""Components and traversal against plain versions: hubs, chains, self-pairs, nulls, repeats, no rows."""

import random

from lodestone.operators.components import components
from lodestone.operators.traversal import reach


def plain(pairs):
    root = {}
    for a, b in pairs:
        if a is None or b is None:
            continue
        ra, rb = root.setdefault(a, {a}), root.setdefault(b, {b})
        if ra is not rb:
            ra |= rb
            root.update(dict.fromkeys(rb, ra))
    return {n: min(s) for n, s in root.items()}


def found(spark, pairs):
    return {r.node: r.component for r in components(spark.createDataFrame(pairs, "x long, y long, u string"), "x", "y").collect()}


def test_components(spark):
    deal = random.Random(3)
    chain = [(i + 1, i) for i in range(1000, 1040)]
    hub = [(5000, i) for i in range(5001, 5200)]
    mixed = [(deal.randrange(90), deal.randrange(90)) for _ in range(60)]
    pairs = [*chain, *hub, *mixed, *mixed[:9], (None, 7), (8, None), (None, None), (700, 700)]
    assert found(spark, [(*p, "extra") for p in pairs]) == plain(pairs)


def test_no_pairs(spark):
    assert found(spark, []) == {}
    assert found(spark, [(None, 1, "a")]) == {}


def test_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("b", "a"), (None, "a"), ("a", None)], "src string, dst string")
    anchors = spark.createDataFrame([("a",), ("a",), ("c",), ("z",), (None,)], "anchor string")
    got = sorted(map(tuple, reach(edges, anchors, 2).collect()))
    assert got == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("c", "d", 1), ("c", "e", 2)]
    assert reach(edges.limit(0), anchors, 2).count() == 0
