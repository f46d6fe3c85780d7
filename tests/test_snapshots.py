"""Keyed sinks: merges, batches that run again, killed writes, two writers, deletes and edges."""

import pytest

from lodestone.sources.snapshots import Snapshots, merge_edges

NODES, EDGES = "id long, name string, synthetic boolean", "src long, dst long, rel string, weight double"


def _rows(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def test_merge_rerun_and_kill(spark, tmp_path, monkeypatch):
    table = Snapshots(spark, f"file://{tmp_path}/nodes", NODES, ["id"])
    assert _rows(table) == []
    make = lambda *rows: spark.createDataFrame(rows, "id long, name string, synthetic boolean, at int")
    first = make((1, "a", False, 1), (1, None, True, 2), (2, "b", None, 1), (None, "x", None, 1), (3, "c", True, 1))
    assert table.merge(first, ["at"], 0)
    held = [(1, "a", True), (2, "b", None), (3, "c", True)]
    assert _rows(table) == held
    assert not table.merge(make((1, "other", False, 9)), ["at"], 0) and _rows(table) == held
    second, publish = make((2, "bb", None, 1), (2, "b2", None, 2), (4, None, False, 1)), Snapshots.publish

    def killed(*_):
        raise InterruptedError

    monkeypatch.setattr(Snapshots, "publish", killed)
    with pytest.raises(InterruptedError):
        table.merge(second, ["at"], 1)
    assert _rows(table) == held
    monkeypatch.setattr(Snapshots, "publish", publish)
    assert table.merge(second, ["at"], 1) and not table.merge(second, ["at"], 1)
    assert _rows(table) == [(1, "a", True), (2, "b2", None), (3, "c", True), (4, None, False)]
    stale = table.manifest()
    table.delete("synthetic")
    assert _rows(table) == [(2, "b2", None), (4, None, False)]
    with pytest.raises(RuntimeError, match="another writer"):
        table.publish(stale, {}, None)
    table.delete("id = 4")
    assert _rows(table) == [(2, "b2", None)]
    table.delete()
    assert _rows(table) == [] and table.manifest()["batch"] == 1


def test_edges(spark, tmp_path):
    nodes = Snapshots(spark, f"file://{tmp_path}/nodes", NODES, ["id"])
    edges = Snapshots(spark, f"file://{tmp_path}/edges", EDGES, ["src", "dst", "rel"])
    nodes.merge(spark.createDataFrame([(k, "n", False) for k in (1, 2, 3)], NODES), ["name"])
    rows = [(1, 2, "A", 0.5), (1, 2, "A", 0.7), (1, 2, "B", None), (1, 9, "A", 1.0), (8, 1, "A", 1.0), (None, 1, "A", 1.0)]
    assert merge_edges(edges, nodes, spark.createDataFrame(rows, EDGES), ["weight"], 0)
    assert _rows(edges) == [(1, 2, "A", 0.7), (1, 2, "B", None)]
