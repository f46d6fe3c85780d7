"""Hard negatives against plain Python, whitening against a dense eigensolver, and both on nulls, ties, repeats and empty tables."""

import math
import random

import duckdb
import numpy as np
import pytest

from lodestone.llm import negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score string, n string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def _plain(rows):
    """Every list sorted whole; rows are told apart by their place."""
    used = []
    for vec, emb, label in rows:
        if label is None or emb is None or any(e is None or not math.isfinite(e) for e in emb):
            continue
        label = (label + 1) % 10 if vec is not None and vec % 7 == 0 else label
        used.append((vec, label, [math.floor(256 * float(np.float32(e))) for e in emb]))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, (a, own, x) in enumerate(used):
        if a is None or a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(x, y, strict=False)), vec, label) for j, (vec, label, y) in enumerate(used) if j != i]
        for ps, pid, _ in sorted((s for s in scored if s[2] == own), key=order)[:5]:
            fits = [s for s in scored if s[2] != own and 30 * ps <= 100 * s[0] <= 90 * ps]
            out += [(a, pid, k + 1, nid, ps, ns) for k, (ns, nid, _) in enumerate(sorted(fits, key=order)[:10])]
    return out


def _rows(seed, n, d, exact):
    rng = random.Random(seed)
    draw = (lambda: rng.choice((-0.5, 0.25, 0.5))) if exact else (lambda: rng.gauss(0, 0.3))
    return [(i, [draw() for _ in range(d)], rng.choice((0, 0, 0, 1, 2, 9))) for i in range(n)]


ODD = [(None, [0.5] * 5, 0), (100, [0.5] * 5, 0), (100, [0.5] * 5, 0), (200, [0.5, 0.25], 1), (300, [], 1), (400, None, 1), (500, [0.5] * 5, None), (600, [float("nan")] * 5, 0), (601, [None, 0.5], 0), (602, [float("inf")], 0), (-100, [0.25] * 5, 0), (None, [0.125] * 5, 9)]


@pytest.mark.parametrize("rows", [_rows(1, 700, 9, False), _rows(2, 400, 5, True), _rows(3, 230, 5, True) + ODD + ODD[:1] * 40, [(100, [0.5], 1)], []], ids=["plain", "ties", "odd", "alone", "empty"])
def test_negatives_equal_plain(spark, rows, monkeypatch):
    monkeypatch.setattr(negatives, "TILE_ROWS", 2)
    monkeypatch.setattr(negatives, "TILE_COLUMNS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    got = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in negatives.mine(_table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(_plain(rows), key=repr)
    assert (len(rows) < 10) == (not got)


def test_negatives_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.execute(negatives.ORACLE)
    names = [d[0] for d in want.description]
    want = sorted(want.fetchall())
    assert want and sorted(tuple(r[c] for c in names) for r in negatives.query(spark, folder).collect()) == want


@pytest.mark.parametrize("shape", [(1, 1, 1), (70, 33, 91), (64, 128, 65), (130, 200, 41)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(sum(shape))
    a, b = rng.integers(-(2**28), 2**28, shape[:2]), rng.integers(-(2**28), 2**28, shape[1:])
    assert (negatives.strassen(a, b) == a.astype(object) @ b.astype(object)).all()


def test_scores_that_do_not_fit_are_refused(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        negatives.mine(_table(spark, [(100, [1e9, 1e9], 1), (101, [1e9, 1.0], 1)])).collect()


def _check(spark, rows, components=8):
    got = whitening.whiten(_table(spark, rows), components).collect()
    used = [(v, e) for v, e, _ in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    d = max(1, *(len(e) for _, e in used))
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in e] + [100_000] * (d - len(e)) for _, e in used])
    n, s = len(x), x.sum(0)
    values, axes = np.linalg.eigh((x - s / n).T @ (x - s / n) / n)
    values, axes = values[::-1], axes[:, ::-1]
    m = min(components, d, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == n * m and {r.component for r in got} == set(range(1, m + 1))
    for k in range(m):
        own = sorted((r for r in got if r.component == k + 1), key=lambda r: (repr(r.vec_id), r.deviation, r.whitened))
        plain = (x - s / n) @ axes[:, k] / math.sqrt(values[k])
        sign = 1 if any(abs(r.whitened - p) < 1e-6 and abs(p) > 1e-3 for r in own for (v, _), p in zip(used, plain, strict=True) if v == r.vec_id and v is not None) else -1
        want = sorted(((v, int(((n * row - s) ** 2).sum()), sign * p) for (v, _), row, p in zip(used, x, plain, strict=True)), key=lambda r: (repr(r[0]), r[1], r[2]))
        for r, (v, deviation, p) in zip(own, want, strict=True):
            assert (r.vec_id, r.n, r.deviation) == (v, n, deviation) and abs(r.whitened - p) < 1e-8
            assert abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_equals_dense(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 30)) * np.linspace(2, 0.2, 30)
    _check(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(x)])


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.standard_normal(3) * (1, 0.5, 0.1)], None) for i in range(40)]
    _check(spark, rows + [(7, [9.0, 1.0, 1.0], 1)] * 3 + [(None, [1.0], 1), (None, None, 1), (50, [float("nan"), 1.0, 1.0], 1), (51, [None], 1), (52, [], 1)])


def test_whitening_without_spread(spark):
    assert whitening.whiten(_table(spark, [])).count() == 0
    assert whitening.whiten(_table(spark, [(1, None, 1)])).count() == 0
    assert whitening.whiten(_table(spark, [(1, [1.0, 2.0], 1)] * 4)).count() == 0
    line = whitening.whiten(_table(spark, [(i, [float(i), 2.0 * i, 0.0], 1) for i in range(9)])).collect()
    assert len(line) == 9 and max(abs(r.explained - 1) for r in line) < 1e-12


def test_jacobi_davidson_restarts(monkeypatch):
    monkeypatch.setattr(whitening, "BASIS", 4)
    rng = np.random.default_rng(6)
    a = rng.standard_normal((900, 120)) * np.linspace(3, 1, 120)
    widest, v = 0, a.T @ a / 900

    def product(u):
        nonlocal widest
        widest = max(widest, u.shape[1])
        return v @ u

    values, axes, worst = whitening.jacobi_davidson(product, 120, 6)
    assert widest <= 12 and worst <= whitening.PRECISE * values[0]
    assert np.abs(values / np.linalg.eigvalsh(v)[::-1][:6] - 1).max() < 1e-12 and np.abs(axes.T @ axes - np.eye(6)).max() < 1e-12
    b = rng.standard_normal((120, 3))
    assert np.abs(v @ whitening.minres(lambda t: v @ t, b, 300, 1e-13) - b).max() < 1e-8
