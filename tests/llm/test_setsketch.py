"""SetSketch near-duplicates against brute force, and the sketch against what it promises."""

import random

import numpy as np
import pytest

from lodestone.llm import setsketch
from lodestone.llm.common import text_buffer

SCHEMA = "doc_id long, text string, n_shingles string, cid string"


def _sets(texts):
    out = []
    for t in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\v\f\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        out.append({tuple(words)} if len(words) == 1 else set(zip(words, words[1:], strict=False)))
    return out


def _plain(rows):
    """All pairs, then the least id that is reachable."""
    sets, at = _sets([t for _, t in rows]), list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                at[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        component = least.get(root(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), component, doc == component))
    return out


def _run(spark, rows):
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(3)
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in setsketch.dedup(docs).collect()]


def _edited(rng, words, share):
    return " ".join(rng.choice(("new", "odd", f"x{rng.randrange(999)}")) if rng.random() < share else w for w in words)


def _groups(seed, groups, copies, size):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        words = [f"{g}w{rng.randrange(400)}" for _ in range(rng.randrange(2, size))]
        rows += [_edited(rng, words, rng.choice((0, 0.02, 0.05, 0.08, 0.12))) for _ in range(copies)]
    rng.shuffle(rows)
    return list(enumerate(rows))


ODD = [(None, "one two three"), (None, "ONE two\tthree"), (7, "one\x0btwo three"), (8, None), (8, ""), (None, None), (9, "alone"), (10, "Alone"), (11, " \n"), (11, "alone alone"), (None, "nobody else"), (12, "a b " * 30_000), (13, "a b " * 20_000 + "c"), (14, "  É x"), (14, "  É x")]


@pytest.mark.parametrize("rows", [_groups(1, 25, 12, 120), _groups(2, 2, 150, 60), ODD, [(5, "x")], []], ids=["groups", "large", "odd", "one", "empty"])
def test_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(setsketch, "TOP", 1)
    monkeypatch.setattr(setsketch, "GROWTH", 3)
    monkeypatch.setattr(setsketch, "BLOCK", 16)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(_run(spark, rows), key=key) == sorted(_plain(rows), key=key)


def _registers(*texts):
    import pyarrow as pa

    data, offsets = text_buffer(pa.array(texts))
    return setsketch.registers(*setsketch.shingle_rows(data, offsets))


def test_registers_merge():
    rng = random.Random(3)
    left, right = (" ".join(f"w{rng.randrange(300)}" for _ in range(200)) for _ in range(2))
    middle = f"{left.split()[-1]} {right.split()[0]}"
    x, y, m, both = _registers(left, right, middle, f"{left} {right}")
    assert (setsketch.merge(x, y, m) == both).all() and (setsketch.merge(x, x) == x).all()


@pytest.mark.parametrize(("n", "m", "common"), [(1000, 1000, 889), (400, 350, 300), (3000, 2000, 500), (5, 5, 5), (60, 60, 0)])
def test_joint_estimates(n, m, common):
    rng, estimates, errors, equal = np.random.default_rng(n), [], [], []
    for _ in range(60):
        g = rng.integers(0, 2**63, n + m - common).astype(np.uint64)
        x, y = (setsketch.registers(s, np.array([0, len(s)])) for s in (np.sort(g[:n]), np.sort(g[n - common :])))
        j, far = setsketch.joint(x, y, np.array([n]), np.array([m]))
        estimates.append(j[0])
        errors.append(far[0])
        equal.append((x == y).mean())
    true = common / (n + m - common)
    assert abs(np.mean(estimates) - true) < 0.02 and np.mean(equal) > true - 0.02
    assert true < 0.8 or max(errors) < setsketch.ERRORS
    assert true > 0.3 or min(errors) > setsketch.ERRORS


def test_parity_never_rules_out_a_link():
    rng = np.random.default_rng(8)
    for n, differ in ((9, 1), (90, 10), (450, 50), (1023, 100), (1025, 100)):
        g = rng.integers(0, 2**63, n + differ).astype(np.uint64)
        x, y = np.sort(g[:n]), np.sort(g[differ:])
        import pyarrow as pa

        size = np.array([len(x), len(y)])
        a, b, more = setsketch.nearest(size, np.array([1, 2]), np.array([1, 2]), pa.array([setsketch.parity(x), setsketch.parity(y)]), np.array([0]), np.array([1]), 5)
        links = 100 * (n - differ) >= 80 * (n + differ)
        assert (list(a) == [0] and list(b) == [1]) or not links
        assert not more


def test_bands_miss_nothing():
    chance = (1 - 0.8**setsketch.BAND) ** setsketch.BANDS
    assert chance < 1e-9
