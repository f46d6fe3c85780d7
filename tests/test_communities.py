"""Leiden communities: connected, nested, reproducible, and of a modularity that a plain single-machine search does not beat."""

import random

import pytest

from lodestone.operators import communities

SCHEMA = "u long, v long, w double"


def _rings():
    return [(10 * g + a, 10 * g + b, 1.0) for g in range(8) for a in range(6) for b in range(a)] + [(10 * g, 10 * ((g + 1) % 8) + 1, 1.0) for g in range(8)]


def _planted(seed):
    rng = random.Random(seed)
    return [(a, b, rng.choice((0.5, 1.0))) for a in range(60) for b in range(a) if rng.random() < (0.5 if a // 12 == b // 12 else 0.04)]


def _sparse():
    rng = random.Random(9)
    return [(rng.randrange(70), rng.randrange(70), 1.0) for _ in range(120)]


GRAPHS = {"rings": _rings(), "planted": _planted(3), "sparse": _sparse()}


def _weights(pairs):
    near = {}
    for a, b, w in pairs:
        for x, y in ((a, b), (b, a)) if a != b else ((a, a),):
            near.setdefault(x, {}).setdefault(y, 0.0)
            near[x][y] += w
    return near


def _modularity(near, of, gamma=1.0):
    total = sum(sum(n.values()) for n in near.values())
    sums = {}
    for a in near:
        sums[of[a]] = sums.get(of[a], 0) + sum(near[a].values())
    return sum(w for a in near for b, w in near[a].items() if of[a] == of[b]) / total - gamma * sum(s * s for s in sums.values()) / total**2


def _plain(near):
    """Greedy moves of single nodes and of whole communities, in order, until nothing gains."""
    of = {a: a for a in near}
    best, gained = _modularity(near, of), True
    while gained:
        gained = False
        for group in [[a] for a in near] + [[a for a in near if of[a] == c] for c in set(of.values())]:
            for to in {of[b] for a in group for b in near[a]} - {of[group[0]]} if len({of[a] for a in group}) == 1 and group else ():
                tried = of | dict.fromkeys(group, to)
                q = _modularity(near, tried)
                if q > best + 1e-9:
                    of, best, gained = tried, q, True
    return best


def _connected(near, members):
    seen, todo = set(), [next(iter(members))]
    while todo:
        a = todo.pop()
        if a not in seen:
            seen.add(a)
            todo += [b for b in near[a] if b in members]
    return seen == members


@pytest.mark.parametrize("name", GRAPHS)
def test_levels(spark, name):
    near = _weights(GRAPHS[name])
    rows, told = communities.levels(spark.createDataFrame(GRAPHS[name], SCHEMA))
    rows = rows.collect()
    before = None
    for level, count, quality in told:
        of = {r.node: r.community for r in rows if r.level == level}
        groups = {}
        for node, c in of.items():
            groups.setdefault(c, set()).add(node)
        assert set(of) == set(near) and len(groups) == count and abs(_modularity(near, of) - quality) < 1e-6
        assert all(c == min(g) and _connected(near, g) for c, g in groups.items())
        assert before is None or all(len({of[n] for n in g}) == 1 for g in before)
        before = groups.values()
    assert told[-1][2] >= _plain(near) - (0.005 if name == "sparse" else 1e-6)
    if name == "rings":
        assert sorted(map(len, before)) == [6] * 8


def test_partitioning_and_gamma(spark):
    small = [p for p in _rings() if p[0] < 20 and p[1] < 20]
    found, told = communities.levels(spark.createDataFrame(small, SCHEMA).repartition(7), gamma=0.01)
    again, _ = communities.levels(spark.createDataFrame(small[::-1], SCHEMA).coalesce(1), gamma=0.01)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect())) and told[-1][1] == 1


def test_odd_pairs(spark):
    rows, told = communities.levels(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, None, 1.0), (4, 5, None), (6, 7, 0.0), (8, 8, 2.0), (9, 10, -1.0)], SCHEMA))
    assert sorted((r.node, r.community) for r in rows.collect() if r.level == told[-1][0]) == [(1, 1), (2, 1), (8, 8)]
    rows, told = communities.levels(spark.createDataFrame([], SCHEMA))
    assert rows.count() == 0 and told == []
    rows, told = communities.levels(spark.createDataFrame([(5, 5, 1.0)], SCHEMA))
    assert [tuple(r) for r in rows.collect()] == [(5, 0, 5)] and told[0][1] == 1


def test_pairs_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    pairs = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (4, 4, 2.0)]
    found, _ = communities.levels(spark.createDataFrame(pairs, SCHEMA).mapInPandas(count, SCHEMA))
    assert sorted((r.node, r.community) for r in found.collect() if r.level == 0) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert made.value == len(pairs)
