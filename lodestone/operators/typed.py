"""Walks, distances and shortest paths over relations between kinds of nodes.

A node is a long key of its kind, so a hop joins only the relations that its kind has, and which relations a walk took is known without
being carried along. Nodes get their names, the kind before the key, at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.storage import fresh_folder

#: Rows that one task joins or groups, rows that are sent to every task instead.
TASK_ROWS, FEW = 1 << 20, 1 << 14


class Relation(NamedTuple):
    """Edges (src, dst, both long) of one name, each from a node of the kind src to one of the kind dst; null ends are no edges."""

    name: str
    src: str
    dst: str
    rows: DataFrame


class _Step(NamedTuple):
    """One relation, taken ahead or back, as rows (at, to); size is their number, spread their mean number at a node."""

    relation: int
    name: str
    ahead: bool
    kind: str
    rows: DataFrame
    size: int
    spread: float


def _steps(relations: list[Relation]) -> dict[str, list[_Step]]:
    """The steps that lead on from each kind."""
    found: dict[str, list[_Step]] = {}
    for k, r in enumerate(relations):
        rows = r.rows.selectExpr("CAST(src AS BIGINT) AS src", "CAST(dst AS BIGINT) AS dst").where("src IS NOT NULL AND dst IS NOT NULL")
        size, left, right = rows.agg(F.count(F.lit(1)), F.approx_count_distinct("src"), F.approx_count_distinct("dst")).first()
        found.setdefault(r.src, []).append(_Step(k, r.name, True, r.dst, rows.toDF("at", "to"), size, size / max(left, 1)))
        back = rows.where("src <> dst") if r.src == r.dst else rows  # a loop is walked once
        found.setdefault(r.dst, []).append(_Step(k, r.name, False, r.src, back.select(F.col("dst").alias("at"), F.col("src").alias("to")), size, size / max(right, 1)))
    return found


def _tasks(rows: float) -> int:
    return 1 + int(rows) // TASK_ROWS


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    return kept, kept.count()


def _grown(front: DataFrame, rows: int, node: str, step: _Step, to: str) -> DataFrame:
    """front with one more column: the other end of each edge of a step; repeated edges count once."""
    tasks = _tasks(max(rows, step.size))
    if rows <= FEW:
        return step.rows.join(F.broadcast(front), F.col("at") == F.col(node)).select(*front.columns, F.col("to").alias(to)).repartition(_tasks(rows * step.spread), node, to).distinct()
    edges = step.rows.repartition(tasks, "at").distinct()
    return front.repartition(tasks, node).join(edges, F.col(node) == F.col("at")).select(*front.columns, F.col("to").alias(to))


def _named(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind), F.col(key).cast("string"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _walks(steps: dict[str, list[_Step]], anchors: DataFrame, kind: str, depth: int, once: bool) -> Iterator[list[tuple]]:
    """For each number of hops the walks of that length by the steps they take: (steps, kind of the end, rows n0, n1, ..., their estimated number).

    once leaves out walks that use an edge twice. All but the longest are written and read again.
    """
    start = anchors.select(F.col("anchor").cast("long").alias("n0")).where("n0 IS NOT NULL").distinct()
    fronts = [((), kind, *_kept(start, "walks"))]
    for hop in range(1, depth + 1):
        grown = []
        for taken, at, front, rows in fronts:
            for step in steps.get(at, ()) if rows else ():
                df = _grown(front, rows, f"n{hop - 1}", step, f"n{hop}")
                for k, before in enumerate(taken):
                    if once and before.relation == step.relation:
                        pair = (f"n{k}", f"n{k + 1}") if before.ahead == step.ahead else (f"n{k + 1}", f"n{k}")
                        df = df.where((F.col(f"n{hop - 1}") != F.col(pair[0])) | (F.col(f"n{hop}") != F.col(pair[1])))
                df, many = _kept(df, "walks") if hop < depth else (df, rows * step.spread)
                grown.append(((*taken, step), step.kind, df, many))
        fronts = grown
        yield fronts


def weighed(relations: list[Relation], anchors: DataFrame, kind: str, depth: int, weights: dict[str, float], default: float, per_hop: float) -> DataFrame:
    """anchor, node, hops (the least), paths and weight: all walks of 1 to depth edges, either way, from an anchor of a kind, that use no edge twice, by their last node.

    A walk weighs the product of the weights of its relations, times per_hop for each hop; the anchor itself is left out. Rows are
    dealt to as many tasks as the walks need and counted there.
    """
    ends: dict[str, list[tuple[DataFrame, float]]] = {}
    for hop, fronts in enumerate(_walks(_steps(relations), anchors, kind, depth, True), 1):
        for taken, at, df, rows in fronts:
            weight = 1.0
            for step in taken:
                weight *= weights.get(step.name, default) * per_hop
            found = df.where(F.col("n0") != F.col(f"n{hop}")) if at == kind else df
            ends.setdefault(at, []).append((found.select("n0", F.col(f"n{hop}").alias("n"), F.lit(hop).alias("hops"), F.lit(weight).alias("weight")), rows))
    out = []
    for at, frames in ends.items():
        rows = _union([df for df, _ in frames]).repartition(_tasks(sum(n for _, n in frames)), "n0", "n")
        summed = rows.groupBy("n0", "n").agg(F.min("hops").alias("hops"), F.count(F.lit(1)).alias("paths"), F.sum("weight").alias("weight"))
        out.append(summed.select(_named(kind, "n0").alias("anchor"), _named(at, "n").alias("node"), "hops", "paths", "weight"))
    if out:
        return _union(out)
    return anchors.sparkSession.createDataFrame([], "anchor string, node string, hops int, paths long, weight double")


def reach(relations: list[Relation], anchors: DataFrame, kind: str, hops: int) -> DataFrame:
    """anchor, node, hops: each node within so many hops, either way, of an anchor of a kind, at its least distance; an anchor is not a row of its own."""
    steps = _steps(relations)
    start = anchors.select(F.col("anchor").cast("long").alias("a")).where("a IS NOT NULL").distinct().select("a", F.col("a").alias("n"))
    fronts = {kind: _kept(start, "reach")}
    seen: dict[str, list[tuple[DataFrame, int, int]]] = {kind: [(*fronts[kind], 0)]}
    for hop in range(1, hops + 1):
        grown: dict[str, list[tuple[DataFrame, float]]] = {}
        for at, (front, rows) in fronts.items():
            for step in steps.get(at, ()) if rows else ():
                grown.setdefault(step.kind, []).append((_grown(front, rows, "n", step, "to").select("a", F.col("to").alias("n")), rows * step.spread))
        fronts = {}
        for at, frames in grown.items():
            before = seen.get(at, [])
            tasks = _tasks(sum(n for _, n in frames) + sum(n for _, n, _ in before))
            level = _union([df for df, _ in frames]).repartition(tasks, "a", "n").distinct()
            if before:
                level = level.join(_union([df for df, _, _ in before]).repartition(tasks, "a", "n"), ["a", "n"], "left_anti")
            fronts[at] = _kept(level, "reach")
        for at, level in fronts.items():
            seen.setdefault(at, []).append((*level, hop))
    rows = [df.select(_named(kind, "a").alias("anchor"), _named(at, "n").alias("node"), F.lit(hop).alias("hops")) for at, levels in seen.items() for df, _, hop in levels if hop]
    return _union(rows) if rows else anchors.sparkSession.createDataFrame([], "anchor string, node string, hops int")


def shortest(relations: list[Relation], pairs: DataFrame, kinds: tuple[str, str], most: int) -> DataFrame:
    """a, b, hops, path, rels: the shortest path of each pair of nodes of two kinds within so many edges, either way; of equal ones the first by its nodes, then relations.

    Walks from a, by the relations that can still lead to the kind of b, meet the pairs, and what is then left is one look
    whether their last edge is there. Pairs of one node have a path without edges, pairs out of reach and null ends no row.
    """
    one, other = kinds
    steps = _steps(relations)
    near = [{other}]  # kinds from which b is so many steps away
    for _ in range(most):
        near.append({at for at, ways in steps.items() for step in ways if step.kind in near[-1]})
    asked, _ = _kept(pairs.selectExpr("CAST(a AS BIGINT) AS a", "CAST(b AS BIGINT) AS b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "asked")
    out = []

    def rows(found: DataFrame, hops: int) -> DataFrame:
        best = found.groupBy("a", "b").agg(F.min(F.struct("path", "rels")).alias("t"))
        return best.select(_named(one, "a").alias("a"), _named(other, "b").alias("b"), F.lit(hops).alias("hops"), F.col("t.path").alias("path"), F.col("t.rels").alias("rels"), F.col("a").alias("x"), F.col("b").alias("y"))

    if one == other:
        same = asked.where("a = b").select("a", "b", F.array(_named(one, "a")).alias("path"), F.array().cast("array<string>").alias("rels"))
        out.append(rows(same, 0))
        asked = asked.where("a <> b")
    for hops in range(1, most + 1):
        if one not in near[hops]:
            continue
        left, many = _kept(asked, "asked")
        fronts = [((), one, *_kept(left.select(F.col("a").alias("n0")).distinct(), "front"))]
        for hop in range(1, hops):
            grown = []
            for taken, at, front, n in fronts:
                for step in (s for s in steps.get(at, ()) if n and s.kind in near[hops - hop]):
                    grown.append(((*taken, step), step.kind, *_kept(_grown(front, n, f"n{hop - 1}", step, f"n{hop}"), "front")))
            fronts = grown
        met = []
        for taken, at, front, n in fronts:
            for last in (s for s in steps.get(at, ()) if n and s.kind == other):
                tasks = _tasks(max(n, many))
                ways = front.repartition(tasks, "n0").join(left.repartition(tasks, "a"), F.col("n0") == F.col("a"))
                tasks = _tasks(max(last.size, n * many / max(left.select("a").distinct().count(), 1)))
                ends = last.rows.repartition(tasks, "at", "to")
                ways = ways.repartition(tasks, f"n{hops - 1}", "b").join(ends, (F.col(f"n{hops - 1}") == F.col("at")) & (F.col("b") == F.col("to")), "left_semi")
                names = [_named(one, "a"), *(_named(step.kind, f"n{k}") for k, step in enumerate(taken, 1)), _named(other, "b")]
                met.append(ways.select("a", "b", F.array(*names).alias("path"), F.array(*(F.lit(step.name) for step in (*taken, last))).alias("rels")))
        if met:
            found, _ = _kept(rows(_union(met), hops), "found")
            out.append(found)
            asked = left.join(found.select(F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"], "left_anti")
    if not out:
        return pairs.sparkSession.createDataFrame([], "a string, b string, hops int, path array<string>, rels array<string>")
    return _union(out).drop("x", "y")
