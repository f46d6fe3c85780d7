"""Leiden communities in supersteps: local moves, refinement inside each community, and the graph of what was refined, level by level.

A superstep is a few joins and partial sums over edges, whatever the degree of a node: no neighbourhood is collected.

Local moves: half of the nodes, by a seeded hash that changes each step, go where modularity gains most. If a step as a whole does not gain,
since neighbours swapped, it is made again with moves that touch each community at most once; their gains add up exactly, so
modularity rises with every step and the moves end. No number of steps or levels is fixed.

Refinement: inside a community every node starts alone. Nodes that are alone and well connected to the community join a well-connected
part of it that gains, drawn with chances that rise with the gain; in each step a seeded coin says who may move, and nobody joins a node that
may leave. So every refined part is connected. The parts are the nodes of the next graph, which starts from the communities that the
local moves have found; it ends when each community is a single node.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.components import components
from lodestone.plans import links
from lodestone.sources.storage import fresh_folder

#: Least gain of a move, as a part of all weight; spread of the drawn choices; least members of a community that is not misc.
GAIN, THETA, MISC = 1e-12, 0.01, 3
#: Resolution and seed of the partition.
GAMMA, SEED = 1.0, 42


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _counted(df: DataFrame, name: str, *counts: Column) -> tuple[DataFrame, tuple]:
    """df as a table in the shared folder, and aggregates over it that are taken while it is written."""
    seen = Observation()
    kept = _kept(df.observe(seen, *(c.alias(f"c{k}") for k, c in enumerate(counts))), name)
    return kept, tuple(seen.get[f"c{k}"] for k in range(len(counts)))


def _coin(seed: int, step: int, node: str = "node") -> Column:
    return F.pmod(F.xxhash64(node, F.lit(seed), F.lit(step)), F.lit(2)) == 0


class _Graph:
    """Edges (u, v, w) in both directions, loops once, and the sum of all weights."""

    def __init__(self, edges: DataFrame, total: float, gamma: float, seed: int) -> None:
        self.edges, self.total, self.gamma, self.seed = edges, total, gamma, seed

    def wishes(self, state: DataFrame) -> DataFrame:
        """node, k, c of state, the best move of each node and what it gains over staying; ties to the least name."""
        sums = state.groupBy(F.col("c").alias("g")).agg(F.sum("k").alias("s"))
        there = state.select(F.col("node").alias("v"), F.col("c").alias("to"))
        near = self.edges.where("u <> v").join(there, "v").groupBy(F.col("u").alias("node"), "to").agg(F.sum("w").alias("w"))
        stays = state.select("node", F.col("c").alias("to"), F.lit(0.0).alias("w"))
        options = near.unionByName(stays).groupBy("node", "to").agg(F.sum("w").alias("w")).join(state, "node").join(sums, F.col("to") == F.col("g"))
        own = F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
        scored = options.select("node", "k", "c", "to", (F.col("w") - self.gamma * F.col("k") * (F.col("s") - own) / self.total).alias("gain"))
        best = scored.groupBy("node", "k", "c").agg(F.max(F.struct("gain", (-F.col("to")).alias("minus"))).alias("b"), F.max(F.when(F.col("to") == F.col("c"), F.col("gain"))).alias("stay"))
        return best.select("node", "k", "c", (-F.col("b.minus")).alias("to"), (F.col("b.gain") - F.col("stay")).alias("delta"))

    def apart(self, wishes: DataFrame) -> DataFrame:
        """Moves of which no two touch one community: each that is the best of both communities it touches."""
        order = F.struct("delta", F.xxhash64("node").alias("h"), "node")
        touched = wishes.select("node", F.explode(F.array("c", "to")).alias("g"), order.alias("o")).groupBy("g").agg(F.max("o").alias("o"))
        chosen = touched.groupBy(F.col("o.node").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        return wishes.join(chosen, "node", "left_semi")

    def quality(self, state: DataFrame) -> float:
        """Modularity of the communities c of state."""
        of = state.select("node", "c")
        inside = self.edges.join(of.toDF("u", "a"), "u").join(of.toDF("v", "b"), "v").where("a = b").agg(F.sum("w").alias("i"))
        spread = state.groupBy("c").agg(F.sum("k").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
        i, q = inside.crossJoin(spread).first()  # two single rows
        return (i or 0.0) / self.total - self.gamma * q / self.total**2

    def moved(self, state: DataFrame, step: int) -> tuple[DataFrame, int]:
        """state after local moves, until no node wishes to move; the number of steps so far.

        A step is taken as it is while fewer nodes than ever wish to move, which cannot go on for ever; any other must raise modularity.
        """
        least, quality = None, None
        gains = F.col("delta") > GAIN * self.total
        while True:
            scored, (wanted,) = _counted(self.wishes(state), "wishes", F.count(F.when(gains, 1)))
            if not wanted:
                return _kept(state, "state"), step
            tried = scored.select("node", "k", F.when(gains & _coin(self.seed, step), F.col("to")).otherwise(F.col("c")).alias("c"))
            step += 1
            if least is None or wanted < least:
                least, quality, state = wanted, None, tried
                continue
            quality = self.quality(state) if quality is None else quality
            gained = self.quality(tried)
            if gained <= quality:
                chosen = self.apart(scored.where(gains)).select("node", F.col("to").alias("goes"))
                tried = _kept(scored.join(chosen, "node", "left").select("node", "k", F.coalesce("goes", "c").alias("c")), "state")
                gained = self.quality(tried)
            state, quality = tried, gained

    def refined(self, state: DataFrame, step: int) -> tuple[DataFrame, int]:
        """node, k, c and part r of each node; the number of steps so far."""
        of = state.select("node", "c")
        inner = _kept(self.edges.where("u <> v").join(of.toDF("u", "c"), "u").join(of.toDF("v", "d"), "v").where("c = d").select("u", "v", "w"), "inner")
        whole = state.groupBy("c").agg(F.sum("k").alias("kc"))
        state = state.withColumn("r", F.col("node"))
        while True:
            part = state.select("node", "r")
            crossing = inner.join(part.toDF("u", "r"), "u").join(part.toDF("v", "to"), "v").where("r <> to").groupBy("u", "r", "to").agg(F.sum("w").alias("w"))
            out = crossing.groupBy("r").agg(F.sum("w").alias("out"))
            parts = state.groupBy("r", "c").agg(F.sum("k").alias("kr"), F.count(F.lit(1)).alias("size")).join(whole, "c").join(out, "r")
            parts = parts.where(F.col("out") >= self.gamma * F.col("kr") * (F.col("kc") - F.col("kr")) / self.total).select("r", "kr", "size")
            alone = parts.where("size = 1").select("r", F.col("kr").alias("k"))
            options = crossing.join(alone, "r").join(parts.toDF("to", "kt", "size"), "to")
            gain = F.col("w") - self.gamma * F.col("k") * F.col("kt") / self.total
            uniform = (F.pmod(F.xxhash64("u", "to", F.lit(self.seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
            drawn = options.withColumn("gain", gain).where(F.col("gain") > GAIN * self.total).withColumn("draw", F.col("gain") / (THETA * F.col("k")) - F.log(-F.log(uniform)))
            free = _coin(self.seed, step, "u") & ~((F.col("size") == 1) & _coin(self.seed, step, "to"))
            moves = drawn.groupBy(F.col("u").alias("node")).agg(F.max_by(F.when(free, F.col("to")), F.when(free, F.col("draw"))).alias("to")).withColumn("wants", F.lit(True))
            step += 1
            joined = state.join(moves, "node", "left").select("node", "k", "c", F.coalesce("to", "r").alias("r"), "wants")
            after, (wanted,) = _counted(joined, "parts", F.count("wants"))
            state = after.drop("wants")
            if not wanted:
                return state, step


def levels(pairs: DataFrame, gamma: float = GAMMA, seed: int = SEED) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """Nested communities of the undirected graph of pairs (u, v, w): rows (node, level, community), and (level, communities, modularity).

    The last level is the partition. Every community is connected and named by its least node. Repeated and reversed pairs add up, pairs
    without both ends or with a weight that is null or not positive are left out, self-pairs count once; no pairs give no levels.
    One seed gives one result, whatever the partitioning.
    """
    ends = pairs.where("u IS NOT NULL AND v IS NOT NULL AND w > 0").select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"), F.col("w").cast("double").alias("w"))
    # sums of decimals do not depend on their order
    one = ends.groupBy("u", "v").agg(F.sum(F.col("w").cast("decimal(28,12)")).cast("double").alias("w"))
    # both directions from one pass, so the pairs are made once
    ways = F.when(F.col("u") == F.col("v"), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    edges = _kept(one.select(F.explode(ways).alias("e"), "w").select("e.u", "e.v", "w"), "edges")
    total = edges.agg(F.sum("w")).first()[0]
    if not total:
        return edges.select(F.col("u").alias("node"), F.lit(0).alias("level"), F.col("v").alias("community")).limit(0), []
    state = _kept(edges.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")).withColumn("c", F.col("node")), "state")
    names = state.select("node", F.col("node").alias("top"))
    found, told, step = None, [], 0
    while True:
        graph = _Graph(edges, total, gamma, seed)
        state, step = graph.moved(state, step)
        nodes, groups = state.agg(F.count(F.lit(1)), F.count_distinct("c")).first()
        if groups == nodes:
            break
        parts, step = graph.refined(state, step)
        if parts.select("r").distinct().count() == nodes:  # no part gains by itself: communities as far as they are connected
            of = state.select("node", "c")
            inner = edges.join(of.toDF("u", "a"), "u").join(of.toDF("v", "b"), "v").where("a = b")
            parts = state.join(components(inner, "u", "v"), "node", "left").select("node", "k", "c", F.coalesce("component", "node").alias("r"))
        parts = _kept(parts, "parts")
        of = parts.select("node", "r")
        edges = _kept(edges.join(of.toDF("u", "a"), "u").join(of.toDF("v", "b"), "v").groupBy("a", "b").agg(F.sum("w").alias("w")).toDF("u", "v", "w"), "edges")
        state = _kept(parts.groupBy(F.col("r").alias("node")).agg(F.sum("k").alias("k"), F.min("c").alias("c")), "state")
        names = _kept(names.join(of.toDF("top", "r"), "top").select("node", F.col("r").alias("top")), "names")
        level = len(told)
        told.append((level, state.count(), round(_Graph(edges, total, gamma, seed).quality(state.withColumn("c", F.col("node"))), 6)))
        least = names.groupBy("top").agg(F.min("node").alias("community"))
        rows = names.join(least, "top").select("node", F.lit(level).alias("level"), "community")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found, told = names.select("node", F.lit(0).alias("level"), F.col("top").alias("community")), [(0, nodes, round(graph.quality(state), 6))]
    return found, told


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.links(spark, sf_dir).where("score >= 0.55").selectExpr("a_id AS u", "b_id AS v", "score AS w")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(levels(_graph(spark, sf_dir))[1], "level int, communities long, modularity double")


def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per level and community: members, the community above, whether it is too small to report, and a digest of its members that does not depend on their order."""
    rows = levels(_graph(spark, sf_dir))[0]
    above = rows.select("node", (F.col("level") - 1).alias("level"), F.col("community").alias("parent"))
    member = F.conv(F.substring(F.sha1(F.col("node").cast("string")), 1, 12), 16, 10).cast("decimal(20,0)")
    groups = rows.join(above, ["node", "level"], "left").groupBy("level", "community").agg(F.count(F.lit(1)).alias("members"), F.min("parent").alias("parent"), F.sha1(F.sum(member).cast("string")).alias("member_hash"))
    return groups.withColumn("misc", F.col("members") < MISC)


def member_digest(nodes: list[int]) -> str:
    """The member_hash of a list of nodes."""
    return hashlib.sha1(str(sum(int(hashlib.sha1(str(n).encode()).hexdigest()[:12], 16) for n in nodes)).encode()).hexdigest()


QUERIES = {"grf13_levels": lambda spark, sf_dir: levels(_graph(spark, sf_dir))[0], "grf13_modularity": summary, "grf15_communities": partition}
ORACLES: dict[str, str] = {}
