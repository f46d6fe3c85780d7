"""Walks that carry their path, weights of paths summed up by node, and shortest paths with their nodes and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import typed
from lodestone.sources.storage import fresh_folder

#: What a hop costs, weight of a relation that the table does not name, hops at most of a shortest path.
PER_HOP, DEFAULT, MOST = 0.55, 0.5, 3
#: Weights of the relations between customers, orders, parts, suppliers and nations.
WEIGHTS = {"PLACED": 1.0, "CONTAINS": 0.8, "SUPPLIED_BY": 0.6, "LIVES_IN": 0.3}


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _both_ways(edges: DataFrame) -> DataFrame:
    known = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", "rel").distinct()
    named = known.withColumn("edge", F.xxhash64("src", "dst", "rel"))
    return named.unionByName(named.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "edge"))


def walks(edges: DataFrame, anchors: DataFrame, depth: int, weights: dict[str, float] | None = None) -> DataFrame:
    """anchor, node, hops, path, rels, weight: every walk of 1 to depth edges (src, dst, rel) from an anchor, either way, that uses no edge twice.

    weight is the product of the weights of its relations, times PER_HOP for each hop. Repeated edges and anchors count once, null
    ends are no edges, a null rel has the DEFAULT weight; a walk may come back to its anchor. Each length is written and read again.
    """
    table = {k: float(v) for k, v in (WEIGHTS if weights is None else weights).items()}
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    own = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("rel", F.lit(""))), F.lit(DEFAULT)) if pairs else F.lit(DEFAULT)
    around = _kept(_both_ways(edges).withColumn("w", own * PER_HOP), "edges")
    start = anchors.where("anchor IS NOT NULL").select("anchor").distinct()
    front = start.select("anchor", F.col("anchor").alias("node"), F.lit(0).alias("hops"), F.array("anchor").alias("path"), F.array().cast("array<string>").alias("rels"), F.array().cast("array<long>").alias("used"), F.lit(1.0).alias("weight"))
    found = None
    for _ in range(depth):
        step = front.join(around, F.col("node") == F.col("src")).where(~F.array_contains("used", F.col("edge")))
        grown = step.select("anchor", F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("rels", F.col("rel")).alias("rels"), F.array_append("used", F.col("edge")).alias("used"), (F.col("weight") * F.col("w")).alias("weight"))
        front = _kept(grown, "walks")
        found = front if found is None else found.unionByName(front)
    return found.drop("used")


def weighed(found: DataFrame) -> DataFrame:
    """anchor, node, hops (the least), paths and the sum of their weights; the anchor itself is left out."""
    return found.where("node <> anchor").groupBy("anchor", "node").agg(F.min("hops").alias("hops"), F.count(F.lit(1)).alias("paths"), F.sum("weight").alias("weight"))


def shortest(pairs: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """a, b, hops, path, rels: the shortest path of each pair within so many edges, either way; of equal ones the first by its nodes, then relations.

    Searched from both ends at once, a half of the hops from each, with one path kept for each end and node. Pairs of one node
    have a path without edges; pairs out of reach and null ends have no row; repeated pairs count once.
    """
    around = _kept(_both_ways(edges), "edges")
    asked = pairs.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()

    def sides(of: str, hops: int, ahead: bool) -> DataFrame:
        level = asked.select(F.col(of).alias("end")).distinct().select("end", F.col("end").alias("node"), F.array("end").alias("path"), F.array().cast("array<string>").alias("rels"), F.lit(0).alias("hops"))
        seen = level
        for h in range(1, hops + 1):
            step = level.join(around, F.col("node") == F.col("src"))
            path = F.array_append("path", F.col("dst")) if ahead else F.array_prepend("path", F.col("dst"))
            rels = F.array_append("rels", F.col("rel")) if ahead else F.array_prepend("rels", F.col("rel"))
            best = step.select("end", F.col("dst").alias("node"), path.alias("path"), rels.alias("rels")).groupBy("end", "node").agg(F.min(F.struct("path", "rels")).alias("t"))
            fresh = best.join(seen.select("end", "node"), ["end", "node"], "left_anti")
            level = _kept(fresh.select("end", "node", "t.path", "t.rels", F.lit(h).alias("hops")), "level")
            seen = seen.unionByName(level)
        return seen

    half = -(-most // 2)
    front = sides("a", half, True).select(F.col("end").alias("a"), "node", F.col("path").alias("p"), F.col("rels").alias("r"), F.col("hops").alias("h"))
    back = sides("b", most - half, False).select(F.col("end").alias("b"), "node", F.col("path").alias("q"), F.col("rels").alias("s"), F.col("hops").alias("k"))
    # a path of n edges is met after the first half of most, or at its end
    met = asked.join(front, "a").join(back, ["b", "node"]).where(F.col("h") == F.least(F.lit(half), F.col("h") + F.col("k")))
    whole = met.select("a", "b", (F.col("h") + F.col("k")).alias("hops"), F.concat("p", F.slice("q", 2, most + 1)).alias("path"), F.concat("r", "s").alias("rels"))
    best = whole.groupBy("a", "b").agg(F.min(F.struct("hops", "path", "rels")).alias("t"))
    return best.select("a", "b", F.col("t.hops").alias("hops"), F.col("t.path").alias("path"), F.col("t.rels").alias("rels"))


_EDGES = (
    ("orders", "concat('c', o_custkey)", "concat('o', o_orderkey)", "PLACED"),
    ("lineitem", "concat('o', l_orderkey)", "concat('p', l_partkey)", "CONTAINS"),
    ("lineitem", "concat('p', l_partkey)", "concat('s', l_suppkey)", "SUPPLIED_BY"),
)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders, parts and suppliers as one typed graph."""
    out = None
    for table, src, dst, rel in _EDGES:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"{src} AS src", f"{dst} AS dst", f"'{rel}' AS rel").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def relations(spark: SparkSession, sf_dir: str) -> list[typed.Relation]:
    """The same graph by relation, its nodes as keys of their kinds."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    return [
        typed.Relation("PLACED", "c", "o", orders.selectExpr("o_custkey AS src", "o_orderkey AS dst")),
        typed.Relation("CONTAINS", "o", "p", lines.selectExpr("l_orderkey AS src", "l_partkey AS dst")),
        typed.Relation("SUPPLIED_BY", "p", "s", lines.selectExpr("l_partkey AS src", "l_suppkey AS dst")),
    ]


def around_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies around one customer in 20, by the weight of all paths to it."""
    anchors = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 20 = 0").selectExpr("c_custkey AS anchor")
    found = typed.weighed(relations(spark, sf_dir), anchors, "c", 3, WEIGHTS, DEFAULT, PER_HOP)
    return found.select("anchor", "node", "hops", "paths", F.round("weight", 6).alias("weight"))


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How one order in 20 ties its customer to the suppliers of its parts."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    pairs = orders.where("o_orderkey % 20 = 0").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("o_custkey AS a", "l_suppkey AS b")
    found = typed.shortest(relations(spark, sf_dir), pairs, ("c", "s"), MOST)
    return found.select("a", "b", F.col("hops").cast("long").alias("hops"), F.array_join("path", ">").alias("path"), F.array_join("rels", ">").alias("rels"))


QUERIES = {"joi16_walks": around_customers, "top24_paths": explained}
_TWIN = "e AS (SELECT *, row_number() OVER () AS edge FROM (" + " UNION ALL ".join(f"SELECT DISTINCT {src} AS src, {dst} AS dst, '{rel}' AS rel FROM {table}" for table, src, dst, rel in _EDGES) + ") t), z AS (SELECT * FROM e UNION ALL SELECT dst, src, rel, edge FROM e)"
_CASE = "CASE rel " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items()) + f" ELSE {DEFAULT} END"
ORACLES = {
    "joi16_walks": f"""
WITH RECURSIVE {_TWIN},
w AS (SELECT 'c' || c_custkey AS anchor, 'c' || c_custkey AS node, 0 AS hops, CAST([] AS BIGINT[]) AS used, 1.0::DOUBLE AS weight FROM customer WHERE c_custkey % 20 = 0
  UNION ALL SELECT anchor, dst, hops + 1, list_append(used, edge), weight * {_CASE} * {PER_HOP} FROM w JOIN z ON z.src = w.node WHERE hops < 3 AND NOT list_contains(used, edge))
SELECT anchor, node, min(hops) AS hops, count(*) AS paths, round(sum(weight), 6) AS weight FROM w WHERE hops > 0 AND node <> anchor GROUP BY anchor, node""",
    # customer to order to part to supplier is the least there can be; of several the first
    "top24_paths": """
SELECT a, b, CAST(3 AS BIGINT) AS hops, a || '>' || o || '>' || p || '>' || b AS path, 'PLACED>CONTAINS>SUPPLIED_BY' AS rels FROM (
  SELECT DISTINCT 'c' || x.o_custkey AS a, 's' || y.l_suppkey AS b FROM orders x JOIN lineitem y ON y.l_orderkey = x.o_orderkey WHERE x.o_orderkey % 20 = 0) w
JOIN (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS o FROM orders) c USING (a)
JOIN (SELECT DISTINCT 'o' || l_orderkey AS o, 'p' || l_partkey AS p FROM lineitem) l USING (o)
JOIN (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS b FROM lineitem) s USING (p, b)
QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY o, p) = 1""",
}
