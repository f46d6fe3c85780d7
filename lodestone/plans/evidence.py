"""Queries over groups and evidence: ledgers, partitions, closure, recall, changed texts, match strength, seeded picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.components import components
from lodestone.plans import graph, resolution
from lodestone.plans.sql import query, register, twin

#: Score of a pair that a reviewer would call the same, members below which a group is misc, ranks that count as hits.
SAME, MISC, HITS = 0.65, 3, (1, 2, 3)
_KNN = graph._PAIRS["joi21_knn"]


def _recall(knn: str) -> str:
    hits = ", ".join(f"count(DISTINCT a_id) FILTER (WHERE rn <= {k} AND score >= {SAME}) AS hit_{k}" for k in HITS)
    return f"SELECT label, count(DISTINCT a_id) AS queries, {hits} FROM (SELECT a_id, score, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rn FROM ({knn}) k) r JOIN {{embeddings}} v ON v.vec_id = a_id GROUP BY label"


_BOTH = {
    "grf12_isolated": """
SELECT p_partkey, coalesce(degree, 0) AS degree FROM {part} LEFT JOIN (
  SELECT l_partkey, count(DISTINCT l_suppkey) AS degree FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY l_partkey) d ON l_partkey = p_partkey""",
    # a turn against the same speaker's turn before it: only new and changed texts would be embedded again
    "grf24_delta": """
SELECT c.role, CASE WHEN p.conv_id IS NULL THEN 'new' WHEN md5(coalesce(p.text, '')) = md5(coalesce(c.text, '')) THEN 'same' ELSE 'changed' END AS state, count(*) AS n
FROM {conversations} c LEFT JOIN {conversations} p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2 AND p.role = c.role GROUP BY 1, 2""",
    "grf31_checks": """
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN k.n > 1 THEN 'repeated key' WHEN c_custkey IS NULL THEN 'no target' WHEN o_totalprice <= 0 THEN 'value' WHEN lines IS NULL THEN 'no lines' ELSE 'sound' END AS reason
  FROM {orders} o JOIN (SELECT o_orderkey AS key, count(*) AS n FROM {orders} GROUP BY o_orderkey) k ON key = o.o_orderkey
  LEFT JOIN {customer} ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM {lineitem} GROUP BY l_orderkey) l ON l_orderkey = o.o_orderkey) t GROUP BY reason""",
    "joi14_open": "SELECT event_type, count(*) AS n FROM (SELECT event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM {events}) t WHERE nx IS NULL GROUP BY event_type",
    "joi23_last_three": """
SELECT c_custkey, o_orderkey, CAST(rn AS BIGINT) AS rn FROM {customer} JOIN (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {orders}) t ON o_custkey = c_custkey AND rn <= 3""",
    "joi26_fall_through": """
SELECT kind, count(*) AS n FROM (
  SELECT CASE WHEN s_suppkey IS NOT NULL THEN 'supplier' WHEN p_partkey IS NOT NULL THEN 'part' WHEN o_orderkey IS NOT NULL THEN 'order' ELSE 'none' END AS kind
  FROM {events} LEFT JOIN {supplier} ON s_suppkey = event_id LEFT JOIN {part} ON p_partkey = event_id LEFT JOIN {orders} ON o_orderkey = event_id) t GROUP BY kind""",
    # strongest way in which a question's evidence is met: the same record, else its group
    "joi27_match": """
SELECT o_orderkey, min(strength) AS strength, count(*) AS found FROM (
  SELECT o_orderkey, 1 AS strength FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey AND l_suppkey = o_custkey
  UNION ALL SELECT o_orderkey, 2 FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {customer} ON c_custkey = o_custkey AND c_nationkey = s_nationkey) t
GROUP BY o_orderkey""",
    "sec09_missing": """
SELECT l_returnflag, count(*) AS dropped, count(DISTINCT l_orderkey) AS orders FROM {lineitem} LEFT JOIN {part} ON p_partkey = l_partkey AND p_retailprice > 1000 WHERE p_partkey IS NULL GROUP BY l_returnflag""",
    "str09_stem": """
SELECT stem, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(lower(c_name), '[#0-9]+$', ''), '[^a-z]+', '') AS stem FROM {customer}) t WHERE length(stem) >= 5 GROUP BY stem""",
    "top17_ranked": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "top19_seeded_pick": "SELECT o_orderkey FROM {orders} ORDER BY md5(concat('42:', CAST(o_orderkey AS VARCHAR(20)))), o_orderkey LIMIT 50",
}
_PAIRS = {"grf28_recall": tuple(_recall(text) for text in _KNN)}
QUERIES, ORACLES = register(_BOTH, _PAIRS)

_BACK = "SELECT p_partkey AS id, lag(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS canonical FROM {part}"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a chain of merges ends: each record was merged into the one before it, all go to the first."""
    return components(query(_BACK)(spark, sf_dir), "id", "canonical")


def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each linked group; groups under MISC members are marked."""
    groups = resolution.linked_groups(spark, sf_dir).groupBy("component").agg(F.count("*").alias("members"), F.max("node").alias("last"))
    return groups.withColumn("misc", F.col("members") < MISC)


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a reviewer would call different and that links put in one group all the same."""
    found = resolution.linked_groups(spark, sf_dir)
    left, right = found.toDF("a_id", "group_a"), found.toDF("b_id", "group_b")
    pairs = query(_KNN[0])(spark, sf_dir).where(F.col("score") < SAME)
    return pairs.join(left, "a_id").join(right, "b_id").where("group_a = group_b").select("a_id", "b_id", "score", F.col("group_a").alias("component"))


QUERIES |= {"grf09_ledger": ledger, "grf15_partition": partition, "grf11_closure": closure}
_GROUPS = resolution.ORACLES["grf06_components"]
ORACLES |= {
    "grf09_ledger": "SELECT p_partkey AS node, m AS component FROM part JOIN (SELECT p_brand AS b, p_size AS s, min(p_partkey) AS m FROM part GROUP BY p_brand, p_size HAVING count(*) > 1) t ON p_brand = b AND p_size = s",
    "grf15_partition": f"SELECT component, count(*) AS members, max(node) AS last, count(*) < {MISC} AS misc FROM ({_GROUPS}) g GROUP BY component",
    "grf11_closure": f"WITH g AS ({_GROUPS}) SELECT a_id, b_id, score, x.component FROM ({twin(_KNN[1])}) k JOIN g x ON x.node = a_id JOIN g y ON y.node = b_id WHERE score < {SAME} AND x.component = y.component",
}
