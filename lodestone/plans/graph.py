"""Graph queries on the star schema: parts, orders and customers as nodes, their references as edges."""

from __future__ import annotations

from lodestone.plans.sql import register

_BOTH = {
    # latest record of each key, with what it supersedes
    "src12_latest": """
SELECT o_custkey, o_orderkey, o_totalprice, superseded FROM (
  SELECT o_custkey, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn,
         count(*) OVER (PARTITION BY o_custkey) - 1 AS superseded
  FROM {orders}) t WHERE rn = 1""",
    # edges only to known endpoints, and the references that dangle
    "joi02_edges": """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey WHERE p.p_size <= 25""",
    "joi03_dangling": """
SELECT l_returnflag, count(*) AS dangling FROM {lineitem} l
WHERE NOT EXISTS (SELECT 1 FROM {part} p WHERE p.p_partkey = l.l_partkey AND p.p_size <= 25) GROUP BY l_returnflag""",
    "joi06_semi": """
SELECT p_partkey, p_name FROM {part} p WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 40)""",
    "joi07_anti": """
SELECT c_custkey, c_name FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""",
    "joi08_collapse": """
SELECT DISTINCT o.o_custkey AS custkey, l.l_partkey AS partkey FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey""",
    # items that touch the same things as an anchor; anchors are the orders whose key 20 divides
    "joi11_cotouch": """
WITH a AS (SELECT DISTINCT l_orderkey AS a_key, l_partkey FROM {lineitem} WHERE l_orderkey % 20 = 0),
m AS (SELECT DISTINCT a_key, b.l_orderkey AS b_key, b.l_partkey FROM a JOIN {lineitem} b ON a.l_partkey = b.l_partkey AND a_key <> b.l_orderkey)
SELECT a_key, b_key, count(*) AS shared FROM m GROUP BY a_key, b_key HAVING count(*) >= 2""",
    "agg03_flags": """
SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS large,
       count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM {orders} GROUP BY o_orderstatus""",
    "agg14_sizes": """
SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1-1' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' WHEN n <= 24 THEN '10-24' ELSE '25+' END AS bucket,
       count(*) AS customers FROM (
  SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey) t GROUP BY 1""",
    "agg15_placement": """
SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished
FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "agg18_last_run": """
SELECT coalesce(last_status, 'never') AS last_status, count(*) AS n FROM {customer} LEFT JOIN (
  SELECT o_custkey, o_orderstatus AS last_status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM {orders}) t ON o_custkey = c_custkey AND rn = 1 GROUP BY 1""",
    "agg19_owner": """
SELECT n_nationkey, c_custkey AS owner, orders, parts FROM (
  SELECT n_nationkey, c_custkey, orders, parts, row_number() OVER (PARTITION BY n_nationkey ORDER BY orders DESC, parts DESC, c_custkey) AS rn
  FROM {nation} JOIN (
    SELECT c_custkey, c_nationkey, orders, parts FROM {customer}
    JOIN (SELECT o_custkey AS a, count(*) AS orders FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem}) GROUP BY o_custkey) o ON a = c_custkey
    JOIN (SELECT b, count(*) AS parts FROM (SELECT DISTINCT o_custkey AS b, l_partkey FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey) p GROUP BY b) q ON b = c_custkey) s
  ON c_nationkey = n_nationkey) t WHERE rn = 1""",
    "agg21_superlatives": """
SELECT l_partkey, count(DISTINCT l_orderkey) AS orders FROM {lineitem} GROUP BY l_partkey ORDER BY orders DESC, l_partkey LIMIT 1""",
    "agg28_matrix": """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders}
GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))""",
    "agg39_drift": """
SELECT o_orderstatus, derived, count(*) AS n FROM (
  SELECT o_orderkey, o_orderstatus, bool_and(l_linestatus = 'F') AS derived FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_orderstatus) t GROUP BY o_orderstatus, derived""",
    "set02_pairs": """
SELECT DISTINCT least(l_suppkey, l_partkey) AS u, greatest(l_suppkey, l_partkey) AS v FROM {lineitem} WHERE l_suppkey <> l_partkey""",
    "set04_except": "SELECT p_partkey FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45",
    "set07_distinct": "SELECT l_partkey FROM {lineitem} INTERSECT SELECT p_partkey FROM {part} WHERE p_size > 25",
    "agg47_jaccard": """
WITH s AS (SELECT DISTINCT o_custkey, l_partkey, year(o_orderdate) % 2 AS side FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey),
b AS (SELECT o_custkey, l_partkey, count(*) AS sides FROM s GROUP BY o_custkey, l_partkey)
SELECT o_custkey, round(count(*) FILTER (WHERE sides = 2) / CAST(count(*) AS DOUBLE), 6) AS jaccard FROM b GROUP BY o_custkey""",
    # anchors reach their orders first, so that only these, and no whole edge table, are made distinct
    "joi16_two_hop": """
WITH a AS (SELECT p_partkey AS anchor FROM {part} WHERE p_size = 1),
near AS (SELECT DISTINCT anchor, l_orderkey AS o FROM a JOIN {lineitem} ON l_partkey = anchor),
hop AS (SELECT DISTINCT anchor, o, l_partkey AS key FROM near JOIN {lineitem} ON l_orderkey = o WHERE l_partkey <> anchor),
far AS (SELECT anchor, key, count(*) AS paths FROM hop GROUP BY anchor, key)
SELECT anchor, key, paths FROM (
  SELECT anchor, key, paths, row_number() OVER (PARTITION BY anchor ORDER BY paths DESC, key) AS rn FROM far) t WHERE rn <= 25""",
}
_PAIRS = {
    "agg29_percentile": (
        "SELECT o_orderpriority, percentile_disc(0.95) WITHIN GROUP (ORDER BY o_totalprice) AS p95 FROM {orders} GROUP BY o_orderpriority",
        "SELECT o_orderpriority, quantile_disc(o_totalprice, 0.95) AS p95 FROM {orders} GROUP BY o_orderpriority",
    ),
    "joi21_knn": (
        """
WITH v AS (SELECT vec_id, label, transform(embedding, x -> CAST(x AS DOUBLE)) AS e FROM {embeddings}),
n AS (SELECT vec_id, label, e, sqrt(aggregate(e, 0D, (s, x) -> s + x * x)) AS len FROM v)
SELECT a_id, b_id, score FROM (
  SELECT a_id, b_id, score, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rn FROM (
    SELECT a.vec_id AS a_id, b.vec_id AS b_id,
           round((1 + aggregate(zip_with(a.e, b.e, (x, y) -> x * y), 0D, (s, x) -> s + x) / (a.len * b.len)) / 2, 6) AS score
    FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 20 = 0) s) t WHERE rn <= 3""",
        """
SELECT a_id, b_id, score FROM (
  SELECT a_id, b_id, score, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rn FROM (
    SELECT a.vec_id AS a_id, b.vec_id AS b_id,
           round((1 + list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) / 2, 6) AS score
    FROM {embeddings} a JOIN {embeddings} b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 20 = 0) s) t WHERE rn <= 3""",
    ),
}
QUERIES, ORACLES = register(_BOTH, _PAIRS)
