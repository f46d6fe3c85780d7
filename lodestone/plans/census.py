"""Filters, projections, censuses and audits; one text serves Spark and DuckDB unless a function's form differs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import overlap
from lodestone.plans.sql import query, register

#: Closed statuses of traversal and of evaluation, kinds a container may have, fields of a changelog that count and that are noise.
CLOSED, CLOSED_EVAL, KINDS, FIELDS, NOISE = ("F", "P"), ("F",), ("MAIL", "SHIP", "RAIL"), ("click", "purchase", "signup"), ("view",)
#: Weights of relations on a path and of one not listed, and the loss by hop.
WEIGHTS, OTHER_WEIGHT, PER_HOP = {"A": 1.0, "N": 0.8}, 0.5, 0.55
#: Rows of a block that meet all others of it in one task, pairs of blocks that one task makes, lines whose orders one task joins.
DEAL, TASK_PAIRS, TASK_LINES = 1024, 1 << 23, 1 << 19
RETRIES, TOP, SHARES = 2, 10, {"A": 0.5, "N": 0.3, "R": 0.2}


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


#: Fixed value: characters shown on each side of a sampled mention.
AROUND = 40
_WEIGHT = "CASE l_returnflag " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in WEIGHTS.items()) + f" ELSE CAST({OTHER_WEIGHT} AS DOUBLE) END"
_SHARE = "CASE l_returnflag " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in SHARES.items()) + " END"
_TITLE = "replace(replace(p_name, 'part ', ''), '-', ' ')"
_LAST = "SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {orders}"
_NODES = "SELECT 'customer' AS label, CAST(c_custkey AS BIGINT) AS k FROM {customer} UNION ALL SELECT 'supplier', CAST(s_suppkey AS BIGINT) FROM {supplier} UNION ALL SELECT 'part', p_partkey FROM {part} UNION ALL SELECT 'order', o_orderkey FROM {orders}"
_EDGES = "SELECT 'placed' AS rel, o_custkey AS src, o_orderkey AS dst FROM {orders} UNION ALL SELECT 'holds', l_orderkey, l_partkey FROM {lineitem} UNION ALL SELECT 'supplied', l_suppkey, l_partkey FROM {lineitem}"

_BOTH = {
    # filters
    "flt01_synthetic": "SELECT d.doc_id FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id WHERE coalesce(toxic = 1, false) = false",
    "flt02_live": "SELECT d.doc_id, n_chars FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id WHERE NOT coalesce(quality = 0, false) AND n_chars >= 20",
    # a missing status counts as open; the two closed sets are kept apart
    "flt03_open": f"""
SELECT o_orderpriority, count(*) FILTER (WHERE status IS NULL OR status NOT IN {_in(CLOSED)}) AS open_traversal, count(*) FILTER (WHERE status IS NULL OR status NOT IN {_in(CLOSED_EVAL)}) AS open_evaluation
FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status FROM {{orders}}) t GROUP BY o_orderpriority""",
    # blacklist first, then the allowlist of every known source; only issues are filtered and each removed row keeps its reason
    "flt04_refs": """
SELECT l_returnflag AS kind, reason, count(*) AS refs FROM (
  SELECT l_returnflag, CASE WHEN l_returnflag <> 'N' THEN 'kept' WHEN l_quantity = 13 THEN 'blacklisted' WHEN s_suppkey IS NULL THEN 'unknown project' ELSE 'kept' END AS reason
  FROM {lineitem} LEFT JOIN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal > 0) s ON s_suppkey = l_suppkey) t GROUP BY l_returnflag, reason""",
    "flt05_containers": """
SELECT count(*) FILTER (WHERE known AND wanted) AS kept, count(*) FILTER (WHERE known AND NOT wanted) AS skipped, count(*) FILTER (WHERE NOT known) AS unknown
FROM (SELECT n_nationkey IS NOT NULL AS known, coalesce(n_regionkey < 3, false) AS wanted FROM {customer} LEFT JOIN (SELECT * FROM {nation} WHERE n_nationkey < 20) n ON n_nationkey = c_nationkey) t""",
    "flt06_fields": f"""
SELECT event_type, CASE WHEN event_type IN {_in(FIELDS)} THEN 'change' WHEN event_type IN {_in(NOISE)} THEN 'ignored' ELSE 'other' END AS class, count(*) AS n FROM {{events}} GROUP BY 1, 2""",
    # documents in scope: named by an item or a commit, and every variant of an ambiguous key
    "flt07_scope": """
WITH named AS (SELECT p_partkey FROM {part} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 45)),
twins AS (SELECT b.p_partkey FROM {part} a JOIN named ON named.p_partkey = a.p_partkey JOIN {part} b ON a.p_name = b.p_name AND a.p_brand = b.p_brand)
SELECT p_partkey, CAST(max(direct) AS BIGINT) AS direct FROM (SELECT p_partkey, 1 AS direct FROM named UNION ALL SELECT p_partkey, 0 FROM twins) t GROUP BY p_partkey""",
    "flt08_selection": """
SELECT o_orderkey, n_refs FROM (
  SELECT o_orderkey, o_orderpriority, o_totalprice, count(DISTINCT l_partkey) AS n_refs FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey AND l_quantity > 40
  GROUP BY o_orderkey, o_orderpriority, o_totalprice) t WHERE o_totalprice >= 100000 AND (o_orderpriority IN ('1-URGENT', '2-HIGH') OR n_refs > 0)""",
    "flt09_slice": "SELECT coalesce(slice, 'base') AS slice, count(*) AS n FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'incremental' END AS slice FROM {documents}) t WHERE coalesce(slice, 'base') = 'base' GROUP BY 1",
    "flt15_provenance": "SELECT d.doc_id, text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL AND l.doc_id IS NOT NULL AS complete FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON l.doc_id = d.doc_id",
    # projections
    "prj05_columns": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, o_orderstatus, CAST(round(o_totalprice, 2) AS DOUBLE) AS price FROM {orders}",
    "prj06_ladder": """
SELECT label, count(*) AS n FROM (
  SELECT CASE WHEN c_custkey IS NOT NULL THEN 'customer' WHEN s_suppkey IS NOT NULL THEN 'supplier' WHEN p_partkey IS NOT NULL THEN 'part' ELSE 'other' END AS label
  FROM (SELECT DISTINCT user_id FROM {events}) e LEFT JOIN {customer} ON c_custkey = user_id AND c_custkey % 3 = 0 LEFT JOIN {supplier} ON s_suppkey = user_id AND s_suppkey % 2 = 0 LEFT JOIN {part} ON p_partkey = user_id AND p_partkey % 5 <> 0) t GROUP BY label""",
    # joins
    "joi01_index": """
WITH own AS (SELECT 'c' AS source, c_custkey AS k, c_nationkey AS nation FROM {customer} UNION ALL SELECT 's', s_suppkey, s_nationkey FROM {supplier}),
bare AS (SELECT k, min(source) AS source FROM own GROUP BY k HAVING count(*) = 1)
SELECT e.event_type, count(own.k) AS by_source, count(bare.k) AS by_key, count(*) AS n
FROM {events} e LEFT JOIN own ON own.source = 's' AND own.k = e.user_id LEFT JOIN bare ON bare.k = e.user_id GROUP BY e.event_type""",
    "joi05_last_run": f"SELECT c_custkey, o_orderkey AS last_order, o_orderstatus AS last_status FROM {{customer}} LEFT JOIN ({_LAST}) t ON o_custkey = c_custkey AND rn = 1",
    "joi09_delivers": "SELECT DISTINCT o_custkey AS item, l_suppkey AS doc FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'",
    "joi18_between": """
SELECT l_suppkey AS a, l_partkey AS b, l_returnflag AS rel, direction, count(*) AS edges FROM (
  SELECT l_suppkey, l_partkey, l_returnflag, CASE WHEN l_suppkey < l_partkey THEN 'a->b' ELSE 'b->a' END AS direction FROM {lineitem}) t GROUP BY 1, 2, 3, 4""",
    "joi19_blocked": "SELECT a.p_partkey AS a, b.p_partkey AS b FROM {part} a JOIN {part} b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey",
    "joi28_linked": """
WITH direct AS (SELECT DISTINCT o_custkey, l_partkey FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'),
linked AS (SELECT DISTINCT o_custkey, l_partkey FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
SELECT p_partkey, count(DISTINCT d.o_custkey) AS direct, count(DISTINCT l.o_custkey) AS linked FROM {part} LEFT JOIN direct d ON d.l_partkey = p_partkey LEFT JOIN linked l ON l.l_partkey = p_partkey GROUP BY p_partkey""",
    # aggregates
    "agg01_nodes": f"SELECT CASE WHEN grouping(label) = 1 THEN 'total' ELSE label END AS label, count(*) AS n FROM ({_NODES}) t GROUP BY GROUPING SETS ((label), ())",
    "agg02_edges": f"SELECT rel, count(*) AS n, count(*) FILTER (WHERE dst % 10 = 0) AS derived, count(*) FILTER (WHERE dst % 10 <> 0) AS stated FROM ({_EDGES}) t GROUP BY rel",
    "agg04_corpus": """
SELECT count(*) AS docs, count(l.doc_id) AS labelled, count(*) FILTER (WHERE b.doc_id IS NOT NULL) AS copied, count(*) FILTER (WHERE l.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS both_flags
FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON l.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id FROM {documents} WHERE md5(text) IN (SELECT md5(text) FROM {documents} GROUP BY md5(text) HAVING count(*) > 1)) b ON b.doc_id = d.doc_id""",
    "agg08_links": "SELECT l_returnflag AS rel, l_suppkey AS src, l_partkey AS dst, min(l_linestatus) AS raw_type, count(*) AS n FROM {lineitem} GROUP BY 1, 2, 3",
    # the commonest name of an entity: most often, then shortest, then first in order
    "agg09_entity": """
WITH n AS (SELECT p_size, p_type, count(*) AS n FROM {part} GROUP BY p_size, p_type),
r AS (SELECT p_size, p_type, row_number() OVER (PARTITION BY p_size ORDER BY n DESC, length(p_type), p_type) AS rn FROM n)
SELECT r.p_size, r.p_type AS name, g.aliases, g.first_key, g.longest FROM r
JOIN (SELECT p_size, count(DISTINCT p_type) - 1 AS aliases, min(p_partkey) AS first_key, max(length(p_name)) AS longest FROM {part} GROUP BY p_size) g ON g.p_size = r.p_size WHERE rn = 1""",
    "agg12_same_as": "SELECT coalesce(tier, 0) AS tier, rule, count(*) AS n FROM (SELECT nullif(l_linenumber % 4, 3) AS tier, l_returnflag AS rule FROM {lineitem}) t GROUP BY 1, 2",
    "agg17_weak": "SELECT o_orderkey FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag IN ('A', 'R'))",
    # failing tests by component for the open bugs of a family; components without any stay with 0
    "agg20_failing": """
SELECT n_name, count(DISTINCT CASE WHEN o_orderstatus = 'O' AND l_returnflag = 'R' THEN l_partkey END) AS failing
FROM {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey LEFT JOIN {orders} ON o_custkey = c_custkey AND o_orderpriority LIKE '1-%' LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY n_name""",
    "agg24_collisions": "SELECT n AS owners, count(*) AS keys FROM (SELECT md5(text) AS k, count(*) AS n FROM {documents} GROUP BY 1) t WHERE n > 1 GROUP BY n",
    "agg30_cost": "SELECT event_type AS strategy, count(*) AS runs, round(sum(value), 2) AS cost, round(avg(value), 4) AS mean, max(value) AS most FROM {events} GROUP BY event_type",
    "agg35_folded": "SELECT round(1 - count(DISTINCT p_name) / CAST(count(*) AS DOUBLE), 6) AS folded, round(count(*) / CAST(count(DISTINCT p_name) AS DOUBLE), 6) AS identities FROM {part}",
    "agg36_ratios": """
WITH m AS (SELECT avg(CAST(CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS DOUBLE)) AS toxic, avg(CAST(CASE WHEN quality = 1 THEN 1 ELSE 0 END AS DOUBLE)) AS good, count(*) / CAST((SELECT count(*) FROM {documents}) AS DOUBLE) AS labelled FROM {labels})
SELECT ratio, round(CAST(v AS DOUBLE), 6) AS v, target, abs(v - target) <= 0.1 AS met FROM (
  SELECT 'toxic' AS ratio, toxic AS v, CAST(0.1 AS DOUBLE) AS target FROM m UNION ALL SELECT 'good', good, CAST(0.8 AS DOUBLE) FROM m UNION ALL SELECT 'labelled', labelled, CAST(0.4 AS DOUBLE) FROM m) t""",
    "agg38_schema": f"SELECT n.label AS src, e.rel, count(*) AS edges, count(DISTINCT e.src) AS sources FROM ({_EDGES}) e JOIN ({_NODES}) n ON n.k = e.src AND n.label = CASE e.rel WHEN 'placed' THEN 'customer' WHEN 'holds' THEN 'order' ELSE 'supplier' END GROUP BY n.label, e.rel",
    "agg44_members": f"SELECT p_brand, p_partkey, CAST(rn AS BIGINT) AS place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM {{part}}) t WHERE rn <= {TOP}",
    "agg48_counters": "SELECT l_returnflag AS rel, l_linestatus AS field, count(*) AS n FROM {lineitem} GROUP BY 1, 2 ORDER BY n DESC, rel, field",
    # windows and ranks
    "win02_last_run": "SELECT l_partkey AS test, l_orderkey AS execution, l_returnflag AS status FROM (SELECT l_partkey, l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC NULLS FIRST, l_orderkey DESC, l_linenumber DESC) AS rn FROM {lineitem}) t WHERE rn = 1",
    "win08_evidence": "SELECT o_custkey, o_orderkey, CAST(rn AS BIGINT) AS place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey) AS rn FROM {orders}) t WHERE rn <= 60",
    "win12_ranks": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM {orders}",
    "win16_stride": "WITH n AS (SELECT count(*) AS n FROM {documents}), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM {documents}) SELECT doc_id FROM r WHERE place IN (SELECT CAST(floor(i * n / CAST(50 AS DOUBLE)) AS BIGINT) FROM (SELECT place AS i FROM r WHERE place < 50) k, n)",
    "top08_path": f"""
SELECT src, dst, round(sum(w1 * w2 * {PER_HOP * PER_HOP:.6f}), 6) AS weight FROM (
  SELECT a.l_suppkey AS src, b.l_suppkey AS dst, a.w AS w1, b.w AS w2 FROM (SELECT DISTINCT l_suppkey, l_orderkey, {_WEIGHT} AS w FROM {{lineitem}}) a
  JOIN (SELECT DISTINCT l_suppkey, l_orderkey, {_WEIGHT} AS w FROM {{lineitem}}) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey) t GROUP BY src, dst""",
    "top09_semantic": "SELECT event_id, round(CASE WHEN value IS NULL THEN 1.0 ELSE greatest(0.05, 1 + 2 * (value - avg_value) / 100) END, 6) AS factor FROM {events} CROSS JOIN (SELECT avg(value) AS avg_value FROM {events}) m",
    "top15_grey": "SELECT l_suppkey, l_partkey, round(score, 4) AS score FROM (SELECT l_suppkey, l_partkey, avg(l_quantity) / 50 * (1 + 0.1 * least(count(*), 3) + 0.1 * max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)) AS score FROM {lineitem} GROUP BY l_suppkey, l_partkey) t ORDER BY t.score DESC, l_suppkey, l_partkey LIMIT 200",
    "top18_shares": f"SELECT l_returnflag, l_orderkey, l_linenumber FROM (SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM {{lineitem}}) t WHERE rn <= round(200 * {_SHARE})",
    # layers with fixed offsets, scored by place; the first row has the counts
    "top22_impact": f"""
WITH l AS (SELECT 1 AS layer, l_partkey AS k, max(l_extendedprice) AS v FROM {{lineitem}} WHERE l_suppkey = 1 GROUP BY l_partkey UNION ALL SELECT 2, o_custkey, max(o_totalprice) FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey WHERE l_suppkey = 1 GROUP BY o_custkey),
r AS (SELECT layer, k, row_number() OVER (PARTITION BY layer ORDER BY v DESC, k) AS rn, count(*) OVER (PARTITION BY layer) AS n FROM l)
SELECT layer, k, round(1 - layer * 0.2 + (1 - rn / CAST(n AS DOUBLE)) * 0.1, 6) AS score FROM r WHERE rn <= {TOP} UNION ALL SELECT 0, count(*), 2.0 FROM l""",
    # a key by the first label that has it, and how many have it
    "top23_lookup": f"""
SELECT min_by(label, CASE label WHEN 'order' THEN 0 WHEN 'part' THEN 1 WHEN 'customer' THEN 2 ELSE 3 END) AS label, k, count(DISTINCT label) AS labels FROM ({_NODES}) t GROUP BY k""",
    "top24_explain": """
SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(DISTINCT a.l_partkey) AS shared, count(*) FILTER (WHERE a.l_returnflag = b.l_returnflag) AS same_rel, min(a.l_partkey) AS first_shared
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY a.l_suppkey, b.l_suppkey""",
    # sets
    "set01_branches": f"SELECT rel, count(*) AS n FROM ({_EDGES} UNION ALL SELECT 'reaches', o_custkey, l_partkey FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey UNION ALL SELECT label, k, k FROM ({_NODES}) v) t GROUP BY rel",
    "set04_orphans": "SELECT l_partkey FROM {lineitem} EXCEPT SELECT p_partkey FROM {part} WHERE p_size > 5",
    "set05_shared": "SELECT a.l_orderkey AS a, b.l_orderkey AS b, count(*) AS shared FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM {lineitem} WHERE l_orderkey % 20 = 0) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM {lineitem}) b ON a.l_suppkey = b.l_suppkey AND a.l_orderkey <> b.l_orderkey GROUP BY 1, 2 HAVING count(*) >= 3",
    "joi07_unlinked": "SELECT doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)",
    # scalars
    "str06_keys": "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1-%' THEN 'issue' WHEN o_orderpriority LIKE '2-%' THEN 'proposal' ELSE 'change' END AS kind, concat(upper(substr(o_orderpriority, 3, 4)), '-', CAST(o_orderkey AS STRING)) AS canonical FROM {orders}",
    "str10_initials": "SELECT c_custkey, concat(lower(substr(c_name, 1, 1)), '.', lower(substr(c_mktsegment, 1, 3))) AS initials FROM {customer}",
    "str11_survivor": "SELECT p_brand, p_size, p_partkey AS survivor FROM (SELECT p_brand, p_size, p_partkey, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY CASE WHEN p_type LIKE 'STANDARD%' THEN 0 ELSE 1 END, length(p_name), lower(p_name), p_partkey) AS rn FROM {part}) t WHERE rn = 1",
    "str25_display": "SELECT form, count(*) AS n FROM (SELECT CASE WHEN length(c_name) < 6 THEN 'short' WHEN c_name LIKE '%#%' THEN 'numbered' WHEN c_name LIKE '% %' THEN 'full name' ELSE 'handle' END AS form FROM {customer}) t GROUP BY form",
    "dte02_day_end": "SELECT event_id, CAST(CAST(ts AS DATE) AS STRING) AS day, ts < CAST(ts AS DATE) + INTERVAL '1' DAY AS within FROM {events}",
    # graph and resolution
    "grf03_titles": "SELECT a.p_partkey AS a, min(b.p_partkey) AS b FROM {part} a JOIN {part} b ON replace(replace(a.p_name, 'part ', ''), '-', ' ') = replace(replace(b.p_name, 'part ', ''), '-', ' ') AND a.p_partkey > b.p_partkey GROUP BY a.p_partkey",
    "grf08_merged": """
WITH c AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS canonical FROM {part})
SELECT src, dst, rel, count(*) AS was FROM (SELECT l_suppkey AS src, coalesce(canonical, l_partkey) AS dst, l_returnflag AS rel FROM {lineitem} LEFT JOIN c ON id = l_partkey) t WHERE src <> dst GROUP BY src, dst, rel""",
    "grf14_levels": "SELECT level, groups, CAST(row_number() OVER (ORDER BY groups, level) AS BIGINT) AS coarseness FROM (SELECT 'region' AS level, count(DISTINCT n_regionkey) AS groups FROM {nation} UNION ALL SELECT 'nation', count(DISTINCT c_nationkey) FROM {customer} UNION ALL SELECT 'segment', count(DISTINCT concat(CAST(c_nationkey AS STRING), c_mktsegment)) FROM {customer}) t",
    "grf16_carried": """
WITH now AS (SELECT p_brand AS level, md5(p_name) AS h, min(p_partkey) AS id FROM {part} GROUP BY 1, 2), old AS (SELECT level, h, id AS report FROM now WHERE id % 3 <> 0),
any_ AS (SELECT h, min(report) AS report FROM old GROUP BY h)
SELECT n.level, n.id, coalesce(o.report, a.report, -1) AS report, o.report IS NULL AND a.report IS NOT NULL AS copied FROM now n LEFT JOIN old o ON o.level = n.level AND o.h = n.h LEFT JOIN any_ a ON a.h = n.h""",
    "grf17_evidence": """
SELECT p_brand, l_orderkey, members FROM (SELECT p_brand, l_orderkey, members, row_number() OVER (PARTITION BY p_brand ORDER BY members DESC, l_orderkey) AS rn FROM (
  SELECT p_brand, l_orderkey, count(DISTINCT l_partkey) AS members FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY p_brand, l_orderkey) c) t WHERE rn <= 12""",
    # the first reason that holds screens a record; self-loops and unknown endpoints are named
    "grf20_screened": """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_quantity IS NULL THEN 'schema' WHEN l_suppkey = l_partkey THEN 'self-loop' WHEN p_partkey IS NULL THEN 'unknown endpoint' WHEN owners > 1 THEN 'ambiguous endpoint' ELSE 'kept' END AS reason
FROM {lineitem} LEFT JOIN (SELECT p_partkey, p_name FROM {part} WHERE p_size > 3) p ON p_partkey = l_partkey LEFT JOIN (SELECT p_name AS name, count(*) AS owners FROM {part} GROUP BY p_name) o ON o.name = p.p_name) t GROUP BY reason""",
    "grf21_off_shape": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} WHERE concat(l_returnflag, l_linestatus) NOT IN ('NO', 'RF') GROUP BY 1, 2",
    "grf27_assignees": """
SELECT o_custkey, person, count(*) AS spells, min(began) AS first_day, max(ended) AS last_day, bool_or(ended IS NULL) AS current FROM (
  SELECT o_custkey, o_orderstatus AS person, CAST(CAST(o_orderdate AS DATE) AS STRING) AS began, CAST(CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS STRING) AS ended FROM {orders}) t GROUP BY o_custkey, person""",
    "grf29_verified": """
SELECT kind, verdict, count(*) AS n FROM (SELECT c.l_returnflag AS kind, CASE WHEN p.p_partkey IS NULL THEN 'missing' WHEN p.p_size < 5 THEN 'outside snapshot' ELSE 'valid' END AS verdict
FROM {lineitem} c LEFT JOIN (SELECT p_partkey, p_size FROM {part} WHERE p_partkey % 11 <> 0) p ON p.p_partkey = c.l_partkey) t GROUP BY kind, verdict""",
    # batches and audits
    "sec02_smallest": "SELECT l_orderkey, min(l_partkey) AS owner, count(*) AS n FROM {lineitem} GROUP BY l_orderkey",
    "sec03_owner": "SELECT l_partkey, min(l_orderkey) AS first_batch, CAST(row_number() OVER (ORDER BY l_partkey) AS BIGINT) AS minted FROM {lineitem} GROUP BY l_partkey",
    "sec04_truth": "SELECT k, max(v) AS v, count(*) AS batches FROM (SELECT o_custkey AS k, o_totalprice AS v FROM {orders} WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, c_acctbal FROM {customer}) t GROUP BY k",
    "sec05_orphans": "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus <> 'P' AND o_orderpriority < '3')",
    "sec06_retries": f"SELECT user_id, count(*) AS failures, CASE WHEN count(*) > {RETRIES} THEN 'quarantined' ELSE 'retry' END AS state FROM {{events}} WHERE event_type = 'error' GROUP BY user_id",
    "sec07_missing_output": "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND l_quantity > 10)",
    "sec08_rejections": "SELECT reason, count(*) AS n, min(doc_id) AS sample FROM (SELECT doc_id, CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars > 10000 THEN 'long' WHEN lang <> 'en' THEN 'language' END AS reason FROM {documents}) t WHERE reason IS NOT NULL GROUP BY reason",
    # groups of equal texts in which no two members have a label: nothing grades their merge
    "sec11_ungraded": "SELECT min(d.doc_id) AS first_doc, count(*) AS members, count(l.doc_id) AS labelled FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON l.doc_id = d.doc_id WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1 AND count(l.doc_id) < 2",
    "sec13_last_run": "SELECT event_type AS rule, count(*) AS n, max(event_id) AS last_run FROM {events} GROUP BY event_type",
    "sec14_freshness": "SELECT md5(text) AS content, min(doc_id) AS first_seen, count(*) AS times FROM {documents} WHERE text IS NOT NULL GROUP BY md5(text)",
    "sec15_stale": "SELECT a.doc_id, b.doc_id IS NULL AS stale FROM {documents} a LEFT JOIN {documents} b ON b.doc_id = a.doc_id + 1 AND md5(a.text) <> md5(b.text)",
    "sec16_unplaced": "SELECT n_regionkey, count(*) FILTER (WHERE c_custkey IS NULL) AS unplaced, count(*) AS n FROM {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_regionkey",
    "sec17_degenerate": "WITH l AS (SELECT count(DISTINCT n_regionkey) AS a, count(*) AS b FROM {nation}) SELECT a, b, b / CAST(a AS DOUBLE) AS ratio, b / CAST(a AS DOUBLE) < 1.1 AS degenerate FROM l",
    "sec18_bare": "SELECT source, count(*) FILTER (WHERE n = 0) AS bare, count(*) AS docs FROM (SELECT d.doc_id, d.source, count(l.doc_id) AS n FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY d.doc_id, d.source) t GROUP BY source",
    "sec19_warnings": "SELECT source, n, n > 60 AS warned FROM (SELECT source, count(*) AS n FROM {documents} GROUP BY source) t",
    "sec20_index_meta": "SELECT m.source, m.n AS stored, l.n AS live, m.n <> l.n AS disagrees FROM (SELECT source, count(*) AS n FROM {documents} GROUP BY source) m JOIN (SELECT source, count(*) AS n FROM {documents} WHERE n_chars >= 20 GROUP BY source) l ON l.source = m.source",
    "sec21_load": "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS expected, coalesce(b.n, 0) AS actual FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_nationkey < 20 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_nationkey > 3 GROUP BY 1) b ON a.k = b.k",
    "sec22_audit": "SELECT l_orderkey, count(DISTINCT l_partkey) AS cited, count(DISTINCT p_partkey) AS valid, count(DISTINCT l_partkey) - count(DISTINCT p_partkey) AS invalid, bool_or(p_partkey IS NOT NULL) AS auditable FROM {lineitem} LEFT JOIN (SELECT p_partkey FROM {part} WHERE p_size > 10) p ON p_partkey = l_partkey GROUP BY l_orderkey",
    "sec25_coverage": "SELECT q.user_id, s.event_type AS strategy FROM (SELECT DISTINCT user_id FROM {events}) q CROSS JOIN (SELECT DISTINCT event_type FROM {events}) s WHERE NOT EXISTS (SELECT 1 FROM {events} e WHERE e.user_id = q.user_id AND e.event_type = s.event_type AND e.value > 50)",
    "sec26_rerun": "SELECT user_id, md5(concat(CAST(count(*) AS STRING), '|', CAST(min(event_id) AS STRING), '|', CAST(max(event_id) AS STRING))) AS digest FROM {events} GROUP BY user_id",
    "sec27_drift": "SELECT lang, count(*) FILTER (WHERE n_chars <> length(text)) AS drifted, count(*) AS n FROM {documents} GROUP BY lang",
    "sec28_answers": "SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'assistant' AND length(text) >= 20) AS answered, bool_and(role IN ('user', 'assistant', 'system')) AS well_formed FROM {conversations} GROUP BY conv_id",
    "sec29_snapshot": "SELECT l_orderkey, count(*) AS hits, count(p_partkey) AS inside FROM {lineitem} LEFT JOIN (SELECT p_partkey FROM {part} WHERE p_partkey <= 1000) p ON p_partkey = l_partkey GROUP BY l_orderkey",
    "sec31_pairs": "SELECT o_orderkey, CASE WHEN md5(CAST(o_orderkey AS STRING)) < '8' THEN 'ab' ELSE 'ba' END AS side, md5(concat('x', CAST(o_orderkey AS STRING))) < '1' AS overlap FROM {orders}",
    "sec32_winners": "SELECT event_type, user_id AS winner, round(best - base, 4) AS delta FROM (SELECT event_type, user_id, s AS best, avg(s) OVER (PARTITION BY event_type) AS base, row_number() OVER (PARTITION BY event_type ORDER BY s DESC, user_id) AS rn FROM (SELECT event_type, user_id, avg(value) AS s FROM {events} GROUP BY event_type, user_id) m) t WHERE rn = 1",
    "sec33_gate": "SELECT criterion, v, v >= least_ AS passed FROM (SELECT 'questions' AS criterion, count(*) AS v, 100 AS least_ FROM {conversations} WHERE role = 'user' UNION ALL SELECT 'benchmarks', count(*), 30 FROM {benchmark}) t",
    "sec34_templates": "SELECT doc_id, replace('What changed in <source>?', '<source>', source) AS question FROM {documents} WHERE source IS NOT NULL",
    "sec37_reset": "SELECT o_custkey, bool_and(o_orderstatus = 'F') AS goes, count(*) AS parents FROM {orders} GROUP BY o_custkey",
    "sec38_pruned": "SELECT l_partkey, count(*) AS rows_left FROM {lineitem} WHERE NOT EXISTS (SELECT 1 FROM {part} WHERE p_partkey = l_partkey AND p_size = 1) GROUP BY l_partkey",
    "sec40_stamp": "SELECT d.doc_id, coalesce(CAST(l.quality AS STRING), 'none') AS stamp FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id",
    "src13_recency": "SELECT c_custkey, c_name, coalesce(last_day, 'never') AS recency FROM {customer} LEFT JOIN (SELECT o_custkey, CAST(CAST(max(o_orderdate) AS DATE) AS STRING) AS last_day FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey",
    "src14_carried": "SELECT k, source FROM (SELECT o_orderkey AS k, 'new' AS source FROM {orders} WHERE o_orderstatus = 'O' UNION ALL SELECT l_orderkey, 'kept' FROM (SELECT DISTINCT l_orderkey FROM {lineitem}) e WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O')) t",
    "src16_title_key": "SELECT p_partkey, nullif(regexp_extract(p_name, '([0-9]+)', 1), '') AS strict_key, nullif(regexp_extract(p_name, '([A-Za-z]+)', 1), '') AS loose_key FROM {part}",
    "src22_unique": "SELECT 'customer' AS label, count(*) AS repeated FROM (SELECT c_custkey FROM {customer} GROUP BY 1 HAVING count(*) > 1) a UNION ALL SELECT 'orders', count(*) FROM (SELECT o_orderkey FROM {orders} GROUP BY 1 HAVING count(*) > 1) b UNION ALL SELECT 'line', count(*) FROM (SELECT l_orderkey, l_linenumber FROM {lineitem} GROUP BY 1, 2 HAVING count(*) > 1) c",
    "sec30_codes": "SELECT item_id, length(text) AS n, text LIKE '%`%' OR text LIKE '%()%' AS code FROM {benchmark}",
}
_COSINE = (
    "aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a.embedding, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)) * sqrt(aggregate(b.embedding, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)))",
    "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))",
)


def _nearest(cosine: str, kind: str) -> str:
    """The vectors nearest to one, which is a single broadcast row."""
    return f"SELECT b.vec_id, b.label, round((1 + {cosine}) / 2, 6) AS score FROM (SELECT embedding, label FROM {{embeddings}} ORDER BY vec_id LIMIT 1) a CROSS JOIN {{embeddings}} b WHERE {kind} ORDER BY score DESC, b.vec_id LIMIT 20"


_PAIRS = {
    "top01_vectors": tuple(_nearest(c, "true") for c in _COSINE),
    "top02_entities": tuple(_nearest(c, "b.label = a.label") for c in _COSINE),
    "mth01_cosine": tuple(f"SELECT a.vec_id AS a, b.vec_id AS b, round({c}, 6) AS cosine FROM {{embeddings}} a JOIN {{embeddings}} b ON b.vec_id = a.vec_id + 1" for c in _COSINE),
    "prj07_compact": (
        "SELECT doc_id, CAST(size(map_filter(map('lang', lang, 'source', source, 'label', label), (k, v) -> v IS NOT NULL AND v <> '')) AS BIGINT) AS kept FROM (SELECT d.doc_id, lang, source, CAST(quality AS STRING) AS label FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id) t",
        "SELECT doc_id, len(list_filter([lang, source, label], lambda v: v IS NOT NULL AND v <> '')) AS kept FROM (SELECT d.doc_id, lang, source, CAST(quality AS STRING) AS label FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id) t",
    ),
    "agg10_union": (
        "SELECT o_custkey, array_join(array_sort(array_union(collect_set(o_orderstatus), collect_set(substr(o_orderpriority, 1, 1)))), ',') AS provenance, min(o_orderkey) AS first_seen FROM {orders} GROUP BY o_custkey",
        "SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list(o_orderstatus), list(substr(o_orderpriority, 1, 1))))), ',') AS provenance, min(o_orderkey) AS first_seen FROM {orders} GROUP BY o_custkey",
    ),
    "agg13_communities": tuple(
        f"SELECT lang, CAST({half} AS DOUBLE) AS p50, CAST({most} AS DOUBLE) AS p95, count(*) AS groups FROM (SELECT lang, source, count(*) AS n FROM {{documents}} GROUP BY lang, source) t GROUP BY lang"
        for half, most in (("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)", "percentile_disc(0.95) WITHIN GROUP (ORDER BY n)"), ("quantile_disc(n, 0.5)", "quantile_disc(n, 0.95)"))
    ),
    "sec24_latency": tuple(
        f"SELECT event_type, round({median}(value), 6) AS median, round(list_[greatest(CAST(floor(0.9 * n) AS INT) - 1, 0) + {base}], 6) AS p90 FROM (SELECT event_type, {median}(value) AS value, {made} AS list_, count(*) AS n FROM {{events}} GROUP BY event_type) t GROUP BY event_type, list_, n"
        for median, made, base in (("median", "sort_array(collect_list(value))", 0), ("median", "list_sort(list(value))", 1))
    ),
    "sec23_anchors": (
        "SELECT p_brand, round(size(array_intersect(a, b)) / CAST(size(array_union(a, b)) AS DOUBLE), 6) AS jaccard, size(array_except(a, b)) + size(array_except(b, a)) = 0 AS identical FROM (SELECT p_brand, collect_set(CASE WHEN p_partkey % 2 = 0 THEN p_size END) AS a, collect_set(CASE WHEN p_partkey % 2 = 1 THEN p_size END) AS b FROM {part} GROUP BY p_brand) t",
        "SELECT p_brand, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS jaccard, len(list_intersect(a, b)) = len(list_distinct(list_concat(a, b))) AS identical FROM (SELECT p_brand, list(DISTINCT p_size) FILTER (WHERE p_partkey % 2 = 0) AS a, list(DISTINCT p_size) FILTER (WHERE p_partkey % 2 = 1) AS b FROM {part} GROUP BY p_brand) t",
    ),
    # a mention (the first address of a text) with what stands around it, of texts drawn by a hash
    "sec10_sample": tuple(
        f"SELECT doc_id, mention, substr(text, greatest(place - {AROUND}, 1), CAST(place - greatest(place - {AROUND}, 1) AS INT) + length(mention) + {AROUND}) AS quote FROM (SELECT doc_id, text, mention, {find}(text, mention) AS place FROM (SELECT doc_id, text, regexp_extract(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+', 0) AS mention FROM {{documents}}) m WHERE length(mention) > 0) t ORDER BY md5(concat('7', CAST(doc_id AS {kind}))), doc_id LIMIT 25"
        for find, kind in (("instr", "STRING"), ("strpos", "VARCHAR"))
    ),
    "str22_sentences": (
        "SELECT doc_id, CAST(size(filter(split(coalesce(text, ''), '[.!?]+[ \\\\n]+'), x -> length(trim(x)) > 0)) AS BIGINT) AS claims FROM {documents}",
        "SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[.!?]+[ \\n]+'), lambda x: length(trim(x)) > 0)) AS claims FROM {documents}",
    ),
    "str26_tokens": (
        "SELECT doc_id, CAST(size(array_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z][A-Z]+-[0-9]+|[0-9a-f]+[0-9][0-9a-f]+', 0))) AS BIGINT) AS ids FROM {documents}",
        "SELECT doc_id, len(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z][A-Z]+-[0-9]+|[0-9a-f]+[0-9][0-9a-f]+'))) AS ids FROM {documents}",
    ),
    "dte01_parsed": (
        "SELECT doc_id, CAST(to_date(try_to_timestamp(s)) AS STRING) AS day FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('2024-01-', lpad(CAST(doc_id % 40 AS STRING), 2, '0')) ELSE 'soon' END AS s FROM {documents}) t",
        "SELECT doc_id, CAST(CAST(TRY_CAST(s AS TIMESTAMP) AS DATE) AS STRING) AS day FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('2024-01-', lpad(CAST(doc_id % 40 AS STRING), 2, '0')) ELSE 'soon' END AS s FROM {documents}) t",
    ),
    # family versions: padded to four numbers, a family's ceiling filled with 9999
    "dte04_versions": (
        "SELECT p_partkey, array_join(slice(concat(transform(split(v, '[.]'), x -> CAST(x AS INT)), array_repeat(0, 4)), 1, 4), '.') AS floor_key, array_join(slice(concat(transform(split(v, '[.]'), x -> CAST(x AS INT)), array_repeat(9999, 4)), 1, 4), '.') AS ceiling_key FROM (SELECT p_partkey, concat(CAST(p_size AS STRING), '.', CAST(p_partkey % 10 AS STRING)) AS v FROM {part}) t",
        "SELECT p_partkey, array_to_string(list_concat(list_transform(string_split(v, '.'), lambda x: CAST(x AS INT)), [0, 0, 0, 0])[1:4], '.') AS floor_key, array_to_string(list_concat(list_transform(string_split(v, '.'), lambda x: CAST(x AS INT)), [9999, 9999, 9999, 9999])[1:4], '.') AS ceiling_key FROM (SELECT p_partkey, concat(CAST(p_size AS STRING), '.', CAST(p_partkey % 10 AS STRING)) AS v FROM {part}) t",
    ),
    "jsn03_path": ("SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(props, '$.missing') AS missing FROM {events}", "SELECT event_id, regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS k, CAST(NULL AS STRING) AS missing FROM {events}"),
    "map01_items": (
        "SELECT coalesce(CAST(o_orderkey AS STRING), o_orderstatus) AS key, array_join(transform(map_entries(map('status', o_orderstatus, 'priority', o_orderpriority)), e -> concat(e.key, '=', e.value)), ' ') AS snippet FROM {orders}",
        "SELECT CAST(o_orderkey AS STRING) AS key, concat('status=', o_orderstatus, ' priority=', o_orderpriority) AS snippet FROM {orders}",
    ),
    "sec41_probes": (
        "SELECT doc_id, array_join(array_compact(array(CASE WHEN n_chars < 20 THEN 'short' END, CASE WHEN lang IS NULL THEN 'no language' END, CASE WHEN source IS NULL THEN 'no source' END)), ',') AS problems FROM {documents}",
        "SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 20 THEN 'short' END, CASE WHEN lang IS NULL THEN 'no language' END, CASE WHEN source IS NULL THEN 'no source' END], lambda x: x IS NOT NULL), ',') AS problems FROM {documents}",
    ),
    "src25_fingerprints": tuple(f"SELECT lang, {sha} AS newest, count(*) AS records FROM {{documents}} GROUP BY lang" for sha in ("sha2(max(coalesce(text, '')), 256)", "sha256(max(coalesce(text, '')))")),
}
QUERIES, ORACLES = register(_BOTH, _PAIRS)
#: Spark's own texts of queries whose SQL is kept for the twin, but makes more rows on the way than it returns.
_LEAN = {
    # the least key of a name is the least before each other key of it; no pair of a name is made
    "grf03_titles": f"""
WITH t AS (SELECT p_partkey AS k, {_TITLE} AS title FROM {{part}}), m AS (SELECT title, min(k) AS least FROM t GROUP BY title)
SELECT k AS a, min(least) AS b FROM t JOIN m ON t.title = m.title AND k > least GROUP BY k""",
    # a part is in scope by its name and brand, which are taken once each
    "flt07_scope": """
WITH hot AS (SELECT DISTINCT l_partkey FROM {lineitem} WHERE l_quantity > 45),
t AS (SELECT p_partkey, p_name, p_brand, l_partkey IS NOT NULL AS direct FROM {part} LEFT JOIN hot ON l_partkey = p_partkey),
g AS (SELECT DISTINCT p_name AS name, p_brand AS brand FROM t WHERE direct)
SELECT p_partkey, CAST(max(CASE WHEN direct THEN 1 ELSE 0 END) AS BIGINT) AS direct FROM t LEFT JOIN g ON p_name = name AND p_brand = brand WHERE direct OR name IS NOT NULL GROUP BY p_partkey""",
    # with a bound that holds for every flag, each task keeps its first rows of a flag before any is shuffled
    "top18_shares": _BOTH["top18_shares"] + f" AND rn <= {round(200 * max(SHARES.values()))}",
}
QUERIES |= {name: query(text) for name, text in _LEAN.items()}


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs a < b of parts of one block (brand, type, size): as many tasks as the pairs need, and large blocks are dealt to several."""
    block = ["p_brand", "p_type", "p_size"]
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(*block, "p_partkey").dropna()
    sizes = part.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = sizes.agg(F.sum(F.expr("CAST(n AS DOUBLE) * (n - 1) / 2"))).first()[0] or 0.0
    dealt = part.join(sizes, block).withColumn("deals", F.ceil(F.col("n") / DEAL).cast("int"))
    left = dealt.select(*block, F.col("p_partkey").alias("a"), F.pmod(F.xxhash64("p_partkey"), "deals").cast("int").alias("deal"))
    right = dealt.select(*block, F.col("p_partkey").alias("b"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    key, tasks = [*block, "deal"], 1 + int(pairs / TASK_PAIRS)
    return left.repartition(tasks, *key).join(right.repartition(tasks, *key), key).where("a < b").select("a", "b")


def shared_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share three suppliers or more with one order in 20."""
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS key", "l_suppkey AS item")
    return overlap.counted(orders, 3, F.col("key") % 20 == 0)


def weighed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that meet in orders, by the weights of both ways: as many tasks as the lines need, so none holds more orders or pairs as tables grow."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tasks = 1 + lines.count() // TASK_LINES
    ways = lines.selectExpr("l_orderkey", "l_suppkey", f"{_WEIGHT} AS w").repartition(tasks, "l_orderkey").distinct()
    pairs = ways.toDF("k", "src", "w1").join(ways.toDF("k", "dst", "w2"), "k").where("src <> dst").selectExpr("src", "dst", f"w1 * w2 * {PER_HOP * PER_HOP:.6f} AS w")
    return pairs.repartition(tasks, "src", "dst").groupBy("src", "dst").agg(F.round(F.sum("w"), 6).alias("weight"))


QUERIES |= {"joi19_blocked": blocked, "set05_shared": shared_suppliers, "top08_path": weighed_paths}


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, digest, n: SHA-256 of all SHA-256 digests of a source's texts in their order, one to a line; a null text is empty, a null source is one.

    Spark sorts the digests, and a task reads those of its sources as a stream, so none is gathered.
    """
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(source: str | None, made, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([source], pa.string()), pa.array([made.hexdigest()]), pa.array([n], pa.int64())], names=["source", "digest", "n"])

        of, made, n = None, None, 0
        for batch in batches:
            for source, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if made is not None and source == of:
                    made.update(b"\n")
                else:
                    if made is not None:
                        yield told(of, made, n)
                    of, made, n = source, hashlib.sha256(), 0
                made.update(h.encode())
                n += 1
        if made is not None:
            yield told(of, made, n)

    return rows.repartition("source").sortWithinPartitions("source", "h").mapInArrow(run, "source string, digest string, n long")


QUERIES["sec39_digests"] = digests
ORACLES["sec39_digests"] = "SELECT source, sha256(string_agg(sha256(coalesce(text, '')), chr(10) ORDER BY sha256(coalesce(text, '')))) AS digest, count(*) AS n FROM documents GROUP BY source"
