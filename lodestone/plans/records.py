"""Queries over records and their mentions: ranked winners, folds, coverage, routes, citations, scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import events, temporal
from lodestone.plans.sql import register
from lodestone.plans.text import _PROSE

#: Rows a relation and a node may show, rows a cell needs, length of a clipped text, least length of a cited prefix.
PER_RELATION, PER_NODE, NEED, CLIP, PREFIX = 12, 50, 5, 80, 8
_FIELDS = ("text", "lang", "source", "n_chars")
_EDGE = "SELECT DISTINCT least(l_suppkey, l_partkey) AS u, greatest(l_suppkey, l_partkey) AS v FROM {lineitem} WHERE l_suppkey <> l_partkey"
#: The first rule that matches a question names its strategy.
_ROUTES = (("temporal", "when|before|after|since|[0-9][0-9][0-9][0-9]"), ("rationale", "why|reason|because"), ("impact", "depend|affect|break"), ("global", "overall|summar|in general"), ("lookup", "what|who|which|how"))


def _route(match: str) -> str:
    rules = " ".join(f"WHEN {match}(lower(text), '{p}') THEN '{k}'" for k, p in _ROUTES)
    return "SELECT role, strategy, count(*) AS n FROM (SELECT role, CASE " + rules + " ELSE 'hybrid' END AS strategy FROM {conversations}) t GROUP BY role, strategy"


def _best(bm25: str) -> str:
    """A parent is as good as its best part."""
    return f"SELECT source, max(score) AS score, count(*) AS parts FROM ({bm25}) b JOIN {{documents}} d ON d.doc_id = b.doc_id GROUP BY source ORDER BY score DESC, source LIMIT 8"


def _factor(bm25: str) -> str:
    """1 for the least score, 2 for the greatest; a single score counts 2."""
    return f"""
WITH b AS ({bm25}), m AS (SELECT min(score) AS lo, max(score) AS hi FROM b)
SELECT doc_id, round(CASE WHEN (SELECT hi - lo FROM m) = 0 THEN 2.0 ELSE 1 + (score - (SELECT lo FROM m)) / (SELECT hi - lo FROM m) END, 4) AS factor FROM b"""


_BM25 = events._PAIRS["top03_bm25"]
_BOTH = {
    # best record of a key by ranked terms, and the first term that set it apart from the next
    "agg06_winner": """
WITH r AS (
  SELECT p_brand, p_size, p_partkey, p_type, p_retailprice, row_number() OVER w AS rn, lead(p_type) OVER w AS type2, lead(p_retailprice) OVER w AS price2
  FROM {part} WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY p_type DESC, p_retailprice DESC, p_partkey))
SELECT p_brand, p_size, p_partkey AS winner,
       CASE WHEN type2 IS NULL THEN 'only' WHEN type2 <> p_type THEN 'type' WHEN price2 <> p_retailprice THEN 'price' ELSE 'key' END AS decided_by
FROM r WHERE rn = 1""",
    "agg11_coverage": "SELECT lang, count(*) AS n, " + ", ".join(f"count(*) - count({f}) AS no_{f}" for f in _FIELDS) + " FROM {documents} GROUP BY lang",
    "agg23_link_density": """
SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'all' ELSE c_mktsegment END AS bucket, count(*) AS items, round(count(o_custkey) / CAST(count(*) AS DOUBLE), 6) AS density
FROM {customer} LEFT JOIN (SELECT DISTINCT o_custkey FROM {orders}) o ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_mktsegment), ())""",
    "agg25_fields": "WITH c AS (SELECT " + ", ".join(f"count({f}) AS {f}" for f in _FIELDS) + " FROM {documents}) " + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS n FROM c" for f in _FIELDS),
    "agg31_two_level": """
SELECT event_type, round(avg(mean), 4) AS mean, count(*) AS cases FROM (
  SELECT user_id, event_type, avg(value) AS mean FROM {events} GROUP BY user_id, event_type) t GROUP BY event_type""",
    "agg32_agreement": """
SELECT count(*) AS cases, count(*) FILTER (WHERE a = b) AS exact, count(*) FILTER (WHERE abs(a - b) <= 10) AS near, round(avg(abs(a - b)), 4) AS mean_gap FROM (
  SELECT user_id, max(value) FILTER (WHERE hour(ts) % 2 = 0) AS a, max(value) FILTER (WHERE hour(ts) % 2 = 1) AS b FROM {events} GROUP BY user_id, CAST(ts AS DATE)) t
WHERE a IS NOT NULL AND b IS NOT NULL""",
    "agg37_top_values": "SELECT p_type, count(*) AS n FROM {part} GROUP BY p_type ORDER BY n DESC, p_type LIMIT 20",
    "agg41_reciprocal": """
WITH e AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS v FROM {lineitem}) SELECT count(*) AS both_ways FROM e JOIN e r ON e.u = r.v AND e.v = r.u AND e.u < e.v""",
    "agg42_density": f"""
WITH e AS ({_EDGE}), n AS (SELECT count(*) AS n FROM (SELECT u FROM e UNION SELECT v FROM e) t)
SELECT (SELECT n FROM n) AS nodes, count(*) AS edges, round(2 * count(*) / CAST((SELECT n * (n - 1) FROM n) AS DOUBLE), 8) AS density FROM e""",
    "agg43_degree": f"SELECT node, count(*) AS degree FROM (SELECT u AS node FROM ({_EDGE}) a UNION ALL SELECT v FROM ({_EDGE}) b) t GROUP BY node",
    "dte03_one_day": "SELECT event_type, count(*) AS n FROM {events} WHERE ts >= DATE '2024-01-10' AND ts < DATE '2024-01-10' + INTERVAL '1' DAY GROUP BY event_type",
    # same-source identity first, else the key alone where only one record has it
    "joi04_fallback": """
WITH bare AS (SELECT c_custkey FROM {customer} GROUP BY c_custkey HAVING count(*) = 1)
SELECT user_id, coalesce(CASE WHEN s.s_suppkey IS NOT NULL THEN 'own' END, CASE WHEN b.c_custkey IS NOT NULL THEN 'bare' END, 'none') AS found, count(*) AS events
FROM {events} LEFT JOIN {supplier} s ON s.s_suppkey = user_id LEFT JOIN bare b ON b.c_custkey = user_id GROUP BY 1, 2""",
    "joi20_cross_source": """
SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS n FROM {customer}) c
JOIN (SELECT s_suppkey, CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT) AS n FROM {supplier}) s ON s.n = c.n""",
    # every reference goes to the survivor of its record, or to itself where the ledger has none
    "joi22_route": """
WITH ledger AS (SELECT p_partkey AS id, m AS canonical FROM {part} p JOIN (SELECT p_brand AS b, p_size AS s, min(p_partkey) AS m FROM {part} GROUP BY p_brand, p_size HAVING count(*) > 1) t
  ON p_brand = b AND p_size = s WHERE p_partkey <> m)
SELECT coalesce(canonical, l_partkey) AS target, count(*) AS refs, count(canonical) AS routed FROM {lineitem} LEFT JOIN ledger ON id = l_partkey GROUP BY 1""",
    # citations by a prefix of an id; joined on the prefix itself, kept where one record has it
    "joi24_prefix": f"""
WITH ids AS (SELECT substr(md5(CAST(o_orderkey AS VARCHAR(20))), 1, {PREFIX}) AS prefix, min(o_orderkey) AS o_orderkey FROM {{orders}} GROUP BY 1 HAVING count(*) = 1)
SELECT o_orderkey, count(*) AS citations FROM (SELECT substr(md5(CAST(l_orderkey AS VARCHAR(20))), 1, {PREFIX}) AS cited FROM {{lineitem}}) c JOIN ids ON prefix = cited GROUP BY o_orderkey""",
    "mth02_sigmoid": "SELECT c_custkey, round(1 / (1 + exp(-greatest(-20.0, least(20.0, c_acctbal / 1000)))), 6) AS p FROM {customer}",
    "set03_union": "SELECT c_nationkey AS nation FROM {customer} UNION SELECT s_nationkey FROM {supplier} UNION SELECT n_nationkey FROM {nation}",
    "str12_clip": f"SELECT doc_id, CASE WHEN length(text) > {CLIP} THEN concat(rtrim(substr(text, 1, {CLIP - 1})), '…') ELSE text END AS clipped FROM {{documents}}",
    "str13_budget": "SELECT doc_id, CAST(floor(length(text) / CAST(3.49 AS DOUBLE) + CAST(0.999 AS DOUBLE)) AS BIGINT) AS tokens FROM {documents}",
    "str20_number": f"SELECT o_orderkey, CAST(nullif(regexp_extract(prose, '#([0-9]+)', 1), '') AS BIGINT) AS number FROM (SELECT o_orderkey, {_PROSE} AS prose FROM {{orders}}) t",
    "top21_cells": f"""
SELECT source, lang, n, least(n, {NEED}) AS kept, n - least(n, {NEED}) AS surplus FROM (SELECT source, lang, count(*) AS n FROM {{documents}} GROUP BY source, lang) t""",
    "win05_union_timeline": """
SELECT id, kind, ref, CAST(row_number() OVER (PARTITION BY id ORDER BY day NULLS LAST, kind, ref) AS BIGINT) AS rn FROM (
  SELECT o_custkey AS id, 'order' AS kind, o_orderkey AS ref, CAST(o_orderdate AS DATE) AS day FROM {orders}
  UNION ALL SELECT user_id, 'event', event_id, CAST(ts AS DATE) FROM {events}) t""",
    "win07_neighbours": f"""
SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber FROM (
  SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, rn) AS total FROM (
    SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey DESC, l_linenumber) AS rn
    FROM {{lineitem}}) t WHERE rn <= {PER_RELATION}) u WHERE total <= {PER_NODE}""",
    "win14_busiest_pair": """
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM {events} GROUP BY 1)
SELECT CAST(a.day AS VARCHAR(10)) AS day, a.n + b.n AS n FROM d a JOIN d b ON b.day = a.day + INTERVAL '1' DAY ORDER BY n DESC, day LIMIT 1""",
}
_PAIRS = {
    "agg05_first": tuple(
        f"SELECT o_custkey, {by}(o_orderkey, {at}(o_orderdate, o_orderkey)) AS first_order, count(*) AS n FROM {{orders}} GROUP BY o_custkey" for by, at in (("min_by", "struct"), ("arg_min", "row"))
    ),
    # one edge a pair: whether any mention is a link, and the kinds of all (three at most)
    "agg07_mention_fold": tuple(
        f"SELECT l_orderkey, l_partkey, bool_or(l_quantity > 25) AS linked, {kinds} AS kinds FROM {{lineitem}} GROUP BY l_orderkey, l_partkey"
        for kinds in ("array_join(sort_array(collect_set(l_returnflag)), ',')", "string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag)")
    ),
    "agg45_same_members": tuple(
        f"SELECT members, count(*) AS groups FROM (SELECT l_orderkey, {members} AS members FROM {{lineitem}} GROUP BY l_orderkey) t GROUP BY members HAVING count(*) > 1"
        for members in ("array_join(sort_array(collect_set(CAST(l_suppkey AS STRING))), ',')", "string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR))")
    ),
    "agg46_cited_sentences": (
        "SELECT doc_id, CAST(size(s) AS BIGINT) AS sentences, CAST(size(filter(s, x -> x rlike '[0-9]')) AS BIGINT) AS cited FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?]+', 0) AS s FROM {documents}) t",
        "SELECT doc_id, len(s) AS sentences, len(list_filter(s, lambda x: regexp_matches(x, '[0-9]'))) AS cited FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?]+') AS s FROM {documents}) t",
    ),
    "arr01_lists": (
        "SELECT vec_id, exists(embedding, x -> x > 2) AS any_high, forall(embedding, x -> x > -3) AS all_over, CAST(size(filter(embedding, x -> x < 0)) AS BIGINT) AS below FROM {embeddings}",
        "SELECT vec_id, len(list_filter(embedding, lambda x: x > 2)) > 0 AS any_high, len(list_filter(embedding, lambda x: x <= -3)) = 0 AS all_over, len(list_filter(embedding, lambda x: x < 0)) AS below FROM {embeddings}",
    ),
    "jsn01_props": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}",
        "SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM {events}",
    ),
    "set06_symmetric": (
        "SELECT p_partkey, CAST(size(array_intersect(a, b)) AS BIGINT) AS shared, CAST(size(array_except(a, b)) + size(array_except(b, a)) AS BIGINT) AS apart FROM (SELECT p_partkey, array_distinct(split(lower(p_name), ' ')) AS a, array_distinct(split(lower(p_type), ' ')) AS b FROM {part}) t",
        "SELECT p_partkey, len(list_intersect(a, b)) AS shared, len(a) + len(b) - 2 * len(list_intersect(a, b)) AS apart FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM {part}) t",
    ),
    "set08_pairs_once": tuple(
        f"SELECT l_suppkey, l_partkey, {by}(l_orderkey, {at}(l_returnflag, -l_extendedprice, l_orderkey)) AS kept, count(*) AS n FROM {{lineitem}} GROUP BY l_suppkey, l_partkey"
        for by, at in (("min_by", "struct"), ("arg_min", "row"))
    ),
    "str08_route": (_route("regexp_like"), _route("regexp_matches")),
    "top06_best_parent": tuple(_best(text) for text in _BM25),
    "top10_lexical": tuple(_factor(text) for text in _BM25),
    "win13_midpoint": tuple(
        f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM {{events}}) t WHERE rn = n {div} 2 + 1"
        for div in ("DIV", "//")
    ),
}
QUERIES, ORACLES = register(_BOTH, _PAIRS)


def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by their status at the cut-off; items without one count as null."""
    return temporal.status_at(spark, sf_dir).groupBy("status").count().withColumnRenamed("count", "n")


QUERIES |= {"joi13_histogram": status_histogram}
ORACLES |= {"joi13_histogram": f"SELECT status, count(*) AS n FROM ({temporal.ORACLES['joi12_status_at']}) t GROUP BY status"}
