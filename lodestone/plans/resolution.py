"""Queries over linked records: components, reach, merges, bands by floor, hybrid ranks, gates, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import typed
from lodestone.operators.components import components
from lodestone.plans import events, graph
from lodestone.plans.sql import query, register, twin

#: The least score of a link, the floors of the band table, results of each ranking, the rank constant, hops.
LINK, FLOORS, TOP, RANK, HOPS = 0.60, (0.80, 0.83, 0.85), 50, 60, 3
_KNN = graph._PAIRS["joi21_knn"]
_BM25 = events._PAIRS["top03_bm25"]


def _floors(knn: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE score >= {f}) AS over_{round(f * 100)}" for f in FLOORS)
    return f"SELECT label, count(*) AS pairs, {counts} FROM ({knn}) k JOIN {{embeddings}} v ON v.vec_id = a_id GROUP BY label"


def _hybrid(bm25: str, cosine: str) -> str:
    """Two bounded rankings fused; each is cut before its rows are numbered, so no window holds more than TOP rows."""
    return f"""
WITH q AS (SELECT max(embedding) FILTER (WHERE vec_id = 0) AS qe FROM {{embeddings}}),
a AS (SELECT doc_id AS id, score FROM ({bm25}) t ORDER BY score DESC, doc_id LIMIT {TOP}),
b AS (SELECT vec_id AS id, score FROM (SELECT vec_id, {cosine} AS score FROM {{embeddings}} WHERE vec_id <> 0) t ORDER BY score DESC, vec_id LIMIT {TOP}),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rn FROM a UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rn FROM b)
SELECT id, count(*) AS rankings, round(sum(1 / CAST({RANK} + rn AS DOUBLE)), 8) AS score FROM r GROUP BY id"""


def _text(markup: str, g: str) -> str:
    """Script and style bodies go, tags become spaces, five entities are read, white space is squeezed."""
    made = markup
    for pattern, put in (("(?is)<script[^>]*>.*?</script>", " "), ("(?is)<style[^>]*>.*?</style>", " "), ("<[^>]*>", " ")):
        made = f"regexp_replace({made}, '{pattern}', '{put}'{g})"
    for entity, put in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        made = f"replace({made}, '{entity}', '{put}')"
    return f"SELECT page_id, md5(trim(regexp_replace({made}, '[ \\t\\r\\n]+', ' '{g}))) AS digest, CAST(length(trim(regexp_replace({made}, '[ \\t\\r\\n]+', ' '{g}))) AS BIGINT) AS n_chars FROM {{pages}}"


_BOTH = {
    # up to five things that both an anchor and another item touch
    "joi10_shared": """
WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM {lineitem})
SELECT a_key, b_key, partkey FROM (
  SELECT a.l_orderkey AS a_key, b.l_orderkey AS b_key, a.l_partkey AS partkey, row_number() OVER (PARTITION BY a.l_orderkey, b.l_orderkey ORDER BY a.l_partkey) AS rn
  FROM e a JOIN e b ON a.l_partkey = b.l_partkey AND a.l_orderkey <> b.l_orderkey AND a.l_orderkey % 20 = 0) t WHERE rn <= 5""",
    "agg16_consolidation": """
SELECT p_brand, count(*) AS things, count(*) FILTER (WHERE n = 1) AS single, count(*) FILTER (WHERE n = 0) AS isolated, max(n) AS most, round(avg(n), 6) AS mean FROM (
  SELECT p_partkey, p_brand, count(DISTINCT l_orderkey) AS n FROM {part} LEFT JOIN {lineitem} ON l_partkey = p_partkey GROUP BY p_partkey, p_brand) t GROUP BY p_brand""",
    "agg27_census": """
SELECT d.lang, count(*) AS documents, count(l.doc_id) AS labelled, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled, count(*) FILTER (WHERE d.text IS NULL OR d.text = '') AS empty
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY d.lang""",
    "agg40_only_in_slice": """
SELECT l_orderkey, count(*) AS mentions FROM {lineitem} GROUP BY l_orderkey HAVING count(*) = count(*) FILTER (WHERE l_returnflag = 'N')""",
    "grf02_same_name": """
SELECT p_brand, norm, min(p_partkey) AS survivor, count(*) AS records FROM (
  SELECT p_partkey, p_brand, trim(lower(p_name)) AS norm FROM {part}) t GROUP BY p_brand, norm HAVING count(*) > 1""",
    # records of one block merge into the least key; edges move to the survivor and count once
    "grf07_merge": """
WITH s AS (SELECT p_brand, p_size, min(p_partkey) AS survivor FROM {part} GROUP BY p_brand, p_size),
m AS (SELECT p_partkey, survivor FROM {part} p JOIN s ON s.p_brand = p.p_brand AND s.p_size = p.p_size),
e AS (SELECT survivor, l_orderkey, count(*) AS n FROM m JOIN {lineitem} ON l_partkey = p_partkey GROUP BY survivor, l_orderkey)
SELECT survivor, count(*) AS edges, CAST(sum(n) - count(*) AS BIGINT) AS dropped FROM e GROUP BY survivor""",
    "grf22_review": """
SELECT reasons, count(*) AS documents FROM (
  SELECT concat_ws(',', CASE WHEN length(trim(coalesce(text, ''))) < 20 THEN 'short' END, CASE WHEN lang IS NULL THEN 'no_lang' END,
                   CASE WHEN quality = 0 THEN 'poor' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' END) AS reasons
  FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id) t GROUP BY reasons""",
    "grf32_gate": """
WITH c AS (
  SELECT 'texts' AS criterion, count(*) FILTER (WHERE text <> '') / CAST(count(*) AS DOUBLE) AS share, 0.9 AS least FROM {documents}
  UNION ALL SELECT 'sound', count(*) FILTER (WHERE quality = 1) / CAST(count(*) AS DOUBLE), 0.5 FROM {labels}
  UNION ALL SELECT 'finished', count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 0.4 FROM {orders})
SELECT criterion, round(share, 6) AS share, CASE WHEN share >= least THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c""",
    # score of a path: a kind's weight a hop, the best path of each node kept, 25 nodes an anchor
    "top07_local": """
WITH e AS (SELECT l_orderkey AS o, l_partkey AS p, max(CASE l_returnflag WHEN 'R' THEN 0.5 WHEN 'A' THEN 0.75 ELSE 1.0 END) AS w FROM {lineitem} GROUP BY l_orderkey, l_partkey),
a AS (SELECT p_partkey AS anchor FROM {part} WHERE p_size = 1),
near AS (SELECT anchor, o, w FROM a JOIN e ON p = anchor),
far AS (SELECT anchor, e.p AS key, max(CAST(near.w AS DOUBLE) * CAST(e.w AS DOUBLE)) AS score FROM near JOIN e ON e.o = near.o WHERE e.p <> anchor GROUP BY anchor, e.p)
SELECT anchor, key, score FROM (SELECT anchor, key, score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, key) AS rn FROM far) t WHERE rn <= 25""",
    "win06_top_per_group": """
SELECT source, doc_id, CAST(rn AS BIGINT) AS rn FROM (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, n_chars DESC, doc_id) AS rn FROM {documents}) t WHERE rn <= 3""",
}
_PAIRS = {
    "agg26_lengths": tuple(
        f"SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS ids, {p.format(0.5)} AS p50, {p.format(0.95)} AS p95, max(n_chars) AS longest FROM {{documents}} GROUP BY lang"
        for p in ("percentile_disc({}) WITHIN GROUP (ORDER BY n_chars)", "CAST(quantile_disc(n_chars, {}) AS DOUBLE)")
    ),
    "grf05_floors": tuple(_floors(text) for text in _KNN),
    # entries of one key fold into one: the earliest value that is there
    "set09_fold": (
        "SELECT user_id, event_type, count(*) AS entries, min_by(value, struct(ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value FROM {events} GROUP BY user_id, event_type",
        "SELECT user_id, event_type, count(*) AS entries, arg_min(value, row(ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value FROM {events} GROUP BY user_id, event_type",
    ),
    "str17_markup": (_text("html", ""), _text("html", ", 'g'")),
    "top05_hybrid": (
        _hybrid(
            _BM25[0],
            "round((SELECT aggregate(zip_with(transform(embedding, x -> CAST(x AS DOUBLE)), transform(qe, x -> CAST(x AS DOUBLE)), (x, y) -> x * y), 0D, (s, x) -> s + x) FROM q), 6)",
        ),
        _hybrid(_BM25[1], "round((SELECT list_dot_product(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) FROM q), 6)"),
    ),
}
QUERIES, ORACLES = register(_BOTH, _PAIRS)

_LINKS = tuple(f"SELECT a_id, b_id FROM ({text}) k WHERE score >= {LINK}" for text in _KNN)
_EDGES = """
SELECT concat('n:', CAST(c_nationkey AS VARCHAR(20))) AS a, concat('c:', CAST(c_custkey AS VARCHAR(20))) AS b FROM {customer}
UNION ALL SELECT concat('c:', CAST(o_custkey AS VARCHAR(20))), concat('o:', CAST(o_orderkey AS VARCHAR(20))) FROM {orders}
UNION ALL SELECT concat('o:', CAST(l_orderkey AS VARCHAR(20))), concat('p:', CAST(l_partkey AS VARCHAR(20))) FROM {lineitem}"""
_ANCHORS = "SELECT concat('n:', CAST(n_nationkey AS VARCHAR(20))) AS anchor FROM {nation}"


def linked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every vector that a link at or over the floor names."""
    return components(query(_LINKS[0])(spark, sf_dir), "a_id", "b_id")


def shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least number of hops from each nation to what lies within HOPS of it, edges taken both ways."""
    edges = (
        ("n:", "c:", "customer", "c_nationkey AS src", "c_custkey AS dst"),
        ("c:", "o:", "orders", "o_custkey AS src", "o_orderkey AS dst"),
        ("o:", "p:", "lineitem", "l_orderkey AS src", "l_partkey AS dst"),
    )
    relations = [typed.Relation(table, src, dst, spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*ends)) for src, dst, table, *ends in edges]
    return typed.reach(relations, spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS anchor"), "n:", HOPS)


QUERIES |= {"grf06_components": linked_groups, "joi17_shortest": shortest}
ORACLES |= {
    "grf06_components": twin(f"""
WITH RECURSIVE l AS ({_LINKS[1]}), e AS (SELECT a_id AS u, b_id AS v FROM l UNION SELECT b_id, a_id FROM l),
r AS (SELECT u AS node, u AS seen FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY node"""),
    "joi17_shortest": twin(f"""
WITH RECURSIVE o AS ({_EDGES}), e AS (SELECT a AS src, b AS dst FROM o UNION SELECT b, a FROM o),
w AS (SELECT anchor, anchor AS node, 0 AS hops FROM ({_ANCHORS}) s UNION SELECT anchor, dst, hops + 1 FROM w JOIN e ON src = node WHERE hops < {HOPS})
SELECT anchor, node, min(hops) AS hops FROM w WHERE node <> anchor GROUP BY anchor, node"""),
}
