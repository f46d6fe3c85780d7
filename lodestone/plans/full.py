"""Operators in full where an earlier query answers a part: as-of fall-backs, real intervals, five-term ranks, strengths, selectors."""

from __future__ import annotations

from lodestone.plans.sql import register

#: The date asked about, files of an anchor that count, events of a timeline, neighbours of an anchor, gap of scores that two judges may have.
CUT, FILES, EVENTS, CAP, NEAR = "2024-01-15", 20, 50, 25, 1
_LOG = "SELECT user_id, event_id, event_type, ts, value, lead(ts) OVER w AS nx, lag(event_type) OVER w AS previous FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_ITEM = "SELECT p_partkey, p_brand, p_size, p_type, p_retailprice, p_name FROM {part}"
_SCORE = "SELECT user_id, event_type, CAST(ts AS DATE) AS day, CAST(floor(value / 20) AS INT) AS grade, hour(ts) % 2 AS judge, value, event_id FROM {events}"
_TOUCH = "SELECT DISTINCT o_custkey AS person, l_partkey AS thing, l_orderkey AS item, o_orderdate AS day FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey"
#: Selectors of the one that has most: name, table, key, measure.
_SELECTORS = (
    ("most lines", "{lineitem}", "l_partkey", "count(*)"),
    ("most orders", "{lineitem}", "l_partkey", "count(DISTINCT l_orderkey)"),
    ("most suppliers", "{lineitem}", "l_partkey", "count(DISTINCT l_suppkey)"),
    ("most returned", "{lineitem}", "l_partkey", "count(*) FILTER (WHERE l_returnflag = 'R')"),
    ("most accepted", "{lineitem}", "l_partkey", "count(*) FILTER (WHERE l_returnflag = 'A')"),
    ("busiest supplier", "{lineitem}", "l_suppkey", "count(*)"),
    ("widest supplier", "{lineitem}", "l_suppkey", "count(DISTINCT l_partkey)"),
    ("largest order", "{lineitem}", "l_orderkey", "count(*)"),
    ("best customer", "{orders}", "o_custkey", "count(*)"),
    ("open customer", "{orders}", "o_custkey", "count(*) FILTER (WHERE o_orderstatus = 'O')"),
    ("most events", "{events}", "user_id", "count(*)"),
    ("most changes", "{events}", "user_id", "count(DISTINCT event_type)"),
)


def _selector(name: str, table: str, key: str, measure: str) -> str:
    return f"SELECT '{name}' AS selector, k, n FROM (SELECT CAST({key} AS BIGINT) AS k, {measure} AS n, row_number() OVER (ORDER BY {measure} DESC, {key}) AS rn FROM {table} GROUP BY {key}) t WHERE rn = 1"


_BOTH = {
    # the last change by the end of the day; else the first later change's old value; else the current one; null before the item began
    "joi12_as_of": f"""
WITH e AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {{events}}),
m AS (SELECT e.user_id, e.event_type AS to_, coalesce(p.event_type, 'created') AS from_, e.ts, e.event_id, e.ts < DATE '{CUT}' + INTERVAL '1' DAY AS past FROM e LEFT JOIN e p ON p.user_id = e.user_id AND p.rn = e.rn - 1),
last_ AS (SELECT user_id, to_, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM m WHERE past),
next_ AS (SELECT user_id, from_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM m WHERE NOT past),
begun AS (SELECT o_custkey, min(o_orderdate) AS created FROM {{orders}} GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN created IS NULL OR created >= DATE '{CUT}' + INTERVAL '1' DAY THEN NULL ELSE coalesce(l.to_, n.from_, 'current') END AS status,
       CASE WHEN l.to_ IS NOT NULL THEN 'change' WHEN n.from_ IS NOT NULL THEN 'next' ELSE 'current' END AS found
FROM {{customer}} LEFT JOIN begun ON o_custkey = c_custkey LEFT JOIN last_ l ON l.user_id = c_custkey AND l.rn = 1 LEFT JOIN next_ n ON n.user_id = c_custkey AND n.rn = 1""",
    "joi13_documents": f"""
WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {{events}} WHERE ts < DATE '{CUT}' + INTERVAL '1' DAY),
r AS (SELECT DISTINCT p_brand AS doc, o_custkey AS item FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey JOIN {{orders}} ON o_orderkey = l_orderkey)
SELECT doc, coalesce(event_type, 'unknown') AS status, count(*) AS items FROM r LEFT JOIN s ON s.user_id = item AND s.rn = 1 GROUP BY 1, 2""",
    "joi14_current": f"SELECT t.user_id, t.event_type AS holder, c.c_nationkey FROM ({_LOG}) t JOIN {{customer}} c ON c.c_custkey = t.user_id WHERE t.nx IS NULL",
    # spells of one holder: those of no length are dropped, the open one has no end
    "win01_spells": f"""
SELECT user_id, holder, valid_from, valid_to FROM (
  SELECT user_id, event_type AS holder, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to
  FROM ({_LOG}) t WHERE previous IS NULL OR previous <> event_type) u WHERE valid_to IS NULL OR valid_to > valid_from""",
    "agg06_five_terms": f"""
WITH r AS (SELECT t.*, row_number() OVER w AS rn, lead(p_type) OVER w AS t2, lead(length(p_name)) OVER w AS n2, lead(p_retailprice) OVER w AS r2, lead(p_name) OVER w AS m2
  FROM ({_ITEM}) t WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY p_type DESC, length(p_name) DESC, p_retailprice DESC, p_name, p_partkey))
SELECT p_brand, p_size, p_partkey AS winner, CASE WHEN t2 IS NULL THEN 'only' WHEN t2 <> p_type THEN 'type' WHEN n2 <> length(p_name) THEN 'length' WHEN r2 <> p_retailprice THEN 'price' WHEN m2 <> p_name THEN 'name' ELSE 'key' END AS decided_by,
       coalesce(t2 = p_type AND n2 = length(p_name) AND r2 = p_retailprice AND m2 = p_name, false) AS ambiguous FROM r WHERE rn = 1""",
    # nearest rank int(q (n - 1) + 0.5) over sizes, and fixed buckets
    "agg14_distribution": """
WITH s AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS place, count(*) OVER () AS all_ FROM (SELECT count(*) AS n FROM {lineitem} GROUP BY l_partkey) t)
SELECT max(CASE WHEN place = floor(0.5 * (all_ - 1) + 0.5) THEN n END) AS p50, max(CASE WHEN place = floor(0.95 * (all_ - 1) + 0.5) THEN n END) AS p95, max(n) AS most,
       count(*) FILTER (WHERE n < 10) AS under_10, count(*) FILTER (WHERE n BETWEEN 10 AND 24) AS under_25, count(*) FILTER (WHERE n BETWEEN 25 AND 49) AS under_50, count(*) FILTER (WHERE n >= 50) AS more FROM s""",
    "agg19_scores": f"""
WITH a AS (SELECT person, count(DISTINCT item) AS items FROM ({_TOUCH}) t GROUP BY person), b AS (SELECT person, count(*) AS things FROM (SELECT DISTINCT person, thing FROM ({_TOUCH}) t) u GROUP BY person)
SELECT coalesce(a.person, b.person) AS person, coalesce(items, 0) + coalesce(things, 0) AS score FROM a FULL OUTER JOIN b ON a.person = b.person""",
    "agg21_selectors": " UNION ALL ".join(_selector(*s) for s in _SELECTORS),
    "agg32_within_one": f"""
WITH c AS (SELECT user_id, day, max(grade) FILTER (WHERE judge = 0) AS a, max(grade) FILTER (WHERE judge = 1) AS b FROM ({_SCORE}) t GROUP BY user_id, day)
SELECT count(*) AS cases, count(*) FILTER (WHERE a = b) AS exact, count(*) FILTER (WHERE abs(a - b) <= {NEAR}) AS within, round(avg(abs(a - b)), 6) AS mean_gap FROM c WHERE a IS NOT NULL AND b IS NOT NULL""",
    # two judges of a pair: a disagreement is a tie, both_wrong wants both
    "agg33_table": f"""
WITH v AS (SELECT user_id, day, judge, CASE WHEN max(value) FILTER (WHERE event_type IN ('click', 'view')) > max(value) FILTER (WHERE event_type NOT IN ('click', 'view')) THEN 'a' ELSE 'b' END AS winner, max(value) < 40 AS wrong FROM ({_SCORE}) t GROUP BY user_id, day, judge),
p AS (SELECT user_id, day, count(DISTINCT winner) AS kinds, min(winner) AS winner, bool_and(wrong) AS both_wrong, count(*) AS judges FROM v GROUP BY user_id, day)
SELECT CASE WHEN kinds > 1 THEN 'tie' ELSE winner END AS outcome, count(*) AS pairs, count(*) FILTER (WHERE both_wrong AND judges = 2) AS both_wrong FROM p GROUP BY 1""",
    "joi04_identities": """
WITH i AS (SELECT 'c' AS source, c_custkey AS k, concat('c', CAST(c_custkey AS STRING)) AS person FROM {customer} UNION ALL SELECT 's', s_suppkey, concat('s', CAST(s_suppkey AS STRING)) FROM {supplier}),
bare AS (SELECT k, min(person) AS person FROM i GROUP BY k HAVING count(DISTINCT person) = 1),
m AS (SELECT 's' AS source, l_suppkey AS k FROM {lineitem} UNION ALL SELECT 's', user_id FROM {events})
SELECT coalesce(i.person, bare.person, 'none') AS person, count(*) AS mentions FROM m LEFT JOIN i ON i.source = m.source AND i.k = m.k LEFT JOIN bare ON bare.k = m.k GROUP BY 1""",
    # changes between two versions: after the low one, up to and with the high family; each item by its earliest release
    "joi15_changes": """
WITH v AS (SELECT l_partkey AS item, p_size AS major, l_linenumber AS minor FROM {lineitem} JOIN {part} ON p_partkey = l_partkey),
e AS (SELECT item, major, minor, row_number() OVER (PARTITION BY item ORDER BY major, minor) AS rn FROM v WHERE major * 10000 + minor > 5 * 10000 + 3 AND major * 10000 + minor <= 7 * 10000 + 9999)
SELECT item, major, minor FROM e WHERE rn = 1 ORDER BY major, minor, item""",
    # one or two hops over typed edges, no edge twice on a path, nearest first, so many to an anchor
    "joi16_expand": f"""
WITH e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_returnflag AS rel FROM {{lineitem}} WHERE l_returnflag <> 'N'),
a AS (SELECT p_partkey AS anchor FROM {{part}} WHERE p_size <= 2),
one AS (SELECT anchor, concat('o', CAST(o AS STRING)) AS k, o, rel, 1 AS hops FROM a JOIN e ON p = anchor),
two AS (SELECT one.anchor, concat('p', CAST(e.p AS STRING)) AS k, 2 AS hops FROM one JOIN e ON e.o = one.o AND NOT (e.p = one.anchor AND e.rel = one.rel)),
n AS (SELECT anchor, k, min(hops) AS hops, count(*) AS paths FROM (SELECT anchor, k, hops FROM one UNION ALL SELECT anchor, k, hops FROM two) t GROUP BY anchor, k)
SELECT anchor, k, hops, paths FROM (SELECT anchor, k, hops, paths, row_number() OVER (PARTITION BY anchor ORDER BY hops, paths DESC, k) AS rn FROM n) t WHERE rn <= {CAP}""",
    "joi11_ranked": f"""
WITH f AS (SELECT person, thing, row_number() OVER (PARTITION BY person ORDER BY thing) AS rn FROM (SELECT DISTINCT person, thing FROM ({_TOUCH}) t WHERE person % 20 = 0) u),
m AS (SELECT f.person, t.item, max(t.day) AS day, count(DISTINCT t.thing) AS shared FROM f JOIN ({_TOUCH}) t ON t.thing = f.thing AND t.person <> f.person WHERE rn <= {FILES} GROUP BY f.person, t.item)
SELECT person, item, shared FROM (SELECT person, item, shared, row_number() OVER (PARTITION BY person ORDER BY shared DESC, day DESC, item) AS rn FROM m) t WHERE rn <= 10""",
    # evidence of five strengths; the strongest counts
    "joi27_strengths": """
WITH g AS (SELECT l_orderkey AS ref, l_partkey AS want, l_suppkey AS parent FROM {lineitem} WHERE l_linenumber <= 2),
c AS (SELECT l_orderkey AS ref, l_partkey AS k, l_suppkey AS parent, l_returnflag AS chunk FROM {lineitem} WHERE l_linenumber > 1),
x AS (SELECT g.ref, g.want, min(CASE WHEN c.k = g.want THEN 1 WHEN c.k = g.want + 1 AND c.chunk = 'R' THEN 2 WHEN c.k % 1000 = g.want % 1000 THEN 3 WHEN c.k % 100 = g.want % 100 THEN 4 WHEN c.parent = g.parent THEN 5 END) AS strength FROM g LEFT JOIN c ON c.ref = g.ref GROUP BY g.ref, g.want)
SELECT CASE strength WHEN 1 THEN 'key' WHEN 2 THEN 'chunk' WHEN 3 THEN 'provenance' WHEN 4 THEN 'prefix' WHEN 5 THEN 'parent' ELSE 'none' END AS strength, count(*) AS refs FROM x GROUP BY 1""",
    # truth apart from the ranking: labels grade what length ranks
    "grf28_retrieval": """
WITH r AS (SELECT d.doc_id, d.source, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY n_chars DESC, d.doc_id) AS rn FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id)
SELECT source, count(*) FILTER (WHERE quality = 1 AND rn <= 10) AS found, count(*) FILTER (WHERE quality = 1) AS wanted, round(count(*) FILTER (WHERE quality = 1 AND rn <= 10) / CAST(greatest(count(*) FILTER (WHERE quality = 1), 1) AS DOUBLE), 6) AS recall,
       count(*) FILTER (WHERE quality = 1 AND rn <= 1) > 0 AS hit_1, count(*) FILTER (WHERE quality = 1 AND rn <= 3) > 0 AS hit_3 FROM r GROUP BY source""",
    "agg28_cells": """
WITH r AS (SELECT user_id, event_type AS strategy, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS type, value / 100 AS recall, value > 50 AS hit FROM {events})
SELECT coalesce(strategy, 'all') AS strategy, coalesce(type, 'all') AS type, round(avg(recall), 6) AS recall, round(avg(CASE WHEN hit THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS hit, count(*) AS n FROM r GROUP BY GROUPING SETS ((strategy), (type), (strategy, type))""",
    "win05_timeline": f"""
SELECT id, kind, ref FROM (SELECT id, kind, ref, row_number() OVER (PARTITION BY id ORDER BY day NULLS LAST, kind, ref) AS rn FROM (
  SELECT o_custkey AS id, 'commit' AS kind, o_orderkey AS ref, CAST(o_orderdate AS DATE) AS day FROM {{orders}}
  UNION ALL SELECT user_id, 'status', event_id, CAST(ts AS DATE) FROM {{events}}
  UNION ALL SELECT o_custkey, 'version', l_orderkey * 10 + l_linenumber, CASE WHEN l_quantity > 40 THEN NULL ELSE CAST(l_shipdate AS DATE) END FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey) t) u WHERE rn <= {EVENTS}""",
    "win11_order": "SELECT conv_id, turn, CAST(row_number() OVER (ORDER BY round, conv_id) AS BIGINT) AS place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM {conversations}) t",
    # copies stand for one: the finest level first, then the best score, then the least id; the group keeps its best score; no text, no group
    "win15_finest": """
WITH b AS (SELECT md5(text) AS h, doc_id, length(lang) AS level, n_chars % 10 AS score FROM {documents} WHERE text IS NOT NULL),
g AS (SELECT h, max(level) AS level, max(score) AS best, count(*) AS copies FROM b GROUP BY h), r AS (SELECT b.h, min(b.doc_id) AS representative FROM b JOIN g ON g.h = b.h AND g.level = b.level AND g.best = b.score GROUP BY b.h)
SELECT g.h, r.representative, g.best, g.copies FROM g JOIN r ON r.h = g.h""",
    # sum over paths of weight, semantic and lexical factor; anchors stay on top
    "top07_weighted": """
WITH p AS (SELECT a.l_suppkey AS anchor, b.l_partkey AS k, sum(CASE a.l_returnflag WHEN 'A' THEN CAST(1.0 AS DOUBLE) WHEN 'N' THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END * CAST(0.55 AS DOUBLE)) AS w FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey WHERE a.l_suppkey % 20 = 0 GROUP BY a.l_suppkey, b.l_partkey),
s AS (SELECT p.anchor, p.k, w, p_retailprice AS sim, avg(p_retailprice) OVER (PARTITION BY anchor) AS mean, p_size AS lex, min(p_size) OVER (PARTITION BY anchor) AS lo, max(p_size) OVER (PARTITION BY anchor) AS hi FROM p JOIN {part} ON p_partkey = k)
SELECT anchor, k, score FROM (SELECT anchor, k, round(score, 4) AS score, row_number() OVER (PARTITION BY anchor ORDER BY round(score, 4) DESC, k) AS rn FROM (
  SELECT anchor, k, w * greatest(CAST(0.05 AS DOUBLE), 1 + 2 * (sim - mean) / 1000) * (1 + CASE WHEN hi = lo THEN 1 ELSE (lex - lo) / CAST(hi - lo AS DOUBLE) END) AS score FROM s) t) u WHERE rn <= 20""",
    "top12_reports": "SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM (SELECT min(doc_id) AS doc_id, min(source) AS source, min(n_chars) AS n_chars FROM {documents} WHERE lang = 'en' GROUP BY md5(text)) t) u WHERE rn <= 5",
    "top19_strata": "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('11|', CAST(doc_id AS STRING))), doc_id) AS rn FROM {documents}) t WHERE rn <= 8",
    "top20_water": "SELECT c_mktsegment, count(*) AS held, greatest(0, CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM {customer} GROUP BY c_mktsegment) m) AS BIGINT) - count(*)) AS poured FROM {customer} GROUP BY c_mktsegment",
    "top21_kept": "SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM {documents}) t WHERE rn <= 5",
    "grf07_applied": """
WITH c AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand, p_size, p_type) AS survivor FROM {part})
SELECT survivor, count(*) AS merged, count(*) - 1 AS ledger_rows, max(id) AS last_id FROM c GROUP BY survivor""",
}
_PAIRS = {
    "str14_script": (
        "SELECT doc_id, CASE WHEN regexp_count(text, '[\\\\u00C0-\\\\u00FF]') >= 0.02 * greatest(regexp_count(text, '[A-Za-z\\\\u00C0-\\\\u00FF]'), 1) THEN 'accented' ELSE 'plain' END AS script FROM {documents} WHERE text IS NOT NULL",
        "SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\\xC0-\\xFF]')) >= 0.02 * greatest(len(regexp_extract_all(text, '[A-Za-z\\xC0-\\xFF]')), 1) THEN 'accented' ELSE 'plain' END AS script FROM {documents} WHERE text IS NOT NULL",
    ),
    "hsh01_ids": (
        "SELECT l_suppkey, l_partkey, substr(sha1(concat(CAST(least(l_suppkey, l_partkey) AS STRING), '|', CAST(greatest(l_suppkey, l_partkey) AS STRING))), 1, 16) AS pair_id, substr(sha1(array_join(array_sort(collect_set(CAST(l_orderkey AS STRING))), '\n')), 1, 12) AS signature FROM {lineitem} GROUP BY l_suppkey, l_partkey",
        "SELECT l_suppkey, l_partkey, substr(sha1(concat(CAST(least(l_suppkey, l_partkey) AS STRING), '|', CAST(greatest(l_suppkey, l_partkey) AS STRING))), 1, 16) AS pair_id, substr(sha1(string_agg(DISTINCT CAST(l_orderkey AS STRING), chr(10) ORDER BY CAST(l_orderkey AS STRING))), 1, 12) AS signature FROM {lineitem} GROUP BY l_suppkey, l_partkey",
    ),
    "mth02_minmax": tuple(f"SELECT c_custkey, round(CASE WHEN hi = lo THEN 1.0 ELSE (c_acctbal - lo) / (hi - lo) END, 6) AS v FROM {{customer}} CROSS JOIN (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM {{customer}}) {name}" for name in ("m", "mm")),
}
# Gold pairs (of a brand, with keys that sum to a multiple of 5) against predicted groups; a merge that no gold pair grades counts apart. Pairs are
# counted by the remainders of their keys, none is made; the twin lists them all. Predicted groups are parts of gold ones, so no merge is wrong.
_GRADED = "n0 * (n0 - 1) DIV 2 + n1 * n4 + n2 * n3"
_REMAINDERS = ", ".join(f"count(*) FILTER (WHERE p_partkey % 5 = {r}) AS n{r}" for r in range(5))
_AGG34 = (
    f"""
WITH m AS (SELECT count(*) AS n, {_REMAINDERS} FROM {{part}} GROUP BY p_brand, p_type, p_size), s AS (SELECT {_REMAINDERS} FROM {{part}} GROUP BY p_brand, p_size),
t AS (SELECT coalesce(sum({_GRADED}), 0) AS tp, coalesce(sum(n * (n - 1) DIV 2 - ({_GRADED})), 0) AS ungraded, (SELECT coalesce(sum({_GRADED}), 0) FROM s) AS same FROM m)
SELECT tp, CAST(0 AS BIGINT) AS fp, same - tp AS fn, round(tp / CAST(greatest(tp, 1) AS DOUBLE), 6) AS p, round(tp / CAST(greatest(same, 1) AS DOUBLE), 6) AS r, round(2 * tp / CAST(greatest(tp + same, 1) AS DOUBLE), 6) AS f1, ungraded FROM t""",
    """
WITH g AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS grp FROM {part}),
pairs AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_brand = b.p_brand AND a.p_size = b.p_size AS same FROM {part} a JOIN {part} b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND (a.p_partkey + b.p_partkey) % 5 = 0),
s AS (SELECT same, x.grp = y.grp AS merged FROM pairs JOIN g x ON x.p_partkey = a JOIN g y ON y.p_partkey = b),
t AS (SELECT count(*) FILTER (WHERE same AND merged) AS tp, count(*) FILTER (WHERE NOT same AND merged) AS fp, count(*) FILTER (WHERE same AND NOT merged) AS fn FROM s)
SELECT tp, fp, fn, round(tp / CAST(greatest(tp + fp, 1) AS DOUBLE), 6) AS p, round(tp / CAST(greatest(tp + fn, 1) AS DOUBLE), 6) AS r, round(2 * tp / CAST(greatest(2 * tp + fp + fn, 1) AS DOUBLE), 6) AS f1,
       (SELECT count(*) FROM g x JOIN g y ON x.grp = y.grp AND x.p_partkey < y.p_partkey WHERE (x.p_partkey + y.p_partkey) % 5 <> 0) AS ungraded FROM t""",
)
_PAIRS["agg34_groups"] = _AGG34
QUERIES, ORACLES = register(_BOTH, _PAIRS)
