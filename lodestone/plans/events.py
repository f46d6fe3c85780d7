"""Queries over the event log beyond status at a date: intervals, timelines, windows, comparisons."""

from __future__ import annotations

from lodestone.plans.sql import register

_LOG = "SELECT user_id, event_id, event_type, ts, value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM {events}"
#: The terms of the ranking query.
TERMS = ("the", "and", "der", "que")
_EACH = tuple(enumerate(TERMS))
_BM25 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+', 0) AS w FROM {{documents}}),
d AS (SELECT doc_id, sum(size(w)) AS dl, {", ".join(f"sum(size(filter(w, x -> x = '{t}'))) AS tf{i}" for i, t in _EACH)} FROM w GROUP BY doc_id HAVING sum(size(w)) > 0),
q AS (SELECT d.*, (SELECT struct(count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count_if(tf{i} > 0) AS df{i}" for i, _ in _EACH)}) FROM d) AS c FROM d)
SELECT doc_id, round({" + ".join(f"ln(1 + (c.n - c.df{i} + 0.5D) / (c.df{i} + 0.5D)) * tf{i} * 2.2D / (tf{i} + 1.2D * (0.25D + 0.75D * dl / c.avgdl))" for i, _ in _EACH)}, 4) AS score
FROM q WHERE {" + ".join(f"tf{i}" for i, _ in _EACH)} > 0"""
_BOTH = {
    "win01_intervals": f"SELECT event_type, count(*) AS intervals, count(nx) AS closed FROM ({_LOG}) t GROUP BY event_type",
    "win04_timeline": """
SELECT user_id, event_id, rn, round(1 - (rn - 1) / CAST(n AS DOUBLE), 4) AS weight FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n
  FROM {events}) t""",
    "agg22_merge_intervals": f"""
SELECT user_id, event_type, count(*) AS n, min(ts) AS valid_from, bool_or(nx IS NULL) AS is_open,
       CASE WHEN bool_or(nx IS NULL) THEN NULL ELSE max(nx) END AS valid_to FROM ({_LOG}) t GROUP BY user_id, event_type""",
    "win03_first_set": """
SELECT user_id, coalesce(min(ts) FILTER (WHERE event_type = 'purchase'), min(ts) FILTER (WHERE event_type = 'signup')) AS dated,
       CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'purchase'
            WHEN count(*) FILTER (WHERE event_type = 'signup') > 0 THEN 'signup' ELSE 'none' END AS dated_by
FROM {events} GROUP BY user_id""",
    "agg33_pairwise": """
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, CASE WHEN a IS NULL THEN 'b' WHEN b IS NULL THEN 'a' WHEN a > b THEN 'a' WHEN b > a THEN 'b' ELSE 'tie' END AS winner
FROM (SELECT user_id, min(ts) AS ts, max(value) FILTER (WHERE hour(ts) % 2 = 0) AS a, max(value) FILTER (WHERE hour(ts) % 2 = 1) AS b
      FROM {events} GROUP BY user_id, CAST(ts AS DATE)) t""",
    "win11_interleave": """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round,
       count(*) OVER (PARTITION BY conv_id) AS turns FROM {conversations}""",
    "agg34_prf": """
SELECT tp, fp, fn, tn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS p, round(tp / CAST(tp + fn AS DOUBLE), 6) AS r FROM (
  SELECT count(*) FILTER (WHERE quality = 1 AND n_chars >= 500) AS tp, count(*) FILTER (WHERE quality = 0 AND n_chars >= 500) AS fp,
         count(*) FILTER (WHERE quality = 1 AND n_chars < 500) AS fn, count(*) FILTER (WHERE quality = 0 AND n_chars < 500) AS tn
  FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id) t""",
    "str13_tokens_est": "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS token_est FROM {documents}",
    # counted by a digest of the text and joined back: no group of copies meets in one task, no text is shuffled
    "win15_rep": """
WITH g AS (SELECT md5(text) AS h, min(doc_id) AS representative, count(*) AS copies FROM {documents} GROUP BY md5(text))
SELECT d.doc_id, g.representative, g.copies FROM {documents} d JOIN g ON md5(d.text) IS NOT DISTINCT FROM g.h""",
}
_PAIRS = {
    "hsh01_chunk_id": (
        "SELECT doc_id, sha1(concat_ws('|', CAST(doc_id AS STRING), 'section', '0', text)) AS chunk_id FROM {documents}",
        "SELECT doc_id, sha1(concat_ws('|', CAST(doc_id AS VARCHAR), 'section', '0', text)) AS chunk_id FROM {documents}",
    ),
    "joi15_version_window": (
        """
SELECT p_partkey, concat(CAST(p_size DIV 10 AS STRING), '.', CAST(p_size % 10 AS STRING), '.0') AS version FROM {part}
WHERE array(p_size DIV 10, p_size % 10, 0) > array(1L, 5, 0) AND array(p_size DIV 10, p_size % 10, 0) <= array(3L, 2, 0)""",
        """
SELECT p_partkey, concat(CAST(p_size // 10 AS VARCHAR), '.', CAST(p_size % 10 AS VARCHAR), '.0') AS version FROM {part}
WHERE (p_size // 10) * 100 + p_size % 10 * 10 > 150 AND (p_size // 10) * 100 + p_size % 10 * 10 <= 320""",
    ),
    # Spark's form cuts each text into words once and counts the terms in place; the second pass is for the corpus figures.
    "top03_bm25": (
        _BM25,
        """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {documents}),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ('the', 'and', 'der', 'que') GROUP BY doc_id, term),
l AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term)
SELECT f.doc_id, round(sum(ln(1 + ((SELECT n FROM s) - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * f.tf * 2.2::DOUBLE / (f.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / (SELECT avgdl FROM s)))), 4) AS score
FROM f JOIN l ON l.doc_id = f.doc_id JOIN d ON d.term = f.term GROUP BY f.doc_id""",
    ),
}
QUERIES, ORACLES = register(_BOTH, _PAIRS)
