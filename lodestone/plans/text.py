"""Queries over texts, names and scores: tokens, scripts, references, shared runs, bands and fused ranks."""

from __future__ import annotations

from lodestone.plans import graph
from lodestone.plans.sql import register

#: The score bands, the least length of a chunk, the rank constant of reciprocal-rank fusion, words of a shared run.
AUTO, GREY, FLOOR, RANK, RUN = 0.92, 0.80, 20, 60, 8

_PROSE = "concat('see ITEM-', o_orderkey, ' and prop-', o_custkey, ', UTF-8 (#', o_orderkey % 1000, ') or ITEM-', o_orderkey)"
_KINDS = (("item", "ITEM-[0-9]+"), ("proposal", "prop-[0-9]+"), ("change", "#[0-9]+"))


def _references(explode: str, extract: str) -> str:
    """Keys by kind, each once an order; a key of no known kind is not a reference."""
    kinds = " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS kind, {explode}({extract.format(p)}) AS ref FROM (SELECT o_orderkey, {_PROSE} AS prose FROM {{orders}}) {k}" for k, p in _KINDS)
    return f"SELECT kind, upper(ref) AS ref, count(DISTINCT o_orderkey) AS mentions FROM ({kinds}) t GROUP BY kind, upper(ref)"


def _bands(knn: str) -> str:
    return f"SELECT CASE WHEN score >= {AUTO} THEN 'auto' WHEN score >= {GREY} THEN 'grey' ELSE 'dropped' END AS band, count(*) AS pairs FROM ({knn}) k GROUP BY 1"


_BOTH = {
    "flt14_floor": f"""
SELECT lang, count(*) AS n, count(*) FILTER (WHERE length(trim(coalesce(text, ''))) < {FLOOR}) AS rejected,
       min(length(trim(coalesce(text, '')))) AS shortest, max(length(trim(coalesce(text, '')))) AS longest FROM {{documents}} GROUP BY lang""",
    "sec01_reasons": f"""
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'empty' WHEN length(trim(text)) < {FLOOR} THEN 'short' WHEN quality IS NULL THEN 'unlabelled'
              WHEN quality = 0 THEN 'poor' WHEN toxic = 1 THEN 'toxic' ELSE 'eligible' END AS reason
  FROM {{documents}} d LEFT JOIN {{labels}} l ON l.doc_id = d.doc_id) t GROUP BY reason""",
    "top04_rrf": f"""
SELECT user_id, event_id, round(1 / CAST({RANK} + by_value AS DOUBLE) + 1 / CAST({RANK} + by_time AS DOUBLE), 8) AS score FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS by_value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS by_time FROM {{events}}) t""",
    "top16_natural_sort": """
SELECT c_custkey, regexp_replace(c_name, '[0-9]+$', '') AS stem, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS number
FROM {customer} ORDER BY stem, number, c_custkey""",
}
_PAIRS = {
    "str01_refs": (_references("explode", "regexp_extract_all(prose, '{}', 0)"), _references("unnest", "regexp_extract_all(prose, '{}')")),
    "str03_tokens": (
        "SELECT doc_id, size(array_distinct(filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+', 0), x -> length(x) > 1))) AS tokens FROM {documents}",
        "SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) > 1))) AS tokens FROM {documents}",
    ),
    "str14_lang": (
        "SELECT doc_id, round(length(regexp_replace(text, '[^\\\\u00C0-\\\\u00FF]', '')) / CAST(length(text) AS DOUBLE), 6) AS accented FROM {documents} WHERE length(text) > 0",
        "SELECT doc_id, round(length(regexp_replace(text, '[^\\x{{C0}}-\\x{{FF}}]', '', 'g')) / CAST(length(text) AS DOUBLE), 6) AS accented FROM {documents} WHERE length(text) > 0".replace("{{", "{").replace("}}", "}"),
    ),
    # Runs are joined by 64-bit hashes, so that a shuffled row takes 16 bytes and not a run of words.
    "str23_leak": (
        f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+', 0) AS w FROM {{documents}}), b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+', 0) AS w FROM {{benchmark}}),
x AS (SELECT doc_id, explode(array_distinct(transform(sequence(1, size(w) - {RUN - 1}), i -> xxhash64(array_join(slice(w, i, {RUN}), ' '))))) AS g FROM d WHERE size(w) >= {RUN}),
y AS (SELECT item_id, explode(array_distinct(transform(sequence(1, size(w) - {RUN - 1}), i -> xxhash64(array_join(slice(w, i, {RUN}), ' '))))) AS g FROM b WHERE size(w) >= {RUN})
SELECT item_id, doc_id, count(*) AS runs FROM x JOIN y ON x.g = y.g GROUP BY item_id, doc_id""",
        f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {{documents}}), b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {{benchmark}}),
x AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - {RUN - 2}), lambda i: array_to_string(w[i : i + {RUN - 1}], ' ')))) AS g FROM d WHERE len(w) >= {RUN}),
y AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - {RUN - 2}), lambda i: array_to_string(w[i : i + {RUN - 1}], ' ')))) AS g FROM b WHERE len(w) >= {RUN})
SELECT item_id, doc_id, count(*) AS runs FROM x JOIN y ON x.g = y.g GROUP BY item_id, doc_id""",
    ),
    "mth03_band": tuple(_bands(text) for text in graph._PAIRS["joi21_knn"]),
}
QUERIES, ORACLES = register(_BOTH, _PAIRS)
