"""DuckDB SQL for what the corpus operators compute exactly, and queries for the exact columns of those that also train or draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import fingerprint, lm, mixing, pii
from lodestone.llm.common import documents

#: A to Z in both cases, and the pattern of a word.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = "[^\\x20\\x09-\\x0D]+"

#: Every byte that a repeated 200-byte string covers is cut out; bytes are pairs of hexadecimal digits here.
SUFFIX = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, k, md5(substr(h, 2 * k + 1, 400)) AS s FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS k FROM d) t),
g AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
m AS (SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS p FROM w SEMI JOIN g USING (s)),
i AS (SELECT r, k, sum(CASE WHEN p IS NULL OR k > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY k) AS run FROM m),
s AS (SELECT r, min(k) AS a, max(k) + 200 AS b FROM i GROUP BY r, run),
c AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM s),
o AS (SELECT d.r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM c JOIN d ON d.r = c.r GROUP BY d.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN o ON o.r = d.r"""


def _links(size: int, percent: int) -> str:
    """Sets of shingles of so many words, linked at so many hundredths, and their components; ids of documents are unique in the tables."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
x AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {size} THEN array_to_string(w, ' ') ELSE array_to_string(w[k : k + {size - 1}], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS k FROM d WHERE len(w) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= {percent} * (a.n + b.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT u AS doc_id, u AS seen FROM e UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.seen),
m AS (SELECT doc_id, min(seen) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""


JACCARD = _links(5, 75)
SETSKETCH = f"SELECT *, doc_id = component_id AS kept FROM ({_links(2, 80)})"

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT) WHEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT) > 4 THEN 2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INT) - 9 ELSE 2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INT) END)) % 10 = 0"
_KINDS = (
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
    ("ip", "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255"),
    ("card", "[0-9](?:[\\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END"),
    ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
)


def _spans(k: int, kind: str, pattern: str, test: str) -> str:
    """Valid matches of one kind: the start of a match is the length of all that precedes it, matches and what is between."""
    found = f"SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ss FROM t"
    steps = f"SELECT doc_id, ss, ms, unnest(range(1, len(ms) + 1)) AS i FROM ({found}) f WHERE len(ms) > 0"
    placed = f"SELECT doc_id, ms[i] AS m, length(ss[i]) AS s, i, sum(length(ss[i]) + length(ms[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM ({steps}) p"
    return f"SELECT doc_id, {k} AS k, '{kind}' AS kind, CAST(e - length(m) AS BIGINT) AS a, CAST(e AS BIGINT) AS b FROM ({placed}) q WHERE {test}"


PII_BASE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans(k, *of) for k, of in enumerate(_KINDS))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{of[0]}" for k, of in enumerate(_KINDS))}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS j FROM s GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"CAST(coalesce(n_{of[0]}, 0) AS BIGINT) AS n_{of[0]}" for of in _KINDS)}, sha256(coalesce(j, '')) AS base_sha256
FROM t LEFT JOIN g ON g.doc_id = t.doc_id"""


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(spark, sf_dir).drop("spans")


#: The targets by water-filling: a source is capped while its cap by weight lies below the level of those that are not.
MIX_TARGETS = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM d GROUP BY source),
f AS (SELECT *, 2.0 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS k FROM s),
v AS (SELECT a.k, (1.5 * (SELECT sum(source_size) FROM f) - coalesce((SELECT sum(cap) FROM f b WHERE b.k < a.k), 0)) / (SELECT sum(weight) FROM f b WHERE b.k >= a.k) AS level FROM f a),
c AS (SELECT f.*, level, cap <= level * weight AS capped FROM f JOIN v ON v.k = f.k),
u AS (SELECT arg_min(level, k) AS level FROM c WHERE NOT capped)
SELECT d.doc_id, d.size, c.source_size, round(CASE WHEN c.capped THEN c.cap ELSE least(u.level * c.weight, c.cap) END, 3) AS target
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN u ON true"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(spark, sf_dir).selectExpr("doc_id", "size", "source_size", "round(target, 3) AS target")


EDITS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nx FROM d)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2)) AS edited_sha256 FROM o"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.query(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def _crc_zero(modulus: int) -> str:
    """Is the CRC-32 of doc_id as text 0 modulo modulus: the table-free form, bit by bit."""
    table = "list_transform(range(0, 256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(0, 8) AS BIGINT[])), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    fold = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, ({table})[CAST(xor(c, b) & 255 AS INT) + 1]))"
    return f"xor({fold}, 4294967295) % {modulus} = 0"


LM_BASE = f"""
WITH d AS (SELECT doc_id, {_crc_zero(10)} AS held_out, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
t AS (SELECT doc_id, held_out, w, unnest(list_append(w, NULL)) AS x FROM d),
c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x),
n AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens,
       round(sum(log10((coalesce(c.c, 0) + 0.1) / (n.n + 0.1 * (n.v + 1)))), 4) AS base_score
FROM t LEFT JOIN c ON c.x IS NOT DISTINCT FROM t.x CROSS JOIN n GROUP BY doc_id, held_out"""


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), model=False).selectExpr("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "round(base_score, 4) AS base_score")


QUERIES = {"llm_pii_base": pii_base, "llm_mix_targets": mix_targets, "llm_edited_texts": edits, "llm_base_scores": lm_base}
ORACLES = {
    "op3_suffix_dedup": SUFFIX,
    "op9_ngram_jaccard": JACCARD,
    "op12_setsketch_dedup": SETSKETCH,
    "llm_pii_base": PII_BASE,
    "llm_mix_targets": MIX_TARGETS,
    "llm_edited_texts": EDITS,
    "llm_base_scores": LM_BASE,
}
