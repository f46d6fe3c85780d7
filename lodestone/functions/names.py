"""Names, labels, citations and anchors as column functions; JVM-side but for NFKC, which has no built-in form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words whose s is no plural, plurals by table, kinds of a citation by their pattern, in order.
KEEP_S = ("status", "kubernetes", "kafka-streams", "sales", "news", "series", "class", "access", "process", "bus", "analysis")
PLURALS = {"indices": "index", "vertices": "vertex", "people": "person", "children": "child", "data": "data"}
CITED = (
    ("issue", r"^[A-Z][A-Z0-9]+-[0-9]+$"),
    ("pull", r"^(?:PR ?)?#[0-9]+$"),
    ("sha", r"^[0-9a-f]{8,40}$"),
    ("short sha", r"^[0-9a-f]{4,7}$"),
    ("user", r"^@[A-Za-z0-9_.-]+$"),
    ("number", r"^[0-9]+$"),
    ("title", r"^[A-Za-z].*$"),
)
#: What a question may be anchored to.
ANCHORS = {
    "items": r"\b[A-Z][A-Z0-9]+-[0-9]+\b",
    "documents": r"\bKIP-[0-9]+\b",
    "shas": r"\b[0-9a-f]{8,40}\b",
    "persons": r"@[A-Za-z0-9_.-]+",
    "versions": r"\b[0-9]+\.[0-9]+(?:\.[0-9]+)*\b",
    "dates": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "quoted": r"\"[^\"\n]{2,60}\"",
    "names": r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b",
}


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    """NFKC and case folding."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


#: What a reference looks like, links first, and what a link leads to.
REFERENCES = (("url", r"https?://[^\s)\]>]+"), ("proposal", r"\bKIP-[0-9]+\b"), ("issue", r"\b[A-Z][A-Z0-9]+-[0-9]+\b"), ("pull", r"#[0-9]+\b"), ("user", r"\[~[A-Za-z0-9_.-]+\]|@[A-Za-z][A-Za-z0-9_.-]*"))
LINKED = (("issue", r"/browse/([A-Za-z][A-Za-z0-9]+-[0-9]+)"), ("pull", r"/pull/([0-9]+)"), ("proposal", r"/wiki/[^\s]*?([Kk][Ii][Pp]-[0-9]+)"))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def person_norm(name: Column) -> Column:
    """A name for comparison: folded, joiners and punctuation as spaces, squeezed; null if nothing is left."""
    return F.nullif(squeezed(F.regexp_replace(folded(name), r"[\p{P}\p{S}]+", " ")), F.lit(""))


def singular(word: Column) -> Column:
    """A word without its plural ending, by table first; short words and those in KEEP_S stay."""
    table = F.create_map(*[F.lit(x) for pair in PLURALS.items() for x in pair])
    plain = F.when(F.length(word) < 4, word).when(word.isin(*KEEP_S) | word.rlike("(?:ss|us|is)$"), word)
    cut = plain.when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(?:x|ch|sh|ss)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    return F.coalesce(F.try_element_at(table, word), cut)


def entity_norm(name: Column) -> Column:
    """An entity's name for comparison: lower case, no possessive, no punctuation, each word singular."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), "['’]s\\b", ""), "[^a-z0-9]+", " ")
    return F.array_join(F.transform(F.filter(F.split(F.trim(bare), " "), lambda x: F.length(x) > 0), singular), " ")


def label(kind: Column) -> Column:
    """A work-item type as a label in camel case; some types have a name of their own."""
    known = F.create_map(*[F.lit(x) for pair in (("1-URGENT", "Blocker"), ("4-NOT SPECIFIED", "Task")) for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.regexp_replace(F.initcap(F.lower(F.regexp_replace(kind, "[^A-Za-z]+", " "))), " ", ""))


def citations(body: Column) -> Column:
    """Bracketed tokens outside code fences that are no Markdown links, each with its kind; a short hash is named as a problem."""
    open_ = F.regexp_replace(body, "(?s)```.*?(?:```|$)", " ")
    tokens = F.filter(F.transform(F.regexp_extract_all(open_, F.lit(r"\[([^\[\]\n]{1,80})\](?!\()"), F.lit(1)), lambda x: F.trim(x)), lambda x: F.length(x) > 0)

    def classified(x: Column) -> Column:
        kind = F.lit("other")
        for name, pattern in reversed(CITED):
            kind = F.when(x.rlike(pattern), name).otherwise(kind)
        return F.struct(x.alias("token"), kind.alias("kind"), (kind == "short sha").alias("problem"))

    return F.transform(tokens, classified)


def anchors(text: Column) -> Column:
    """What a text is anchored to: distinct finds of each kind, in order of appearance; items that are documents count there only."""
    found = {k: F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0))) for k, p in ANCHORS.items()}
    found["items"] = F.array_except(found["items"], found["documents"])
    return F.struct(*[v.alias(k) for k, v in found.items()])


def references(text: Column) -> Column:
    """What a text refers to, in order of first appearance, each once: kind and key.

    One pattern finds links and bare keys at once, so what stands inside a link is not found again. A link to an item, a
    page or a change refers to that; keys in lower case count only where the host of a link says what they are.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("|".join(p for _, p in REFERENCES)), F.lit(0))

    def named(x: Column) -> Column:
        kind, key = F.lit("url"), x
        for name, pattern in reversed(REFERENCES[1:]):
            kind = F.when(x.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
        for name, pattern in LINKED:
            inside = F.regexp_extract(x, pattern, 1)
            hit = x.startswith("http") & (inside != "")
            kind, key = F.when(hit, name).otherwise(kind), F.when(hit, inside).otherwise(key)
        return F.struct(kind.alias("kind"), F.upper(F.regexp_replace(key, r"^[#@]|^\[~|\]$", "")).alias("key"))

    return F.array_distinct(F.transform(found, named))


def runs(text: Column) -> Column:
    """Test runs, a line each: key, verdict and note."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"^\s*[A-Z]+-[0-9]+:\s*(?:PASS|FAIL|BLOCKED)"))
    part = lambda x, k: F.regexp_extract(x, r"^\s*([A-Z]+-[0-9]+):\s*(PASS|FAIL|BLOCKED)\s*(.*)$", k)
    return F.transform(lines, lambda x: F.struct(part(x, 1).alias("key"), part(x, 2).alias("verdict"), F.nullif(F.trim(part(x, 3)), F.lit("")).alias("note")))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "str02_names": lambda spark, sf_dir: _table(spark, sf_dir, "customer").select("c_custkey", person_norm(F.concat_ws("_", "c_name", "c_mktsegment")).alias("norm")),
    "str04_entities": lambda spark, sf_dir: _table(spark, sf_dir, "part").select("p_partkey", entity_norm(F.concat_ws("'s ", "p_type", "p_name")).alias("norm")),
    "str18_labels": lambda spark, sf_dir: _table(spark, sf_dir, "orders").groupBy(label(F.col("o_orderpriority")).alias("label")).agg(F.count(F.lit(1)).alias("n")),
    "str21_citations": lambda spark, sf_dir: _table(spark, sf_dir, "orders").select("o_orderkey", F.explode(citations(F.concat(F.lit("see ["), F.col("o_orderkey"), F.lit("] and [link](x), ```[no]``` or [ABC-"), F.col("o_custkey"), F.lit("]")))).alias("c")).select("o_orderkey", "c.token", "c.kind", "c.problem"),
    "str07_anchors": lambda spark, sf_dir: _table(spark, sf_dir, "documents").select("doc_id", anchors(F.col("text")).alias("a")).select("doc_id", F.size("a.versions").cast("long").alias("versions"), F.size("a.dates").cast("long").alias("dates"), F.size("a.persons").cast("long").alias("persons")),
    "str19_runs": lambda spark, sf_dir: _table(spark, sf_dir, "orders").select("o_orderkey", F.explode(runs(F.concat(F.lit("XT-"), "o_orderkey", F.lit(": "), F.when(F.col("o_orderstatus") == "F", "PASS ok").otherwise("FAIL"), F.lit("\nno run\n XP-1: BLOCKED")))).alias("r")).select("o_orderkey", "r.key", "r.verdict", "r.note"),
}
_FOUND = "len(list_distinct(regexp_extract_all(coalesce(text, ''), '{}')))"
_PROSE = ("SELECT o_orderkey, 'see https://x.org/browse/item-' || o_orderkey || ' and ITEM-' || o_custkey || ', #' || o_orderkey % 100 || ' (KIP-' || o_custkey % 9 || ') by @u' || o_custkey % 5 || ' ITEM-' || o_custkey AS t FROM {}")
QUERIES["str01_references"] = lambda spark, sf_dir: spark.sql(_PROSE.format("{orders}"), orders=_table(spark, sf_dir, "orders")).select("o_orderkey", F.posexplode(references(F.col("t"))).alias("place", "r")).select("o_orderkey", F.col("place").cast("long").alias("place"), "r.kind", "r.key")
ORACLES = {
    "str01_references": """
SELECT o_orderkey, CAST(unnest([0, 1, 2, 3, 4]) AS BIGINT) AS place, unnest(['issue', 'issue', 'pull', 'proposal', 'user']) AS kind,
       unnest(['ITEM-' || o_orderkey, 'ITEM-' || o_custkey, '' || o_orderkey % 100, 'KIP-' || o_custkey % 9, 'U' || o_custkey % 5]) AS key FROM orders WHERE o_orderkey <> o_custkey
UNION ALL SELECT o_orderkey, CAST(unnest([0, 1, 2, 3]) AS BIGINT), unnest(['issue', 'pull', 'proposal', 'user']), unnest(['ITEM-' || o_orderkey, '' || o_orderkey % 100, 'KIP-' || o_custkey % 9, 'U' || o_custkey % 5]) FROM orders WHERE o_orderkey = o_custkey""",
    "str02_names": "SELECT c_custkey, trim(regexp_replace(lower(c_name || '_' || c_mktsegment), '[^a-z0-9]+', ' ', 'g')) AS norm FROM customer",
    "str18_labels": "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Blocker' WHEN '4-NOT SPECIFIED' THEN 'Task' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' END AS label, count(*) AS n FROM orders GROUP BY 1",
    "str21_citations": """
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS token, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) BETWEEN 4 AND 7 THEN 'short sha' WHEN length(CAST(o_orderkey AS VARCHAR)) >= 8 THEN 'sha' ELSE 'number' END AS kind, length(CAST(o_orderkey AS VARCHAR)) BETWEEN 4 AND 7 AS problem FROM orders
UNION ALL SELECT o_orderkey, 'ABC-' || o_custkey, 'issue', false FROM orders""",
    "str07_anchors": f"SELECT doc_id, {_FOUND.format(chr(92) + 'b[0-9]+' + chr(92) + '.[0-9]+(?:' + chr(92) + '.[0-9]+)*' + chr(92) + 'b')} AS versions, {_FOUND.format(chr(92) + 'b[0-9]{4}-[0-9]{2}-[0-9]{2}' + chr(92) + 'b')} AS dates, {_FOUND.format('@[A-Za-z0-9_.-]+')} AS persons FROM documents",
    "str19_runs": "SELECT o_orderkey, 'XT-' || o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN o_orderstatus = 'F' THEN 'ok' END AS note FROM orders UNION ALL SELECT o_orderkey, 'XP-1', 'BLOCKED', NULL FROM orders",
}
