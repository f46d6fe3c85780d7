"""The engine's public surface: one method per tool, each a parameterised query whose answer comes in one envelope.

An answer holds at most `limit` items, so what reaches the driver is bounded; everything before that is a Spark plan. The
given tables stand for the graph: orders are items, parts things, customers people, documents and their terms text.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import paths, terms

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Characters of a token, hops around an item of a local search.
TOKEN, AROUND = 4, 2
_DAY = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
#: The first rule that matches a question names its strategy; without a match it is hybrid.
ROUTES = (
    ("temporal", r"\b(?:when|before|after|since|until|on [0-9]{4})\b|[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("rationale", r"\b(?:why|reason|because|motivat)"),
    ("impact", r"\b(?:depend|affect|break|impact)"),
    ("global", r"\b(?:overall|summar|in general|themes?)\b"),
    ("lookup", r"^\s*(?:what is|who is|which)\b"),
)
EXAMPLES = {
    "orders of a customer": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = :k ORDER BY o_orderkey",
    "parts of an order": "SELECT l_partkey, l_quantity FROM lineitem WHERE l_orderkey = :k ORDER BY l_partkey, l_linenumber",
}


@dataclass
class Answer:
    """The envelope of every tool."""

    strategy: str
    items: list[dict[str, Any]] = field(default_factory=list)
    truncated: bool = False
    latency_ms: int = 0
    route: str | None = None
    tokens: int = 0


class Engine:
    """The tools over one data set."""

    def __init__(self, spark: SparkSession, sf_dir: str, limit: int = 25):
        self.spark, self.sf_dir, self.limit = spark, sf_dir, limit

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **args: Any) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if f"{{{t}}}" in text}
        return self.spark.sql(text, args=args, **used)

    def _answer(self, strategy: str, rows: DataFrame, limit: int | None = None, route: str | None = None) -> Answer:
        began, limit = time.time(), limit or self.limit
        got = [r.asDict(recursive=True) for r in rows.limit(limit + 1).collect()]
        size = sum(len(json.dumps(r, default=str, ensure_ascii=False)) for r in got[:limit])
        return Answer(strategy, got[:limit], len(got) > limit, int(1000 * (time.time() - began)), route, -(-size // TOKEN))

    def route(self, question: str) -> Answer:
        """The strategy of a question, the pattern that named it, and whether one did."""
        for strategy, pattern in ROUTES:
            if re.search(pattern, question, re.IGNORECASE):
                return Answer("route", [{"strategy": strategy, "reason": pattern, "confident": True}])
        return Answer("route", [{"strategy": "hybrid", "reason": "no rule", "confident": False}])

    def search_chunks(self, query: str, keys: tuple[str, ...] = ()) -> Answer:
        """Documents by BM25 over the words of the query, with a snippet."""
        words = tuple(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))
        if not words:
            return Answer("s1")
        found = terms.search(self.spark, terms.index(self.spark, self.sf_dir), words, keys, self.limit + 1)
        rows = F.broadcast(found).join(self.table("documents"), "doc_id").select(F.col("doc_id").alias("key"), "score", "source", F.left("text", F.lit(80)).alias("snippet"))
        return self._answer("s1", rows.orderBy(F.col("score").desc(), "key"))

    def search_with_context(self, query: str) -> Answer:
        """The best document of each source, and how many others of the source match."""
        words = tuple(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))
        if not words:
            return Answer("s2")
        found = terms.search(self.spark, terms.index(self.spark, self.sf_dir), words, (), 10 * self.limit)
        rows = F.broadcast(found).join(self.table("documents"), "doc_id").groupBy("source").agg(F.max("score").alias("score"), F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("key"), (F.count(F.lit(1)) - 1).alias("others"))
        return self._answer("s2", rows.orderBy(F.col("score").desc(), "source"))

    def lookup(self, key: int) -> Answer:
        """A node by key, the first label that has it, and its neighbours, nearest kinds first."""
        text = """
WITH n AS (SELECT 'order' AS label, 0 AS place FROM {orders} WHERE o_orderkey = :k UNION ALL SELECT 'part', 1 FROM {part} WHERE p_partkey = :k UNION ALL SELECT 'customer', 2 FROM {customer} WHERE c_custkey = :k),
e AS (SELECT 'order' AS label, l_returnflag AS rel, l_partkey AS key FROM {lineitem} WHERE l_orderkey = :k UNION ALL SELECT 'part', l_returnflag, l_orderkey FROM {lineitem} WHERE l_partkey = :k UNION ALL SELECT 'customer', 'placed', o_orderkey FROM {orders} WHERE o_custkey = :k)
SELECT e.label, rel, key FROM e JOIN (SELECT min_by(label, place) AS label FROM n) m ON m.label = e.label ORDER BY rel, key"""
        return self._answer("lookup", self._sql(text, k=key))

    def local_search(self, key: int) -> Answer:
        """What lies around an order, by the weights of all walks to it; each with its hops and the strongest walk as evidence."""
        anchor = self.spark.createDataFrame([(f"o{key}",)], "anchor string")
        found = paths.walks(paths.graph(self.spark, self.sf_dir), anchor, AROUND)
        best = found.groupBy("node").agg(F.max_by(F.array_join("path", ">"), F.struct("weight", "path")).alias("evidence"))
        rows = paths.weighed(found).join(best, "node").select(F.col("node").alias("key"), "hops", "paths", F.round("weight", 6).alias("score"), "evidence")
        return self._answer("s3", rows.orderBy(F.col("score").desc(), "key"))

    def global_search(self) -> Answer:
        """Sources by their documents, the widest first."""
        return self._answer("s5", self._sql("SELECT source AS key, count(*) AS size, sum(n_chars) AS chars FROM {documents} GROUP BY source ORDER BY size DESC, key"))

    def get_schema(self) -> Answer:
        """Tables and their columns."""
        rows = [{"table": t, "columns": dict(self.table(t).dtypes)} for t in TABLES]
        return Answer("schema", rows)

    def query_examples(self) -> Answer:
        return Answer("examples", [{"title": k, "query": v} for k, v in EXAMPLES.items()])

    def run_query(self, title: str, key: int) -> Answer:
        """A query of the example bank with its parameter; no other text is run."""
        text = re.sub(r"\b(" + "|".join(TABLES) + r")\b", r"{\1}", EXAMPLES[title])
        return self._answer("s4", self._sql(text, k=key))

    def status_at(self, user: int, day: str) -> Answer:
        """The last status by the end of a day; "not yet" where all changes are later, since a change does not name what it replaced."""
        text = """
SELECT coalesce(max_by(event_type, struct(ts, event_id)) FILTER (WHERE ts < CAST(:d AS DATE) + INTERVAL '1' DAY), 'not yet') AS status, count(*) AS changes FROM {events} WHERE user_id = :k"""
        return self._answer("s6", self._sql(text, k=user, d=day))

    def timeline(self, user: int) -> Answer:
        return self._answer("s6", self._sql("SELECT ts, event_type AS kind, event_id AS key FROM {events} WHERE user_id = :k ORDER BY ts, event_id", k=user))

    def changes_between(self, low: int, high: int) -> Answer:
        """Things of versions after low, up to and with high."""
        return self._answer("s6", self._sql("SELECT p_size AS version, p_partkey AS key FROM {part} WHERE p_size > :a AND p_size <= :b ORDER BY version, key", a=low, b=high))

    def assignees_over_time(self, customer: int) -> Answer:
        text = "SELECT o_orderstatus AS holder, min(o_orderdate) AS since, max(o_orderdate) AS until, count(*) AS spells FROM {orders} WHERE o_custkey = :k GROUP BY o_orderstatus ORDER BY since, holder"
        return self._answer("s6", self._sql(text, k=customer))

    def impact(self, part: int) -> Answer:
        """What a part touches: its orders first, then their customers."""
        text = """
SELECT 1 AS layer, l_orderkey AS key, max(l_extendedprice) AS weight FROM {lineitem} WHERE l_partkey = :k GROUP BY l_orderkey
UNION ALL SELECT 2, o_custkey, max(o_totalprice) FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_partkey = :k GROUP BY o_custkey ORDER BY layer, weight DESC, key"""
        return self._answer("impact", self._sql(text, k=part))

    def explain_edge(self, order: int, part: int) -> Answer:
        """The edges between two nodes, with what they rest on; without one, the suppliers that both touch; without these, the shortest path."""
        direct = self._answer("explain", self._sql("SELECT l_returnflag AS rel, l_linenumber AS line, l_suppkey AS source FROM {lineitem} WHERE l_orderkey = :a AND l_partkey = :b ORDER BY line", a=order, b=part))
        if direct.items:
            return direct
        shared = self._answer("explain", self._sql("SELECT DISTINCT x.l_suppkey AS via FROM {lineitem} x JOIN {lineitem} y ON x.l_suppkey = y.l_suppkey WHERE x.l_orderkey = :a AND y.l_partkey = :b ORDER BY via", a=order, b=part))
        if shared.items:
            return shared
        pair = self.spark.createDataFrame([(f"o{order}", f"p{part}")], "a string, b string")
        return self._answer("explain", paths.shortest(pair, paths.graph(self.spark, self.sf_dir)).select("hops", "path", "rels"))

    def ask(self, question: str) -> Answer:
        """A question by its route and the numbers and days in it; text search where its tool would lack one of them."""
        strategy = self.route(question).items[0]["strategy"]
        days = re.findall(_DAY, question)
        numbers = [int(n) for n in re.findall(r"\b[0-9]+\b", re.sub(_DAY, " ", question))]
        if strategy == "global":
            answer = self.global_search()
        elif strategy == "temporal" and days and numbers:
            answer = self.status_at(numbers[0], days[0])
        elif strategy == "temporal" and len(numbers) > 1:
            answer = self.changes_between(*sorted(numbers[:2]))
        elif strategy == "temporal" and numbers:
            answer = self.timeline(numbers[0])
        elif strategy == "impact" and numbers:
            answer = self.impact(numbers[0])
        elif strategy == "lookup" and numbers:
            answer = self.lookup(numbers[0])
        elif strategy == "rationale" and len(numbers) > 1:
            answer = self.explain_edge(*numbers[:2])
        else:
            answer = self.search_chunks(question)
        answer.route = strategy
        return answer
