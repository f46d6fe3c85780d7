"""Every tool answers in the envelope, bounded by its limit."""

import pytest

from lodestone.surface import EXAMPLES, Answer, Engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, SF, limit=5)


def test_routes(engine):
    got = [engine.route(q).items[0]["strategy"] for q in ("When was it fixed?", "why so", "What breaks?", "Summarise: overall themes", "who is Ann", "tell me")]
    assert got == ["temporal", "rationale", "impact", "global", "lookup", "hybrid"]


def test_answers(engine, spark):
    line = spark.read.parquet(f"{SF}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").first()
    answers = {
        "search": engine.search_chunks("the and"),
        "context": engine.search_with_context("the and"),
        "lookup": engine.lookup(line.l_orderkey),
        "local": engine.local_search(line.l_orderkey),
        "global": engine.global_search(),
        "status": engine.status_at(1, "2024-01-15"),
        "timeline": engine.timeline(1),
        "changes": engine.changes_between(3, 7),
        "assignees": engine.assignees_over_time(1),
        "impact": engine.impact(line.l_partkey),
        "explain": engine.explain_edge(line.l_orderkey, line.l_partkey),
        "run": engine.run_query("parts of an order", line.l_orderkey),
        "ask": engine.ask("what does the text say"),
    }
    for name, a in answers.items():
        assert isinstance(a, Answer) and len(a.items) <= 5 and a.latency_ms >= 0, name
    assert answers["explain"].items[0]["line"] == line.l_linenumber and answers["ask"].route == "hybrid"
    assert answers["impact"].items[0]["layer"] == 1 and all(3 < i["version"] <= 7 for i in answers["changes"].items)
    scores = [i["score"] for i in answers["search"].items]
    assert scores == sorted(scores, reverse=True) and len(scores) == 5 and answers["search"].truncated
    assert engine.search_chunks("!?").items == [] and engine.lookup(-1).items == []
    assert len(engine.get_schema().items) == 14 and len(engine.query_examples().items) == len(EXAMPLES)


def test_ask_goes_where_the_route_says(engine, spark):
    line = spark.read.parquet(f"{SF}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").first()
    asked = {
        "what was the status of 1 on 2024-01-15": ("temporal", "s6", {"status", "changes"}),
        "what changed since 3, before 7": ("temporal", "s6", {"version", "key"}),
        f"what does {line.l_partkey} affect": ("impact", "impact", {"layer", "key", "weight"}),
        f"what is {line.l_orderkey}": ("lookup", "lookup", {"label", "rel", "key"}),
        f"why does {line.l_orderkey} need {line.l_partkey}": ("rationale", "explain", {"rel", "line", "source"}),
        "why the and": ("rationale", "s1", {"key", "score", "source", "snippet"}),
        "overall": ("global", "s5", {"key", "size", "chars"}),
    }
    for question, (route, strategy, names) in asked.items():
        a = engine.ask(question)
        assert (a.route, a.strategy) == (route, strategy) and a.items and set(a.items[0]) == names and a.tokens > 0, question


def test_local_search_and_paths(engine, spark):
    key = spark.read.parquet(f"{SF}/lineitem.parquet").agg({"l_orderkey": "min"}).first()[0]
    top = engine.local_search(key).items
    assert all(i["evidence"].startswith(f"o{key}>") and i["evidence"].endswith(f">{i['key']}") for i in top)
    assert [i["score"] for i in top] == sorted((i["score"] for i in top), reverse=True) and top[0]["hops"] == 1
    assert engine.explain_edge(-1, key).items == []
