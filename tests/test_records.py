"""Records, names, terms and communities against plain versions, with bad lines, nulls, repeats and empty tables."""

import itertools
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.operators import communities, terms
from lodestone.sources import records


def test_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1, "b": "x"}\n\n  \n{"a": null, "b": "y", "c": 2}\n')
    assert [tuple(r) for r in records.read_lines(spark, str(good), "a long, b string").collect()] == [(1, "x"), (None, "y")]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="bad line in .*bad.jsonl"):
        records.read_lines(spark, str(bad), "a long").collect()
    assert records.read_tolerant(spark, str(bad), "a long").count() == 1
    assert records.write_lines(spark.range(7), str(tmp_path / "out")) == 7
    assert records.read_lines(spark, str(tmp_path / "out"), "id long").count() == 7


def test_commits(spark):
    log = "\x1esha1\x1fann\x1fa@b\x1f2024-01-01\x1f fix \x1fbody\x1f\n a.py \n\nb.py\x1etoo\x1ffew\x1esha2\x1fb\x1fc\x1fd\x1fe\x1f\x1f"
    got = records.commits(spark.createDataFrame([(log,), (None,), ("",)], "value string")).collect()
    assert [(r.sha, r.subject, r.files) for r in got] == [("sha1", "fix", ["a.py", "b.py"]), ("sha2", "e", [])]


def test_issues(spark, tmp_path):
    raw = {
        "key": "K-1",
        "fields": {"summary": " A \n title ", "status": {"name": "In  Progress"}, "updated": "2024-01-02T03:04:05", "components": [{"name": " core  lib "}, {"name": None}], "issuelinks": [{"type": {"name": "Blocks"}, "outwardIssue": {"key": "K-2"}}, {"type": {"name": "Blocks"}, "inwardIssue": {"key": "K-3"}}]},
        "changelog": {"histories": [{"created": "2024-01-01T00:00:00", "author": "a", "items": [{"field": "status", "fromString": "Open", "to": "3"}]}, {"created": None, "items": [{"field": "x"}]}]},
    }
    (tmp_path / "raw.jsonl").write_text(json.dumps(raw) + "\n" + json.dumps({"key": "K-9"}) + "\n" + json.dumps({"fields": {}}) + "\n")
    got = {r.key: r for r in records.issues(records.read_lines(spark, str(tmp_path / "raw.jsonl"), records.ISSUE)).collect()}
    one, bare = got["K-1"], got["K-9"]
    assert (one.title, one.status, one.components) == ("A title", "In Progress", ["core lib"])
    assert [tuple(x) for x in one.links] == [("blocks", "K-2", "out"), ("blocks", "K-3", "in")]
    assert [(c["field"], c["from"], c["to"], c["by"]) for c in one.changelog] == [("status", "Open", "3", "a")]
    assert (bare.title, bare.components, bare.links, bare.changelog) == (None, [], [], []) and len(got) == 2


def test_merges(spark):
    held = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k long, name string, v double")
    fresh = spark.createDataFrame([(2, None, 5.0), (3, "c", None), (3, "c", None), (None, "x", 1.0)], "k long, name string, v double")
    once = records.merge_nodes(held, fresh, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1.0), (2, "b", 5.0), (3, "c", None)]
    assert sorted(map(tuple, records.merge_nodes(once, fresh, "k").collect())) == sorted(map(tuple, once.collect()))
    edges = spark.createDataFrame([(1, 2, "r")], "src long, dst long, rel string")
    more = spark.createDataFrame([(1, 2, "r"), (1, 2, "s"), (1, 9, "r"), (3, 1, "r"), (3, 1, "r")], "src long, dst long, rel string")
    merged = records.merge_edges(edges, more, once, "k", ["rel"])
    assert sorted(map(tuple, merged.collect())) == [(1, 2, "r"), (1, 2, "s"), (3, 1, "r")]
    assert records.without(once, F.col("v") > 2).count() == 2
    rows = spark.createDataFrame([(7, 1, 2), (7, 3, 1), (7, 3, 0), (None, 1, 1), (8, None, 5)], "k long, at long, src long")
    assert sorted(map(tuple, records.latest(rows, "k", "at", "src").collect())) == [(7, 3, 0), (8, None, 5)]
    assert records.digest(once).collect() == records.digest(once.orderBy(F.desc("k")).repartition(3)).collect() != records.digest(held).collect()
    wide = spark.createDataFrame([([1.0, 2.0],), (None,)], "e array<double>")
    assert records.vectors(wide, "e", 2).count() == 2
    with pytest.raises(Exception, match="not 3 wide"):
        records.vectors(wide, "e", 3).collect()


def test_names(spark):
    frame = spark.createDataFrame([("Ｊöhn_O'Brien-Smith",), ("  ",), (None,), ("Straße",)], "n string")
    assert [r[0] for r in frame.select(names.person_norm(F.col("n"))).collect()] == ["jöhn o brien smith", None, None, "strasse"]
    frame = spark.createDataFrame([("Kafka's Brokers",), ("Status classes",), ("indices & queries",), ("bus",)], "n string")
    assert [r[0] for r in frame.select(names.entity_norm(F.col("n"))).collect()] == ["kafka broker", "status class", "index query", "bus"]
    body = "see [KIP-1], [abc](http://x) ```\n[K-2]\n``` [#12] [deadbeef12] [dead1] [@me] [A title] []"
    got = spark.createDataFrame([(body,)], "b string").select(F.explode(names.citations(F.col("b"))).alias("c")).collect()
    assert [(r.c.token, r.c.kind, r.c.problem) for r in got] == [("KIP-1", "issue", False), ("#12", "pull", False), ("deadbeef12", "sha", False), ("dead1", "short sha", True), ("@me", "user", False), ("A title", "title", False)]
    a = spark.createDataFrame([("KIP-5 and ABC-7 since 3.6.1 by @bob on 2024-01-02, ABC-7",)], "t string").select(names.anchors(F.col("t")).alias("a")).first().a
    assert (a.items, a.documents, a.versions, a.persons, a.dates) == (["ABC-7"], ["KIP-5"], ["3.6.1"], ["@bob"], ["2024-01-02"])


def test_search(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("red fox ran far and sat".split()) for _ in range(rng.randint(1, 30))) for _ in range(40)] + [None, "", "fox"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms.write_index(docs, str(tmp_path / "i"))
    got = [tuple(r) for r in terms.search(spark, str(tmp_path / "i"), ("fox", "far"), ("sat",), 15).collect()]
    cut = {i: re.findall("[a-z0-9]+", t or "") for i, t in enumerate(texts)}
    cut = {i: w for i, w in cut.items() if w}
    mean, want = sum(map(len, cut.values())) / len(cut), []
    df = Counter(itertools.chain.from_iterable(map(set, cut.values())))
    for i, w in cut.items():
        s = sum((8 if t == "sat" else 1) * math.log(1 + (len(cut) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in ("fox", "far", "sat"))
        if s > 0:
            want.append((-round(s, 4), i))
    assert [i for i, _ in got] == [i for _, i in sorted(want)[:15]]
    assert terms.search(spark, str(tmp_path / "i"), ("nothing",)).count() == 0


def test_communities(spark):
    rng = random.Random(8)
    edges = [(10 * g + a, 10 * g + b, 1.0) for g in range(6) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.8] + [(10 * g, 10 * g + 13, 0.2) for g in range(5)]
    edges += [(3, 1, 0.5), (None, 4, 1.0), (5, 5, 1.0), (7, 60, None), (7, 70, -1.0)]
    rows, told = communities.levels(spark.createDataFrame(edges, "u long, v long, w double"))
    last = told[-1]
    groups = {}
    for r in rows.where(f"level = {last[0]}").collect():
        groups.setdefault(r.community, set()).add(r.node // 10)
    assert all(len(g) == 1 for g in groups.values()) and last[2] > 0.6
    assert all(min(n for n in members) == c for c, members in _members(rows, last[0]).items())
    assert communities.levels(spark.createDataFrame([], "u long, v long, w double"))[1] == []


def _members(rows, level):
    out = {}
    for r in rows.where(f"level = {level}").collect():
        out.setdefault(r.community, []).append(r.node)
    return out
