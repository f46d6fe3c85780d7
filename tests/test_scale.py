"""Work that must grow with the tables: rows that the steps of a plan put out, and the results that go with it."""

import hashlib
import random

import pandas as pd
import pyarrow as pa
import pytest

from lodestone.llm import lm, twins
from lodestone.operators import chunks, overlap, resolution, terms
from lodestone.plans import catalogue, census, more, sql
from lodestone.sources.storage import fresh_folder
from lodestone.streaming import items


def most_rows(df) -> int:
    """The most rows that one step of the plan of a collected DataFrame has put out."""

    def walk(node) -> int:
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        rows = node.metrics().get("numOutputRows")
        below = [node.plan()] if node.nodeName().endswith("QueryStage") else [node.children().apply(k) for k in range(node.children().size())]
        return max([rows.get().value() if rows.isDefined() else 0, *(walk(x) for x in below)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_digest_of_a_source_stands_for_every_bit_of_its_texts(spark, tmp_path):
    rows = [(1, "b", "x"), (2, None, "x"), (3, "a", None), (4, "b", "x"), (5, "a", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def digest(*texts):
        return hashlib.sha256("\n".join(sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)).encode()).hexdigest()

    got = {tuple(r) for r in catalogue.QUERIES["sec39_digests"](spark, str(tmp_path)).collect()}
    assert got == {("x", digest("b", "", "b"), 3), (None, digest("a"), 1), ("y", digest("a"), 1)}


def put(spark, tmp_path, **tables) -> str:
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_parts_of_one_title_are_not_paired(spark, tmp_path):
    rows = [(i, "old part x-y" if i % 2 else "old x y") for i in range(400)] + [(1000, None), (1001, None), (1002, "one"), (7, "one")]
    df = catalogue.QUERIES["grf03_titles"](spark, put(spark, tmp_path, part=(rows, "p_partkey long, p_name string")))
    assert {tuple(r) for r in df.collect()} == {(i, 0) for i in range(1, 400)} | {(1002, 7)}
    assert most_rows(df) <= 2 * len(rows)


def test_parts_of_one_name_are_not_paired_for_scope(spark, tmp_path):
    parts = [(i, "n", "b") for i in range(400)] + [(500, None, "b"), (501, None, "b"), (502, "n", "c"), (503, "m", "c"), (503, "k", "c"), (504, "k", "c")]
    lines = [(i, 50.0) for i in range(300)] + [(500, 46.0), (503, 46.0), (502, 45.0)]
    tables = put(spark, tmp_path, part=(parts, "p_partkey long, p_name string, p_brand string"), lineitem=(lines, "l_partkey long, l_quantity double"))
    df = catalogue.QUERIES["flt07_scope"](spark, tables)
    assert {tuple(r) for r in df.collect()} == {(i, int(i < 300)) for i in range(400)} | {(500, 1), (503, 1), (504, 0)}
    assert most_rows(df) <= 2 * len(parts)


def test_shares_are_cut_before_they_are_shuffled(spark, tmp_path):
    lines = [(i, i % 7, "ANRX"[i % 4], float(i % 1000)) for i in range(4000)]
    df = catalogue.QUERIES["top18_shares"](spark, put(spark, tmp_path, lineitem=(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_extendedprice double")))
    got = [tuple(r) for r in df.collect()]
    for flag, many in (("A", 100), ("N", 60), ("R", 40)):
        best = sorted((x for x in lines if x[2] == flag), key=lambda x: (-x[3], x[0], x[1]))[:many]
        assert sorted(r[1:] for r in got if r[0] == flag) == sorted(x[:2] for x in best)
    assert len(got) == 200 and "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_large_blocks_are_dealt_to_tasks(spark, tmp_path):
    parts = [(i, "b", "t", 1) for i in range(2100)] + [(6000, "b", "t", 2), (6001, "b", "t", 2), (6002, "b", None, 2), (6003, "c", "t", 2)]
    df = catalogue.QUERIES["joi19_blocked"](spark, put(spark, tmp_path, part=(parts, "p_partkey long, p_brand string, p_type string, p_size int")))
    n, ids, wrong = df.selectExpr("count(*)", "count(DISTINCT struct(a, b))", "count_if(a >= b OR (a >= 6000) <> (b >= 6000))").first()
    assert (n, ids, wrong) == (2100 * 2099 // 2 + 1,) * 2 + (0,)
    assert "deal" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("least", [2, 3])
def test_sets_meet_by_subsets(spark, least, monkeypatch):
    monkeypatch.setattr(overlap, "MOST", 20)  # so that sets of more than five or six items count as large
    monkeypatch.setattr(overlap, "DEAL", 3)
    deal = random.Random(least)
    sets = {k: set(deal.sample(range(25), deal.choice((1, 2, 4, 5, 9)))) for k in range(60)} | {90: {1, 2, 3}, 91: {1, 2, 3}, 92: set(range(25))}
    rows = [(k, x) for k, s in sets.items() for x in s] + [(90, 1), (90, None), (None, 1)]
    frame = spark.createDataFrame(rows, "key long, item long")
    for asked in (None, 20):
        pairs = [(a, b, s & t) for a, s in sets.items() for b, t in sets.items() if (a < b if asked is None else a != b and a % asked == 0) and len(s & t) >= least]
        condition = None if asked is None else frame.key % asked == 0
        assert sorted(tuple(r) for r in overlap.shared(frame, least, condition).collect()) == sorted((a, b, x) for a, b, both in pairs for x in both)
        assert {tuple(r) for r in overlap.counted(frame, least, condition).collect()} == {(a, b, len(both)) for a, b, both in pairs}


def test_listed_pairs_have_their_first_items(spark):
    deal = random.Random(9)
    sets = {k: set(deal.sample(range(30), deal.choice((1, 3, 8)))) for k in range(40)}
    frame = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "key long, item long")
    want = [(a, b, x) for a in sets for b in sets if a < b for x in sorted(sets[a] & sets[b])[:2]]
    assert sorted(tuple(r) for r in overlap.listed(frame, 2).collect()) == sorted(want)


def test_verdicts_join_on_both_ends(spark, tmp_path):
    rows = [(i, i // 300) for i in range(600)] + [(3, 0), (None, 0), (900, None)]
    df = resolution._forbidden(spark, put(spark, tmp_path, embeddings=(rows, "vec_id long, label int")))
    want = [(a, b) for a, x in rows for b, y in rows if None not in (a, b, x) and x == y and a < b <= a + 7]
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    assert most_rows(df) <= 7 * len(rows)


def test_postings_are_blocks_and_equal_ids_one_document(spark, tmp_path):
    rows = [(i, "Red fox red") for i in range(50)] + [(7, "fox owl"), (None, "fox"), (None, "owl"), (60, None), (61, "--")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    terms.write_index(docs, str(tmp_path / "i"))
    blocks = spark.read.parquet(str(tmp_path / "i/postings"))
    got = {(r.term, d): n for r in blocks.collect() for d, n in zip(r.docs, r.tfs, strict=True)}
    want = {(t, i): n for i in range(50) for t, n in (("red", 2), ("fox", 1))} | {("fox", 7): 2, ("owl", 7): 1, ("fox", None): 1, ("owl", None): 1}
    assert got == want and blocks.count() < 10
    lengths = {tuple(r) for r in spark.read.parquet(str(tmp_path / "i/lengths")).collect()}
    assert lengths == {(i, 3) for i in range(50) if i != 7} | {(7, 5), (None, 2)}


def test_state_of_an_item_is_read_and_written_once_a_batch():
    calls, held = [], []

    class State:
        def get(self):
            calls.append("get")
            return iter(list(held))

        def put(self, rows):
            calls.append("put")
            held[:] = rows

        def appendList(self, rows):
            calls.append("append")
            held.extend(rows)

    class Handle:
        def getListState(self, *_):
            return State()

    spells, day = items.Spells(), pd.Timestamp("2024-01-01")
    spells.init(Handle())

    def feed(*rows):
        frame = pd.DataFrame([(e, day + pd.Timedelta(days=d), s) for e, d, s in rows], columns=["event_id", "ts", "status"])
        return [tuple(r) for r in next(spells.handleInputRows((1,), iter([frame]), None))["status"].items()]

    assert feed(*((k, k, "a") for k in range(50))) == [(k, "a") for k in range(50)]
    assert feed((60, 60, "b"))[-1] == (50, "b") and calls == ["get", "append"] * 2
    assert feed((60, 61, "c"))[-1] == (50, "c") and calls[-1] == "put" and len(held) == 51


def test_chunks_are_made_of_few_texts_at_once():
    class Docs:
        dtypes = [("doc_id", "bigint")]

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([str(k) for k in range(1000)])], names=["doc_id", "text"])
    made = list(chunks._by_text(Docs(), lambda t: [(t,)], (("text", pa.string()),))(iter([batch])))
    assert max(b.num_rows for b in made) <= chunks.SLICE and pa.Table.from_batches(made).to_pylist() == pa.Table.from_batches([batch]).to_pylist()


def test_base_scores_train_nothing(spark, tmp_path, monkeypatch):
    def train(*_):
        raise AssertionError("trained")

    rows = [(i, "a b c " * (i % 4)) for i in range(60)]
    tables = put(spark, tmp_path, documents=([(*r, "en", "x", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    want = {r[:5] + (round(r.base_score, 4),) for r in lm.query(spark, tables).collect()}
    monkeypatch.setattr(lm, "train_round", train)
    assert {tuple(r) for r in twins.lm_base(spark, tables).collect()} == want


def test_tasks_of_paths_follow_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(census, "TASK_LINES", 100)
    lines = [(k // 4, k * k % 11, "ANR"[k % 3]) for k in range(2000)] + [(1, 5, None), (None, 5, "A"), (1, None, "A")]
    df = catalogue.QUERIES["top08_path"](spark, put(spark, tmp_path, lineitem=(lines, "l_orderkey long, l_suppkey long, l_returnflag string")))
    ways = {(o, s, {"A": 1.0, "N": 0.8}.get(f, 0.5)) for o, s, f in lines if o is not None and s is not None}
    want = {}
    for o, s, w in ways:
        for p, t, v in ways:
            if o == p and s != t:
                want[s, t] = want.get((s, t), 0) + w * v * 0.3025
    assert {(r.src, r.dst): r.weight for r in df.collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert df.rdd.getNumPartitions() == 1 + len(lines) // 100


def test_people_of_a_stem_are_not_gathered(spark, tmp_path):
    deal = random.Random(11)
    customers = [(k, f"Customer#{k % 40:09d}", deal.randrange(2), deal.choice("SA"), float(deal.randrange(120))) for k in range(1, 120)] + [(21, "other 017", 0, "S", 5.0), (None, "x 014", 1, "S", 7.0), (300, None, None, None, None)]
    suppliers = [(k, f"Supplier#{k % 30:09d}", int(k in (9, 10)), 77.0 if k in (9, 10) else float(deal.randrange(120))) for k in range(1, 60)] + [(7, "none", 0, 5.0), (None, "y 014", 1, 7.0)]
    orders = [(o, deal.randrange(1, 60)) for o in range(150)] + [(None, 3)]
    lines = [(deal.randrange(150), deal.randrange(8), deal.randrange(1, 60)) for _ in range(500)] + [(None, 1, 3), (5, None, 3)]
    tables = put(spark, tmp_path, customer=(customers, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double"), supplier=(suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
                 orders=(orders, "o_orderkey long, o_custkey long"), lineitem=(lines, "l_orderkey long, l_partkey long, l_suppkey long"))
    want = sorted((tuple(r) for r in sql.query(more._BOTH["grf01_persons"])(spark, tables).collect()), key=repr)
    assert {r[2] for r in want} == {r[0] for r in more._RULES}
    assert sorted((tuple(r) for r in catalogue.QUERIES["grf01_persons"](spark, tables).collect()), key=repr) == want
    once = put(spark, tmp_path / "once", **{t: (list({r[0]: r for r in rows if r[0] is not None}.values()), spark.read.parquet(f"{tables}/{t}.parquet").schema) for t, rows in (("customer", customers), ("supplier", suppliers), ("orders", orders), ("lineitem", lines))})
    df = catalogue.QUERIES["grf01_persons"](spark, once)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, sql.query(more._BOTH["grf01_persons"])(spark, once).collect()))
    assert not {"Window", "Aggregate"} & set(df._jdf.queryExecution().optimizedPlan().toString().replace("[", " ").split())


def _one_by_one(pairs, foes):
    """Taking links in order: components and refused links."""
    bad, held, out = {}, {}, []
    for a, b in foes:
        bad.setdefault(a, set()).add(b)
        bad.setdefault(b, set()).add(a)
    for a, b, s in sorted(pairs, key=lambda p: (p[2] is None, -(p[2] or 0), p[:2])):
        x, y = held.setdefault(a, {a}), held.setdefault(b, {b})
        if x is not y:
            if any(bad.get(m, set()) & y for m in x):
                out.append((a, b, s))
            else:
                x |= y
                held.update(dict.fromkeys(y, x))
    return {n: min(s) for n, s in held.items()}, out


@pytest.mark.parametrize(("most", "deal", "n"), [(None, None, 150), (9, 4, 9)], ids=["tasks", "rounds"])
def test_verdicts_inside_a_large_group_need_no_round_each(spark, monkeypatch, most, deal, n):
    made = []
    monkeypatch.setattr(resolution, "fresh_folder", lambda session, name: made.append(name) or fresh_folder(session, name))
    if most:
        monkeypatch.setattr(resolution, "MOST", most)
        monkeypatch.setattr(resolution, "DEAL", deal)
    rng = random.Random(6)
    # a chain whose links wait for each other, groups torn by verdicts, groups without
    pairs = [(i, i + 1, 0.99 - i / 1000) for i in range(n)] + [(a, b, rng.choice([0.6, 0.7, None])) for a in range(200, 200 + n) for b in range(a + 1, min(a + 4, 200 + n)) if rng.random() < 0.6]
    pairs += [(k, k + 1, 0.5) for k in range(400, 480, 4)] + [(k, k + 2, 0.4) for k in range(400, 480, 4)]
    foes = [(i, i + 3) for i in range(0, n - 3, 2)] + [(a, a + rng.choice([2, 5])) for a in range(200, 190 + n, 3)] + [(k, k + 2) for k in range(400, 440, 4)] + [(1, 450), (9000, 9001)]
    kept, refused = resolution.constrained(spark.createDataFrame(pairs, "a long, b long, score double"), spark.createDataFrame(foes, "a long, b long"))
    want, out = _one_by_one(pairs, foes)
    assert {r.node: r.component for r in kept.collect()} == want and kept.count() == len(want)
    assert sorted(map(tuple, refused.collect()), key=str) == sorted(out, key=str)
    assert most or len(made) <= 6
