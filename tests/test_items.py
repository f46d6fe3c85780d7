"""State by item, step metrics by listener, water-fill and table functions against plain versions."""

import random
from datetime import datetime, timedelta

from lodestone.functions import tables
from lodestone.operators import fill
from lodestone.streaming import items

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime(2024, 1, 1, 12)


def _land(spark, folder, files):
    for rows in files:
        made = [(i, START + timedelta(minutes=m) if m is not None else None, u, kind, 1.0) for i, m, u, kind in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return str(folder)


def test_spells_in_any_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.randrange(60), rng.choice((7, 8)), rng.choice(("open", "closed", "error"))) for k in range(40)]
    odd = [(90, None, 7, "open"), (91, 3, None, "open"), (None, 4, 7, "open"), (92, 5, 7, None)]
    late = rows[::-1] + rows[5:9]
    path = _land(spark, tmp_path, [late[:15] + odd, late[15:30], late[30:]])
    got = sorted(map(tuple, items.spells(spark, path, maxFilesPerTrigger="1").collect()), key=repr)
    want = []
    for u in (7, 8):
        last = {}
        for k, m, _, kind in sorted(r for r in rows if r[2] == u):
            last[m] = kind
        at = sorted(last)
        want += [(u, START + timedelta(minutes=m), START + timedelta(minutes=n) if n is not None else None, last[m]) for m, n in zip(at, [*at[1:], None], strict=True)]
    assert got == sorted(want, key=repr)


def test_listener(spark, tmp_path):
    path = _land(spark, tmp_path, [[(k, k, 7, "error" if k % 4 == 0 else "view")] for k in range(4)])
    got = items.steps(spark, path, maxFilesPerTrigger="1").first()
    assert (got["rows"], got["passed"], got["complete"]) == (4, 3, True)


def test_water_fill(spark):
    rng = random.Random(2)
    rows = [(g, f"b{k}", rng.randrange(12), rng.choice((None, 0, 1, 3, 9)), rng.choice((5, 17, 60)) if k == 0 else None) for g in (1, 2, 3, None) for k in range(6)]
    amount = {r[0]: r[4] for r in rows if r[4]}
    rows = [(*r[:4], amount[r[0]]) for r in rows]
    want = {}
    for g in amount:
        own = {b: [held, room] for grp, b, held, room, _ in rows if grp == g and room != 0}
        poured = dict.fromkeys(own, 0)
        for _ in range(amount[g]):
            open_ = [b for b in own if own[b][1] is None or poured[b] < own[b][1]]
            if open_:
                b = min(open_, key=lambda x: (own[x][0] + poured[x], x))
                poured[b] += 1
        want |= {(g, b): n for b, n in poured.items()}
    frame = spark.createDataFrame(rows + rows[:3] + [(9, "x", None, 3, 5), (9, "y", 3, 3, 0)], "grp long, bucket string, held long, room long, amount long")
    assert {(r.grp, r.bucket): r.poured for r in fill.water_fill(frame).collect()} == want


def test_table_functions(spark):
    tables.register(spark)
    docs = spark.createDataFrame([(1, "# Top\n\nsee [ABC-1] and [x](y)\n\n```\n[no]\n```\n\n[#12] [ ] [deadbeef]"), (2, None), (3, "")], "doc_id long, text string")
    blocks = spark.sql("SELECT doc_id, b.position, b.kind, b.level FROM {d} d, LATERAL md_blocks(d.text) b ORDER BY 1, 2", d=docs).collect()
    assert [tuple(r) for r in blocks] == [(1, 0, "heading", 1), (1, 1, "paragraph", 0), (1, 2, "fence", 0), (1, 3, "paragraph", 0)]
    cited = spark.sql("SELECT c.token, c.kind FROM {d} d, LATERAL md_citations(d.text) c ORDER BY c.position", d=docs).collect()
    assert [tuple(r) for r in cited] == [("ABC-1", "issue"), ("#12", "pull"), ("deadbeef", "sha")]
    assert [tuple(r) for r in spark.sql("SELECT doc_id, c.heading FROM {d} d, LATERAL md_chunks(d.text) c", d=docs).collect()] == [(1, "Top")]
