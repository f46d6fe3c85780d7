"""Chunks, packing and constrained merges against plain versions, with nulls, ties, repeats, long texts and empty tables."""

import random

from pyspark.sql import functions as F

from lodestone.operators import chunks, packing, resolution

FENCE = "intro line\n\n# Top\n\nwords here\n\n- item\n  ```py\n  a | b\n\n  # not a heading\n  ```\n\n| a | b |\n|---|---|\n| 1 | 2 |\nafter table\n\n### Sub\ntext"


def _kinds(text):
    found = chunks.split(text)
    return [(chunks.KINDS[k], n) for k, n in zip(found.kind, found.level, strict=True)], [found.text[a:b] for a, b in zip(found.start, found.end, strict=True)]


def test_blocks():
    got, texts = _kinds(FENCE)
    assert got == [("paragraph", 0), ("heading", 1), ("paragraph", 0), ("paragraph", 0), ("fence", 0), ("table", 0), ("paragraph", 0), ("heading", 3), ("paragraph", 0)]
    assert texts[4] == "  ```py\n  a | b\n\n  # not a heading\n  ```" and texts[5].count("|") == 9 and texts[1] == "# Top"
    assert _kinds("```\nnever closed\n\n# x\n\n") == ([("fence", 0)], ["```\nnever closed\n\n# x"])
    assert _kinds("~~~~\n```\n~~~\n~~~~\n- ```\nx\n```\nend")[1] == ["~~~~\n```\n~~~\n~~~~", "- ```\nx\n```", "end"]
    assert _kinds("a\r\nb\r\r# c \rd")[1] == ["a\nb", "# c", "d"]
    assert _kinds("```\nx\n- ```\ny\n```")[1] == ["```\nx\n- ```\ny\n```"]
    assert _kinds("") == _kinds(" \n\t\n") == ([], [])


def test_chunks_cover_and_overlap():
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    text = "\n\n".join(" ".join(words[i : i + 150]) for i in range(0, 6000, 150))
    places = [(a, b) for _, a, b in chunks.spans(chunks.split(text))]
    assert len(places) > 10 and places[0][0] == 0 and places[-1][1] == len(text)
    for (_, end), (start, stop) in zip(places, places[1:], strict=False):
        assert start < end < stop and end - start <= chunks.CARRIED * chunks.CHARS and text[start - 1].isspace()
        assert chunks.tokens(stop - start) <= chunks.MOST
    made = [body for _, body in chunks.chunks(text)]
    assert list(dict.fromkeys(" ".join(made).split())) == list(dict.fromkeys(words))


def test_sections_fences_and_cuts():
    part = "word " * 450
    made = list(chunks.chunks(f"# One\n\n{part}\n\n# Two\n\n{part}\n\n## Three\n\nshort"))
    assert [h for h, _ in made] == ["One", "Two", "Three"]
    fence = "```\n" + "line of code\n" * 400 + "```"
    whole = [b for _, b in chunks.chunks(f"{'a b ' * 200}\n\n{fence}\n\ntail")]
    assert any(fence in b for b in whole) and not any(b.startswith("line of code") for b in whole)
    assert whole[-1] == "tail"
    lead = [b for _, b in chunks.chunks(f"short lead\n\n{fence}")]
    assert lead == [f"short lead\n\n{fence}"]
    long = [b for _, b in chunks.chunks("x" * 10_000)]
    assert "".join(long) == "x" * 10_000 and all(chunks.tokens(len(b)) <= chunks.MOST for b in long)
    huge = "```\n" + "line of code\n" * 4000 + "```"
    assert all(chunks.tokens(len(b)) <= chunks.HARD and (b.startswith("line") or b.startswith("```")) for _, b in chunks.chunks(huge))


def test_carried(spark):
    text = "word " * 100
    rows = [text, "short", "x" * 300, text + "\n```\ncode\n```", "```\n" + text, "```\na\n```\n" + text, text + "\n| a | b |", None]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").orderBy("k").select(chunks.carried(F.coalesce("t", F.lit("")))).collect()]
    tail = ("word " * 39).strip()
    assert got == [tail, "", "", "", "", tail, "", ""]


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, "short", "p"), (4, "long enough to be a chunk", "p"), (4, "long enough to be a chunk", "p"), (None, "a text without any id at all", "p")], "doc_id long, text string, position string")
    got = chunks.chunk(docs).collect()
    assert sorted((r.doc_id or 0, r.position) for r in got) == [(0, 0), (4, 0), (4, 0)] and len({r.id for r in got}) == 2
    assert chunks.chunk(docs.limit(0)).count() == 0


def test_bins(spark):
    rng = random.Random(2)
    items = [(s, i, rng.choice([None, 0, 5, 30, 70, 120])) for s in range(3) for i in range(40)]
    frame = spark.createDataFrame(items, "shard long, place long, size int")
    got = {(r.shard, r.place): r.bin for r in packing.in_order(frame, 100).collect()}
    for s in range(3):
        at, held = 0, None
        for _, i, n in (x for x in items if x[0] == s):
            if held is not None and held + (n or 0) > 100:
                at, held = at + 1, 0
            held = (held or 0) + (n or 0)
            assert got[s, i] == at
    loads = {}
    for r in packing.lightest(frame, 4).collect():
        loads.setdefault(r.shard, [0] * 4)[r.bin] += r.size
    for s, load in loads.items():
        sizes = sorted(((n or 0, i) for k, i, n in items if k == s), key=lambda x: (-x[0], x[1]))
        want = [0] * 4
        for n, _ in sizes:
            want[want.index(min(want))] += n
        assert sorted(load) == sorted(want)
    assert packing.in_order(frame.limit(0), 9).count() == packing.lightest(frame.limit(0), 2).count() == 0


def test_context(spark):
    rng = random.Random(3)
    rows = [(q, rng.choice("abc"), i, rng.choice([None, 0.1, 0.5, 0.9]), "x" * rng.choice([0, 3, 40, 200, 900])) for q in ("p", "q") for i in range(120)]
    got = {}
    for r in packing.fit(spark.createDataFrame(rows, "query string, kind string, id long, score double, text string"), 300).orderBy("query", "place").collect():
        got.setdefault(r.query, []).append(r.id)
    for q in ("p", "q"):
        ranked = sorted((x for x in rows if x[0] == q), key=lambda x: (x[3] is None, -(x[3] or 0), x[2]))
        heads = {next(x[2] for x in ranked if x[1] == k) for k in "abc"}
        left, want = 300, []
        for x in [x for x in ranked if x[2] in heads] + [x for x in ranked if x[2] not in heads]:
            n = max(1, int(min(len(x[4]), 600) / 3.49 + 0.999))
            if n <= left:
                want.append(x[2])
                left -= n
        assert got[q] == want


def test_constrained(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(40), rng.randrange(40), rng.choice([0.5, 0.7, 0.9])) for _ in range(45)] + [(100, 101, 0.9), (101, 102, 0.8), (None, 3, 0.9), (5, 5, 1.0)]
    foes = [(rng.randrange(40), rng.randrange(40)) for _ in range(12)] + [(100, 102), (7, None)]
    kept, refused = resolution.constrained(spark.createDataFrame(pairs, "a long, b long, score double"), spark.createDataFrame(foes, "a long, b long"))
    best = {}
    for a, b, s in pairs:
        if a is not None and a != b:
            best[min(a, b), max(a, b)] = max(s, best.get((min(a, b), max(a, b)), 0))
    bad, held, out = {frozenset(f) for f in foes if None not in f and f[0] != f[1]}, {}, []
    for (a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        x, y = held.setdefault(a, {a}), held.setdefault(b, {b})
        if x is not y:
            if any(frozenset((m, n)) in bad for m in x for n in y):
                out.append((a, b, s))
            else:
                x |= y
                held.update(dict.fromkeys(y, x))
    assert {r.node: r.component for r in kept.collect()} == {n: min(s) for n, s in held.items()}
    assert sorted(map(tuple, refused.collect())) == sorted(out)


def test_hard_negatives(spark):
    rows = [(1, "ann lee"), (2, "ann leo"), (3, "bob"), (4, None), (None, "ann lee"), (1, "ann lee")]
    got = [(r.a, r.b) for r in resolution.hard_negatives(spark.createDataFrame(rows, "owner long, name string")).collect()]
    assert got == [(1, 2)]
