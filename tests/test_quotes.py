"""Verbatim quotes against brute force: words cut at the edges, white space, short quotes, nulls, repeats, no rows."""

import random
import re

import pytest

from lodestone.operators import quotes


def plain(asked, texts):
    out, flat = {}, lambda t: re.sub(r"[ \t-\r]+", " ", t).strip(" ")
    for i, q in asked:
        for k, t in texts:
            if None in (i, q, k, t) or len(flat(q).split(" ")) < 3:
                continue
            at = flat(t).find(flat(q))
            if at >= 0:
                end = at + len(flat(q))
                edge = lambda c: not re.fullmatch(r"[A-Za-z0-9_]", c)
                out[i, k] = (at + 1, edge(flat(t)[at - 1 : at] if at else "") and edge(flat(t)[end : end + 1]))
    return out


def run(spark, asked, texts):
    q, t = spark.createDataFrame(asked, "quote_id long, quote string"), spark.createDataFrame(texts, "text_id long, text string")
    rows = quotes.find(q, t).collect()
    assert len(rows) == len({(r.quote_id, r.text_id) for r in rows})
    return {(r.quote_id, r.text_id): (r.place, r.bounded) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_quotes(spark, seed):
    draw = random.Random(seed)
    texts = [(k, draw.choice((" ", "\n", "  ")).join(draw.choices(("ab", "abc", "b", "cab", "x.", "a-b"), k=draw.randrange(0, 60)))) for k in range(60)]
    asked = []
    for i in range(60):
        text = draw.choice(texts)[1]
        at = draw.randrange(0, max(1, len(text)))
        asked.append((i, text[at : at + draw.randrange(1, 60)]))
    want = plain(asked, texts)
    assert want and len({b for _, b in want.values()}) == 2
    assert run(spark, asked, texts) == want


def test_edges(spark):
    asked = [(1, "one two three"), (2, "two three"), (None, "one two three"), (3, None), (4, ""), (5, "w " * 3000 + "end"), (1, "one two three"), (6, "ne two thre")]
    texts = [(1, "one\ttwo  three"), (1, "one\ttwo  three"), (2, "none two threes"), (None, "one two three"), (3, None), (4, ""), (5, "w " * 5000 + "end")]
    assert run(spark, asked, texts) == plain(asked, texts) == {(1, 1): (1, True), (1, 2): (2, False), (5, 5): (4001, True), (6, 1): (2, False), (6, 2): (3, False)}
    assert run(spark, [], texts) == {} and run(spark, asked, []) == {}
