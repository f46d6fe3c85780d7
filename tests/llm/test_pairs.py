"""Every linked pair of classes and the links of each document, against all pairs compared."""

import random
import re

from lodestone.llm import jaccard


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", (text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_pairs_and_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIR_BLOCK", 5)  # several blocks to a bucket
    deal = random.Random(8)
    made = []
    for n in (6, 40, 150, 300):
        base = [str(deal.randrange(10**6)) for _ in range(n)]
        made += [" ".join(base)] * 3
        for k in range(14):  # one word changed or a tail: most of a group link to each other
            near = list(base)
            near[deal.randrange(n)] = f"x{k}"
            made += [" ".join(near), " ".join([*base, *(f"y{k}{j}" for j in range(deal.randrange(1, 4)))])]
    rows = [(i, t) for i, t in enumerate([None, "", "one", *made])] + [(None, made[0]), (4, "other words of a repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t) for _, t in rows]
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            least[s] = min(i, least.get(s, i))
    joined = [(a, b) for a in least for b in least if a != b and 100 * len(a & b) >= 75 * len(a | b)]
    assert len(joined) > 4 * len(least)  # far more than stars hold
    got = jaccard.pairs(docs).collect()
    assert len({(r.class_a, r.class_b) for r in got}) == len(got)
    assert sorted(sorted((r.doc_a, r.doc_b)) for r in got) == sorted(sorted((least[a], least[b])) for a, b in joined if least[a] < least[b] or (least[a] == least[b] and hash(a) < hash(b)))
    want = [(i, sum(1 for k, t in enumerate(sets) if k != j and s and t and 100 * len(s & t) >= 75 * len(s | t))) for j, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]
    assert sorted(map(repr, ((r.doc_id, r.n_links) for r in jaccard.link_counts(docs).collect()))) == sorted(map(repr, want))
