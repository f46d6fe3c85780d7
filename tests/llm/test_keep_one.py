"""One row of each linked group, where doc_ids repeat or are null."""

import random
import re

from lodestone.llm import jaccard

SCHEMA = "doc_id long, text string, source string"


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    """Rows that stay, and the groups (doc_ids and texts) of which one stays."""
    sets = [shingles(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    apart, groups = [], {}
    for row, s, g in zip(rows, sets, group, strict=True):
        if s:
            groups.setdefault(g, []).append(row)
        else:
            apart.append(row)
    return apart, list(groups.values())


def test_repeated_and_null_ids(spark):
    deal = random.Random(11)
    made = [" ".join(deal.choice("abcdefghijklm") * deal.randint(1, 4) for _ in range(60)) for _ in range(9)]
    near = [t + " tail" for t in made]
    rows = [
        (7, made[0], "a"), (7, made[1], "a"),  # two unlinked texts under one id
        (3, made[2], "a"), (8, near[2], "a"), (8, made[3], "b"), (8, "", "b"), (8, None, "b"),  # one near copy, one alone, two empty
        (None, made[4], "a"), (None, made[4], "b"), (None, near[4], "a"),  # a group without ids
        (None, near[5], "a"), (9, made[5], "a"),  # null comes last
        (12, made[6], "a"), (12, near[6], "a"), (12, made[6], "a"),  # one id, one group
        (20, made[7], "a"), (21, made[8], "a"), (None, "", "a"), (None, "", "a"),
    ]
    got = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    apart, groups = plain(rows)
    words = [r for r in got if shingles(r[1])]
    assert sorted(map(repr, set(got) - set(words))) == sorted(map(repr, set(apart)))
    assert len(got) - len(words) == len(apart)
    assert len(words) == len(groups)
    for group in groups:
        mine = [r for r in words if r in group]
        ids = [r[0] for r in group if r[0] is not None]
        assert len(mine) == 1
        assert mine[0][0] == (min(ids) if ids else None)
