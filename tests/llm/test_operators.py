"""Operators against brute force on small tables with nulls, empty and repeated texts, and extra columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fingerprint, gif, jaccard, lm, mixing, pieces, pii, suffix, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def table(spark, texts, sources=("a", "b", None)):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(n, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = prose(40)
    near = [" ".join(w if rng.random() > 0.02 else "zz" for w in t.split()) for t in base[:20]]
    return [None, "", " ", "one", "é漢字😀 word", *base, *near, *base[:5], base[0] + " " + base[1], "A" * 3000]


def test_empty_tables(spark):
    none = table(spark, [])
    for run in (mixing.take, fingerprint.neighbours, jaccard.join, lm.score, suffix.dedup, pieces.digest, pii.redact, mixing.apply_mix):
        assert run(none).count() == 0
    assert gif.digests(gif.store_texts(none)).count() == 0


def test_mix(spark, texts):
    got = mixing.take(table(spark, texts)).toPandas()
    sizes = {i: len(re.findall(r"[^ \t-\r]+", t or "")) for i, t in enumerate(texts)}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == sizes
    total = got.groupby(got.source.fillna("")).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert abs(total.target.sum() - 1.5 * sum(sizes.values())) < 1e-6
    assert (abs(total.taken - total.target) <= got["size"].max()).all()
    assert (got.taken <= 2 * got["size"]).all()
    again = mixing.take(table(spark, texts).repartition(3)).toPandas()
    assert sorted(zip(got.doc_id, got.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))
    assert mixing.apply_mix(table(spark, texts)).count() == got.copies.sum()


def test_jaccard(spark, texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    least = list(range(len(texts)))
    for _ in range(9):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(table(spark, texts)).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, least, strict=True))}
    assert jaccard.keep_one(table(spark, texts)).count() == len({c for c, s in zip(least, sets, strict=True) if s}) + sum(not s for s in sets)


@pytest.mark.parametrize("batches", [1, 5])
def test_suffix(spark, texts, batches):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + 200] for t in raw for k in range(len(t) - 199))
    want = {}
    for i, t in enumerate(raw):
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        want[i] = (len(t), sum(gone), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.dedup(table(spark, texts), batches).collect()}
    assert got == want


def test_gif(spark, texts):
    for r in gif.digests(gif.store_texts(table(spark, texts))).collect():
        raw = (texts[r.doc_id] or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest()
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, 64 * 2000, np.uint8).tobytes()
    assert b"".join(f[box][..., 0].tobytes() for _, f, box in gif.compose(gif.encode_gif(noise))) == noise
    bad = spark.createDataFrame([(1, bytearray(b"GIF89a")), (2, None)], "doc_id long, media binary")
    assert gif.decode_frames(bad).where("error is not null").count() == 2


def test_warc(spark, tmp_path):
    big = b"x" * 1500
    rows = [(1, "u\r\nv", bytearray(big)), (2, None, bytearray(big)), (3, "w", bytearray(b"s")), (4, "w", bytearray(b"s")), (5, "n", None)]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, payload binary"), str(tmp_path / "a"))
    got = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert sorted(r.record_type for r in got) == ["response"] * 4 + ["revisit"]
    assert sorted(bytes(r.payload) for r in got) == sorted([big, big, b"s", b"s", b""])
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 3


def test_pieces(spark, texts):
    docs = table(spark, texts)
    got = pieces.decode(pieces.encode(docs)).collect()
    assert all(r.decoded_ == (r.text or "") for r in got)
    again = {r.doc_id: r.pieces_ for r in pieces.encode(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.pieces_ for r in got}
    assert sorted(pieces.round_trip(docs).collect(), key=lambda r: r.doc_id) == sorted(got, key=lambda r: r.doc_id)


def test_fingerprints(spark, texts):
    for r in fingerprint.neighbours(table(spark, texts), stretch_rows=7).collect():
        t, n = texts[r.doc_id] or "", texts[(r.doc_id - 1) % len(texts)] or ""
        half = len(t) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1) == (t == n or r.near_next == 1)
    a, b = (fingerprint.PrefixHash(fingerprint.code_points(x)) for x in ("hello world", "yellow world"))
    assert a.extension(1, b, 1) == 4


def test_pii(spark):
    texts = [None, "", "a@b.c_d@e.f x 1.2.3.256 and 1.2.3.4 +1 (386) 555-3733", "4111111111111111" + " 1" * 40, "Tel: 555-123-4567 or me (at) site (dot) org"]
    rows = pii.detect(pii.staged(pii.candidates(table(spark, texts)), "t")).select("row.doc_id", pii.joined(F.col("base")).alias("b")).collect()
    got = {r.doc_id: r.b for r in rows}
    assert got[2] == "email:0:5,email:5:11,ip:28:35,phone:36:53" and got[0] == got[1] == ""
    assert pii.redact(table(spark, texts)).where("doc_id = 2").first().text.startswith("[EMAIL][EMAIL] x 1.2.3.256 and [IP] [PHONE]")


def test_lm(spark, texts):
    got = lm.score(table(spark, texts), block_bytes=4096).toPandas()
    assert set(got.n_tokens) and got.base_score.lt(0).all() and np.isfinite(got.score).all()


def test_toxicity(spark):
    clean, foul = prose(300, 5), [t + " you idiot clown" for t in prose(300, 6)]
    texts = [x for pair in zip(clean, foul, strict=True) for x in pair]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(len(texts))] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    docs = table(spark, texts)
    got = toxicity.score(docs, toxicity.train(docs, labels)).where(toxicity.crc_mod(F.col("doc_id"), 5) == 0).toPandas()
    assert ((got.score_ >= 0.5) == (got.doc_id % 2 == 1)).mean() > 0.95
    groups = defaultdict(set)
    for t, s in zip(got.text, got.score_, strict=True):
        groups[t].add(s)
    assert all(len(s) == 1 for s in groups.values())
