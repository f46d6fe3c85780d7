"""What the corpus operators promise beyond small tables: bounds, long texts, hand-made media, sampling odds, clashing names, the pipeline."""

import hashlib
import itertools
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import fingerprint, gif, jaccard, lm, mixing, pieces, pii, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("size", "nth", "r_nth", "n", "copies", "salt", "score", "score_", "row", "cands", "cands_", "base_", "text_", "spans", "place_", "suspect_", "drop_", "h1", "k1", "key_", "key", "pieces_", "decoded_")


def crowded(spark, texts):
    """Documents with an extra column under every name that an operator might want for itself."""
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.withColumns({c: F.concat(F.lit(f"{c}:"), "doc_id") for c in CLASHING})


def extras(rows):
    return all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHING)


def test_clashing_names(spark):
    rng = random.Random(2)
    texts = [None, "", *(" ".join(str(rng.randrange(900)) for _ in range(60)) for _ in range(9)), "call +1 (386) 555-3733 now"]
    texts += texts[2:5]
    docs = crowded(spark, texts)
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and extras(mixed.collect())
    clean = pii.redact(docs)
    got = clean.collect()
    assert clean.columns == docs.columns and extras(got) and {r.text for r in got if r.doc_id == 11} == {"call [PHONE] now"}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and extras(kept.collect()) and kept.count() == len(texts) - 3
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    calm = toxicity.keep_clean(docs, toxicity.train(docs, labels))
    assert calm.columns == docs.columns and extras(calm.collect())
    tripped = pieces.round_trip(docs)
    rows = tripped.collect()
    assert extras(rows) and all(r[-1] == (r.text or "") for r in rows)
    assert extras(pieces.decode(pieces.encode(docs), pieces="pieces__").collect())


#: Settled at once for the most part, and through trees of several levels.
TREES = {"one task": {}, "fan_in 16": {"fan_in": 16, "giants": 256}, "fan_in 4": {"fan_in": 4, "giants": 256}}


@pytest.mark.parametrize("tree", TREES)
@pytest.mark.parametrize("seed", range(5))
def test_mix_meets_targets(spark, seed, tree):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.take(docs, seed, **TREES[tree]).toPandas()
    total = got.groupby(got.source.fillna("")).agg(taken=("taken", "sum"), target=("target", "first"))
    miss = abs(total.taken - total.target) / total.target
    # 50 documents cannot balance one of a tenth of all words where its odds are near 0 or 1: 3 % is all that fair draws can do there
    assert miss.max() < 0.035 and miss.mean() < 0.005
    assert (got.taken <= 2 * got["size"]).all()


@pytest.mark.parametrize("tree", TREES)
def test_mix_keeps_fractions_on_average(spark, tree):
    """200 sources of the same 60 sizes, two of them large, are 200 draws of one source."""
    sources, docs, share = 200, 60, 1.3
    size = F.expr("CASE WHEN id % 60 = 0 THEN 4000 WHEN id % 60 = 1 THEN 900 ELSE 3 + (id % 60) * (id % 60) % 97 END").cast("long")
    rows = spark.range(sources * docs).select(F.col("id").alias("doc_id"), F.format_string("s%03d", F.floor(F.col("id") / docs)).alias("source"), size.alias("size"))
    got = mixing.take_sized(rows, 17, weights=(1,), share=share, **TREES[tree]).toPandas()
    mean = got.groupby(got.doc_id % docs).copies.mean()
    error = (share - 1) * (2 - share) / sources  # variance of a mean of fair draws
    assert abs(mean - share).max() < 4.5 * error**0.5
    assert ((mean - share) ** 2).mean() < 1.6 * error


@pytest.mark.parametrize("tree", TREES)
def test_mix_ties_and_one_large_document(spark, tree):
    rows = [(i, "a b c", "en", "tied", 5) for i in range(50)] + [(None, "a b c", "en", "tied", 5)] * 3 + [(100, "w " * 5000, "en", "one", 1), (101, None, "en", "one", 1), (102, "", "en", "one", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.take(docs, **TREES[tree]).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    tied = got[got.source == "tied"]
    assert abs(tied.taken.sum() - tied.target.iloc[0]) <= 3
    again = mixing.take(docs.repartition(5), **TREES[tree]).toPandas()
    assert Counter(zip(got.doc_id.fillna(-1), got.copies, strict=True)) == Counter(zip(again.doc_id.fillna(-1), again.copies, strict=True))


def test_mix_of_repeated_rows(spark):
    rows = [(1, "a b c d", "en", "hot", 7)] * 300 + [(2, "x", "en", "cold", 1)] * 7 + [(None, "y z", "en", None, 3)] * 5
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.take(docs).toPandas()
    assert len(got) == len(rows)
    for _, group in got.groupby(got.source.fillna("")):
        assert group.copies.max() - group.copies.min() <= 1 and abs(group.taken.sum() - group.target.iloc[0]) <= group["size"].max()
    assert Counter(r.source for r in mixing.apply_mix(docs).collect()) == Counter(got.loc[got.index.repeat(got.copies)].source.where(lambda s: s.notna(), None).tolist())


def test_pii_long_text(spark):
    many = 20_000
    text = " ".join(f"10.{i % 250}.2.{i % 300} a{i}@b.de" for i in range(many))
    found = pii.detect(pii.staged(pii.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")), "t"))
    spans = [(s.start, s.kind, s.end) for s in found.first().base]
    want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    assert spans == sorted(want)


def test_pii_precision_and_recall(spark):
    """Planted spans that the base patterns miss, among look-alikes: what the method adds is mostly right."""
    rng = random.Random(4)
    texts, truth = [], []
    for i in range(400):
        number = f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        good = i % 2 == 0
        texts.append(f"{'Please call me, my phone: ' if good else 'order ref '}{number} thanks")
        truth.append(good)
    rows = pii.detect(pii.staged(pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "t")).select("row.doc_id", F.size("spans").alias("n")).collect()
    added = {r.doc_id for r in rows if r.n}
    right = {i for i, g in enumerate(truth) if g}
    assert len(added & right) >= 0.9 * len(right) and len(added & right) >= 0.9 * len(added)


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("share", [0.5, 0.8])
def test_common_passage_makes_no_pairs(spark, monkeypatch, share):
    """Documents that share a passage and link nowhere: what is verified grows with them, not with their pairs."""
    seen = {}
    real = jaccard._rest
    for n in (60, 120):
        rng = random.Random(n)
        word = lambda: str(rng.randrange(10**7))
        passage = [word() for _ in range(int(1000 * share))]
        texts = [" ".join([*passage, *(word() for _ in range(1000 - len(passage)))]) for _ in range(n)]
        made = []
        monkeypatch.setattr(jaccard, "_rest", lambda *a: made.append(r := real(*a)) or r)  # noqa: B023
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
        assert got == {i: i for i in range(n)}
        seen[n] = sum(r.count() for r in made)
    assert seen[120] <= 4 * 120 and seen[120] <= 2.5 * max(seen[60], 30)


def _codes(indexes, bits):
    """Indexes as an LZW stream that clears its table before every sample, so that all codes have one width."""
    clear, width, out, n, stream = 1 << bits, bits + 1, 0, 0, bytearray()
    for code in [x for i in indexes for x in (clear, int(i))] + [clear + 1]:
        out |= code << n
        n += width
    while n > 0:
        stream.append(out & 255)
        out >>= 8
        n -= 8
    return bytes(stream)


def _image(at, index, disposal=0, clear=None, delay=5, palette=None, interlaced=False, bits=2):
    h, w = index.shape
    rows = index[[r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]] if interlaced else index
    data = _codes(rows.ravel(), bits)
    control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
    local = (bytes(palette), 0x80 | (len(palette) // 3).bit_length() - 2) if palette else (b"", 0)
    blocks = b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"
    return control + b"\x2c" + struct.pack("<HHHHB", *at, w, h, local[1] | (0x40 if interlaced else 0)) + local[0] + bytes([bits]) + blocks


def _gif(size, palette, *images):
    return b"GIF89a" + struct.pack("<HHBBB", *size, 0x80 | (len(palette) // 3).bit_length() - 2, 0, 0) + bytes(palette) + b"".join(images) + b"\x3b"


def test_gif_rules(spark):
    red, green, blue, white = (200, 0, 0), (0, 200, 0), (0, 0, 200), (255, 255, 255)
    palette = [x for c in (red, green, blue, white) for x in c]
    full, box = np.zeros((9, 4), np.uint8), np.array([[1, 2], [2, 1]], np.uint8)
    rows = np.repeat(np.arange(9, dtype=np.uint8)[:, None] % 4, 4, 1)
    media = _gif(
        (4, 9),
        palette,
        _image((0, 0), full),
        _image((1, 1), box, disposal=2, clear=2, delay=7),  # index 2 shows what is below; then the box is cleared
        _image((0, 3), box, disposal=3, palette=[9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6]),  # own colours; then what was there comes back
        _image((0, 0), rows, interlaced=True, clear=0),
    )
    got = gif.decode_frames(spark.createDataFrame([(1, bytearray(media))], "doc_id long, media binary")).orderBy("frame").collect()
    assert [(r.error, r.start_cs, r.delay_cs) for r in got] == [(None, 0, 5), (None, 5, 7), (None, 12, 5), (None, 17, 5)]
    want = np.zeros((9, 4, 4), np.uint8)
    want[:] = (*red, 255)
    frames = [want.copy()]
    want[1, 1], want[2, 2] = (*green, 255), (*green, 255)
    frames.append(want.copy())
    want[1:3, 1:3] = 0
    before = want.copy()
    want[3, 0], want[3, 1], want[4, 0], want[4, 1] = (8, 8, 8, 255), (7, 7, 7, 255), (7, 7, 7, 255), (8, 8, 8, 255)
    frames.append(want.copy())
    want = before
    for y in range(9):
        if y % 4:
            want[y] = (*(red, green, blue, white)[y % 4], 255)
    frames.append(want)
    for r, frame in zip(got, frames, strict=True):
        assert r.rgba == frame.tobytes()
        bins = np.zeros(64, int)
        for p in frame.reshape(-1, 4):
            if p[3] == 255:
                bins[(p[0] >> 6) * 16 + (p[1] >> 6) * 4 + (p[2] >> 6)] += 1
        assert list(r.histogram) == bins.tolist()


def test_gif_columns(spark):
    import zlib

    texts = [None, "", "é" * 70, "x" * 200_000, "tie", "tie"]
    for r in gif.digests(gif.store_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = gif.encode_gif(padded)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        grey = np.bincount(np.frombuffer(padded, np.uint8) >> 6, minlength=4)
        assert r.feature.endswith("hist=" + ",".join(map(str, grey)))


def test_sampling_follows_the_lattice():
    """Frequencies of sampled segmentations against the weights of all of them, listed."""
    vocab = pieces.vocabulary(pieces.MODEL)
    word = b" other"
    known = {}
    for i, raw in enumerate(vocab.bytes):
        if raw and vocab.weight[i] > pieces.BYTE_WEIGHT:
            known.setdefault(raw, i)
    odds = {}
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:], strict=False)]
        if all(p in known for p in parts):
            odds[tuple(known[p] for p in parts)] = np.exp(sum(vocab.weight[known[p]] for p in parts))
    n = 40_000
    keys = np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)
    got = Counter(map(tuple, (x.tolist() for x in pieces.sample_block(vocab, [b"other"] * n, keys))))
    total = sum(odds.values())
    assert len(odds) > 3 and set(got) <= set(odds)
    for path, w in odds.items():
        p = w / total
        assert abs(got[path] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_fingerprint_likeness(spark):
    rng = random.Random(9)
    base = " ".join(str(rng.randrange(1000)) for _ in range(400))
    texts = [None, "", "short", base, base[:900] + "zz" + base[902:], base, base[200:] + base[:200], "é漢字" * 300, "tie", "tie"]
    rows = {r.doc_id: r for r in fingerprint.neighbours(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")).collect()}

    def spans(t):
        return {t[k : k + fingerprint.SPAN] for k in range(max(1, len(t) - fingerprint.SPAN + 1))} if t else set()

    for i, t in enumerate(texts):
        t, following = t or "", texts[(i - 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        for got, other in ((rows[i].near_edited, edited), (rows[i].near_next, following)):
            a, b = spans(t), spans(other)
            exact = 1.0 if t == other else len(a & b) / len(a | b) if a and b else 0.0
            assert abs(got - exact) < 0.25 and (got == 1.0) >= (t == other)
    assert rows[3].fingerprint == rows[5].fingerprint and rows[8].fingerprint == rows[9].fingerprint
    a, b = (fingerprint.PrefixHash(fingerprint.code_points(t)) for t in (texts[3], texts[4]))
    assert a.extension(0, b, 0) == 900 and a.extension(902, b, 902) == len(base) - 902


def test_lm_is_normalised_and_learns(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        words = ["start"]
        for _ in range(60):
            words.append({"start": "red", "red": "fox", "fox": rng.choice(["ran", "sat"]), "ran": "start", "sat": "start"}[words[-1]])
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x")], "doc_id long, text string, score string")
    got = lm.score(docs, block_bytes=4096).toPandas()
    assert len(got) == 301 and (got.n_tokens.sum() == sum(len(t.split()) + 1 for t in texts) + 1)
    held = got[got.held_out]
    assert held.score.sum() > 0.6 * held.base_score.sum()
    units = lm.Units(np.arange(40, dtype=np.uint64) << np.uint64(48), np.full(40, 9), np.arange(50), np.full(50, 2), np.full(50, 12), 7)
    p = lm.start(units)
    every = np.arange(units.n)
    for two, one in ((0, 3), (units.end, units.end)):
        total = 10 ** lm.log_probabilities(units, p, np.full(units.n, two), np.full(units.n, one), every)
        assert abs(total.sum() - 1) < 1e-5
    assert lm.score(docs.where("doc_id < 0")).count() == 0


def test_toxicity_of_repeated_ids(spark):
    rows = [(7, f"you are vile number {k}") for k in range(500)] + [(i, f"a calm day {i}") for i in range(20, 60)] + [(i, f"vile vile {i}") for i in range(60, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] + [(i, 0) for i in range(20, 60)] + [(i, 1) for i in range(60, 90)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, limit=20)
    again = toxicity.train(docs.repartition(7), labels.repartition(3), limit=20)
    assert model[1] == again[1] and (model[0] == again[0]).all()
    got = toxicity.score(docs, model).collect()
    assert all((r.score_ >= 0.5) == ("vile" in r.text) for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_warc_records(spark, tmp_path):
    none = "page_id long, url string, payload binary, header string"
    warc.write_archive(spark.createDataFrame([], none), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0
    body = b"<p>\r\n\r\nx</p>" * 200
    warc.write_archive(spark.createDataFrame([(1, "u", bytearray(body), "x"), (2, "v", bytearray(body), "y"), (None, "w", bytearray(body), "z")], none), str(tmp_path / "a"))
    rows = warc.read_archive(spark, str(tmp_path / "a")).withColumn("record", warc.record_bytes(F.col("header"), F.col("block"))).collect()
    for r in rows:
        head, rest = bytes(r.record).split(b"\r\n\r\n", 1)
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert len(rest) == int(fields[b"Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n") and fields[b"WARC-Date"]
        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(body).hexdigest().encode()
        assert rest[:-4] == (body if fields[b"WARC-Type"] == b"response" else b"") and bytes(r.payload) == body
    assert sorted(r.record_type for r in rows) == ["response", "revisit", "revisit"]


def test_pipeline(spark, tmp_path):
    """run() against the five stages done plainly; models are asked for their parameters, decisions are made again here."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = [" ".join(word() for _ in range(rng.randint(5, 80))) for _ in range(60)]
    texts = [None, "", *prose, *(t + " more" for t in prose[:20] if len(t.split()) > 40), *prose[5:9]]
    texts += [f"you stupid vile clown {word()}" for _ in range(25)] + [f"{p} mail me@{word()}.org or 10.1.2.3" for p in prose[30:45]]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s3", 9)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int("vile" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((r.doc_id, r.n_pieces, r.decoded_sha256, r.lossless) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    weights, bias = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    grams = dict(toxicity.features(*_buffer([t or "" for _, t, *_ in rows])))
    kept = [r for k, r in enumerate(rows) if 1 / (1 + np.exp(-(weights[grams[k]].sum(dtype=np.float64) + bias))) < 0.5]
    assert all(("vile" in (r[1] or "")) == (r not in kept) for r in rows)
    sets, root = [shingles(r[1]) for r in kept], list(range(len(kept)))
    for _ in range(4):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    groups, kept2 = {}, []
    for r, s, g in zip(kept, sets, root, strict=True):
        if s:
            groups.setdefault(g, []).append(r)
        else:
            kept2.append(r)
    kept2 += [min(g, key=lambda r: r[0]) for g in groups.values()]
    frame = spark.createDataFrame(kept2, DOCS)
    found = {r.row.doc_id: r.spans for r in pii.detect(pii.staged(pii.candidates(frame), "t")).collect()}
    clean = []
    for r in kept2:
        out, at = "", 0
        for s in found[r[0]]:
            if s.start >= at:
                out += r[1][at : s.start] + f"[{pii.KINDS[s.kind].upper()}]"
            at = max(at, s.end)
        clean.append((*r[:1], None if r[1] is None else out + r[1][at:], *r[2:4], len((out + r[1][at:]) if r[1] else "")))
    assert sum("[EMAIL] or [IP]" in (r[1] or "") for r in clean) >= 5
    taken = {r.doc_id: r.copies for r in mixing.take(spark.createDataFrame(clean, DOCS)).collect()}
    want = [(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in clean for _ in range(taken[r[0]])]
    assert sorted((d, h) for d, _, h, _ in got) == sorted(want) and all(r[3] for r in got)


def _buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


def test_lm_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["sun", "moon", "a", "of", f"w{i % 9}"]) for _ in range(40))) for i in range(400)], "doc_id long, text string")
    got = [lm.score(docs.repartition(n), block_bytes=32768, shard_bytes=4096).toPandas().sort_values("doc_id").score.to_numpy() for n in (1, 7)]
    assert np.allclose(*got, rtol=1e-6)
