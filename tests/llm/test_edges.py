"""Rows repeated with their ids, null ids and texts of a hundred thousand characters, in every operator."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import fingerprint, gif, jaccard, lm, mixing, pieces, pii, suffix, toxicity


def _model(docs):
    labels = docs.sparkSession.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    return toxicity.score(docs, toxicity.train(docs, labels)).drop("lang", "source", "n_chars")


OPERATORS = {
    "suffix": suffix.dedup,
    "pieces": pieces.digest,
    "lm": lm.score,
    "gif": lambda docs: gif.digests(gif.store_texts(docs)),
    "pii": lambda docs: pii.redact(docs.select("doc_id", "text", "n_chars")),
    "fingerprint": lambda docs: fingerprint.neighbours(docs).drop("edited_sha256", "edited_fingerprint", "near_edited", "near_next", "common_prefix"),
    "jaccard": jaccard.join,
    "toxicity": _model,
    "mixing": lambda docs: mixing.take(docs).drop("copies", "taken"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_repeats_nulls_and_long_texts(spark, name):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}é" for _ in range(12_000))
    rows = [(1, "a short text of some words", "en", "a", 1)] * 2 + [(2, long, "en", "b", 2)] * 2 + [(3, long + " tail", "en", None, 3), (None, "no id at all", "en", "a", 4), (None, None, "en", "a", 5), (None, None, "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = OPERATORS[name](docs)
    got = (made.withColumn("score", F.round("score", 3)) if name == "lm" else made).collect()
    assert len(got) == len(rows)
    for i, n in ((1, 2), (2, 2), (3, 1)):
        own = [r for r in got if r.doc_id == i]
        assert len(own) == n and len({repr(r) for r in own}) == 1
    if name == "suffix":  # a repeated row is its own repeat
        assert all(r.n_removed == r.n_bytes for r in got if r.doc_id == 2)
        assert next(r for r in got if r.doc_id == 3).kept_sha256 == hashlib.sha256(b" tail").hexdigest()
    if name == "pieces":
        assert all(r.lossless for r in got)
    if name == "jaccard":
        assert {r.component_id for r in got if r.doc_id in (2, 3)} == {2}


def test_long_fingerprints_agree(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcd ") for _ in range(150_000))
    a, b = (fingerprint.PrefixHash(fingerprint.code_points(t)) for t in (text, text[:70_000] + "#" + text[70_001:]))
    assert a.extension(0, b, 0) == 70_000 and a.extension(70_001, b, 70_001) == len(text) - 70_001
    got = fingerprint.neighbours(spark.createDataFrame([(1, text), (2, text[:-1])], "doc_id long, text string")).where(F.col("doc_id") == 2).first()
    assert got.near_next > 0.95


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("texts", [[None, "", ""], ["a", "bb", "a"]])
def test_nothing_to_do(spark, name, texts):
    rows = [(i, t, "en", None, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(OPERATORS[name](docs).collect()) == len(rows)
