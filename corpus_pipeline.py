"""Corpus pipeline: toxicity, near duplicates, personal data, source mix, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
Repeated rows are separate documents except to the near-duplicate stage, which keeps one of each group. Columns
beside those of documents pass through under any name; a stage of an empty table is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import jaccard, mixing, pieces, pii, toxicity
from lodestone.llm.common import documents, staged


#: Rows of an Arrow batch at most: texts are long, and a worker holds a batch several times over.
BATCH_ROWS = 2000


def _lean(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5; null and empty texts are scored like any other."""
    _lean(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id; documents without words all stay."""
    _lean(spark)
    return jaccard.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every span of personal data replaced by its kind; null texts stay null, repeated rows stay repeated."""
    _lean(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice; null and empty texts have size 0 and stay as often as the whole part of their share of copies, equal rows differ by one copy at most."""
    _lean(spark)
    return mixing.apply_mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number and digest of its sampled pieces, and proof that they decode to its text; a null text is empty."""
    _lean(spark)
    return pieces.digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The stages train models and sample, which SQL does not express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
