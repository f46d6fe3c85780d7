"""Full text by an inverted index: postings are written once, sorted by term, and a search reads those of its own terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.plans import events
from lodestone.sources.storage import fresh_folder

#: BM25's saturation and length weight, the boost of a key, the terms and keys of the registered search.
K1, B, BOOST = 1.2, 0.75, 8.0
TERMS, KEYS, TOP = ("the", "and"), ("que",), 20
#: Documents of a block of postings at most.
BLOCK = 2000
_WORD = re.compile("[a-z0-9]+")
_built: dict[tuple[str, str], str] = {}


def _postings(key: pa.DataType):
    """Blocks (term, docs, tfs) of batches of (doc_id, lower-case text): the documents of a term and how often they hold it; under a null term lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, BLOCK) for b in batches for k in range(0, b.num_rows, BLOCK)):
            names, codes, places, tfs = {None: 0}, [], [], []
            for place, text in enumerate(batch.column(1).to_pylist()):
                counts = Counter(_WORD.findall(text)) if text else ()
                if counts:
                    codes += [0, *(names.setdefault(t, len(names)) for t in counts)]
                    places += [place] * (1 + len(counts))
                    tfs += [counts.total(), *counts.values()]
            if codes:
                code = np.array(codes)
                order = np.argsort(code, kind="stable")
                offsets = pa.array(np.searchsorted(code[order], np.arange(len(names) + 1)), pa.int32())
                docs = pa.ListArray.from_arrays(offsets, batch.column(0).cast(key).take(pa.array(np.array(places)[order])))
                yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), docs, pa.ListArray.from_arrays(offsets, pa.array(np.array(tfs, np.int64)[order]))], names=["term", "docs", "tfs"])

    return run


def write_index(docs: DataFrame, path: str) -> None:
    """Postings (term, docs, tfs) in blocks and lengths (doc_id, dl) of docs (doc_id, text) under path; null texts have no terms, equal ids are one document.

    A document is counted where it is read; only ids of several rows are counted together.
    """
    kind = dict(docs.dtypes)["doc_id"]
    cut = lambda df: df.select("doc_id", F.lower("text").alias("text")).mapInArrow(_postings(to_arrow_type(docs.schema["doc_id"].dataType)), f"term string, docs array<{kind}>, tfs array<long>")
    flat = lambda df: df.select("term", F.explode(F.arrays_zip("docs", "tfs")).alias("p")).select("term", F.col("p.docs").alias("doc_id"), F.col("p.tfs").alias("tf"))
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id")
    twice.write.parquet(f"{path}/twice")
    twice = docs.sparkSession.read.schema(twice.schema).parquet(f"{path}/twice")
    blocks = cut(docs)
    if twice.limit(1).count():
        several = docs.join(twice, docs.doc_id.eqNullSafe(twice.doc_id), "left_semi")
        merged = flat(cut(several)).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf")).select("term", F.array("doc_id").alias("docs"), F.array("tf").alias("tfs"))
        blocks = cut(docs.join(twice, docs.doc_id.eqNullSafe(twice.doc_id), "left_anti")).unionByName(merged)
    blocks.write.parquet(f"{path}/blocks")
    held = docs.sparkSession.read.schema(blocks.schema).parquet(f"{path}/blocks")
    flat(held.where("term IS NULL")).select("doc_id", F.col("tf").alias("dl")).write.parquet(f"{path}/lengths")
    held.where("term IS NOT NULL").withColumn("first", F.col("docs")[0]).repartitionByRange("term", "first").sortWithinPartitions("term", "first").drop("first").write.parquet(f"{path}/postings")


def index(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the index of a data set's documents; a session builds it once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        path = fresh_folder(spark, "terms")
        write_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
        _built[key] = path
    return _built[key]


def search(spark: SparkSession, path: str, terms: tuple[str, ...], keys: tuple[str, ...] = (), top: int = TOP) -> DataFrame:
    """The top documents of an OR query: doc_id, score; keys weigh BOOST times, ties go to the least id."""
    postings = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(*terms, *keys))
    postings = postings.select("term", F.explode(F.arrays_zip("docs", "tfs")).alias("p")).select("term", F.col("p.docs").alias("doc_id"), F.col("p.tfs").alias("tf"))
    facts = spark.read.parquet(f"{path}/lengths").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"))
    of_term = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row for each term that was asked for
    rows = postings.join(F.broadcast(of_term), "term").join(spark.read.parquet(f"{path}/lengths"), "doc_id").crossJoin(F.broadcast(facts))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(F.col("term").isin(*keys), BOOST).otherwise(1.0) if keys else F.lit(1.0)
    part = weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return rows.groupBy("doc_id").agg(F.round(F.sum(part), 4).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(top)


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents that hold a term of the ranking query: texts are cut into words once, the figures read back."""
    word = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    cut = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", word.alias("w"))
    one = cut.select("doc_id", F.size("w").alias("dl"), *[_times("w", t).alias(f"tf{i}") for i, t in enumerate(events.TERMS)])
    path = fresh_folder(spark, "counts")
    one.groupBy("doc_id").agg(F.sum("dl").alias("dl"), *[F.sum(f"tf{i}").alias(f"tf{i}") for i in range(len(events.TERMS))]).where("dl > 0").write.parquet(path)
    held = spark.read.parquet(path)
    facts = held.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(events.TERMS))])
    rows, score = held.crossJoin(F.broadcast(facts)), F.lit(0.0)
    for i in range(len(events.TERMS)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return rows.where(" + ".join(f"tf{i}" for i in range(len(events.TERMS))) + " > 0").select("doc_id", F.round(score, 4).alias("score"))


def _times(words: str, term: str):
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


_TERM_SQL = ", ".join(f"'{t}'" for t in (*TERMS, *KEYS))
QUERIES = {
    "top03_bm25": bm25,
    "top03_index": lambda spark, sf_dir: spark.read.parquet(f"{index(spark, sf_dir)}/postings").groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")),
    "top03_search": lambda spark, sf_dir: search(spark, index(spark, sf_dir), TERMS, KEYS),
}
ORACLES = {
    "top03_bm25": events.ORACLES["top03_bm25"],
    "top03_index": "SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) t GROUP BY term",
    "top03_search": f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ({_TERM_SQL}) GROUP BY doc_id, term), l AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS n, avg(dl) AS mean FROM l), d AS (SELECT term, count(*) AS df FROM f GROUP BY term)
SELECT f.doc_id, round(sum(CASE WHEN f.term = 'que' THEN 8.0::DOUBLE ELSE 1.0::DOUBLE END * ln(1 + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * f.tf * 2.2::DOUBLE / (f.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / s.mean))), 4) AS score
FROM f JOIN l ON l.doc_id = f.doc_id JOIN d ON d.term = f.term CROSS JOIN s GROUP BY f.doc_id ORDER BY score DESC, f.doc_id LIMIT {TOP}""",
}
