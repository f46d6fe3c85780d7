"""Verbatim quotes: which texts hold a quote, where, and whether it begins and ends at the edge of a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: words by which a quote and a text meet, at most.
MEET = 8


def collapsed(text: Column) -> Column:
    """The text with each run of white space as one blank, none at its ends."""
    return F.trim(F.regexp_replace(text, r"[ \t-\r]+", " "))


def find(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quote_id, text_id, place, bounded for (quote_id, quote) and (text_id, text): every text that holds a whole quote.

    White space is collapsed on both sides; `place` is the first place in characters, from 1; `bounded` says that no letter, digit or
    underscore stands right before or after it. The words inside a quote, all but its first and last, are whole words of any text that
    holds it: texts meet quotes by the hash of the first MEET of them, then the whole quote is looked for. Quotes of fewer than three
    words prove nothing and have no rows, nor do null ids, quotes and texts. Rows that repeat an id and its text count once.
    """
    quotes = quotes.where("quote_id IS NOT NULL AND quote IS NOT NULL").select("quote_id", collapsed(F.col("quote")).alias("quote")).distinct()
    words = F.split("quote", " ")
    quotes = quotes.withColumn("many", F.least(F.lit(MEET), F.size(words) - 2)).where("many > 0")
    quotes = quotes.withColumn("gram", F.xxhash64("many", F.array_join(F.slice(words, F.lit(2), F.col("many")), " ")))
    texts = texts.where("text_id IS NOT NULL AND text IS NOT NULL").select("text_id", collapsed(F.col("text")).alias("text"))
    lengths = sorted(r.many for r in quotes.select("many").distinct().collect())  # MEET numbers at most
    runs = [
        F.expr(f"transform(sequence(1, greatest(size(w) - {k - 1}, 1)), i -> xxhash64({k}, array_join(slice(w, i, {k}), ' ')))") for k in lengths
    ] or [F.array().cast("array<bigint>")]
    grams = texts.select("text_id", F.split("text", " ").alias("w")).select("text_id", F.explode(F.array_distinct(F.flatten(F.array(*runs)))).alias("gram"))
    met = grams.join(quotes.select("quote_id", "quote", "gram"), "gram").select("text_id", "quote_id", "quote").distinct()
    held = met.join(texts, "text_id").withColumn("place", F.instr(F.col("text"), F.col("quote"))).where("place > 0")
    before, after = F.expr("substring(text, place - 1, 1)"), F.expr("substring(text, place + length(quote), 1)")
    inside = (F.col("place") > 1) & before.rlike(r"^\w$") | after.rlike(r"^\w$")
    return held.select("quote_id", "text_id", F.col("place").cast("long").alias("place"), (~inside).alias("bounded")).groupBy("quote_id", "text_id").agg(F.min("place").alias("place"), F.max("bounded").alias("bounded"))


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark as quotes in all documents."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("text_id"), "text")
    return find(items, docs).withColumnsRenamed({"quote_id": "item_id", "text_id": "doc_id"})


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoted(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), F.count_if("bounded").alias("bounded"))


#: Every quote against every text, on the whole strings.
_PLAIN = r"""
SELECT item_id, doc_id, place, NOT (place > 1 AND regexp_full_match(substr(t, place - 1, 1), '\w') OR regexp_full_match(substr(t, place + length(q), 1), '\w')) AS bounded FROM (
  SELECT item_id, doc_id, q, t, strpos(t, q) AS place
  FROM (SELECT item_id, trim(regexp_replace(text, '[ \t-\r]+', ' ', 'g')) AS q FROM benchmark) b JOIN (SELECT doc_id, trim(regexp_replace(text, '[ \t-\r]+', ' ', 'g')) AS t FROM documents) d ON contains(t, q)
  WHERE len(string_split(q, ' ')) > 2) s"""
QUERIES = {"str05_places": quoted, "str05_quote": counted}
ORACLES = {"str05_places": _PLAIN, "str05_quote": f"SELECT item_id, count(*) AS docs, count(*) FILTER (WHERE bounded) AS bounded FROM ({_PLAIN}) p GROUP BY item_id"}
