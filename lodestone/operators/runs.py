"""The longest run of words that two texts share, for every pair that shares one of at least so many words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: words of the shortest run that is a leak.
LEAST = 8
_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+', 0)"


def longest_runs(left: DataFrame, right: DataFrame, least: int = LEAST) -> DataFrame:
    """left_id, right_id, longest, left_at, right_at of (left_id, text) and (right_id, text): the longest shared run and where it begins, in words.

    Runs of least words meet by their hash; those that lie on one diagonal without a gap are one run, so the length found is
    exact and no text is compared with another. Of equal runs the first counts. Pairs without such a run, null
    texts and null ids have no row; of rows that share an id the longest run counts.
    """

    def places(rows: DataFrame, side: str) -> DataFrame:
        words = rows.where(f"{side}_id IS NOT NULL").select(f"{side}_id", F.monotonically_increasing_id().alias(f"{side}_row"), F.expr(_WORDS).alias("w")).where(F.size("w") >= least)
        hashes = F.expr(f"transform(sequence(1, size(w) - {least - 1}), i -> xxhash64(array_join(slice(w, i, {least}), ' ')))")
        return words.select(f"{side}_id", f"{side}_row", F.posexplode(hashes).alias(f"{side}_at", "gram"))

    met = places(left, "left").join(places(right, "right"), "gram").withColumn("diagonal", F.col("right_at") - F.col("left_at"))
    key = ["left_id", "left_row", "right_id", "right_row", "diagonal"]
    steps = met.selectExpr(*key, "left_at", f"left_at - row_number() OVER (PARTITION BY {', '.join(key)} ORDER BY left_at) AS run")
    found = steps.groupBy(*key, "run").agg(F.min("left_at").alias("left_at"), (F.count(F.lit(1)) + least - 1).alias("longest"))
    best = found.groupBy("left_id", "right_id").agg(F.max(F.struct("longest", (-F.col("left_at")).alias("a"), (-F.col("left_at") - F.col("diagonal")).alias("b"))).alias("t"))
    return best.select("left_id", "right_id", F.col("t.longest").alias("longest"), (-F.col("t.a")).cast("long").alias("left_at"), (-F.col("t.b")).cast("long").alias("right_at"))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark against all documents."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("left_id"), "text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("right_id"), "text")
    return longest_runs(items, docs).withColumnsRenamed({"left_id": "item_id", "right_id": "doc_id", "left_at": "item_at", "right_at": "doc_at"})


QUERIES = {"str23_longest": leaks}
#: Every start of a run (words before it differ) is extended to its end, word by word.
ORACLES = {
    "str23_longest": f"""
WITH RECURSIVE b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
x AS (SELECT item_id, w, i, array_to_string(w[i : i + {LEAST - 1}], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - {LEAST - 2})) AS i FROM b) t),
y AS (SELECT doc_id, w, k, array_to_string(w[k : k + {LEAST - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LEAST - 2})) AS k FROM d) t),
s AS (SELECT item_id, doc_id, x.w AS p, y.w AS q, i, k, {LEAST} AS n FROM x JOIN y ON x.g = y.g WHERE i = 1 OR k = 1 OR x.w[i - 1] <> y.w[k - 1]),
r AS (SELECT * FROM s UNION ALL SELECT item_id, doc_id, p, q, i, k, n + 1 FROM r WHERE i + n <= len(p) AND k + n <= len(q) AND p[i + n] = q[k + n])
SELECT item_id, doc_id, CAST(n AS BIGINT) AS longest, CAST(i - 1 AS BIGINT) AS item_at, CAST(k - 1 AS BIGINT) AS doc_at FROM r QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY n DESC, i, k) = 1"""
}
