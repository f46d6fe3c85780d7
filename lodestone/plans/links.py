"""Links, components, bands and shared touches over every row; joi21_knn, joi10_shared and joi11_cotouch without _all are searches from one anchor in 20."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import overlap
from lodestone.operators.components import components
from lodestone.plans import evidence, resolution, text
from lodestone.plans.sql import twin

#: Nearest rows kept of each vector, vectors of a block and numbers in them at most, anchors of a block that are compared at
#: once, groups of candidates.
NEAREST, BLOCK, NUMBERS, TILE, GROUPS = 3, 16384, 1 << 20, 256, 256

_LINKS = f"""
SELECT a_id, b_id, score FROM (
  SELECT a_id, b_id, score, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rn FROM (
    SELECT a.vec_id AS a_id, b.vec_id AS b_id,
           round((1 + list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) / 2, 6) AS score
    FROM {{embeddings}} a JOIN {{embeddings}} b ON a.label = b.label AND a.vec_id <> b.vec_id) s) t WHERE rn <= {NEAREST}"""


def _first(row: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the NEAREST greatest scores of each row, the first of equal ones; rows ascend, scores are not negative."""
    if not len(row):
        return np.zeros(0, np.int64)
    begin, found = np.flatnonzero(np.diff(row, prepend=-1)), []
    many = np.diff(begin, append=len(row))
    for _ in range(NEAREST):
        most = np.maximum.reduceat(score, begin)
        equal = np.flatnonzero((score == np.repeat(most, many)) & (score >= 0))
        found.append(equal[np.diff(row[equal], prepend=-1) > 0])
        score[found[-1]] = -1
    return np.concatenate(found)


def _nearest(table: pa.Table) -> pa.Table:
    """The nearest candidates of each anchor of one pair of blocks.

    Products in single precision and the greatest of each group of candidates give a floor under the NEAREST best of an anchor. What
    reaches it, less the most that this precision and the rounding of scores can hide, is scored in full.
    """
    vectors = table.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    ids, anchor = table.column("vec_id").to_numpy(), table.column("side").to_numpy() == 0
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    sound = (length > 0) & np.isfinite(length)
    left, right = np.flatnonzero(anchor & sound), np.flatnonzero(~anchor & sound)
    right = right[np.argsort(ids[right], kind="stable")]
    span, width = -(-len(right) // GROUPS), vectors.shape[1]
    unit = lambda rows: (vectors[rows] / length[rows, None]).astype(np.float32)
    others = np.zeros((span * GROUPS, width), np.float32)
    others[: len(right)] = unit(right)
    slack, step = (width + 8) * 2.0**-23 + 4e-6, max(1, NUMBERS // width)
    a, b, score = [], [], []
    for k in range(0, len(left) if len(right) else 0, TILE):
        rows = left[k : k + TILE]
        s = unit(rows) @ others.T
        s[:, len(right) :] = -4
        for i, (x, y) in enumerate(zip(np.searchsorted(ids[right], ids[rows]), np.searchsorted(ids[right], ids[rows], "right"), strict=True)):
            s[i, x:y] = -4
        s = s.reshape(len(rows), span, GROUPS)
        most = s.max(axis=1)
        floor = np.maximum(np.partition(most, GROUPS - NEAREST, axis=1)[:, GROUPS - NEAREST] - slack, -3)
        at, group = np.nonzero(most >= floor[:, None])
        which, place = np.nonzero(s[at, :, group] >= floor[at, None])
        order = np.argsort(at[which] * (span * GROUPS) + place * GROUPS + group[which], kind="stable")
        at, near = at[which][order], right[(place * GROUPS + group[which])[order]]
        full = np.empty(len(at))
        for i in range(0, len(at), step):
            x, y = rows[at[i : i + step]], near[i : i + step]
            full[i : i + step] = np.einsum("ij,ij->i", vectors[x], vectors[y], dtype=np.float64) / (length[x] * length[y])
        full = np.floor(np.maximum(1 + full, 0) / 2 * 1e6 + 0.5) / 1e6
        best = _first(at, full.copy())
        a.append(ids[rows[at[best]]])
        b.append(ids[near[best]])
        score.append(full[best])
    columns = (pa.array(np.concatenate(x) if x else np.zeros(0), t) for x, t in ((a, pa.int64()), (b, pa.int64()), (score, pa.float64())))
    return pa.table(list(columns), names=["a_id", "b_id", "score"])


def nearest(vectors: DataFrame, block: int = BLOCK, asked: Column | None = None) -> DataFrame:
    """The NEAREST rows of each vector among all others of its label, or of those asked for: blocks against blocks, partial bests merged.

    Missing ids, labels and vectors and vectors of length zero have no score and link nothing.
    """
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL)")
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.expr("embedding" if single else "transform(embedding, x -> CAST(x AS DOUBLE))").alias("e"), F.size("embedding").alias("width"), (F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))).alias("asks"))
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(NUMBERS) / F.col("width"))))
    blocks = (F.ceil(n / F.first(most)).cast("int").alias(name) for n, name in ((F.count_if("asks"), "left"), (F.count(F.lit(1)), "right")))
    rows = rows.join(rows.groupBy("label", "width").agg(*blocks), ["label", "width"]).where("left > 0")
    key, value, spread = ["label", "width", "block", "other"], ["vec_id", "e"], F.xxhash64("vec_id")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    mine = lambda many: F.pmod(spread, F.col(many)).cast("int")
    anchors = rows.where("asks").withColumn("block", mine("left")).select("*", every("right").alias("other")).select(*key, *value, F.lit(0).alias("side"))
    others = rows.withColumn("other", mine("right")).select("*", every("left").alias("block")).select(*key, *value, F.lit(1).alias("side"))
    best = anchors.unionByName(others).groupBy(*key).applyInArrow(_nearest, "a_id long, b_id long, score double")
    return _best(best)


def _best(found: DataFrame) -> DataFrame:
    return found.selectExpr("*", "row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rn").where(F.col("rn") <= NEAREST).drop("rn")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link table: every vector against all rows of its label."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_ODD = """
WITH v AS (SELECT vec_id, label, transform(embedding, x -> CAST(x AS DOUBLE)) AS e FROM {embeddings} WHERE vec_id IS NOT NULL AND label IS NOT NULL),
n AS (SELECT vec_id, label, size(e) AS width, sqrt(aggregate(e, 0D, (s, x) -> s + x * x)) AS len FROM v),
k AS (SELECT vec_id, label, width, CASE WHEN len IS NULL OR width = 0 THEN 'none' WHEN len > 0 AND len < double('inf') THEN 'sound' ELSE 'nan' END AS kind FROM n),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, kind, width, vec_id ORDER BY vec_id) AS rn FROM (
  SELECT *, dense_rank() OVER (PARTITION BY label, kind, width ORDER BY vec_id) AS place FROM k) p WHERE place <= 4) r WHERE rn <= 3)
SELECT a.vec_id AS a_id, b.vec_id AS b_id, CASE WHEN a.kind <> 'none' AND b.kind <> 'none' AND a.width = b.width THEN double('NaN') END AS score
FROM k a JOIN low b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 20 = 0 AND (a.kind <> 'sound' OR b.kind <> 'sound' OR a.width <> b.width)"""


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search joi21_knn: the nearest rows of the anchors alone, and as in SQL also pairs without a number for a score.

    These are NaN, which comes first (a vector of length zero or not finite), or null, which comes last (no vector, a missing number, other
    widths). They are equal for all rows of a kind, so the rows of least id stand for it: of four ids, since one can be the anchor's own.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return _best(nearest(vectors, asked=F.col("vec_id") % 20 == 0).unionByName(spark.sql(_ODD, embeddings=vectors)))


def recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(evidence._recall("SELECT * FROM {knn}"), knn=anchored(spark, sf_dir), embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def linked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(links(spark, sf_dir).where(F.col("score") >= resolution.LINK), "a_id", "b_id")


def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = linked_groups(spark, sf_dir).groupBy("component").agg(F.count("*").alias("members"), F.max("node").alias("last"))
    return groups.withColumn("misc", F.col("members") < evidence.MISC)


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked_groups(spark, sf_dir)
    left, right = found.toDF("a_id", "group_a"), found.toDF("b_id", "group_b")
    pairs = links(spark, sf_dir).where(F.col("score") < evidence.SAME)
    return pairs.join(left, "a_id").join(right, "b_id").where("group_a = group_b").select("a_id", "b_id", "score", F.col("group_a").alias("component"))


def _over_links(made: str):
    """A query whose text reads the link table as {links}."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(made, links=links(spark, sf_dir), embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

    return run


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sets of parts."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS key", "l_partkey AS item")


def _both(pairs: DataFrame, value: str) -> DataFrame:
    return pairs.select(value, F.explode(F.array(F.struct(F.col("a").alias("a_key"), F.col("b").alias("b_key")), F.struct(F.col("b").alias("a_key"), F.col("a").alias("b_key")))).alias("p")).select("p.a_key", "p.b_key", value)


def cotouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(overlap.counted(_orders(spark, sf_dir), 2), "shared")


def cotouched_by_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.counted(_orders(spark, sf_dir), 2, F.col("key") % 20 == 0).toDF("a_key", "b_key", "shared")


def shared_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(overlap.listed(_orders(spark, sf_dir), 5).withColumnRenamed("item", "partkey"), "partkey")


_TABLE = "SELECT * FROM {links}"
_GROUPS = twin(f"""
WITH RECURSIVE l AS (SELECT a_id, b_id FROM ({_LINKS}) k WHERE score >= {resolution.LINK}), e AS (SELECT a_id AS u, b_id AS v FROM l UNION SELECT b_id, a_id FROM l),
r AS (SELECT u AS node, u AS seen FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
QUERIES = {
    "joi21_knn": anchored,
    "grf28_recall": recalled,
    "joi21_links": links,
    "grf06_components_all": linked_groups,
    "grf15_partition_all": partition,
    "grf11_closure_all": closure,
    "mth03_band_all": _over_links(text._bands(_TABLE)),
    "grf05_floors_all": _over_links(resolution._floors(_TABLE)),
    "joi11_cotouch_all": cotouched,
    "joi11_cotouch": cotouched_by_anchor,
    "joi10_shared_all": shared_parts,
}
ORACLES = {
    "joi21_links": twin(_LINKS),
    "grf06_components_all": _GROUPS,
    "grf15_partition_all": f"SELECT component, count(*) AS members, max(node) AS last, count(*) < {evidence.MISC} AS misc FROM ({_GROUPS}) g GROUP BY component",
    "grf11_closure_all": f"WITH g AS ({_GROUPS}) SELECT a_id, b_id, score, x.component FROM ({twin(_LINKS)}) k JOIN g x ON x.node = a_id JOIN g y ON y.node = b_id WHERE score < {evidence.SAME} AND x.component = y.component",
    "mth03_band_all": twin(text._bands(_LINKS)),
    "grf05_floors_all": twin(resolution._floors(_LINKS)),
    "joi11_cotouch_all": """
WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT a.l_orderkey AS a_key, b.l_orderkey AS b_key, count(*) AS shared
FROM e a JOIN e b ON a.l_partkey = b.l_partkey AND a.l_orderkey <> b.l_orderkey GROUP BY 1, 2 HAVING count(*) >= 2""",
    "joi10_shared_all": """
WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT a_key, b_key, partkey FROM (
  SELECT a.l_orderkey AS a_key, b.l_orderkey AS b_key, a.l_partkey AS partkey, row_number() OVER (PARTITION BY a.l_orderkey, b.l_orderkey ORDER BY a.l_partkey) AS rn
  FROM e a JOIN e b ON a.l_partkey = b.l_partkey AND a.l_orderkey <> b.l_orderkey) t WHERE rn <= 5""",
}
#: Components, partitions, closures and bands are no searches: their plain names, too, stand for the whole link table.
WHOLE = ("grf06_components", "grf15_partition", "grf11_closure", "mth03_band", "grf05_floors")
QUERIES |= {name: QUERIES[f"{name}_all"] for name in WHOLE}
ORACLES |= {name: ORACLES[f"{name}_all"] for name in WHOLE}
