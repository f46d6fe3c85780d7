"""Hard-negative mining: exact integer inner products of anchors and candidates by Strassen's recursion, and heaps that merge.

Usable rows are packed into blocks of integer matrices where they lie. Anchors are dealt into blocks of their own; every block of
anchors meets every block of candidates once, as a stated set of queries against all rows, and the blocks of candidates that
meet one block of anchors are spread over many tasks. A task multiplies its tiles by Strassen's seven products, recursively,
padded with zeros to even sides; numbers are int64 and sums wrap, so the products are exact wherever the scores fit a long.

Two passes: the first keeps a heap of the best POSITIVES + 1 rows of an anchor's own label (the anchor itself is among
them), the second a heap of the best NEGATIVES rows of other labels inside each positive's window of scores. Heaps of tiles merge in
the task; heaps of tasks merge by a ranked window, of which Spark keeps the first rows of each key before the shuffle.

Defined results: rows with a null label or vector, or with a null or non-finite component, take no part; a shorter vector
counts as padded with zeros; a row with a null vec_id is no anchor and keeps its label, it can be a partner and comes after equal scores;
rows that share a vec_id are rows of their own, so a repeated anchor is a positive of its copy and has its results twice;
an anchor without positives, or with an empty window, has no rows; an empty table gives no rows; other columns are ignored.
Scores that do not fit a long stop the run with an error rather than wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import vectors
from lodestone.llm.common import partitions, staged, tidy

#: Fixed values of the contract: scale of a component, positives of an anchor, negatives of a positive, its window in hundredths.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
#: Anchors of a block, blocks of candidates of one task at most (on average), rows and columns of a tile, side at which the recursion ends.
ANCHORS, CANDIDATES, TILE_ROWS, TILE_COLUMNS, LEAF = 1024, 16, 256, 4096, 32


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 matrices by seven products of quarters; sums wrap modulo 2**64, which leaves fitting results exact."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    a = np.pad(a, ((0, m & 1), (0, k & 1)))
    b = np.pad(b, ((0, k & 1), (0, n & 1)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1, p2 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11)
    p3, p4 = strassen(a11, b12 - b22), strassen(a22, b21 - b11)
    p5, p6, p7 = strassen(a11 + a12, b22), strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def _guard(a: np.ndarray, c: np.ndarray) -> None:
    if a.size and c.size and float(np.abs(a).max()) * float(np.abs(c).max()) * a.shape[1] * 100 >= 2.0**63:
        raise OverflowError("scores of these vectors do not fit a long")


def merged(heap: tuple[np.ndarray, ...], most: int) -> tuple[np.ndarray, ...]:
    """The first rows of each key of (key, score, none, id): higher scores first, then smaller ids, null ids last."""
    key, score, none, vec = heap
    order = np.lexsort((vec, none, ~score, key))
    key = key[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    rank = np.arange(len(key)) - np.repeat(head, np.diff(np.r_[head, len(key)]))
    return tuple(c[order][rank < most] for c in (heap[0], score, none, vec))


class Candidates:
    """The blocks of candidates of one task as one matrix, in the order of their ids."""

    def __init__(self, table: pa.Table, width: int) -> None:
        ids = pa.concat_arrays([c.flatten() for c in table.column("ids").chunks])
        none = ids.is_null().to_numpy(zero_copy_only=False)
        vec = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        x = np.concatenate([vectors.widened(vectors.unpacked(d, w.as_py()), width, 0) for d, w in zip(table.column("data"), table.column("width"), strict=True)])
        order = np.lexsort((vec, none))
        self.vec, self.none, self.x = vec[order], none[order], x[order]
        self.label = pa.concat_arrays([c.flatten() for c in table.column("labels").chunks]).to_numpy(zero_copy_only=False)[order]


def _sides(anchors: pa.Table, table: pa.Table) -> tuple[np.ndarray, np.ndarray, Candidates]:
    width = max(max(anchors.column("width").to_pylist()), max(table.column("width").to_pylist()))
    a = np.concatenate([vectors.widened(vectors.unpacked(d, w.as_py()), width, 0) for d, w in zip(anchors.column("data"), anchors.column("width"), strict=True)])
    there = Candidates(table, width)
    _guard(a, there.x)
    return a, anchors.column("label").to_numpy(), there


_HEAP = pa.schema([("row", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _heap_table(row: np.ndarray, slot: np.ndarray, score: np.ndarray, none: np.ndarray, vec: np.ndarray) -> pa.Table:
    return pa.table([pa.array(row, pa.int64()), pa.array(slot, pa.int32()), pa.array(vec, pa.int64(), mask=none), pa.array(score, pa.int64())], schema=_HEAP)


def _no_heap() -> tuple[np.ndarray, ...]:
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)


def _together(heap: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...], most: int) -> tuple[np.ndarray, ...]:
    return merged(tuple(np.concatenate(pair) for pair in zip(heap, more, strict=True)), most)


def _positive_heaps(anchors: pa.Table, table: pa.Table) -> pa.Table:
    """The best rows of each anchor's own label in these blocks, the anchor itself among them."""
    if not anchors.num_rows or not table.num_rows:
        return _HEAP.empty_table()
    a, label, there = _sides(anchors, table)
    row, heap, most = anchors.column("row").to_numpy(), _no_heap(), POSITIVES + 1
    for of in np.unique(label):
        mine, own = np.flatnonzero(label == of), np.flatnonzero(there.label == of)
        for p in range(0, len(mine), TILE_ROWS):
            for q in range(0, len(own), TILE_COLUMNS):
                i, j = mine[p : p + TILE_ROWS], own[q : q + TILE_COLUMNS]
                score = strassen(a[i], np.ascontiguousarray(there.x[j].T))
                best = np.argsort(~score, axis=1, kind="stable")[:, :most]
                j = j[best]
                heap = _together(heap, (np.repeat(i, best.shape[1]), np.take_along_axis(score, best, 1).ravel(), there.none[j].ravel(), there.vec[j].ravel()), most)
    return _heap_table(row[heap[0]], np.zeros(len(heap[0])), *heap[1:])


def _negative_heaps(anchors: pa.Table, table: pa.Table) -> pa.Table:
    """The best rows of other labels inside the window of each positive of each anchor in these blocks."""
    if not anchors.num_rows or not table.num_rows:
        return _HEAP.empty_table()
    a, label, there = _sides(anchors, table)
    row = anchors.column("row").to_numpy()
    held = anchors.column("scores").combine_chunks()
    count = held.value_lengths().to_numpy()
    positive = vectors.matrix(count, held.flatten().to_numpy(), POSITIVES, 0)
    exists = np.arange(POSITIVES) < count[:, None]
    high, low = (HIGH * positive) // 100, -((-LOW * positive) // 100)
    heap = _no_heap()
    for p in range(0, len(a), TILE_ROWS):
        for q in range(0, len(there.x), TILE_COLUMNS):
            i, j = slice(p, p + TILE_ROWS), slice(q, q + TILE_COLUMNS)
            score = strassen(a[i], np.ascontiguousarray(there.x[j].T))
            other = label[i, None] != there.label[None, j]
            below = np.where(other, ~score, np.iinfo(np.int64).max)
            order = np.argsort(below, axis=1, kind="stable")
            below, n = np.take_along_axis(below, order, 1), other.sum(1)
            for slot in range(POSITIVES):
                first = (below < ~high[i, slot, None]).sum(1)
                at = first[:, None] + np.arange(NEGATIVES)
                fits = (at < n[:, None]) & exists[i, slot, None]
                at = np.minimum(at, below.shape[1] - 1)
                value = ~np.take_along_axis(below, at, 1)
                fits &= (value >= low[i, slot, None]) & (value <= high[i, slot, None])
                x, y = np.nonzero(fits)
                where = q + order[x, at[x, y]]
                heap = _together(heap, ((p + x) * POSITIVES + slot, value[x, y], there.none[where], there.vec[where]), NEGATIVES)
    return _heap_table(row[heap[0] // POSITIVES], heap[0] % POSITIVES, *heap[1:])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of packed blocks, one row each, with the product of each with itself."""
    for batch in batches:
        for ids, labels, width, data in zip(*(batch.column(c) for c in ("ids", "labels", "width", "data")), strict=True):
            vec, x = np.array([-1 if v is None else v for v in ids.as_py()], np.int64), vectors.unpacked(data, width.as_py())
            known = ids.values.is_valid().to_numpy(zero_copy_only=False)
            own = np.flatnonzero(known & (vec % ANCHOR_EVERY == 0))
            if len(own):
                _guard(x[own], x[own])
                columns = [pa.array(vec[own]), labels.values.take(pa.array(own)), pa.array([width.as_py()] * len(own), pa.int32()), pa.array([vectors.packed(x[i]) for i in own]), pa.array((x[own] ** 2).sum(1))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "label", "width", "data", "self"])


def mine(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, label, embedding)."""
    spark = rows.sparkSession
    relabelled = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    usable = rows.where("label is not null").select("vec_id", relabelled.alias("label"), "embedding")
    blocks = staged(vectors.blocks(usable, SCALE, 0), "vectors")
    anchors = blocks.mapInArrow(tidy(_anchor_rows), "anchor_id long, label int, width int, data binary, self long")
    anchors = staged(anchors.withColumn("row", F.monotonically_increasing_id()), "anchors")
    n, held = anchors.count(), blocks.count()
    deals = max(1, -(-n // ANCHORS))
    spread = min(max(1, held), max(-(-held // CANDIDATES), -(-partitions(spark) // deals)))
    number = F.xxhash64(F.monotonically_increasing_id())
    there = blocks.withColumn("part", F.pmod(number, F.lit(spread).cast("long"))).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))

    def heaps(of: DataFrame, run) -> DataFrame:
        dealt = of.withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(deals)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
        return dealt.groupBy("deal", "part").cogroup(there.groupBy("deal", "part")).applyInArrow(run, "row long, slot int, vec_id long, score long")

    best, own = "ORDER BY score DESC, vec_id NULLS LAST", "vec_id <=> anchor_id AND score = self"
    found = heaps(anchors, _positive_heaps).selectExpr("*", f"row_number() OVER (PARTITION BY row {best}) AS k").where(F.col("k") <= POSITIVES + 1)
    found = found.join(anchors.select("row", "anchor_id", "self"), "row")
    # of the rows that look like the anchor one is the anchor itself
    found = found.selectExpr("*", f"min(CASE WHEN {own} THEN k END) OVER (PARTITION BY row) AS me").where("me IS NULL OR k <> me")
    positives = found.selectExpr("row", "anchor_id", "vec_id", "score", f"row_number() OVER (PARTITION BY row {best}) AS k").where(F.col("k") <= POSITIVES)
    positives = staged(positives.select("row", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("k") - 1).cast("int").alias("slot")), "positives")
    windows = positives.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    negatives = heaps(anchors.join(windows, "row"), _negative_heaps)
    ranked = negatives.selectExpr("*", f"row_number() OVER (PARTITION BY row, slot {best}) AS rank").where(F.col("rank") <= NEGATIVES)
    out = ranked.join(positives, ["row", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(vectors.embeddings(spark, sf_dir))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * c.x[i])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""
