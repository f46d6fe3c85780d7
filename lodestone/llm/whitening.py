"""Embedding whitening by a block Jacobi-Davidson method whose products with the covariance run in Spark, matrix-free.

The covariance V is never formed: a product V·U is the sum over all rows of (x - S/n)·((x - S/n)·U), computed where the packed
blocks of vectors lie; tasks send one d by m partial sum each, which a reduction tree adds up. The driver holds only the
subspace: at most BASIS * k columns of length d.

Each round takes the Ritz pairs of the subspace, locks the leading ones whose residual has reached double precision,
solves the projected correction equations (I - QQ')(V - θI)(I - QQ')t = -r of all others together by a few steps of MINRES,
orthonormalises the corrections against the subspace and adds them. A subspace that is full restarts from its best Ritz vectors.
It ends when all wanted pairs are locked. The starting block is fixed, so that reruns agree.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped; an entry that a shorter vector lacks
counts as 0 (x = 100000); only components whose eigenvalue stands above the rounding of the largest are returned, so there are
fewer than COMPONENTS in a narrower or degenerate table, and none if all vectors are equal; deviation is null where it does not
fit a long; null vec_ids pass through; repeated rows count as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import vectors
from lodestone.llm.common import merge_tree, staged, tidy

#: Fixed values of the contract: x = floor(SCALE * c) + SHIFT, components returned at most.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Widest subspace in multiples of the wanted components, steps of MINRES in a round, rounds in which nothing need be locked.
BASIS, INNER, PATIENCE = 8, 4, 40
#: Residual, as a part of the largest eigenvalue, that counts as double precision: rounding of a product by a vector of unit length.
PRECISE = 2.0**-46
#: Partial sums that the driver adds up itself; more are first added in a tree.
DIRECT = 32


class Rows:
    """The packed vectors of a table and sums over them."""

    def __init__(self, blocks: DataFrame) -> None:
        self.blocks = blocks
        self.tasks = max(1, blocks.rdd.getNumPartitions())
        size = blocks.agg(F.max("width").alias("d"), F.sum("n").alias("n")).first()
        self.d, self.n = size["d"] or 0, size["n"] or 0
        self.products = 0

    def total(self, of: Callable[[np.ndarray], np.ndarray], kind: type = np.float64) -> np.ndarray:
        """Sum over all blocks of the array that of makes of a block's x, in an order that does not change between runs."""
        width, found = self.d, []

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                for w, data in zip(batch.column(1), batch.column(2), strict=True):
                    own = of(vectors.widened(vectors.unpacked(data, w.as_py()), width, SHIFT))
                    out = own if out is None else out + own
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.astype(kind).tobytes()])], names=["sum"])

        def add(table: pa.Table) -> pa.Table:
            held = sorted(zip((k.as_py() for k in table.column("task")), (s.as_py() for s in table.column("sum")), strict=True))
            sums = np.sum([np.frombuffer(s, kind) for _, s in held], axis=0)
            return pa.table([pa.array([held[0][0]], pa.int32()), pa.array([table.column("slot")[0].as_py()], pa.int32()), pa.array([sums.tobytes()])], names=["task", "slot", "sum"])

        sums = self.blocks.select("n", "width", "data").mapInArrow(tidy(part), "sum binary")
        if self.tasks > DIRECT:
            sums = sums.withColumn("task", F.spark_partition_id()).withColumn("slot", F.col("task") % DIRECT)
            sums = merge_tree(sums, ["slot"], add, "task int, slot int, sum binary", self.tasks // DIRECT).orderBy("slot").select("sum")
        found = [np.frombuffer(r["sum"], kind) for r in sums.collect()]  # at most DIRECT sums
        self.products += 1
        return np.sum(found, axis=0)

    def moments(self) -> tuple[np.ndarray, np.ndarray, float]:
        """S (exact), the mean, and the trace of V."""
        s = self.total(lambda x: x.sum(0), np.int64)
        mean = s / self.n
        return s, mean, float(self.total(lambda x: ((x - mean) ** 2).sum(keepdims=True).ravel())[0]) / self.n

    def covariance(self, mean: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """V times the columns of u, without V."""

        def product(u: np.ndarray) -> np.ndarray:
            u = np.ascontiguousarray(u)

            def centred(x: np.ndarray) -> np.ndarray:
                c = x - mean
                return (c.T @ (c @ u)).ravel()

            return self.total(centred).reshape(u.shape) / self.n

        return product


def orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The part of new that basis does not span, as orthonormal columns; what is dependent is left out."""
    out = np.zeros((len(new), 0))
    for column in new.T:
        before = np.linalg.norm(column)
        for _ in range(3):
            column = column - basis @ (basis.T @ column)
            column = column - out @ (out.T @ column)
        size = np.linalg.norm(column)
        if before > 0 and size > 1e-10 * before:
            out = np.hstack([out, (column / size)[:, None]])
    return out


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, reach: float) -> np.ndarray:
    """x with apply(x) near b, all columns at once: Lanczos with Givens rotations, until reach or the number of steps."""
    x, w, w_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    start = np.where(beta > 0, beta, 1)
    v, v_old, eta = b / start, np.zeros_like(b), beta.copy()
    beta_old, c, c_old, s, s_old = np.zeros_like(beta), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        if (np.abs(eta) <= reach * start).all():
            break
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta_old * v_old
        beta_new = np.linalg.norm(p, axis=0)
        r1 = s_old * beta_old
        r2 = s * alpha + c * c_old * beta_old
        r3 = c * alpha - s * c_old * beta_old
        size = np.hypot(r3, beta_new)
        safe = np.where(size > 0, size, 1)
        c_next, s_next = r3 / safe, beta_new / safe
        w_next = (v - r1 * w_old - r2 * w) / safe
        x = x + np.where(size > 0, c_next * eta, 0) * w_next
        eta = -s_next * eta
        w_old, w, v_old = w, w_next, v
        v = p / np.where(beta_new > 0, beta_new, 1)
        beta_old, c_old, c, s_old, s = beta_new, c, c_next, s, s_next
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k leading eigenvalues of the symmetric product in falling order, their unit vectors and the largest residual."""
    wide = min(d, BASIS * k)
    basis = orthonormal(np.random.default_rng(13).standard_normal((d, min(d, 2 * k))), np.zeros((d, 0)))
    image = product(basis)
    best, since, locked = np.inf, 0, 0
    while True:
        h = basis.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz = basis @ s[:, :k]
        residual = image @ s[:, :k] - ritz * theta[:k]
        far = np.linalg.norm(residual, axis=0)
        precise = far <= PRECISE * max(theta[0], 0)
        done = int(np.argmin(precise)) if not precise.all() else k  # pairs are locked from the first one on
        worst = float(far.max())
        since = 0 if done > locked or worst < best / 2 else since + 1
        best, locked = min(best, worst), max(locked, done)
        if done == k or theta[0] <= 0 or (basis.shape[1] == d and since > 2):
            return theta[:k], ritz, worst
        if since > PATIENCE:
            raise ArithmeticError(f"no eigenpair was locked in {PATIENCE} rounds; residual {worst}")
        if basis.shape[1] == d:  # the whole space: only the images of the basis can be more exact
            basis = orthonormal(basis @ s, np.zeros((d, 0)))
            image = product(basis)
            continue
        if basis.shape[1] + k - done > wide and wide < d:
            keep = s[:, : min(2 * k, wide - k)]
            basis, image = basis @ keep, image @ keep
        at, q = theta[done:k], ritz

        def projected(t: np.ndarray, at=at, q=q) -> np.ndarray:
            t = t - q @ (q.T @ t)
            t = product(t) - at * t
            return t - q @ (q.T @ t)

        r = residual[:, done:]
        r = r - q @ (q.T @ r)
        steps = 0 if d - basis.shape[1] <= k - done else INNER  # the rest of the space fits into the subspace
        new = orthonormal(minres(projected, -r, steps, 1e-3) if steps else r, basis)
        if basis.shape[1] + new.shape[1] <= d and new.shape[1] < min(k - done, d - basis.shape[1]):
            spare = np.random.default_rng(basis.shape[1]).standard_normal((d, min(k - done, d - basis.shape[1]) - new.shape[1]))
            new = np.hstack([new, orthonormal(spare, np.hstack([basis, new]))])
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Up to so many rows for each usable row of (vec_id, embedding): its place on each component, with the digest columns of the fit."""
    spark = rows.sparkSession
    blocks = staged(vectors.blocks(rows.select("vec_id", F.lit(0).alias("label"), "embedding"), SCALE, SHIFT), "vectors")
    table = Rows(blocks)
    n, d = table.n, table.d
    empty = spark.createDataFrame([], _OUT)
    if not n:
        return empty
    s, mean, trace = table.moments()
    if trace <= 0:
        return empty
    values, axes, _ = jacobi_davidson(table.covariance(mean), d, min(components, d))
    held = values > d * np.finfo(float).eps * values[0]
    values, axes = values[held], axes[:, held]
    scaled = axes / np.sqrt(values)
    m = len(values)
    middle = table.total(lambda x: ((x - mean) @ scaled).sum(0)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scaled - middle
        return (w.T @ w).ravel()

    error = float(np.abs(table.total(spread).reshape(m, m) / n - np.eye(m)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, width, data in zip(*(batch.column(c) for c in ("ids", "width", "data")), strict=True):
                x = vectors.widened(vectors.unpacked(data, width.as_py()), d, SHIFT)
                w, count = (x - mean) @ scaled, len(x)
                off = n * x - s
                fits = (off.astype(float) ** 2).sum(1) < 2.0**62
                deviation = np.where(fits, (np.where(fits[:, None], off, 0) ** 2).sum(1), 0)
                columns = [
                    ids.values.take(pa.array(np.repeat(np.arange(count), m))),
                    pa.array(np.tile(np.arange(1, m + 1), count), pa.int32()),
                    pa.array(np.full(count * m, n), pa.int64()),
                    pa.array(np.repeat(deviation, m), pa.int64(), mask=np.repeat(~fits, m)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, count)),
                    pa.array(np.full(count * m, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")])

    return blocks.mapInArrow(tidy(project), _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(vectors.embeddings(spark, sf_dir))
