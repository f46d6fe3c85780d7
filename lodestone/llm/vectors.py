"""Tables of vectors as packed blocks of exact integers, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import tidy

#: Rows of a block, and numbers that a block holds at most (so that blocks of wide vectors stay small).
ROWS, NUMBERS = 2048, 1 << 20
BLOCK = "ids array<long>, labels array<int>, n int, width int, data binary"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def integers(column: pa.Array, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The usable rows of a list column (not null, no null and no non-finite entry), their lengths, and floor(scale * entry) + shift of all of them."""
    column = column.cast(pa.large_list(pa.float64()))
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    value = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(length)), length)
    usable = pc.is_valid(column).to_numpy(zero_copy_only=False)
    usable[row[~np.isfinite(value)]] = False
    kept = value[usable[row]]
    scaled = np.floor(scale * kept)
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("a component is too large for exact 64-bit integers")
    return np.flatnonzero(usable), length[usable], scaled.astype(np.int64) + shift


def matrix(lengths: np.ndarray, flat: np.ndarray, width: int, fill: int) -> np.ndarray:
    """One row a vector, padded with fill up to width."""
    out = np.full((len(lengths), width), fill, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def packed(x: np.ndarray) -> bytes:
    """The numbers in the narrowest type that holds them, its size in the first byte."""
    for kind in (np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()
    return bytes([8]) + x.tobytes()


def unpacked(data: pa.Scalar, width: int) -> np.ndarray:
    raw = data.as_py()
    return np.frombuffer(raw, f"i{raw[0]}", offset=1).astype(np.int64).reshape(-1, width) if width else np.zeros((0, 0), np.int64)


def pack_row(ids: pa.Array, labels: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    def listed(column: pa.Array, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.cast(kind))

    sizes = [pa.array([v], pa.int32()) for v in x.shape]
    return pa.RecordBatch.from_arrays([listed(ids, pa.int64()), listed(labels, pa.int32()), *sizes, pa.array([packed(x)])], names=["ids", "labels", "n", "width", "data"])


def blocks(rows: DataFrame, scale: int, shift: int) -> DataFrame:
    """Blocks of the usable rows of (vec_id, label, embedding), packed where the rows lie; entries that a shorter vector lacks count as 0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, lengths, flat = integers(batch.column(2), scale, shift)
            ends = np.cumsum(lengths)
            k = 0
            while k < len(usable):
                step = max(1, min(ROWS, NUMBERS // max(1, int(lengths[k : k + ROWS].max()))))
                part = slice(k, k + step)
                own = flat[ends[k] - lengths[k] : ends[min(k + step, len(usable)) - 1]]
                at = pa.array(usable[part])
                # a block of empty vectors has one column of padding, so that its rows are still counted
                yield pack_row(batch.column(0).take(at), batch.column(1).take(at), matrix(lengths[part], own, max(1, int(lengths[part].max())), shift))
                k += step

    kinds = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>"))
    return kinds.mapInArrow(tidy(pack), BLOCK)


def widened(x: np.ndarray, width: int, fill: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=fill)
