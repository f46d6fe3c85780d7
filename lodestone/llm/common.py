"""Shared helpers of the corpus operators: staging, row keys and word scanning over UTF-8 buffers."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.storage import fresh_folder

#: The white space that separates words (space, tab, LF, VT, FF, CR).
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that df does not have, whatever the case of its names: the wanted ones where free."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def merge_tree(rows: DataFrame, key: list[str], merge, schema: str, tasks: int, fan_in: int = 64) -> DataFrame:
    """merge (an Arrow function of the rows of one key, to rows of the same kind) over rows that about so many tasks send.

    Where more than 4 * fan_in tasks send, their rows are first merged in fan_in groups a key, or in steps of more
    groups; so no task merges what all tasks have sent.
    """
    groups = []
    while tasks > 4 * fan_in:
        tasks = -(-tasks // fan_in)
        groups.append(min(tasks, 1 << 30))
    if not groups:
        return rows.groupBy(*key).applyInArrow(merge, schema)
    rows, kept = rows.withColumn("deal", F.spark_partition_id()), schema + ", deal int"

    def step(table: pa.Table) -> pa.Table:
        out = merge(table.drop_columns(["deal"]))
        return out.append_column("deal", pa.array([table.column("deal")[0].as_py()] * out.num_rows, pa.int32()))

    for n in groups:
        rows = rows.withColumn("deal", F.col("deal") % n).groupBy(*key, "deal").applyInArrow(step, kept)
    return rows.drop("deal").groupBy(*key).applyInArrow(merge, schema)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id modulo modulus; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """96 bits that identify a row by its content: equal rows share a key and every result."""
    return F.xxhash64(doc_id, text), F.hash(text, doc_id)


def tidy(run):
    """A function for mapInArrow that gives freed memory back to the system when its task ends: workers live on."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only some C libraries offer it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def doc_slices(offsets: np.ndarray, limit: int = 1 << 19):
    """Ranges of whole documents with about limit bytes each, so that work arrays stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX
    h = (h ^ (h >> _U(29))) * _MIX
    return h ^ (h >> _U(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial sums of bytes; span(s, e) hashes are taken from them."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the range of its words (n + 1 offsets)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    start = ~space
    end = start.copy()
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    after, before = start[inner], end[inner - 1]
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    start[inner] = after
    end[inner - 1] = before
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased."""
    return span_hash(prefix_sums(_LOWER[data]), starts, ends)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
