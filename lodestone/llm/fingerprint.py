"""Document fingerprints from prefix polynomial hashes.

PrefixHash keeps modular prefix arrays under two primes of about 31 bits. Any span's hash comes from two
entries of each, so any two spans of any two texts can be compared at once, and the longest common extension
of two places is found by binary search over span lengths. A fingerprint is the length, the hash of the whole
text and the KEEP smallest hashes among all spans of SPAN code points (a bottom-k sketch); likeness is the
share of the smallest spans of both texts together that both hold.

Defined results: null texts are empty; texts shorter than SPAN have one span, the whole text, and an empty text
none; two empty texts are alike (1.0), an empty and a non-empty one are not (0.0); documents with one doc_id
follow each other in code-point order of their texts; null doc_ids come last in the descending order; a table
of one row is its own neighbour; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents, partitions

#: The two primes below 2**31 and the bases of the polynomials.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SPAN = 24
KEEP = 64
#: Documents of one stretch of the descending order.
STRETCH = 256
_U = np.uint64
_tables: dict[int, list[np.ndarray]] = {}


def _powers(n: int) -> list[np.ndarray]:
    """Powers of each base and of its inverse, by repeated doubling."""
    have = max(_tables, default=0)
    if have >= n:
        return _tables[have]
    size = 1 << max(12, n.bit_length())
    out = []
    for p, b in zip(PRIMES, BASES, strict=True):
        for x in (b, pow(b, -1, p)):
            row = np.ones(size, _U)
            filled, step = 1, x
            while filled < size:
                more = min(filled, size - filled)
                row[filled : filled + more] = row[:more] * _U(step) % _U(p)
                step = step * step % p
                filled += more
            out.append(row)
    _tables.clear()
    _tables[size] = out
    return out


class PrefixHash:
    """Modular prefix arrays of a sequence of code points."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        tables = _powers(self.n + 1)
        self.sums, self.down = [], []
        values = codes.astype(_U) + _U(1)
        for k, p in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, _U)
            np.cumsum(values * tables[2 * k][: self.n] % _U(p), out=sums[1:])
            sums %= _U(p)
            self.sums.append(sums)
            self.down.append(tables[2 * k + 1])

    def span(self, start, end) -> np.ndarray:
        """62-bit hashes of the spans [start, end); equal spans have equal hashes wherever they stand."""
        h = []
        for sums, down, p in zip(self.sums, self.down, PRIMES, strict=True):
            h.append((sums[end] + _U(p) - sums[start]) * down[start] % _U(p))
        return h[0] << _U(31) | h[1]

    def extension(self, at: int, other: PrefixHash, there: int) -> int:
        """Length of the longest common extension of self[at:] and other[there:]."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(at, at + mid) == other.span(there, there + mid):
                low = mid
            else:
                high = mid - 1
        return low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _spread(h: np.ndarray) -> np.ndarray:
    h = h * _U(0x9E3779B97F4A7C15)
    return (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93) >> _U(32)


def sketch(prefix: PrefixHash, span: int = SPAN, keep: int = KEEP) -> list[int]:
    """The keep smallest distinct 32-bit hashes of all spans."""
    if prefix.n == 0:
        return []
    starts = np.arange(max(1, prefix.n - span + 1))
    h = _spread(prefix.span(starts, np.minimum(starts + span, prefix.n)))
    few = 4 * keep
    if len(h) > 2 * few:  # repeated spans can fill the smallest places; then all are sorted
        small = np.unique(np.partition(h, few)[:few])
        if len(small) >= keep:
            return small[:keep].tolist()
    return np.unique(h)[:keep].tolist()


def fingerprint(prefix: PrefixHash) -> tuple[str, list[int]]:
    kept = sketch(prefix)
    whole = int(prefix.span(0, prefix.n)) if prefix.n else 0
    return f"{prefix.n}:{whole:016x}:" + "".join(f"{x:08x}" for x in kept), kept


def parse(text: str) -> list[int]:
    held = text.rsplit(":", 1)[1]
    return [int(held[i : i + 8], 16) for i in range(0, len(held), 8)]


def likeness(a: str, b: str, keep: int = KEEP, parsed: tuple[list[int], list[int]] | None = None) -> float:
    """Estimated share of the spans of two texts that both hold, from their fingerprints alone."""
    if a == b:
        return 1.0
    x, y = parsed or (parse(a), parse(b))
    if not x or not y:
        return 0.0
    return len(set(x) & set(y) & set(union := sorted({*x, *y})[:keep])) / len(union)


def _edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _describe(doc_id, text: str, mine, following: str, theirs) -> tuple:
    prefix, (print_, kept) = mine
    edited = _edited(text, following)
    changed = PrefixHash(code_points(edited))
    edited_print, edited_kept = fingerprint(changed)
    return (
        doc_id,
        len(text),
        hashlib.sha256(edited.encode()).hexdigest(),
        print_,
        edited_print,
        likeness(print_, edited_print, parsed=(kept, edited_kept)),
        likeness(print_, theirs[1][0], parsed=(kept, theirs[1][1])),
        prefix.extension(0, changed, 0),
    )


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (stretch, halo, doc_id, text) in order: each row that is not a halo meets the row after it in its stretch."""
    held = None
    for batch in batches:
        rows = []
        for stretch, halo, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            prefix = PrefixHash(code_points(text))
            mine = prefix, fingerprint(prefix)
            if held is not None and held[0] == stretch:
                rows.append(_describe(held[1], held[2], held[3], text, mine))
            held = None if halo else (stretch, doc_id, text, mine)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def neighbours(docs: DataFrame, stretch_rows: int = STRETCH) -> DataFrame:
    """Fingerprint every document, its edited text and its neighbour in descending doc_id.

    The order is cut at quantiles of doc_id into stretches that tasks sort by themselves. A stretch also gets a
    copy of the first row of the next one; those rows are found by one aggregate over the stretches.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.select("doc_id").count()
    many = min(4096, max(1, n // stretch_rows))
    cuts = []
    if many > 1:
        found = rows.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], 20 * many)).first()[0]
        cuts = sorted(set(found or ()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(cuts, np.int64)
        for batch in batches:
            ids = batch.column(0)
            at = np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            at = np.where(known, len(edges) - at, len(edges) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *batch.columns], names=["stretch", *batch.schema.names])

    placed = rows.mapInArrow(place, "stretch long, doc_id long, text string")
    first = rows.select("doc_id").mapInArrow(place, "stretch long, doc_id long").groupBy("stretch").agg(F.max("doc_id").alias("doc_id"))
    heads = sorted((r[0], r[1]) for r in first.collect())
    spark = docs.sparkSession
    before = [(heads[i - 1][0], d) for i, (_, d) in enumerate(heads)]
    halos = F.broadcast(spark.createDataFrame(before, "target long, first_id long"))
    tops = rows.join(halos, F.col("doc_id").eqNullSafe(F.col("first_id")))
    tops = tops.groupBy("target", "doc_id").agg(F.min("text").alias("text"))
    both = placed.select("stretch", F.lit(False).alias("halo"), "doc_id", "text").unionAll(tops.select("target", F.lit(True), "doc_id", "text"))
    order = ["stretch", "halo", F.col("doc_id").desc_nulls_last(), "text"]
    return both.repartition(partitions(spark), "stretch").sortWithinPartitions(*order).mapInArrow(_walk, _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(documents(spark, sf_dir))
