"""Near-duplicates through SetSketch registers: truncated minima on an exponential scale, banded, estimated jointly, verified exactly.

A document is its set of distinct 2-word shingles, known by 64-bit hashes; documents with equal sets form one class. Each
shingle starts a Poisson process of rate RATE * REGISTERS, and each of its points falls on one register drawn at random; so every register
sees the minimum of independent exponentials. The points of a shingle come in rising order and end once they lie above all minima of the
set, so a set costs about one point a shingle. A register holds floor(1 - log_BASE(minimum)), cut off at 0 and LAST + 1: registers of a
union are the larger of both, element by element, and two sets agree in a register with a chance of their similarity at least.

Bands of BAND registers name buckets. With 40 bands of 4 a pair at 0.8 meets nowhere with a chance of (1 - 0.8^4)^40, under 1e-9.
Buckets are counted with partial sums and joined as stars, so a hot bucket is never gathered; the likelihood of the numbers of registers that are larger on the
left, on the right, and equal, given both set sizes, drops pairs for which a similarity of 0.8 is six standard errors away; what stays is verified
on the whole sets and joined into components. Buckets that still hold several components are looked at again in rounds:
members outside the largest component name the TOP members of other components that are nearest by a parity sketch, which can
never rule out a pair that links; while some member had more, a round follows in which it may name GROWTH times as many.
No bucket is capped, no link between components is lost, and copies are never expanded into pairs.

Defined results: null or empty texts have no shingles, size 0, no links and their own doc_id as component; one word is one shingle; equal
rows share a component, and rows that share a doc_id are judged each by its text; a null doc_id takes part but is never a
component's name unless all of its doc_ids are null, and it is kept only then; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard
from lodestone.llm.common import doc_slices, documents, mix, staged, text_buffer, tidy, word_hashes, words

#: Similarity in hundredths at which documents link.
LINK = 80
#: Registers in bands; base, rate and last step of their scale.
BANDS, BAND = 40, 4
REGISTERS = BANDS * BAND
BASE, RATE, LAST = 1.001, 20.0, (1 << 16) - 2
#: Standard errors by which a pair may miss LINK and still be verified; pairs whose registers are compared at once.
ERRORS, AT_ONCE = 6.0, 4096
#: Bits of a parity sketch for each shingle at least, and the least width; words of sketches that are compared at once.
PARITY, LEAST, WORDS = 8, 256, 1 << 20
#: Members that a member of a bucket names in the first round, and their growth by round; members that one task compares with
#: as many others; bytes of members that are compared in one group of a shuffle.
TOP, GROWTH, BLOCK, DEAL_BYTES = 8, 64, 4096, 24 << 20
_U = np.uint64


def shingle_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each document, as hashes, and where each document's begin (n + 1 offsets)."""
    starts, ends, cut = words(data, offsets)
    w, n = word_hashes(data, starts, ends), len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(cut))
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    single = cut[:-1][np.diff(cut) == 1]
    g = np.concatenate([mix(w[pair] * _U(0xC2B2AE3D27D4EB4F) + w[pair + 1]), mix(w[single] ^ _U(0x7FEB352D))])
    d = np.concatenate([doc[pair], doc[single]])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])][: len(g)]
    g, d = g[new], d[new]
    return g, np.searchsorted(d, np.arange(n + 1))


def set_ids(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; those of empty sets mean nothing."""
    sums = np.zeros(len(g) + 1, _U)
    np.cumsum(mix(g + _U(0x51ED270B)), out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(_U)).view(np.int64)


def registers(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The registers of each set, one row each; those of an empty set are 0."""
    n = len(at) - 1
    least, limit = np.full((n, REGISTERS), np.inf), np.full(n, np.inf)
    flat = least.reshape(-1)
    doc, seed, x = np.repeat(np.arange(n), np.diff(at)), g, np.zeros(len(g))
    while len(doc):
        seed = mix(seed + _U(0x9E3779B97F4A7C15))
        x = x - np.log(((seed >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52) / (RATE * REGISTERS)
        live = x < limit[doc]
        doc, seed, x = doc[live], seed[live], x[live]
        np.minimum.at(flat, doc * REGISTERS + (mix(seed ^ _U(0xA5A5A5A5)) % _U(REGISTERS)).astype(np.int64), x)
        active = np.flatnonzero(np.bincount(doc, minlength=n))
        limit[active] = least[active].max(1)
    step = np.zeros((n, REGISTERS))
    full = np.isfinite(least)
    step[full] = np.floor(1 - np.log(least[full]) / np.log(BASE))
    return np.clip(step, 0, LAST + 1).astype(np.uint16)


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The registers of the union of the sets."""
    return np.maximum.reduce(sketches)


def _log_likelihood(j: np.ndarray, u: np.ndarray, v: np.ndarray, counts: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of similarity j, where u and v are the sets' shares of the sum of sizes and counts says how often left, right and none is larger."""
    left, right = (-np.log1p(-np.clip(p, 0, 1) * (BASE - 1) / BASE) / np.log(BASE) for p in (u - v * j, v - u * j))
    chances = (left, right, 1 - left - right)
    return sum(np.where(c > 0, c * np.log(np.maximum(p, 1e-300)), 0.0) for c, p in zip(counts, chances, strict=True))


def joint(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of sets of n and m elements with registers x and y (rows), and by how many standard errors LINK lies above."""
    counts = tuple((c.sum(1)).astype(float) for c in (x > y, x < y, x == y))
    n, m = n.astype(float), m.astype(float)
    u, v = n / (n + m), m / (n + m)
    most = np.minimum(n, m) / np.maximum(n, m)
    low, high = np.zeros(len(n)), most.copy()
    for _ in range(60):  # the likelihood rises to one maximum and falls
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rises = _log_likelihood(a, u, v, counts) < _log_likelihood(b, u, v, counts)
        low, high = np.where(rises, a, low), np.where(rises, high, b)
    best = (low + high) / 2
    gap = _log_likelihood(best, u, v, counts) - _log_likelihood(np.minimum(LINK / 100, most), u, v, counts)
    return best, np.where(best < LINK / 100, np.sqrt(2 * np.maximum(gap, 0)), 0.0)


def parity_width(n: np.ndarray) -> np.ndarray:
    """Bits of the parity sketch of a set of n shingles: a power of two."""
    return np.maximum(LEAST, 1 << np.ceil(np.log2(np.maximum(PARITY * n, 1))).astype(np.int64))


def parity(g: np.ndarray) -> bytes:
    """Each shingle flips one bit, so sets that differ in d shingles differ in at most d bits."""
    width = int(parity_width(np.array(len(g))))
    at = (mix(g ^ _U(0x3C6EF372)) & _U(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8)).tobytes()


def _folded(sketches: pa.Array, own: np.ndarray, width: int, to: int) -> np.ndarray:
    """The sketches of these members, of one width, folded by exclusive or to a lesser one."""
    rows = np.frombuffer(b"".join(sketches.take(pa.array(own)).to_pylist()), _U)
    return np.bitwise_xor.reduce(rows.reshape(len(own), width // to, to // 64), axis=1)


def nearest(n: np.ndarray, root: np.ndarray, cid: np.ndarray, sketches: pa.Array, namers: np.ndarray, others: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs (namer, other) of different components that sizes and sketches allow, the top nearest of each namer; was any left out.

    Sets of n and m shingles link only if they differ in at most (n + m) (100 - LINK) / (100 + LINK) of them.
    """
    width, found = parity_width(n), [(np.zeros(0, np.int64),) * 3]
    for w in np.unique(width[namers]):
        own = namers[width[namers] == w]
        for v in (w // 2, w, w * 2):
            there = others[width[others] == v]
            if not len(there):
                continue
            to = int(min(v, w))
            x, y = _folded(sketches, own, int(w), to), _folded(sketches, there, int(v), to)
            step = max(1, WORDS // y.size)
            for k in range(0, len(own), step):
                i = own[k : k + step]
                total = n[i][:, None] + n[there]
                fits = (root[i][:, None] != root[there]) & ((100 + LINK) * np.abs(n[i][:, None] - n[there]) <= (100 - LINK) * total)
                a, b = np.nonzero(fits)
                if 4 * len(a) < fits.size:
                    differ = np.bitwise_count(x[k + a] ^ y[b]).sum(1, dtype=np.int64)
                else:
                    differ = np.bitwise_count(x[k : k + step, None] ^ y).sum(2, dtype=np.int64)[a, b]
                near = (100 + LINK) * differ <= (100 - LINK) * total[a, b]
                found.append((i[a[near]], there[b[near]], differ[near]))
    left, right, far = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((cid[right], far, left))
    left, right = left[order], right[order]
    head = np.flatnonzero(np.r_[True, left[1:] != left[:-1]][: len(left)])
    rank = np.arange(len(left)) - np.repeat(head, np.diff(np.r_[head, len(left)]))
    return left[rank < top], right[rank < top], bool((rank >= top).any())


def _name(top: int):
    """The pairs that are named between the blocks of buckets dealt to one group; more: some member had more than top."""

    def run(table: pa.Table) -> pa.Table:
        c = {k: table.column(k).to_numpy() for k in ("bucket", "block", "other", "mine", "cid", "root", "n", "names")}
        sketches = table.column("sketch").combine_chunks()
        order = np.lexsort((c["other"], c["block"], c["bucket"]))
        key = np.stack([c[k][order] for k in ("bucket", "block", "other")])
        pairs, more = [np.zeros((0, 2), np.int64)], False
        for own in np.split(order, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1):
            left, right = own[c["mine"][own] == c["block"][own]], own[c["mine"][own] == c["other"][own]]
            tries = [(left[c["names"][left]], right)]
            if c["block"][own[0]] != c["other"][own[0]]:
                tries.append((right[c["names"][right]], left[~c["names"][left]]))
            for namers, others in tries:
                x, y, rest = nearest(c["n"], c["root"], c["cid"], sketches, namers, others, top)
                pairs.append(np.sort(np.stack([c["cid"][x], c["cid"][y]], axis=1), axis=1))
                more |= rest
        once = np.unique(np.concatenate(pairs), axis=0)
        return pa.table([pa.array(once[:, 0]), pa.array(once[:, 1]), pa.array(np.full(len(once), more))], names=["a", "b", "more"])

    return run


def _rest(members: DataFrame, classes: DataFrame, roots: DataFrame, top: int) -> DataFrame:
    """Named pairs (a, b) of the buckets (bucket, cid, k) that hold several components; more: some member had more than top."""
    deals = max(1, (members.agg(F.sum(F.col("bytes") + 64)).first()[0] or 0) // DEAL_BYTES)
    rooted = members.join(roots, members["cid"] == roots["node"], "left").select("bucket", "cid", "k", F.coalesce("root", "cid").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.max_by("root", F.struct("size", "root")).alias("most")).where("r <> s").select("bucket", "most")
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    rows = rooted.join(mixed, "bucket").join(classes, "cid").withColumn("names", F.col("root") != F.col("most")).withColumn("mine", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("block", F.least("mine", "with")).withColumn("other", F.greatest("mine", "with"))
    rows = rows.select(F.pmod(F.xxhash64("bucket", "block", "other"), F.lit(deals)).alias("deal"), "bucket", "block", "other", "mine", "cid", "root", "n", "names", "sketch")
    found = rows.groupBy("deal").applyInArrow(_name(top), "a long, b long, more boolean")
    return staged(found.groupBy("a", "b").agg(F.max("more").alias("more")), "rest")


_SKETCHED = "doc_id long, n long, cid long, registers binary, parity binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document with the size and name of its set; the first of each set in a batch has its sketches."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        seen: set[int] = set()
        for i, j in doc_slices(offsets):
            g, at = shingle_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n, cid = np.diff(at), set_ids(g, at)
            fresh = np.zeros(len(n), bool)
            for k in np.flatnonzero(n):
                if int(cid[k]) not in seen:
                    seen.add(int(cid[k]))
                    fresh[k] = True
            new = np.flatnonzero(fresh)
            own = [g[at[k] : at[k + 1]] for k in new]
            rows = registers(np.concatenate(own), np.r_[0, np.cumsum([len(s) for s in own])]) if own else ()
            kept: list[list] = [[None] * len(n), [None] * len(n)]
            for k, s, row in zip(new, own, rows, strict=True):
                kept[0][k], kept[1][k] = row.tobytes(), parity(s)
            columns = [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(cid, mask=n == 0), *(pa.array(c, pa.binary()) for c in kept)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SKETCHED.split(", ")])


def _bands(wanted):
    """The bucket of each band of each class; with a filter, only those that it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, BANDS + 1, dtype=_U))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, BAND)
            h = np.zeros(x.shape[:2], _U) + salt
            for k in range(BAND):
                h = mix(h * _U(0x9FB21C651E98DF25) + x[:, :, k].astype(_U))
            bucket, cid = h.view(np.int64).ravel(), np.repeat(batch.column(0).to_numpy(), BANDS)
            if wanted is not None:
                filled, h = wanted.value, h.ravel()
                hit = filled[((h >> _U(6)) & _U(len(filled) - 1)).astype(np.int64)] >> (h & _U(63)) & _U(1) == 1
                bucket, cid = bucket[hit], cid[hit]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(cid)], names=["bucket", "cid"])

    return run


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose registers do not speak against a link."""
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(k, AT_ONCE)
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("x", "y"))
            _, errors = joint(x, y, part.column("n").to_numpy(), part.column("m").to_numpy())
            yield part.select(["a", "b"]).filter(pa.array(errors <= ERRORS))


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes that the likelihood of their registers lets through; sizes alone rule out some exactly."""
    left = classes.select(F.col("cid").alias("a"), F.col("n"), F.col("registers").alias("x"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("registers").alias("y"))
    both = pairs.join(left, "a").join(right, "b").where(100 * F.least("n", "m") >= LINK * F.greatest("n", "m"))
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(tidy(_plausible), "a long, b long")


def _sets_of(wanted):
    """The sets of documents whose class the filter lets through, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = wanted.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for i, j in doc_slices(offsets):
                g, at = shingle_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cid = set_ids(g, at)
                h = cid.view(_U)
                hit = filled[((h >> _U(6)) & _U(len(filled) - 1)).astype(np.int64)] >> (h & _U(63)) & _U(1) == 1
                own = np.flatnonzero(hit & (np.diff(at) > 0))
                own = own[np.unique(cid[own], return_index=True)[1]]
                if len(own):
                    cut = np.r_[0, np.cumsum(at[own + 1] - at[own])].astype(np.int32)
                    held = np.concatenate([g[at[k] : at[k + 1]] for k in own]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cid[own]), pa.ListArray.from_arrays(pa.array(cut), pa.array(held))], names=["cid", "tokens"])

    return run


def confirmed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose whole sets link."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    own = sets.join(needed, "cid", "left_semi")
    both = pairs.join(own.select(F.col("cid").alias("a"), F.col("tokens").alias("x")), "a").join(own.select(F.col("cid").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= LINK * (F.size("x") + F.size("y") - common)).select("a", "b")


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row per document (doc_id, n, cid), and the root of each class that links to others."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = staged(texts.mapInArrow(tidy(_sketch), _SKETCHED), "sketched")
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "registers", "parity")]
    classes = staged(sketched.where("registers is not null").groupBy("cid").agg(*first), "classes")
    banded = classes.select("cid", "registers")
    held = banded.mapInArrow(tidy(_bands(None)), "bucket long, cid long").groupBy("bucket")
    shared = held.agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("cid")).alias("kind")).where("k > 1")
    # buckets of the same members count once
    shared = staged(shared.groupBy("kind", "k").agg(F.min("bucket").alias("bucket"), F.min("hub").alias("hub")).drop("kind"), "buckets")
    entries = banded.mapInArrow(tidy(_bands(jaccard._filter(shared.select("bucket"), "bucket"))), "bucket long, cid long")
    entries = staged(entries.join(shared, "bucket"), "entries")
    stars = staged(entries.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct(), "stars")
    members = entries.where("k > 2").select("bucket", "cid", F.col("k").cast("long").alias("k"))
    members = staged(members.join(classes.select("cid", F.octet_length("parity").alias("bytes")), "cid"), "members")
    known = classes.select("cid", "n", F.col("parity").alias("sketch"))

    needed = staged(entries.select("cid").distinct(), "needed")
    sets = texts.select("text").mapInArrow(tidy(_sets_of(jaccard._filter(needed, "cid"))), "cid long, tokens array<long>")
    sets = staged(sets.join(needed, "cid", "left_semi").groupBy("cid").agg(F.first("tokens").alias("tokens")), "sets")
    links, tested, top = staged(confirmed(sets, plausible(stars, classes)), "linked"), stars, TOP
    roots = jaccard._rooted(links)
    while True:
        rest = _rest(members, known, roots, top)
        fresh = staged(rest.select("a", "b").join(tested, ["a", "b"], "left_anti"), "fresh")
        if fresh.limit(1).count():
            links = staged(links.unionAll(confirmed(sets, plausible(fresh, classes))), "linked")
            roots, tested = jaccard._rooted(links), tested.unionAll(fresh)
        if not rest.where("more").limit(1).count():
            return sketched.select("doc_id", "n", "cid"), roots
        top *= GROWTH


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id (null without shingles), kept."""
    rows, roots = _linked(docs)
    joined = rows.join(jaccard._least(rows, roots, F.col("doc_id"), "component_id"), "cid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("cid").alias("class_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).drop("class_id")
