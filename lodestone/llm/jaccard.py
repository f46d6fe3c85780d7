"""N-gram Jaccard join by universe partition and the pigeonhole principle, verified exactly.

A document is its set of distinct 5-word shingles, known by 64-bit hashes. Documents with equal sets form one
class. Two sets of sizes a and b link at 0.75 only if they differ in at most H = (a + b) // 7 shingles.

Bands and segments. Sizes fall into bands that grow by 4/3, so partners share a band or sit in neighbouring
ones; the pairs of band g and g + 1 form group g. Each group hashes the universe into m segments, more than H.
At most H segments of a pair differ, so at least m - H are equal; seen as sets of m segment signatures, the two
must share one among the first H + 1 in any common order. That order is the allocation by cost: segments whose
rarest shingle is rarest come first, by a sketch of shingle counts over the whole corpus; empty ones come last.
Where a band is large enough to pay for it, one wide segment is indexed with its one-deletion neighbourhood:
a pair that misses there differs in two places at least, which spares its two costliest segments.

From buckets to links. A bucket of equal signatures is joined as a star, not as all pairs; links of the stars
are verified on the whole sets and joined into components. Buckets that still hold several components are looked at
again, in rounds: each member outside the bucket's largest component names its TOP nearest members of other components
by parity sketch, which can never reject a pair that links; what is new is verified and the components are joined
anew. While some member had more candidates than it named, a round follows in which it may name GROWTH times as many,
so the work is in proportion to the members and to the candidates that must be verified, and no link between
components is lost. A sketch has two to
four bits for each shingle, so it stays selective whatever the length of a text. No bucket is capped and copies are
never expanded into pairs. pairs() and link_counts() compare all members of a bucket instead, in the same blocks, so
they hold every linked pair of classes and not only what components need.

Defined results: null or empty texts have no shingles, size 0, no links and their own doc_id as component;
fewer than five words are one shingle, the whole sequence; equal rows share a component; a null doc_id takes part
but is never a component's name unless all of its doc_ids are null; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import doc_slices, documents, free_names, merge_tree, mix, partitions, row_key, staged, text_buffer, tidy, word_hashes, words
from lodestone.operators.components import components

WORDS = 5
#: Shingles that the wide segment holds on average in the smallest sets of a group, and the least such size.
WIDE, WIDE_FROM = 16, 128
SPARE = 0.6
COUNTERS = 1 << 20
#: Least bits of a sketch; candidates that a member of a bucket names in the first round, and their growth by round.
SKETCH_BITS, TOP, GROWTH = 256, 8, 64
BLOCK_BYTES = 1 << 20
#: Signatures that one part of the index holds, and members that one task compares with as many others.
PART_ENTRIES, PAIR_BLOCK = 750_000, 4096
#: Bytes of bucket members that are compared in one group of a shuffle (a group names a pair once, whatever buckets it shares),
#: and words of sketches that are compared at once.
DEAL_BYTES, AT_ONCE = 24 << 20, 1 << 20
#: Words of a filter: 16 bits for each key it holds, within these bounds (16 MB at most are broadcast).
BLOOM_LEAST, BLOOM_MOST = 1 << 12, 1 << 21
_U = np.uint64


def band_bounds(limit: int) -> np.ndarray:
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, -(-out[-1] * 4 // 3)))
    out.append(-(-out[-1] * 4 // 3))
    out.append(-(-out[-1] * 4 // 3))
    return np.array(out, np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    starts, ends, cut = words(data, offsets)
    w = word_hashes(data, starts, ends)
    n = len(w)
    full = np.zeros(n, _U)
    for k in range(WORDS):
        full[: max(0, n - WORDS + 1)] = full[: max(0, n - WORDS + 1)] * _U(0xC2B2AE3D27D4EB4F) + w[k : k + max(0, n - WORDS + 1)]
    full = mix(full)
    out = []
    for a, b in zip(cut, cut[1:], strict=False):
        if b - a >= WORDS:
            out.append(np.unique(full[a : b - WORDS + 1]))
        elif b > a:
            h = _U(b - a)
            h = np.array([h])
            for k in range(a, b):
                h = mix(h * _U(0x9FB21C651E98DF25) + w[k])
            out.append(h)
        else:
            out.append(np.zeros(0, _U))
    return out


def set_id(tokens: np.ndarray) -> np.int64:
    with np.errstate(over="ignore"):
        return mix(np.array([mix(tokens + _U(0x51ED270B)).sum(dtype=_U) + _U(len(tokens))])).view(np.int64)[0]


def sketch_bits(n: int) -> int:
    """Bits of the sketch of a set of n shingles: a power of two, from 2n up."""
    return max(SKETCH_BITS, 1 << (2 * n - 1).bit_length())


def parity(tokens: np.ndarray) -> bytes:
    """Parity sketch: each shingle flips one bit, so sets that differ in d shingles differ in at most d bits."""
    width = sketch_bits(len(tokens))
    bit = (mix(tokens ^ _U(0xA5A5A5A5)) & _U(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=width) & 1).astype(np.uint8)).tobytes()


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(17)).astype(np.int64) & (COUNTERS - 1)


_SETS = "doc_id long, k1 long, k2 int, n long, cid long, sketch binary, slice int, at binary, hits binary"
_SETS_NAMES = [x.split()[0] for x in _SETS.split(", ")]
_SETS_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
_SLICES = 16


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document with its set's size, id and sketch; then this task's counts of repeated shingles."""
    total, seen = np.zeros(COUNTERS, np.uint32), set()
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        n, cid, sketch = [], [], []
        for i, j in doc_slices(offsets):
            for tokens in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                n.append(len(tokens))
                cid.append(set_id(tokens) if len(tokens) else None)
                fresh = len(tokens) and cid[-1] not in seen
                sketch.append(parity(tokens) if fresh else None)
                if fresh:
                    seen.add(cid[-1])
                    np.add.at(total, _counter(tokens), 1)
        none = [None] * len(n)
        columns = [batch.column(0), batch.column(2), batch.column(3), n, cid, sketch, none, none, none]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _SETS_TYPES, strict=True)], names=_SETS_NAMES)
    width = COUNTERS // _SLICES
    for k in range(_SLICES):
        own = total[k * width : (k + 1) * width]
        at = np.flatnonzero(own > 1)  # a shingle met once in a task is rare enough to be taken for new
        if len(at):
            row = [None, None, None, None, None, None, k, at.astype(np.uint32).tobytes(), own[at].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _SETS_TYPES, strict=True)], names=_SETS_NAMES)


def _add_up(table: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // _SLICES, np.int64)
    for at, hits in zip(table.column("at"), table.column("hits"), strict=True):
        total[np.frombuffer(at.as_buffer(), np.uint32)] += np.frombuffer(hits.as_buffer(), np.uint32)
    at = np.flatnonzero(total)
    low = np.minimum(total[at], 2**32 - 1).astype(np.uint32)
    return pa.table([pa.array([table.column("slice")[0].as_py()], pa.int32()), pa.array([at.astype(np.uint32).tobytes()]), pa.array([low.tobytes()])], names=["slice", "at", "hits"])


def shingle_counts(described: DataFrame, tasks: int) -> np.ndarray:
    """Estimated document counts by hashed shingle, COUNTERS numbers whatever the corpus."""
    rows = described.where("slice is not null").select("slice", "at", "hits")
    total = np.zeros(COUNTERS, np.uint32)
    width = COUNTERS // _SLICES
    for r in merge_tree(rows, ["slice"], _add_up, "slice int, at binary, hits binary", tasks).collect():
        total[r["slice"] * width + np.frombuffer(r["at"], np.uint32)] = np.frombuffer(r["hits"], np.uint32)
    return total


def _plan(bounds: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments and wide segments of each group."""
    low = bounds[group]
    most = (bounds[group + 2] - 1 + bounds[group + 1] - 1) // 7
    wide = (low >= WIDE_FROM).astype(np.int64)
    return np.maximum(np.ceil(SPARE * (low - WIDE * wide)).astype(np.int64), most - 2 * wide + 1), wide


def signatures(sets: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets and, for each, the number of its set."""
    size = np.array([len(s) for s in sets], np.int64)
    if size.sum() == 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    bounds = band_bounds(int(size.max()))
    band = np.searchsorted(bounds, size, side="right") - 1
    tokens = np.concatenate(sets)
    rarity = counts[_counter(tokens)]
    sigs, owners = [], []
    upper_least = bounds[np.maximum(band, 0)] - 1  # largest set of the band below
    for shift in (0, 1):
        group = band - shift
        if shift:
            use = (group >= 0) & (3 * size <= 4 * upper_least)
            differ = (size + upper_least) // 7
        else:
            use = group >= 0
            differ = (size + np.minimum(size * 4 // 3, bounds[np.maximum(band, 0) + 2] - 1)) // 7
        who = np.flatnonzero(use)
        if not len(who):
            continue
        m, wide = _plan(bounds, group[who])
        prefix = np.minimum(np.maximum(differ[who] - 2 * wide + 1, 1), m)
        pick = np.repeat(use, size)
        tok, rare = tokens[pick], rarity[pick]
        own = np.repeat(np.arange(len(who)), size[who])
        g = group[who].astype(_U)
        salted = mix(tok + (g[own] << _U(32)) + _U(77))
        is_wide = (wide[own] == 1) & ((salted >> _U(40)).astype(np.int64) * bounds[group[who]][own] < WIDE << 24)
        base = np.r_[0, np.cumsum(m)]

        w = np.flatnonzero(is_wide)
        value = mix(tok ^ _U(0x7F4A7C15))
        if wide.any():
            total = np.zeros(len(who), _U)
            np.add.at(total, own[w], value[w])
            tag = g * _U(0x1000193) + _U(1)
            sigs += [mix(total[wide == 1] ^ mix(tag[wide == 1])), mix((total[own[w]] - value[w]) ^ mix(tag[own[w]]))]
            owners += [who[wide == 1], who[own[w]]]

        narrow = np.flatnonzero(~is_wide)
        segment = base[own[narrow]] + ((salted[narrow] & _U(0xFFFFFFFF)) % m[own[narrow]].astype(_U)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        segment, at = segment[order], narrow[order]
        head = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(segment) else np.zeros(0, np.int64)
        held = segment[head]
        content = np.add.reduceat(value[at], head) if len(head) else np.zeros(0, _U)
        cost = np.minimum.reduceat(rare[at], head) if len(head) else np.zeros(0, np.uint32)
        holder = own[at[head]]
        sig = mix(content ^ mix(g[holder] * _U(0x1000193) + ((held - base[holder]).astype(_U) << _U(20)) + _U(2)))
        order = np.lexsort((sig, cost, holder))
        holder, sig = holder[order], sig[order]
        first = np.searchsorted(holder, np.arange(len(who) + 1))
        rank = np.arange(len(holder)) - first[holder]
        keep = rank < prefix[holder]
        sigs.append(sig[keep])
        owners.append(who[holder[keep]])
        for k in np.flatnonzero(np.diff(first) < prefix):  # too few segments hold shingles: empty ones, in order
            empty = np.setdiff1d(np.arange(m[k]), held[np.searchsorted(held, base[k]) : np.searchsorted(held, base[k + 1])] - base[k])
            empty = empty[: prefix[k] - (first[k + 1] - first[k])].astype(_U)
            sigs.append(mix(mix(g[k] * _U(0x1000193) + (empty << _U(20)) + _U(2))))
            owners.append(np.full(len(empty), who[k]))
    return np.concatenate(sigs), np.concatenate(owners)


def _index(parts: int, counts):
    """Signatures of each task's distinct sets, packed by part: 48 bits and the set's place in the row's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for i, j in doc_slices(offsets, BLOCK_BYTES):
                for a in range(i, j, 60_000):
                    b = min(j, a + 60_000)
                    sets, ids = [], []
                    for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                        c = set_id(s) if len(s) else None
                        if c is not None and c not in seen:
                            seen.add(c)
                            sets.append(s)
                            ids.append(c)
                    if not sets:
                        continue
                    sig, owner = signatures(sets, counts.value)
                    part = (sig % _U(parts)).astype(np.int64)
                    sig = sig // _U(parts)
                    order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")
                    part, sig, owner = part[order], sig[order], owner[order].astype(np.uint16)
                    cut = np.searchsorted(part, np.arange(parts + 1))
                    listed = np.array(ids, np.int64)
                    low, high = sig.astype(np.uint32), (sig >> _U(32)).astype(np.uint16)
                    rows = []
                    for p, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
                        if y > x:
                            used, place = np.unique(owner[x:y], return_inverse=True)
                            rows.append((p, listed[used].tobytes(), place.astype(np.uint16).tobytes(), low[x:y].tobytes(), high[x:y].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["part", "ids", "place", "low", "high"])

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Stars of the buckets of one part (bucket null), and the buckets of three and more sets."""
    sig, cid = [], []
    for ids, place, low, high in zip(*(table.column(c) for c in ("ids", "place", "low", "high")), strict=True):
        cid.append(np.frombuffer(ids.as_buffer(), np.int64)[np.frombuffer(place.as_buffer(), np.uint16)])
        sig.append(np.frombuffer(high.as_buffer(), np.uint16).astype(_U) << _U(32) | np.frombuffer(low.as_buffer(), np.uint32))
    sig, cid = np.concatenate(sig), np.concatenate(cid)
    order = np.argsort(sig)
    sig, cid = sig[order], cid[order]
    same = sig[1:] == sig[:-1]
    shared = np.r_[False, same] | np.r_[same, False]
    sig, cid = sig[shared], cid[shared]
    order = np.lexsort((cid, sig))
    sig, cid = sig[order], cid[order]
    new = np.r_[True, (sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1])][: len(sig)]
    sig, cid = sig[new], cid[new]
    head = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
    size = np.diff(np.r_[head, len(sig)])
    hub = np.repeat(cid[head], size)
    edges = np.unique(np.stack([hub, cid])[:, hub != cid], axis=1)
    members = mix(cid.view(_U))
    kind = np.add.reduceat(members, head) if len(head) else np.zeros(0, _U)
    _, first = np.unique(np.stack([kind, size.astype(_U)]), axis=1, return_index=True)
    large = [k for k in first if size[k] > 2]
    a, b, bucket = [edges[0]], [edges[1]], [np.zeros(edges.shape[1], np.int64)]
    for k in large:
        a.append(np.full(size[k], size[k]))
        b.append(cid[head[k] : head[k] + size[k]])
        bucket.append(np.full(size[k], kind[k].view(np.int64) | 1))
    bucket = np.concatenate(bucket)
    return pa.table([pa.array(np.concatenate(a).astype(np.int64)), pa.array(np.concatenate(b).astype(np.int64)), pa.array(bucket, mask=bucket == 0)], names=["a", "b", "bucket"])


def _sets_of(bloom):
    """The sets of documents whose class the filter lets through, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = bloom.value, set()
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for i, j in doc_slices(offsets):
                ids, sets = [], []
                for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    c = int(set_id(s)) if len(s) else None
                    if c is not None and c not in seen and wanted[(c >> 6) & (len(wanted) - 1)] >> _U(c & 63) & _U(1):
                        seen.add(c)
                        ids.append(c)
                        sets.append(s.view(np.int64))
                if ids:
                    cut = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(sets)))], names=["cid", "tokens"])

    return run


def _filter(keys: DataFrame, name: str):
    """A broadcast filter over the long column name of keys (distinct, materialised), sized by their number."""
    size, n = BLOOM_LEAST, keys.count()
    while size < BLOOM_MOST and 64 * size < 16 * n:
        size *= 4
    place = F.shiftright(name, 6).bitwiseAND(F.lit(size - 1)).alias("w")
    filled = keys.groupBy(place).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 as int))")).alias("bits")).toPandas()  # at most BLOOM_MOST rows
    words_ = np.zeros(size, np.int64)
    words_[filled["w"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64)
    return keys.sparkSession.sparkContext.broadcast(words_.view(_U))


def _sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The whole sets (cid, tokens) of all classes in pairs; every member of a bucket is in a star, so one pass serves all rounds."""
    needed = staged(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "needed")
    sets = docs.select("text").mapInArrow(tidy(_sets_of(_filter(needed, "cid"))), "cid long, tokens array<long>")
    return staged(sets.join(needed, "cid", "left_semi").dropDuplicates(["cid"]), "sets")


def verify(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of class ids whose whole sets link."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    own = sets.join(needed, "cid", "left_semi")
    left = pairs.join(own.select(F.col("cid").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(own.select(F.col("cid").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= 75 * (F.size("x") + F.size("y") - common)).select("a", "b")


def _rooted(links: DataFrame) -> DataFrame:
    """The root of each class that links to others, and the classes of its component: node, root, size."""
    roots = staged(components(links, "a", "b").withColumnRenamed("component", "root"), "roots")
    return staged(roots.join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root"), "roots")


def _sketches(column, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: the place of each member that has or folds to it, and the sketches; equal bits fold by exclusive or."""
    width = np.array([sketch_bits(int(x)) for x in n])
    rows: dict = {}
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        bits = np.frombuffer(b"".join(column[int(i)].as_py() for i in own), np.uint8).reshape(len(own), w // 8)
        rows.setdefault(w, []).append((own, bits))
        if w > SKETCH_BITS:
            rows.setdefault(w // 2, []).append((own, bits[:, : w // 16] ^ bits[:, w // 16 :]))
    out = {}
    for w, parts in rows.items():
        own, bits = np.concatenate([o for o, _ in parts]), np.concatenate([b for _, b in parts])
        where = np.full(len(n), -1)
        where[own] = np.arange(len(own))
        out[int(w)] = where, np.ascontiguousarray(bits).view(_U)
    return out


def _near(cols: dict, bits: dict, width: np.ndarray, namers: np.ndarray, others: np.ndarray, top: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs (namer, other) of different components that sizes and sketches allow, the top nearest of each namer; was any left out."""
    n, cid, root = cols["n"], cols["cid"], cols["root"]
    left, right, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w in np.unique(width[namers]):
        own = namers[width[namers] == w]
        for v in (w // 2, w, w * 2):
            there = others[width[others] == v]
            if not len(there):
                continue
            place, rows = bits[int(min(v, w))]
            step = max(1, AT_ONCE // (len(there) * rows.shape[1]))
            for k in range(0, len(own), step):
                i = own[k : k + step]
                differ = np.bitwise_count(rows[place[i]][:, None] ^ rows[place[there]][None]).sum(2, dtype=np.int64)
                total = n[i][:, None] + n[there][None]
                fits = (7 * differ <= total) & (7 * np.abs(n[i][:, None] - n[there][None]) <= total) & (root[i][:, None] != root[there][None])
                x, y = np.nonzero(fits)
                left.append(i[x])
                right.append(there[y])
                far.append(differ[x, y])
    left, right, far = np.concatenate(left), np.concatenate(right), np.concatenate(far)
    if top is None or not len(left):
        return left, right, False
    order = np.lexsort((cid[right], far, left))
    left, right = left[order], right[order]
    head = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
    rank = np.arange(len(left)) - np.repeat(head, np.diff(np.r_[head, len(left)]))
    return left[rank < top], right[rank < top], bool((rank >= top).any())


def _across(top: int | None):
    """Candidates of the buckets' blocks that are dealt to one group; more: some member had more than top."""

    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_numpy() for c in ("bucket", "block", "other", "mine", "cid", "root", "n", "names")}
        order = np.lexsort((cols["other"], cols["block"], cols["bucket"]))
        cols = {c: v[order] for c, v in cols.items()}
        sketch = table.column("sketch").take(pa.array(order)).combine_chunks()
        new = np.r_[True, np.any([cols[c][1:] != cols[c][:-1] for c in ("bucket", "block", "other")], axis=0)]
        cut, a, b, more = [*np.flatnonzero(new), len(order)], [], [], False
        for p, q in zip(cut, cut[1:], strict=False):
            own = {c: v[p:q] for c, v in cols.items()}
            bits = _sketches(sketch.slice(p, q - p), own["n"])
            width = np.array([sketch_bits(int(x)) for x in own["n"]])
            left, right, names = own["mine"] == own["block"], own["mine"] == own["other"], own["names"]
            tries = [(left & names, right)] + ([(right & names, left & ~names)] if own["block"][0] != own["other"][0] else [])
            for namers, others in tries:
                if namers.any() and others.any():
                    x, y, rest = _near(own, bits, width, np.flatnonzero(namers), np.flatnonzero(others), top)
                    a.append(np.minimum(own["cid"][x], own["cid"][y]))
                    b.append(np.maximum(own["cid"][x], own["cid"][y]))
                    more |= rest
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.zeros((2, 0), np.int64)
        found = [pa.array(pairs[0].astype(np.int64)), pa.array(pairs[1].astype(np.int64)), pa.array(np.full(pairs.shape[1], more))]
        return pa.table(found, names=["a", "b", "more"])

    return run


def _rest(members: DataFrame, classes: DataFrame, roots: DataFrame, top: int | None) -> DataFrame:
    """Candidate pairs (a, b) of the buckets (bucket, cid, k) in different components; more: some member had more than top."""
    deals = max(1, (members.agg(F.sum(F.col("bytes") + 64)).first()[0] or 0) // DEAL_BYTES)
    rooted = members.join(roots, members["cid"] == roots["node"], "left").select("bucket", "cid", "k", F.coalesce("root", "cid").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.max_by("root", F.struct("size", "root")).alias("most")).where("r <> s").select("bucket", "most")
    rows = rooted.join(mixed, "bucket").join(classes, "cid").withColumn("names", F.lit(True) if top is None else F.col("root") != F.col("most"))
    blocks = F.ceil(F.col("k") / PAIR_BLOCK).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("block", F.least("mine", "with")).withColumn("other", F.greatest("mine", "with"))
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("bucket", "block", "other"), F.lit(deals)))
    rows = rows.select("deal", "bucket", "block", "other", "mine", "cid", "root", "n", "names", "sketch")
    found = rows.groupBy("deal").applyInArrow(_across(top), "a long, b long, more boolean")
    return staged(found.groupBy("a", "b").agg(F.max("more").alias("more")), "rest")


def _buckets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A row per document (doc_id, its row's key k1 and k2, n, cid, sketch); stars, members and classes of the buckets."""
    spark = docs.sparkSession
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    texts = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    described = staged(texts.mapInArrow(tidy(_describe), _SETS), "shingles")
    rows = described.where("slice is null").select("doc_id", "k1", "k2", "n", "cid", "sketch")
    entries = 0.7 * (rows.agg(F.sum("n")).first()[0] or 0)
    parts = int(min(1 << 20, max(partitions(spark), entries // PART_ENTRIES)))
    counts = spark.sparkContext.broadcast(shingle_counts(described, int(entries) // 2_000_000))
    packed = texts.select("text").mapInArrow(tidy(_index(parts, counts)), "part int, ids binary, place binary, low binary, high binary")
    met = staged(packed.groupBy("part").applyInArrow(_meet, "a long, b long, bucket long"), "met")
    stars = met.where("bucket is null").select("a", "b").distinct()
    classes = rows.where("sketch is not null").groupBy("cid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    members = met.where("bucket is not null").select("bucket", F.col("b").alias("cid"), F.col("a").alias("k")).distinct()
    members = staged(members.join(classes.select("cid", F.octet_length("sketch").alias("bytes")), "cid"), "members")
    return rows, stars, members, classes


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of _buckets, and the root of each class that links to others."""
    rows, stars, members, classes = _buckets(docs)
    stars = staged(stars, "stars")
    sets = _sets(docs, stars)
    links, tested, top = staged(verify(sets, stars), "linked"), stars, TOP
    roots = _rooted(links)
    while True:
        rest = _rest(members, classes, roots, top)
        fresh = staged(rest.select("a", "b").join(tested, ["a", "b"], "left_anti"), "fresh")
        if fresh.limit(1).count():
            links = staged(links.unionAll(verify(sets, fresh)), "linked")
            roots, tested = _rooted(links), tested.unionAll(fresh)
        if not rest.where("more").limit(1).count():
            return rows, roots
        top *= GROWTH


def _pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of _buckets, and every pair a < b of classes whose sets link, verified exactly."""
    rows, stars, members, classes = _buckets(docs)
    alone = classes.select(F.col("cid").alias("node"), F.col("cid").alias("root"), F.lit(1).alias("size"))
    within = _rest(members, classes, alone, None).select("a", "b")
    candidates = staged(stars.unionAll(within).distinct(), "candidates")
    return rows, staged(verify(_sets(docs, candidates), candidates), "pairs")


def pairs(docs: DataFrame) -> DataFrame:
    """Every linked pair of classes: class_a, class_b and the least doc_id of each; equal sets are one class."""
    rows, found = _pairs(docs)
    named = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc"))
    left = named.select(F.col("cid").alias("a"), F.col("doc").alias("doc_a"))
    right = named.select(F.col("cid").alias("b"), F.col("doc").alias("doc_b"))
    return found.join(left, "a").join(right, "b").select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "doc_a", "doc_b")


def link_counts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, the other documents that link to it; copies are counted, not expanded."""
    rows, found = _pairs(docs)
    sizes = rows.where("n > 0").groupBy("cid").agg(F.count(F.lit(1)).alias("copies"))
    both = found.unionAll(found.select("b", "a"))
    others = both.join(sizes, both["b"] == sizes["cid"]).groupBy("a").agg(F.sum("copies").alias("others"))
    total = sizes.join(others, sizes["cid"] == others["a"], "left").select("cid", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows.join(total, "cid", "left").select("doc_id", F.col("cid").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _least(rows: DataFrame, roots: DataFrame, value, name: str) -> DataFrame:
    """Per class (cid) the least value of its whole component."""
    named = rows.where("n > 0").groupBy("cid").agg(F.min(value).alias("own_"))
    rooted = named.join(roots, named["cid"] == roots["node"], "left").select("cid", "own_", F.coalesce("root", "cid").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("own_").alias(name)), "root").select("cid", name)


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id (null without shingles)."""
    rows, roots = _linked(docs)
    joined = rows.join(_least(rows, roots, F.col("doc_id"), "component_id"), "cid", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("cid").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the least doc_id; documents without shingles all stay.

    A row is known by the hash of its doc_id and text, so rows that share a doc_id are judged each in its own
    component. Null doc_ids come last; equal doc_ids in a component are told apart by that hash. Only rows that a
    fixed-size filter suspects of being dropped or repeated are shuffled; the others pass through.
    """
    spark = docs.sparkSession
    rows, roots = _linked(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    named = rows.where("n > 0").join(_least(rows, roots, order, "best"), "cid")
    of_row = named.groupBy("k1", "k2").agg(F.max(F.expr("k1 <> best.k1 or k2 <> best.k2")).alias("drop"), F.count(F.lit(1)).alias("n"))
    special = staged(of_row.where("drop or n > 1").select("k1", "k2", "drop"), "dropped")
    shared = _filter(special, "k1")
    place, suspect, h1, h2, drop = free_names(docs, "place", "suspect", "h1", "h2", "drop")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, filled = batch.column(batch.num_columns - 1).to_numpy().view(_U), shared.value
            hit = filled[((h >> _U(6)) & _U(len(filled) - 1)).astype(np.int64)] >> (h & _U(63)) & _U(1)
            marked_ = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hit.astype(bool))], names=[*batch.schema.names[:-1], suspect])
            for i in range(0, len(hit), 256):
                yield marked_.slice(i, 256)

    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{suspect}` boolean"
    marked = docs.withColumn(place, k1).mapInArrow(tidy(marks), schema)
    clear = marked.where(~F.col(suspect)).drop(suspect)
    doubtful = marked.where(F.col(suspect)).drop(suspect).withColumns({h1: k1, h2: k2})
    of = special.select(F.col("k1").alias(h1), F.col("k2").alias(h2), F.col("drop").alias(drop))
    kept = doubtful.join(of, [h1, h2], "left").where(F.col(drop).isNull() | ~F.col(drop)).select(*[F.col(f"`{c}`") for c in docs.columns], h1, h2, drop)
    alone = kept.where(F.col(drop).isNull())
    once = kept.where(F.col(drop).isNotNull()).dropDuplicates([h1, h2])
    return clear.unionAll(alone.drop(h1, h2, drop)).unionAll(once.drop(h1, h2, drop))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).drop("class_id")


def pair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(documents(spark, sf_dir))


def count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(documents(spark, sf_dir))
