"""Suffix-array dedup: a logarithmic family of sparse suffix arrays, sorted by bytes and merge-scanned.

Every byte is removed that a LENGTH-byte string (a window) covers which also starts elsewhere in the corpus. A suffix
array of all bytes would be several times the corpus, so the arrays are sparse: each window picks the suffix at
its least hashed SEED-byte string (its anchor). The choice depends on the window's bytes alone, so equal windows
pick the same place, and one suffix in about seventy is enough to find every repeat. An anchor stands for a stretch:
all windows that picked it. Its entry holds the stretch's bytes, the suffix from the anchor on first, then what
precedes the anchor.

Texts come in batches. The entries of a batch are sorted by their bytes: that is its suffix array. It is scanned
against itself and against every level of the index in order of the suffixes: equal entries are repeats as a whole;
entries with SEED common bytes at the anchor and unequal stretches are compared window by window, where candidates
come from prefix sums along the aligned bytes and count only if all LENGTH bytes agree. The batch then enters level 0,
and levels of equal rank merge as in a binary counter. Entries are dealt to parts by a hash of the seed, and each
part holds a family of its own. The query deals the corpus to BATCHES batches; extend() adds a batch to an index that
lives on as a table.

With a whole corpus at hand a first pass counts seeds, and a filter of those that are there twice keeps suffixes
that cannot repeat from being shuffled; it has 16 bits a seed, FILTER_MOST words at most, and what it lets through
in vain only costs time. Equal stretches collapse within a task before they are shuffled, and within a level.

Rows are known by 64 bits of doc_id and text. Defined results: null texts are empty; texts shorter than LENGTH lose
nothing; overlapping and adjacent repeats are judged on the input; equal rows count as each other's repeat; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import doc_slices, documents, mix, partitions, powers, prefix_sums, span_hash, staged, text_buffer, tidy

LENGTH, SEED = 200, 40
BACK = LENGTH - SEED  # most bytes of a stretch before its anchor
#: Bytes of an entry: the suffix from the anchor, the number of windows, the bytes before the anchor, and these bytes.
WIDTH = LENGTH + 2 + BACK
#: Batches that the corpus is dealt to.
BATCHES = 8
#: Anchors to a part of the index and to a part of the seed counts, entries that a task collapses at once, windows compared at once.
PART_ANCHORS, COUNT_ANCHORS, HELD, WINDOWS = 64_000, 4_000_000, 50_000, 1 << 20
FILTER_LEAST, FILTER_MOST = 1 << 12, 1 << 21
_PLACE = 28  # bits of a place within a block
_U = np.uint64
_KEY = f"S{WIDTH}"
_FIELDS = (("key", _KEY), ("row", np.int64), ("at", np.uint32), ("wins", np.uint8), ("full", np.uint8))
_RUN = "part long, level int, " + ", ".join(f"{f} binary" for f, _ in _FIELDS)
_RUN_NAMES = [x.split()[0] for x in _RUN.split(", ")]
#: Levels of rows that are not part of the index: found repeats, and fresh entries of batch b as FRESH - b.
REPEATS, FRESH = -1, -2


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor: its document, first window, number of windows, bytes before it, and fingerprints of seed and stretch."""
    n = len(data)
    none = np.zeros(0, np.int64)
    empty = (none, none, none, none, none.astype(_U), none.astype(_U))
    if n < LENGTH:
        return empty
    sums, (_, down) = prefix_sums(data), powers(n + 1)
    seed = mix((sums[SEED:] - sums[:-SEED]) * down[: n + 1 - SEED])
    least = seed >> _U(_PLACE) << _U(_PLACE) | np.arange(len(seed), dtype=_U)
    span, reach = BACK + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    place = (least & _U((1 << _PLACE) - 1)).astype(np.int64)
    start = np.arange(len(place))
    doc = np.searchsorted(offsets, start, side="right") - 1
    inside = start + LENGTH <= offsets[doc + 1]
    start, doc, place = start[inside], doc[inside], place[inside]
    if not len(start):
        return empty
    head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    wins = np.diff(np.r_[head, len(start)])
    first, at = start[head], place[head]
    ctx = mix(span_hash(sums, first, first + wins - 1 + LENGTH) + (at - first).astype(_U) * _U(0xC2B2AE3D27D4EB4F) + wins.astype(_U))
    return doc[head], first, wins, at - first, seed[at], ctx


def entry_bytes(data: np.ndarray, first: np.ndarray, wins: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The entries of anchors, WIDTH bytes each; in byte order they are in order of their suffixes."""
    out = np.zeros((len(first), WIDTH), np.uint8)
    anchor, last = (first + back)[:, None], len(data) - 1
    ahead = anchor + np.arange(LENGTH)
    out[:, :LENGTH] = np.where(ahead < (first + wins - 1 + LENGTH)[:, None], data[np.minimum(ahead, last)], 0)
    out[:, LENGTH], out[:, LENGTH + 1] = wins, back
    behind = anchor + np.arange(-BACK, 0)
    out[:, LENGTH + 2 :] = np.where(behind >= first[:, None], data[np.maximum(behind, 0)], 0)
    return out


def _row(part: int, level: int, arrays: dict) -> tuple:
    return (part, level, *(np.ascontiguousarray(arrays[f]).astype(t, copy=False).tobytes() if f in arrays else None for f, t in _FIELDS))


def _batch_of(rows: list[tuple], kind):
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_RUN_NAMES)
    return kind.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.binary()] * len(_FIELDS)), strict=True)], names=_RUN_NAMES)


def _parted(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, and the places that have it."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    head = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
    for a, b in zip(head, [*head[1:], len(part)], strict=True):
        yield int(part[order[a]]), order[a:b]


def _seeds(parts: int):
    """Distinct seeds of each block of texts by part; one that is there twice is sent twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for i, j in doc_slices(offsets, 4 << 20):
                seeds = [anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[4] for a, b in ((i + x, i + y) for x, y in doc_slices(offsets[i : j + 1] - offsets[i]))]
                unique, n = np.unique(np.concatenate(seeds), return_counts=True)
                seeds = np.concatenate([unique, unique[n > 1]])
                rows = [(p, seeds[own].tobytes()) for p, own in _parted((seeds % _U(parts)).astype(np.int64))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["part", "seeds"])

    return run


def _twice(table: pa.Table) -> pa.Table:
    unique, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), _U) for x in table.column("seeds")]), return_counts=True)
    found = unique[n > 1]
    return pa.table([pa.array([found.tobytes()]), pa.array([len(found)], pa.int64())], names=["seeds", "n"])


def _filter(found: DataFrame):
    """A broadcast filter of the packed seeds (seeds, n) of found."""
    n, size = found.agg(F.sum("n")).first()[0] or 0, FILTER_LEAST
    while size < FILTER_MOST and 64 * size < 16 * n:
        size *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_ = np.zeros(size, _U)
        for batch in batches:
            for seeds in batch.column(0):
                _mark(words_, np.frombuffer(seeds.as_buffer(), _U))
        at = np.flatnonzero(words_)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words_[at].view(np.int64))], names=["w", "bits"])

    bits = found.select("seeds").mapInArrow(tidy(fill), "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most FILTER_MOST rows
    words_ = np.zeros(size, np.int64)
    words_[bits["w"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    return found.sparkSession.sparkContext.broadcast(words_.view(_U))


def _bits(seeds: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for shift in (0, 32):
        h = (seeds >> _U(shift)) & _U(64 * size - 1)
        yield (h >> _U(6)).astype(np.int64), h & _U(63)


def _mark(words_: np.ndarray, seeds: np.ndarray) -> None:
    for at, bit in _bits(seeds, len(words_)):
        np.bitwise_or.at(words_, at, _U(1) << bit)


def _entries(parts: int, batches: int, wanted):
    """Fresh entries of texts (row, text) by part and batch; of stretches that a task meets twice, one stays and all are repeats."""

    def collapsed(held: list[tuple]) -> pa.RecordBatch:
        key, seed, ctx, row, at, wins = (np.concatenate(c) for c in zip(*held, strict=True))
        _, kept, inverse, n = np.unique(ctx, return_index=True, return_inverse=True, return_counts=True)
        again = (n[inverse] > 1) & (key == key[kept[inverse]]).all(1)
        once = ~again
        once[kept] = True
        rows = [_row(int(seed[again][0] % _U(parts)), REPEATS, {"row": row[again], "at": at[again], "wins": wins[again]})] if again.any() else []
        part, batch = (seed % _U(parts)).astype(np.int64), row % batches
        for p, own in _parted(np.where(once, part * batches + batch, -1)):
            if p >= 0:
                fresh = {"key": key[own].view(_KEY).ravel(), "row": row[own], "at": at[own], "wins": wins[own], "full": again[own]}
                rows.append(_row(p // batches, FRESH - p % batches, fresh))
        return _batch_of(rows, pa.RecordBatch)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            ids = batch.column(0).to_numpy()
            data, offsets = text_buffer(batch.column(1))
            held: list[tuple] = []
            for i, j in doc_slices(offsets):
                own, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                doc, first, wins, back, seed, ctx = anchors(own, bounds)
                if wanted is not None:
                    hit = np.ones(len(seed), bool)
                    for at, bit in _bits(seed, len(wanted.value)):
                        hit &= (wanted.value[at] >> bit & _U(1)).astype(bool)
                    doc, first, wins, back, seed, ctx = (x[hit] for x in (doc, first, wins, back, seed, ctx))
                if len(seed):
                    held.append((entry_bytes(own, first, wins, back), seed, ctx, ids[i + doc], first - bounds[doc], wins))
                if sum(len(h[1]) for h in held) > HELD:
                    yield collapsed(held)
                    held = []
            if held:
                yield collapsed(held)

    return run


def _load(table: pa.Table) -> Iterator[tuple[int, dict]]:
    for values in zip(*(table.column(c) for c in ["level", *(f for f, _ in _FIELDS)]), strict=True):
        yield values[0].as_py(), {f: np.frombuffer(v.as_buffer() if v.is_valid else b"", t) for (f, t), v in zip(_FIELDS, values[1:], strict=True)}


def _joined(runs: list[dict]) -> dict:
    """One run from several, in byte order."""
    all_ = {f: np.concatenate([r[f] for r in runs]) for f, _ in _FIELDS}
    order = np.argsort(all_["key"], kind="stable")
    return {f: v[order] for f, v in all_.items()}


def _bytes(key: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(key).view(np.uint8).reshape(len(key), WIDTH)


def _seed_of(key: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(_bytes(key)[:, :SEED]).view(f"S{SEED}").ravel()


def _holds(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values a sorted array holds, and where."""
    at = np.searchsorted(sorted_, values)
    inside = at < len(sorted_)
    inside[inside] = sorted_[at[inside]] == values[inside]
    return inside, at


def _window_matches(aligned: np.ndarray, wins: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Which windows (one column for each start before the anchor) of entries with common seeds some other entry has too."""
    n, starts = len(aligned), BACK + 1
    found = np.zeros((n, starts), bool)
    up, _ = powers(LENGTH + BACK + 1)
    wide = max(1, WINDOWS // n)
    for low in range(0, starts, wide):
        high = min(starts, low + wide)
        sums = np.empty((n, high - low), _U)
        for a in range(0, n, 4096):
            total = np.zeros((len(aligned[a : a + 4096]), LENGTH + BACK + 1), _U)
            np.cumsum((aligned[a : a + 4096].astype(_U) + _U(1)) * up[: LENGTH + BACK], axis=1, out=total[:, 1:])
            sums[a : a + 4096] = total[:, low + LENGTH : high + LENGTH] - total[:, low:high]
        column = np.arange(low, high)
        k = back[:, None].astype(np.int64) - BACK + column
        who, where = np.nonzero((k >= 0) & (k < wins[:, None]))
        value = mix(sums[who, where] + column[where].astype(_U) * _U(0x9FB21C651E98DF25))
        order = np.argsort(value)
        value, who, where = value[order], who[order], column[where[order]]
        same = np.flatnonzero(value[1:] == value[:-1])
        for a in range(0, len(same), 16384):
            s = same[a : a + 16384]
            reach = where[s][:, None] + np.arange(LENGTH)
            equal = s[(aligned[who[s][:, None], reach] == aligned[who[s + 1][:, None], reach]).all(1) & (where[s] == where[s + 1])]
            found[who[equal], where[equal]] = True
            found[who[equal + 1], where[equal + 1]] = True
    return found


def _compare(part: int, runs: list[tuple[dict, np.ndarray]]) -> Iterator[tuple]:
    """Repeats among the named entries of some runs, whose seeds meet; entries known to be repeats as a whole are not named again."""
    took = {f: np.concatenate([r[f][own] for r, own in runs]) for f, _ in _FIELDS}
    if len(took["key"]) < 2:
        return
    took = _joined([took])
    seeds = _seed_of(took["key"])
    head = np.flatnonzero(np.r_[True, seeds[1:] != seeds[:-1]])
    cut, ends = [0], [*head[1:], len(seeds)]
    for end in ends:  # whole groups of one seed, about 2048 entries at once
        if end - cut[-1] >= 2048 or end == len(seeds):
            cut.append(end)
    for a, b in zip(cut, cut[1:], strict=False):
        raw = _bytes(took["key"][a:b])
        aligned = np.concatenate([raw[:, LENGTH + 2 :], raw[:, :LENGTH]], axis=1)
        back = raw[:, LENGTH + 1].astype(np.int64)
        found = _window_matches(aligned, took["wins"][a:b].astype(np.int64), back) & (took["full"][a:b] == 0)[:, None]
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        who, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        if len(who):
            at = took["at"][a:b][who].astype(np.int64) + back[who] - BACK + begin
            yield _row(part, REPEATS, {"row": took["row"][a:b][who], "at": at, "wins": end - begin})


def _wholly(part: int, run: dict, own: np.ndarray) -> tuple:
    return _row(part, REPEATS, {f: run[f][own] for f in ("row", "at", "wins")})


def _advance(last: bool):
    """Take a part's fresh batches one by one into its levels; the levels are returned too unless these were the last batches."""

    def run(table: pa.Table) -> pa.Table:
        part, levels, fresh, rows = table.column("part")[0].as_py(), {}, {}, []
        for level, r in _load(table):
            if level >= 0:
                levels[level] = r | {"full": r["full"].copy()}
            elif level == REPEATS:
                rows.append(_row(part, REPEATS, r))
            else:
                fresh.setdefault(FRESH - level, []).append(r)
        for b in sorted(fresh):
            new = _joined(fresh[b])
            head = np.flatnonzero(np.r_[True, new["key"][1:] != new["key"][:-1]])
            n = np.diff(np.r_[head, len(new["key"])])
            rows.append(_wholly(part, new, np.repeat(n > 1, n)))
            new = {f: v[head] for f, v in new.items()} | {"full": np.maximum.reduceat(new["full"], head) | (n > 1).astype(np.uint8)}
            known = np.zeros(len(head), bool)
            for old in levels.values():
                both, at = _holds(old["key"], new["key"])
                rows.append(_wholly(part, new, both & (new["full"] == 0)))
                partner = at[both]
                rows.append(_wholly(part, old, partner[old["full"][partner] == 0]))
                old["full"][partner] = 1
                known |= both
            new = {f: v[~known] for f, v in new.items()}
            if not len(new["key"]):
                continue
            seeds, n = np.unique(_seed_of(new["key"]), return_counts=True)
            shared, mine, meeting = n > 1, _seed_of(new["key"]), []
            for old in levels.values():
                own, at = _holds(seeds, _seed_of(old["key"]))
                shared[at[own]] = True
                meeting.append((old, own))
            own, at = _holds(seeds, mine)
            rows += _compare(part, [(new, shared[at] & own), *meeting])
            rank, carried = 0, new
            while rank in levels:
                carried = _joined([carried, levels.pop(rank)])
                rank += 1
            levels[rank] = carried
        if not last:
            rows += [_row(part, level, r) for level, r in levels.items()]
        return _batch_of(rows, pa.Table)

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed repeats as rows: row key, first and last byte's end."""
    for batch in batches:
        for row, at, wins in zip(*(batch.column(c) for c in ("row", "at", "wins")), strict=True):
            begin = np.frombuffer(at.as_buffer(), np.uint32).astype(np.int64)
            n = np.frombuffer(wins.as_buffer(), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row.as_buffer(), np.int64)), pa.array(begin), pa.array(begin + n - 1 + LENGTH)], names=["row", "begin", "end"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        removed, spans, digest = [], [], []
        for k, found in enumerate(batch.column(2)):
            own = data[offsets[k] : offsets[k + 1]]
            if found.is_valid and len(found):
                at = found.values
                begin, end = at.field(0).to_numpy(zero_copy_only=False), at.field(1).to_numpy(zero_copy_only=False)
                depth = np.bincount(begin, minlength=len(own) + 1) - np.bincount(end, minlength=len(own) + 1)
                gone = np.cumsum(depth[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum()))
                own = own[~gone]
            else:
                removed.append(0)
                spans.append(0)
            digest.append(hashlib.sha256(own.tobytes()).hexdigest())
        columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _as_spans(found: DataFrame) -> DataFrame:
    return found.where(f"level = {REPEATS}").select("row", "at", "wins").mapInArrow(tidy(_spans), "row long, begin long, end long")


def find_repeats(texts: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Spans (row, begin, end) of all repeats in texts (row, text), taken in as so many batches."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counts = max(partitions(spark), size // 67 // COUNT_ANCHORS)
    seeds = texts.select("text").mapInArrow(tidy(_seeds(counts)), "part long, seeds binary")
    wanted = _filter(staged(seeds.groupBy("part").applyInArrow(_twice, "seeds binary, n long"), "seeds"))
    parts = max(partitions(spark), size // 67 // PART_ANCHORS)
    fresh = texts.mapInArrow(tidy(_entries(parts, batches, wanted)), _RUN)
    return _as_spans(fresh.groupBy("part").applyInArrow(_advance(True), _RUN))


def extend(index: DataFrame | None, texts: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """One more batch of texts (row, text) for an index of so many parts: the repeats it makes known, and the new index."""
    fresh = texts.mapInArrow(tidy(_entries(parts, 1, None)), _RUN)
    both = fresh if index is None else fresh.unionAll(index)
    after = staged(both.groupBy("part").applyInArrow(_advance(False), _RUN), "levels")
    return _as_spans(after), after.where("level >= 0")


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Bytes, removed bytes and runs, and the digest of what is left, for every document."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    spans = find_repeats(texts.select("row", "text"), batches)
    listed = spans.groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    joined = texts.join(listed, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(tidy(_keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
