"""SentencePiece encoding by sampling, and lossless decoding.

A public model's pieces span a lattice over each text. The lattice is cut where no piece can cross, at the
start of every run of spaces, and equal stretches of a block of documents share one lattice. Forward filtering
sums the weights of all paths to each place; backward sampling draws the incoming piece of each place, from
the end of a stretch to its start, by numbers hashed from the seed, the row's key and the place. The same row
is thus always cut the same way, whatever task handles it.

The model is a BPE model whose scores are merge ranks; a piece's log-weight is -ALPHA * ln(rank + 2).
Characters without a piece become byte pieces. A leading space is added on encoding and taken off on decoding.

Defined results: null and empty texts have no pieces and decode to the empty text; rows with equal doc_id and
text get equal pieces; the character U+2581 itself is written in byte pieces, so it survives; pieces that hold a
space after another character are never sampled; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import doc_slices, documents, free_names, mix, prefix_sums, span_hash, text_buffer, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = 29
BYTE_WEIGHT = -30.0
#: Text that is cut at a time; the work arrays take about a hundred times as much.
BLOCK_BYTES = 1 << 18
#: Rows that decoding hands on at a time.
DECODE_ROWS = 128
_U = np.uint64


class Vocabulary:
    """Pieces of a model as bytes, byte pieces, and the hashes of all their prefixes by length."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        self.byte_ids = np.full(256, -1, np.int32)
        usable = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            raw = piece.replace("▁", " ").encode()
            if sp.is_byte(i):
                raw = bytes([int(piece[3:-1], 16)])
                self.byte_ids[raw[0]] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw = b""
            elif raw and b" " not in raw.lstrip(b" "):
                usable.append(i)
            self.bytes.append(raw)
        self.weight = np.full(len(self.bytes), BYTE_WEIGHT)
        for rank, i in enumerate(sorted(usable, key=lambda i: -sp.get_score(i))):
            self.weight[i] = -alpha * np.log(rank + 2)
        self._index(usable)

    def _index(self, usable: list[int]) -> None:
        """A hash table of all prefixes of pieces, with the piece that each prefix is, or -1."""
        prefixes: dict[bytes, int] = {}
        for i in usable:
            raw = self.bytes[i]
            for n in range(1, len(raw)):
                prefixes.setdefault(raw[:n], -1)
            prefixes[raw] = i
        size = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
        self.longest = int(size.max(initial=0))
        flat = np.frombuffer(b"".join(prefixes), np.uint8)
        end = np.cumsum(size)
        self.hashes = span_hash(prefix_sums(flat), end - size, end)
        self.piece_of = np.fromiter(prefixes.values(), np.int32, len(prefixes))
        self.slots = np.full(1 << 20, -1, np.int32)
        waiting, at = np.arange(len(self.hashes), dtype=np.int32), self._slot(self.hashes)
        while len(waiting):
            free = self.slots[at] < 0
            self.slots[at[free]] = waiting[free]  # of several, one stays
            left = self.slots[at] != waiting
            waiting, at = waiting[left], at[left] + 1 & (1 << 20) - 1

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> _U(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the prefixes, or -1."""
        at = self._slot(h)
        found = self.slots[at]
        miss = np.flatnonzero((found >= 0) & (self.hashes[found] != h))
        while len(miss):
            at[miss] = at[miss] + 1 & (1 << 20) - 1
            found[miss] = self.slots[at[miss]]
            miss = miss[(found[miss] >= 0) & (self.hashes[found[miss]] != h[miss])]
        return found


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    return Vocabulary(path, alpha)


def _edges(vocab: Vocabulary, data: np.ndarray, sums: np.ndarray, limit: np.ndarray):
    """All pieces that fit: start, end and id; limit is the end of the stretch that holds each byte."""
    alive = np.arange(len(data))
    starts, ends, ids = [], [], []
    covered = np.zeros(len(data), bool)  # a piece of one character begins here
    width = np.ones(len(data), np.int64)
    for lead, n in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
        width[data >= lead] = n
    for n in range(1, vocab.longest + 1):
        alive = alive[alive + n <= limit[alive]]
        if not len(alive):
            break
        found = vocab.find(span_hash(sums, alive, alive + n))
        same = found >= 0
        alive, piece = alive[same], vocab.piece_of[found[same]]
        full = piece >= 0
        starts.append(alive[full])
        ends.append(alive[full] + n)
        ids.append(piece[full])
        covered[alive[full & (width[alive] == n)]] = True
    first = np.flatnonzero((data & 0xC0) != 0x80)
    char = np.zeros(len(data), np.int64)
    char[first] = 1
    bare = ~covered[first[np.cumsum(char) - 1]] if len(first) else np.ones(len(data), bool)
    lone = np.flatnonzero(bare)
    starts.append(lone)
    ends.append(lone + 1)
    ids.append(vocab.byte_ids[data[lone]])
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)


def _forward(begin: np.ndarray, size: int, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log-sums of the weights of all paths from a stretch's begin to each place; edges come sorted by end."""
    total = np.full(size + 1, -np.inf)
    depth = end - begin
    small = depth.astype(np.uint16) if depth.max(initial=0) < 65536 else depth
    order = np.argsort(small, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
    at_begin = np.zeros(size + 1, bool)
    at_begin[begin] = True
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = order[a:b]
        if not len(own):
            continue
        s, e = start[own], end[own]
        value = weight[own] + np.where(s == begin[own], 0.0, total[s])
        heads = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
        total[e[heads]] = np.logaddexp.reduceat(value, heads)
    return total


def sample_block(vocab: Vocabulary, texts: list[bytes], keys: np.ndarray) -> list[np.ndarray]:
    """Sampled piece ids of each text; keys are the rows' 64-bit seeds."""
    data = np.frombuffer(b"".join(b" " + t for t in texts if t), np.uint8)
    lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    if not len(data):
        return [np.zeros(0, np.int32) for _ in texts]
    bounds = np.r_[0, np.cumsum(lengths)]
    space = data == 32
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[bounds[:-1][lengths > 0]] = True
    starts = np.flatnonzero(head)
    ends = np.r_[starts[1:], len(data)]
    owner = np.searchsorted(bounds, starts, side="right") - 1
    nth = np.arange(len(starts)) - np.searchsorted(starts, bounds[:-1])[owner]
    _, first, inverse = np.unique(span_hash(prefix_sums(data), starts, ends), return_index=True, return_inverse=True)

    size = (ends - starts)[first]
    base = np.r_[0, np.cumsum(size)]
    local = np.arange(base[-1]) - np.repeat(base[:-1], size)
    unique = data[np.repeat(starts[first], size) + local]
    limit = np.repeat(base[1:], size)
    begin_of = np.repeat(base[:-1], size)
    s, e, ids = _edges(vocab, unique, prefix_sums(unique), limit)
    order = np.argsort(e, kind="stable")
    s, e, ids = s[order], e[order], ids[order]
    weight = vocab.weight[ids]
    begin = begin_of[s]
    total = _forward(begin, len(unique), s, e, weight)
    share = np.exp(weight + np.where(s == begin, 0.0, total[s]) - total[e])
    run = np.cumsum(share)
    new = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
    counts = np.diff(np.r_[new, len(e)])
    within = run - np.repeat(run[new] - share[new], counts)
    node = np.zeros(len(unique) + 1, np.int64)
    node[e[new]] = np.arange(len(new))
    last = np.r_[new[1:], len(e)] - 1

    place, stop = base[1:][inverse], base[:-1][inverse]
    seeds = mix(keys[owner] ^ (nth.astype(_U) * _U(0x9E3779B97F4A7C15)))
    active, step, picked = np.arange(len(starts)), 0, []
    many = np.zeros(len(starts), np.int64)
    while len(active):
        u = (mix(seeds[active] + _U(step)) >> _U(11)).astype(np.float64) / float(1 << 53)
        at = node[place[active]]
        edge, end = new[at], last[at]
        more = np.flatnonzero((within[edge] <= u) & (edge < end))
        while len(more):
            edge[more] += 1
            more = more[(within[edge[more]] <= u[more]) & (edge[more] < end[more])]
        picked.append((active, ids[edge]))
        many[active] += 1
        place[active] = s[edge]
        active = active[place[active] > stop[active]]
        step += 1
    offset = np.r_[0, np.cumsum(many)]
    out = np.empty(offset[-1], np.int32)
    for k, (who, what) in enumerate(picked):
        out[offset[who] + many[who] - 1 - k] = what
    cut = offset[np.searchsorted(starts, bounds)]
    return [out[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _cut(vocab: Vocabulary, batch: pa.RecordBatch, text: int, key: int) -> Iterator[tuple[int, pa.ListArray]]:
    """Sampled pieces of a batch, in blocks of whole rows: first row and pieces of each."""
    data, offsets = text_buffer(batch.column(text))
    keys = batch.column(key).to_numpy(zero_copy_only=False).view(_U)
    for i, j in doc_slices(offsets, BLOCK_BYTES):
        texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
        made = sample_block(vocab, texts, keys[i:j])
        cuts = np.r_[0, np.cumsum([len(m) for m in made])].astype(np.int32)
        yield i, pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(made)))


def _spell(vocab: Vocabulary, pieces: pa.ListArray) -> Iterator[tuple[int, pa.Array]]:
    """Texts that pieces spell, a few rows at a time: first row and texts of each."""
    cuts, ids = pieces.offsets.to_numpy(), pieces.values.to_numpy(zero_copy_only=False)
    for i in range(0, len(pieces), DECODE_ROWS):
        own = cuts[i : i + DECODE_ROWS + 1]
        texts = [b"".join(map(vocab.bytes.__getitem__, ids[a:b].tolist()))[1:].decode() for a, b in zip(own, own[1:], strict=False)]
        yield i, pa.array(texts, pa.string())


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumn(free_names(docs, "key")[0], F.xxhash64(F.lit(seed), "doc_id"))


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *more])


def encode(docs: DataFrame, model: str = MODEL, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """docs (with doc_id, text) with one more column, an array of piece ids: pieces_, or pieces__ and so on if docs has that name."""
    text, key = docs.columns.index("text"), len(docs.columns)
    (as_,) = free_names(docs, "pieces_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model, alpha)
        for batch in batches:
            for i, pieces in _cut(vocab, batch, text, key):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, len(pieces)).columns[:key], pieces], names=[*batch.schema.names[:key], as_])

    return _keyed(docs, seed).mapInArrow(tidy(run), _ddl(docs, f"`{as_}` array<int>"))


def decode(encoded: DataFrame, model: str = MODEL, pieces: str = "pieces_") -> DataFrame:
    """encoded with one more column, the text that its pieces spell: decoded_, or decoded__ and so on if that name is taken."""
    at = encoded.columns.index(pieces)
    (as_,) = free_names(encoded, "decoded_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            for i, texts in _spell(vocab, batch.column(at)):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, len(texts)).columns, texts], names=[*batch.schema.names, as_])

    return encoded.mapInArrow(tidy(run), _ddl(encoded, f"`{as_}` string"))


def round_trip(docs: DataFrame, model: str = MODEL, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """decode(encode(docs)) in one pass, so that a task needs one Python worker and moves each text once."""
    text, key = docs.columns.index("text"), len(docs.columns)
    pieces_, decoded_ = free_names(docs, "pieces_", "decoded_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model, alpha)
        for batch in batches:
            names = [*batch.schema.names[:key], pieces_, decoded_]
            for i, pieces in _cut(vocab, batch, text, key):
                for k, texts in _spell(vocab, pieces):
                    own = batch.slice(i + k, len(texts)).columns[:key]
                    yield pa.RecordBatch.from_arrays([*own, pieces.slice(k, len(texts)), texts], names=names)

    return _keyed(docs, seed).mapInArrow(tidy(run), _ddl(docs, f"`{pieces_}` array<int>", f"`{decoded_}` string"))


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Pieces of every document in short: number, digest, and whether decoding gives the text back."""
    rows = round_trip(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id",
        F.size("pieces_").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("pieces_", " "), 256).alias("pieces_sha256"),
        F.sha2("decoded_", 256).alias("decoded_sha256"),
        (F.col("decoded_") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
