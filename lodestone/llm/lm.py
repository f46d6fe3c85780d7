"""LM scoring: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

The model predicts a unit from the two units before it. Units are the most frequent words, each by itself, as many
as WORDS_BY_ROOT times the root of the training tokens; classes of the other words by their last two bytes; and the
end of a text. So vocabulary and contexts grow with the corpus, without a cap; what a task holds of the model grows with
the root of the tokens (about 140 bytes a unit).
Within a class a word has its share of the corpus counts, smoothed, with one event for every unseen word.

Each unit has a context vector, a target vector and a bias. Units are cut into groups of about the root of their
number, in order of their endings; groups have target vectors too. A probability is that of the group, normalised over
all groups, times that of the unit, normalised over its group, each by batched matrix products. Both are trained by
NCE with sampled noise. Training sees every training token once, in ROUNDS rounds over disjoint sets of documents:
in a round each shard, dealt by content and read in order of doc_id and text, starts from the same parameters, takes
Adagrad steps over its own tokens and returns the vectors it touched; these are averaged by the tokens that touched
them, through a merge tree. Shards and their seeds come from the documents alone: files, partitions and lost executors
do not change what is learned.

Word counts are exact and cover the corpus. Documents are dealt to blocks by content; each block asks for its
distinct words, one sorted array per part of the hash space; a part sums all blocks' counts of its words and
answers every block. So a frequent word travels once a block, and no task holds the vocabulary. Words are known
by 48 hash bits and their last two bytes.

Defined results: null texts are empty and have one token, the end; a null doc_id counts as the empty text for
crc32; equal texts have equal counts and base scores, and model scores that agree to about seven digits (matrix
products round by the shape of a block); without training documents N and V are 0, nothing is known and the model
is uniform over groups and units; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, doc_slices, documents, lower_bytes, merge_tree, partitions, staged, text_buffer, word_hashes, words

#: Single words of the vocabulary by the root of the training tokens, and the classes of the other words by ending.
WORDS_BY_ROOT, CLASSES = 2, 254
SMOOTH = 0.1
#: Bytes of text of a block, of a training shard and of a part's share of the corpus; words of a part that are kept as candidates occur so often.
BLOCK_BYTES, SHARD_BYTES, PART_BYTES, CANDIDATE = 3 << 20, 16 << 20, 64 << 20, 4
#: Vector length, noise samples of a minibatch (words, groups), its tokens, step size, rounds; units of a slice that is merged at once.
DIM, NOISE, NOISE_GROUPS, BATCH, RATE, ROUNDS, SLICE = 16, 32, 8, 640, 0.035, 2, 8192
_U = np.uint64


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """48 bits of a word's hash below its last two bytes."""
    lower = lower_bytes(data)
    h = word_hashes(data, starts, ends) >> _U(16)
    final = lower[ends - 1].astype(_U) if len(ends) else np.zeros(0, _U)
    before = np.where(ends - starts > 1, lower[np.maximum(ends - 2, 0)], 0).astype(_U) if len(ends) else np.zeros(0, _U)
    return (before << _U(8) | final) << _U(48) | h


def _blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int, int]:
    """doc_id, text, train and the block that the document's content deals it to; bytes of all texts; training documents."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (crc_mod(F.col("doc_id"), 10) != 0).alias("train"))
    size, n_train = rows.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    many = max(1, -(-(size or 0) // block_bytes))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(many))), size or 0, n_train


def _tokens(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of documents with their word keys and the offsets of each document's words."""
    data, offsets = text_buffer(table.column("text"))
    for i, j in doc_slices(offsets, 4 << 20):
        part = data[offsets[i] : offsets[j]]
        starts, ends, cut = words(part, offsets[i : j + 1] - offsets[i])
        yield i, j, word_keys(part, starts, ends), cut


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys & _U(0xFFFFFFFF)) % _U(parts)).astype(np.int64)


def _distinct(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order of part and key, and the bounds of the parts."""
    unique = np.unique(keys)
    part = _part_of(unique, parts)
    order = np.argsort(part, kind="stable")
    return unique[order], np.searchsorted(part[order], np.arange(parts + 1))


_ASK = "part int, block long, keys binary, counts binary"
_ANSWER = "part int, block long, counts binary, top_keys binary, top_counts binary, sizes binary, words binary, endings binary, ending_words binary, ending_tokens binary"


def _ask(parts: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        train = table.column("train").to_numpy(zero_copy_only=False)
        keys, use = [], []
        for i, j, k, cut in _tokens(table):
            keys.append(k)
            use.append(np.repeat(train[i:j], np.diff(cut)))
        keys, use = np.concatenate(keys), np.concatenate(use)
        unique, bounds = _distinct(keys, parts)
        rank = np.argsort(unique, kind="stable")
        n = np.bincount(rank[np.searchsorted(unique[rank], keys[use])], minlength=len(unique))
        rows = [(p, block, unique[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes()) for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "keys", "counts"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Sum one part's counts, answer each block, and describe the part in one more row (block null)."""
    asked = [np.frombuffer(x.as_buffer(), _U) for x in table.column("keys")]
    counts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")]
    unique, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(unique)).astype(np.int64)
    answer = total[inverse]
    cut = np.r_[0, np.cumsum([len(a) for a in asked])]
    part = table.column("part")[0].as_py()
    rows = [(part, b, answer[i:j].tobytes(), *[None] * 7) for b, i, j in zip(table.column("block").to_pylist(), cut, cut[1:], strict=False)]
    known = total > 0
    unique, total = unique[known], total[known]
    sizes, n_sizes = np.unique(_size_of(total), return_counts=True)
    top = total >= CANDIDATE
    endings, where = np.unique((unique >> _U(48)).astype(np.int64), return_inverse=True)
    n_words = np.bincount(where, minlength=len(endings)).astype(np.int64)
    n_tokens = np.bincount(where, total, len(endings)).astype(np.int64)
    rows.append((part, None, None, *(x.tobytes() for x in (unique[top], total[top], sizes, n_sizes, endings, n_words, n_tokens))))
    types = (pa.int32(), pa.int64(), *[pa.binary()] * 8)
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _ANSWER.split(", ")])


def _size_of(counts: np.ndarray) -> np.ndarray:
    """Counts in eight classes an octave: at most a few hundred distinct values."""
    return np.floor(8 * np.log2(np.maximum(counts, 1))).astype(np.int64)


def _unpacked(described: DataFrame, columns: list[str], names: list[str], least: int | None = None) -> DataFrame:
    """The packed longs of columns as rows; with least, only those whose last value has that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                values = [np.frombuffer(v.as_buffer(), np.int64) for v in row]
                if least is not None:
                    own = _size_of(values[-1]) >= least
                    values = [v[own] for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=names)

    return described.select(*columns).mapInArrow(run, ", ".join(f"{n} long" for n in names))


class Units:
    """The units of a corpus: single words in order of their keys, classes by ending, one class for all other endings, the end."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, endings: np.ndarray, words_: np.ndarray, tokens_: np.ndarray, n_ends: int):
        order = np.argsort(keys)
        self.keys, key_counts = keys[order], counts[order]
        self.n_ends = n_ends
        self.tokens, self.distinct = int(tokens_.sum()) + n_ends, int(words_.sum()) + (n_ends > 0)
        tokens = np.bincount(endings, tokens_, 1 << 16)
        distinct = np.bincount(endings, words_, 1 << 16)
        own = (self.keys >> _U(48)).astype(np.int64)
        np.subtract.at(tokens, own, key_counts)
        np.subtract.at(distinct, own, 1)
        best = np.sort(np.lexsort((np.arange(1 << 16), -tokens))[:CLASSES])
        n = len(self.keys)
        self.end = n + CLASSES + 1
        self.of_ending = np.full(1 << 16, n + CLASSES, np.int64)
        self.of_ending[best] = n + np.arange(CLASSES)
        self.n = self.end + 1
        self.class_tokens = np.bincount(self.of_ending, tokens, self.n)
        self.class_words = np.bincount(self.of_ending, distinct, self.n)
        self.unit_tokens = self.class_tokens.copy()
        self.unit_tokens[:n] = key_counts
        self.unit_tokens[self.end] = n_ends
        self.width = int(np.ceil(np.sqrt(self.n)))  # units of a group
        self.groups = -(-self.n // self.width)

    def of(self, keys: np.ndarray) -> np.ndarray:
        unit = self.of_ending[(keys >> _U(48)).astype(np.int64)]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            unit = np.where(self.keys[at] == keys, at, unit)
        return unit

    def word_share(self, unit: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its unit, from its count."""
        share = (counts + SMOOTH) / (self.class_tokens[unit] + SMOOTH * (self.class_words[unit] + 1))
        return np.where(unit < len(self.keys), 0.0, np.log10(share))


def _contexts(unit: np.ndarray, cut: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token (words and one end a document): the units two and one before, its unit, and the documents' token offsets."""
    n = len(cut) - 1
    ends = cut[1:] + np.arange(n)
    out = np.empty(len(unit) + n, np.int64)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = unit, end
    first = np.r_[0, ends[:-1] + 1]
    one, two = np.r_[end, out[:-1]], np.r_[end, end, out[:-2]][: len(out)]
    one[first] = end
    two[first] = end
    second = first[ends > first] + 1
    two[second] = end
    return two, one, out, np.r_[first, len(out)]


def start(units: Units, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters before training: small vectors, biases of the corpus frequencies. The last column of Q and G is the bias."""
    rng = np.random.default_rng(seed)
    share = (units.unit_tokens + 1.0) / (units.unit_tokens.sum() + units.n)
    of_group = np.bincount(np.arange(units.n) // units.width, share, units.groups)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    p = {"R": small(units.n, DIM), "Q": small(units.n, DIM + 1), "G": small(units.groups, DIM + 1), "C": np.concatenate([0.3 * np.eye(DIM), 0.7 * np.eye(DIM)]).astype(np.float32)}
    p["Q"][:, DIM], p["G"][:, DIM] = np.log(share), np.log(of_group)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in the place of x."""
    np.clip(x, -30, 30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Adagrad steps of NCE on a copy of the parameters; knows which rows were touched, and how often."""

    def __init__(self, p: dict[str, np.ndarray], units: Units, seed: list[int]):
        self.p = {k: v.copy() for k, v in p.items()}
        self.width, self.rng = units.width, np.random.default_rng(seed)
        self.squares = {k: np.full(len(v), 1e-4, np.float32) for k, v in p.items()}
        self.hits = {k: np.zeros(len(v), np.int64) for k, v in p.items()}
        share = (units.unit_tokens + 1.0) / (units.unit_tokens.sum() + units.n)
        of_group = np.bincount(np.arange(units.n) // units.width, share, units.groups)
        self.noise = {k: (np.log(n * x).astype(np.float32), np.cumsum(x), n) for k, x, n in (("Q", share, NOISE), ("G", of_group, NOISE_GROUPS))}

    def _step(self, name: str, at: np.ndarray, grad: np.ndarray) -> None:
        """One Adagrad step on rows at; rows may be named several times, each has one running square."""
        shift = len(at).bit_length()
        packed = np.sort(at << shift | np.arange(len(at)))
        at, order = packed >> shift, packed & ((1 << shift) - 1)
        new = np.ones(len(at), bool)
        np.not_equal(at[1:], at[:-1], out=new[1:])
        head = np.flatnonzero(new)
        total, at = np.add.reduceat(grad[order], head, axis=0), at[head]
        self.hits[name][at] += np.diff(np.append(head, len(order)))
        squares = self.squares[name][at] + np.einsum("ij,ij->i", total, total) / total.shape[1]
        self.squares[name][at] = squares
        total *= (RATE / np.sqrt(squares))[:, None]
        self.p[name][at] -= total

    def _contrast(self, name: str, hidden: np.ndarray, target: np.ndarray) -> np.ndarray:
        """NCE against noise shared by the minibatch: steps on the target table, and the gradient of hidden (with bias column)."""
        lift, summed, k = self.noise[name]
        fake = np.minimum(np.searchsorted(summed, self.rng.random(k) * summed[-1]), len(lift) - 1)
        own, other = self.p[name][target], self.p[name][fake]
        e_real = -_sigmoid(lift[target] - np.einsum("ij,ij->i", hidden, own))
        e_false = _sigmoid(hidden @ other.T - lift[fake])
        back = e_real[:, None] * own + e_false @ other
        self._step(name, np.concatenate([target, fake]), np.concatenate([e_real[:, None] * hidden, e_false.T @ hidden]))
        return back[:, :DIM]

    def learn(self, two: np.ndarray, one: np.ndarray, target: np.ndarray) -> None:
        r, c = self.p["R"], self.p["C"]
        x2, x1 = r[two], r[one]
        hidden = np.ones((len(two), DIM + 1), np.float32)
        hidden[:, :DIM] = x2 @ c[:DIM] + x1 @ c[DIM:]
        back = self._contrast("Q", hidden, target)
        back += self._contrast("G", hidden, target // self.width)
        to2, to1 = back @ c[:DIM].T, back @ c[DIM:].T
        step_c = np.concatenate([x2.T @ back, x1.T @ back])
        own = np.r_[0, np.flatnonzero(two[1:] != one[:-1]) + 1]  # elsewhere the unit two before is the last token's unit one before
        apart = to2[own]
        to2[own] = 0
        to1[:-1] += to2[1:]
        self._step("R", np.concatenate([one, two[own]]), np.concatenate([to1, apart]))
        self.squares["C"] += (step_c * step_c).mean(1)
        self.hits["C"] += len(two)
        self.p["C"] = c - 0.2 * RATE * step_c / np.sqrt(self.squares["C"])[:, None]


_TOUCHED = "name string, slice int, at binary, hits binary, sums binary"


def _touched(name: str, k: int, at: np.ndarray, hits: np.ndarray, sums: np.ndarray) -> tuple:
    return name, k, at.astype(np.uint32).tobytes(), hits.astype(np.int64).tobytes(), sums.astype(np.float64).tobytes()


def _touched_table(rows: list[tuple], kind):
    types = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return kind.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["name", "slice", "at", "hits", "sums"])


def _add_touched(table: pa.Table) -> pa.Table:
    """Hits and hit-weighted steps of one slice of one table, summed."""
    at = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("at")]
    hits = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("hits")])
    sums = [np.frombuffer(x.as_buffer(), np.float64).reshape(len(a), -1) for x, a in zip(table.column("sums"), at, strict=True)]
    where = np.concatenate(at).astype(np.int64)
    order = np.argsort(where, kind="stable")
    head = np.flatnonzero(np.r_[True, where[order][1:] != where[order][:-1]])
    row = _touched(table.column("name")[0].as_py(), table.column("slice")[0].as_py(), where[order][head], np.add.reduceat(hits[order], head), np.add.reduceat(np.concatenate(sums)[order], head, axis=0))
    return _touched_table([row], pa.Table)


def train_round(texts: DataFrame, units: Units, p: dict[str, np.ndarray], r: int, shards: int) -> dict[str, np.ndarray]:
    """Parameters after round r over texts (shard, doc_id, text): the average of what every shard has learned from p."""
    shared = texts.sparkSession.sparkContext.broadcast((units, p))

    def run(table: pa.Table) -> pa.Table:
        u, before = shared.value
        trainer = Trainer(before, u, [r, table.column("shard")[0].as_py()])
        for _, _, keys, cut in _tokens(table.sort_by([("doc_id", "ascending"), ("text", "ascending")])):
            two, one, unit, _ = _contexts(u.of(keys), cut, u.end)
            for i in range(0, len(unit), BATCH):
                trainer.learn(two[i : i + BATCH], one[i : i + BATCH], unit[i : i + BATCH])
        rows = []
        for name, now in trainer.p.items():
            at = np.flatnonzero(trainer.hits[name])
            for k in np.unique(at // SLICE):
                own = at[at // SLICE == k]
                hits = trainer.hits[name][own]
                rows.append(_touched(name, int(k), own, hits, hits[:, None] * (now[own] - before[name][own]).astype(np.float64)))
        return _touched_table(rows, pa.Table)

    found = merge_tree(texts.groupBy("shard").applyInArrow(run, _TOUCHED), ["name", "slice"], _add_touched, _TOUCHED, shards).collect()  # at most the model
    p = {k: v.copy() for k, v in p.items()}
    for row in found:
        at, hits = np.frombuffer(row["at"], np.uint32), np.frombuffer(row["hits"], np.int64)
        p[row["name"]][at] += (np.frombuffer(row["sums"], np.float64).reshape(len(at), -1) / hits[:, None]).astype(np.float32)
    return p


def log_probabilities(units: Units, p: dict[str, np.ndarray], two: np.ndarray, one: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Normalised log10 probability of each target after its two units, by batched matrix products."""
    first, second = p["R"] @ p["C"][:DIM], p["R"] @ p["C"][DIM:]
    n, group = len(target), target // units.width
    hidden = np.ones((n, DIM + 1), np.float32)
    hidden[:, :DIM] = first[two] + second[one]
    value = np.empty(n)

    def normalised(own: np.ndarray, table: np.ndarray, place: np.ndarray) -> np.ndarray:
        score = hidden[own] @ table.T
        picked = score[np.arange(len(own)), place]
        np.clip(score, -80, 80, out=score)  # far beyond what training reaches; keeps exp within floats
        return np.clip(picked, -80, 80) - np.log(np.exp(score, out=score).sum(1))

    for a in range(0, n, 8192):
        own = np.arange(a, min(n, a + 8192))
        value[own] = normalised(own, p["G"], group[own])
    order = np.argsort(group, kind="stable")
    cut = np.searchsorted(group[order], np.arange(units.groups + 1))
    for g in np.flatnonzero(np.diff(cut)):
        table = p["Q"][g * units.width : (g + 1) * units.width]
        for a in range(cut[g], cut[g + 1], 8192):
            own = order[a : min(cut[g + 1], a + 8192)]
            value[own] += normalised(own, table, target[own] - g * units.width)
    return value / np.log(10)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def learn_units(described: DataFrame, n_ends: int, tokens: int) -> Units:
    """Units from the parts' descriptions: single words are all those in the size classes that fit the vocabulary."""
    wanted = int(WORDS_BY_ROOT * np.sqrt(tokens))
    sizes = sorted(_unpacked(described, ["sizes", "words"], ["size", "n"]).groupBy("size").agg(F.sum("n").alias("n")).collect(), reverse=True)
    least, held = 1 << 30, 0
    for r in sizes:
        if held + r["n"] > wanted or r["size"] < _size_of(np.array([CANDIDATE]))[0]:
            break
        least, held = r["size"], held + r["n"]
    top = _unpacked(described, ["top_keys", "top_counts"], ["key", "n"], least).toPandas()  # at most wanted rows
    ends = _unpacked(described, ["endings", "ending_words", "ending_tokens"], ["ending", "words", "tokens"])
    ends = ends.groupBy("ending").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).toPandas()  # at most 65,536 rows
    column = lambda f, c: f[c].to_numpy(np.int64)
    return Units(column(top, "key").view(_U), column(top, "n"), column(ends, "ending"), column(ends, "words"), column(ends, "tokens"), n_ends)


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, model: bool = True) -> DataFrame:
    """Counts, base score and model score of every document; learns from the documents that crc32 lets train.

    The base score stands on counts alone: without model nothing is trained, and the column score is 0.
    """
    spark = docs.sparkSession
    blocks, size, n_train = _blocks(docs, block_bytes)
    parts = max(2 * partitions(spark), size // PART_BYTES)
    asked = blocks.groupBy("block").applyInArrow(_ask(parts), _ASK)
    answers = staged(asked.groupBy("part").applyInArrow(_answer, _ANSWER), "answers")
    described = answers.where("block is null")
    total = _unpacked(described, ["ending_tokens"], ["tokens"]).agg(F.sum("tokens")).first()[0] or 0
    units = learn_units(described, n_train, total + n_train)
    params = start(units)
    shards = max(1, size // (ROUNDS * shard_bytes))
    dealt = blocks.where("train").withColumn("deal", F.pmod(F.xxhash64("text", "doc_id"), F.lit(ROUNDS * shards)))
    for r in range(ROUNDS if n_train and model else 0):
        own = dealt.where(F.col("deal") % ROUNDS == r).select(F.expr(f"deal div {ROUNDS}").alias("shard"), "doc_id", "text")
        params = train_round(own, units, params, r, shards)
    shared = spark.sparkContext.broadcast((units, params))

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        u, p = shared.value
        n = texts.num_rows
        out = {k: np.zeros(n) for k in ("n_tokens", "n_known", "base", "score")}
        order = np.argsort(replies.column("part").to_numpy())
        counts = [np.frombuffer(replies.column("counts")[int(k)].as_buffer(), np.int64) for k in order]
        counts = np.concatenate(counts or [np.zeros(0, np.int64)])
        held = list(_tokens(texts))
        unique, _ = _distinct(np.concatenate([k for _, _, k, _ in held] or [np.zeros(0, _U)]), parts)
        rank = np.argsort(unique)
        unique, counts = unique[rank], counts[rank]
        for i, j, keys, cut in held:
            c = counts[np.searchsorted(unique, keys)] if len(keys) else np.zeros(0, np.int64)
            two, one, unit, first = _contexts(u.of(keys), cut, u.end)
            end = unit == u.end
            all_counts = np.full(len(unit), u.n_ends, np.int64)
            all_counts[~end] = c
            base = np.log10((all_counts + SMOOTH) / (u.tokens + SMOOTH * (u.distinct + 1)))
            values = [("n_known", all_counts > 0), ("base", base)]
            if model:
                learned = log_probabilities(u, p, two, one, unit)
                learned[~end] += u.word_share(unit[~end], c)
                values.append(("score", learned))
            for name, value in values:
                out[name][i:j] = np.add.reduceat(value.astype(np.float64), first[:-1])
            out["n_tokens"][i:j] = np.diff(first)
        columns = [
            texts.column("doc_id"),
            pa.array(~texts.column("train").to_numpy(zero_copy_only=False)),
            pa.array(out["n_tokens"].astype(np.int64)),
            pa.array(out["n_known"].astype(np.int64)),
            pa.array(np.full(n, u.tokens)),
            pa.array(out["base"]),
            pa.array(out["score"]),
        ]
        return pa.table(columns, names=[x.split()[0] for x in _SCORED.split(", ")])

    replies = answers.where("block is not null").select("part", "block", "counts")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, _SCORED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
