"""Mixing sources to target weights by pivotal dependent rounding.

Every document holds a fractional number of copies, target / source size of its source. Fractions are settled from
the largest document down: a document is paired with the pool of all smaller ones, and words of probability mass
move between the two, at random but fair odds, until the document has a whole number of copies; the pool takes up
the difference in proportion to what its members can give or take. So every fraction is kept on average.

One rule holds for sources of every size. First the documents that hold more than one part in GIANTS of their
source (fewer than GIANTS entries, whatever the source) are settled against all other documents of the source, which
are known by two sums: what they can give and what they can take. Then the others, with the fractions that this left
them, are settled in buckets; each leaves one fraction open at most, and these residuals meet in the next level of a
reduction tree with the same rule. The residual at the root is drawn by itself. So the words of a source miss its target
by one part in GIANTS of the source at most, and by what the largest documents could not be balanced by all others together.

Equal (doc_id, source, size) rows are one entry with a count: their copies are dealt evenly, so that no group of
repeated rows has to fit a task.

Defined results: null texts have size 0 and take 0 words; a null source is a source of its own, last in the
order; equal rows are separate documents whose copies differ by one at most; an empty table gives no rows; other
columns are ignored, and apply_mix() passes them through whatever their names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD_PATTERN, free_names, staged

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Entries (or residuals) that one task settles in sequence; documents of a source that can be settled before all others are fewer than GIANTS.
FAN_IN, GIANTS = 2048, 2048
#: Fractions nearer than this to a whole number are whole; units that fractions are summed in, so that sums do not depend on their order.
_EPS, _UNIT = 1e-9, 1 << 30

_STATE = "doc_id string, source string, size long, n long, source_size long, target double, bucket long, whole long, part double, draw double, last double, open boolean"


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD_PATTERN))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source with its size, documents and target; input (source, size).

    The shares are water-filled: sources in order of cap / weight are capped while their cap is below their
    share of what is left. The windows run over one row per source, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    s = s.withColumn("weight", w).withColumn("cap", F.col("source_size") * cap)
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(whole) * share - before) / after)
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)  # that of the first one not capped: it falls from there on
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(level * F.col("weight"), F.col("cap"))))
    return s.select("source", "source_size", "n_docs", "target")


def _settle(g: pd.DataFrame, down: float = 0.0, up: float = 0.0, final: bool = False) -> tuple[pd.DataFrame, float, float]:
    """Settle the fractions of one bucket, largest documents first, until at most one is left open.

    A pool outside, of smaller documents, can give `down` words and take `up`; a fraction of it is then its part * scale + shift. With `final`
    a document that all smaller ones cannot balance is settled all the same; without, its fraction stays open for the next level.
    """
    g = g.sort_values(["size", "draw", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    size, first, draw = g["size"].tolist(), g["part"].tolist(), g["draw"].tolist()
    whole, part, held = g["whole"].tolist(), list(first), -1
    # a member of the pool has the part first * scale + shift: what all of them give or take is one step
    scale, shift = 1.0, 0.0
    inner = [s > 0 and _EPS < p < 1 - _EPS for s, p in zip(size, first, strict=True)]
    down += sum(s * p for s, p, i in zip(size, first, inner, strict=True) if i)
    up += sum(s * (1 - p) for s, p, i in zip(size, first, inner, strict=True) if i)
    for i, s in enumerate(size):
        if not inner[i]:
            continue
        p = min(1.0, max(0.0, first[i] * scale + shift))
        down, up = max(0.0, down - s * p), max(0.0, up - s * (1 - p))
        if _EPS < p < 1 - _EPS and down > _EPS and up > _EPS:
            if final:  # nothing can balance more than the pool: settled now, with as much of it as keeps the odds fair
                rise, gives = draw[i] < p, min(s * (1 - p), down, up * (1 - p) / p)
                moved, p = (gives, 1.0) if rise else (-gives * p / (1 - p), 0.0)
            else:
                most, least = min(1 - p, down / s), min(p, up / s)
                step = most if draw[i] * (most + least) < least else -least
                moved, p = step * s, p + step
            if moved > 0:
                keep = max(0.0, 1 - moved / down)
                scale, shift = scale * keep, shift * keep
            else:
                keep = max(0.0, 1 + moved / up)
                scale, shift = scale * keep, 1 - (1 - shift) * keep
            down, up = max(0.0, down - moved), max(0.0, up + moved)
        part[i] = p
        if _EPS < p < 1 - _EPS:  # the pool had too little left to settle it: it is empty now
            held = i
    for i in range(len(size)):
        if i != held:
            whole[i] += round(part[i])
            part[i] = 0.0
    g["whole"], g["part"] = whole, part
    g["open"] = False
    if held >= 0:
        g.loc[held, "open"] = True
    return g, scale, shift


def _bucket(g: pd.DataFrame) -> pd.DataFrame:
    return _settle(g)[0]


def _root(g: pd.DataFrame) -> pd.DataFrame:
    """Settle the residuals of a source and draw the last one, by a number that has settled nothing yet."""
    g = _settle(g)[0]
    g["whole"] += (g["open"] & (g["last"] < g["part"])).astype("int64")
    return g


def _giants(g: pd.DataFrame) -> pd.DataFrame:
    """Settle the largest documents of a source against all others of it."""
    g, scale, shift = _settle(g, float(g["down"].iloc[0]), float(g["up"].iloc[0]), final=True)
    return g.drop(columns=["down", "up"]).assign(scale=scale, shift=shift)


def take(docs: DataFrame, seed: int = 17, fan_in: int = FAN_IN, giants: int = GIANTS, **plan) -> DataFrame:
    """Copies of each document: doc_id, source, size, source_size, target, copies, taken; docs has doc_id, text, source."""
    rows = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    entries = take_sized(rows, seed, fan_in, giants, **plan)
    nth = entries.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return nth.select("doc_id", "source", "size", "source_size", "target", _share().alias("copies"), (_share() * F.col("size")).alias("taken"))


def _share() -> Column:
    """Copies of the nth of n equal rows that have some copies together."""
    return F.floor(F.col("copies") / F.col("n")) + (F.col("nth") <= F.col("copies") % F.col("n")).cast("long")


def take_sized(rows: DataFrame, seed: int = 17, fan_in: int = FAN_IN, giants: int = GIANTS, **plan) -> DataFrame:
    """One row per distinct (doc_id, source, size) with the number n of such rows and the copies they have together."""
    kind = dict(rows.dtypes)["doc_id"]  # pandas would make floats of ids with nulls, so they travel as text
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = staged(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets = staged(source_targets(rows.select("source", (F.col("size") * F.col("n")).alias("size")), **plan), "targets")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / fan_in))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = F.struct(F.col("source").isNull(), F.coalesce(F.col("source"), F.lit("")))  # joins null sources, too
    sources = targets.select(named.alias("s"), "source_size", "target", buckets.alias("buckets"))

    def number(salt: int) -> Column:  # one for each level: a number that has moved a fraction does not move it again
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed + salt), "doc_id", "size"), 11) / float(1 << 53)

    state = (
        rows.withColumn("s", named)
        .join(sources, "s")
        .withColumn("rate", rate * F.col("n"))
        .withColumn("bucket", F.expr(f"pmod(xxhash64({seed + 1}, doc_id, size), buckets)"))
        .withColumn("whole", F.floor("rate"))
        .withColumn("part", F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0))
        .withColumn("draw", number(0))
        .withColumn("last", number(2))
        .withColumn("open", F.lit(True))
    )
    columns = [x.split()[0] for x in _STATE.split(", ")]
    large = F.col("size") * giants > F.col("source_size")
    mass = F.col("size").cast("decimal(18,0)") * F.round(F.col("part") * _UNIT).cast("decimal(11,0)")
    inner = ~large & (F.col("size") > 0) & (F.col("part") > _EPS) & (F.col("part") < 1 - _EPS)
    pools = state.where(inner).groupBy("s").agg(F.sum(mass).cast("double").alias("mass"), F.sum("size").cast("double").alias("words"))
    pools = pools.select("s", (F.col("mass") / _UNIT).alias("down"), (F.col("words") - F.col("mass") / _UNIT).alias("up"))
    first = state.where(large).join(pools, "s", "left").select(*columns, F.coalesce("down", F.lit(0.0)).alias("down"), F.coalesce("up", F.lit(0.0)).alias("up"))
    first = staged(first.groupBy("source").applyInPandas(_giants, _STATE + ", scale double, shift double"), "giants")
    out, held = first.where("not open").select(*columns), first.where("open").select(*columns)
    moved = first.groupBy(named.alias("s")).agg(F.max("scale").alias("scale"), F.max("shift").alias("shift"))
    # fractions of the pool follow what the largest documents took from it or gave to it; whole ones stay
    part = F.when(inner & F.col("scale").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("part") * F.col("scale") + F.col("shift")))).otherwise(F.col("part"))
    state = state.where(~large).join(moved, "s", "left").withColumn("part", part).select(*columns)
    left = (targets.agg(F.max("n_docs")).first()[0] or 0) / fan_in
    level = 3
    while True:  # every level leaves one fraction of a bucket open at most
        state = staged(state.groupBy("source", "bucket").applyInPandas(_bucket, _STATE), "mix")
        out = out.unionByName(state.where("not open"))
        state = state.where("open").withColumn("bucket", F.floor(F.col("bucket") / fan_in)).withColumn("draw", number(level))
        if left <= fan_in:  # the residuals of a source fit one bucket: the root
            break
        left, level = left / fan_in, level + 1
    held = held.withColumn("draw", number(level))
    out = out.unionByName(state.unionByName(held).groupBy("source").applyInPandas(_root, _STATE))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "source", "size", "n", "source_size", "target", F.col("whole").alias("copies"))


def apply_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed table itself: each document repeated as often as it is taken, with the columns of docs, under whatever names.

    Equal rows are counted, and different rows that share doc_id, source and size are ranked in parts by a hash of
    the whole row, so no window holds a whole group.
    """
    size, n, copies, c, salt, own, before, out = free_names(docs, "size", "n", "copies", "c", "salt", "own", "before", "out")
    entry = take_sized(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), seed)
    right = entry.where("copies > 0").select(F.col("doc_id").alias("doc_id_"), F.col("source").alias("source_"), F.col("size").alias("size_"), F.col("n").alias(n), F.col("copies").alias(copies))
    plain = [F.col(f"`{x}`") for x in docs.columns]

    def met(left: str, right: str) -> Column:
        return F.col(f"l.{left}").eqNullSafe(F.col(f"r.{right}"))

    on = met("doc_id", "doc_id_") & met("source", "source_") & (F.col(f"l.`{size}`") == F.col("r.size_"))
    sized = docs.withColumn(size, word_count(F.col("text")))
    joined = sized.alias("l").join(right.alias("r"), on).select("l.*", f"r.`{n}`", f"r.`{copies}`")

    def repeat(rows: DataFrame, times: Column) -> DataFrame:
        counted = rows.select(*plain, times.cast("int").alias(out)).where(F.col(out) > 0)
        return counted.select(*plain, F.explode(F.sequence(F.lit(1), F.col(out))).alias(out)).drop(out)

    many = joined.where(F.col(n) > 1).groupBy(*plain, size, n, copies).agg(F.count(F.lit(1)).alias(c))
    many = staged(many.withColumn(salt, F.pmod(F.xxhash64(*plain), F.lit(256))), "repeated")
    key = ["doc_id", "source", size]
    within = Window.partitionBy(*key, salt).orderBy(F.xxhash64(*plain), *plain)
    many = many.withColumn(own, F.sum(c).over(within) - F.col(c))
    heads = many.groupBy(*key, salt).agg(F.sum(c).alias(c))
    heads = heads.withColumn(before, F.sum(c).over(Window.partitionBy(*key).orderBy(salt)) - F.col(c))
    same = met("doc_id", "doc_id") & met("source", "source") & (F.col(f"l.`{size}`") == F.col(f"r.`{size}`")) & (F.col(f"l.`{salt}`") == F.col(f"r.`{salt}`"))
    placed = many.alias("l").join(heads.alias("r"), same).select("l.*", f"r.`{before}`")
    extra = F.greatest(F.lit(0), F.least(F.col(c), F.col(copies) % F.col(n) - F.col(own) - F.col(before)))
    return repeat(joined.where(F.col(n) == 1), F.col(copies)).unionAll(repeat(placed, F.col(c) * F.floor(F.col(copies) / F.col(n)) + extra))


def query(spark, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import documents

    mixed = take(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")
