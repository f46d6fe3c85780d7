"""Entity resolution beyond plain components: merges that respect verdicts, tiers with a name guard, hard negatives."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.components import components
from lodestone.plans import links
from lodestone.sources.storage import fresh_folder

#: The score from which a pair is merged, that from which it is asked about, the likeness of a hard negative.
AUTO, GREY, ALIKE = 0.92, 0.80, 0.75
#: Open links and forbidden pairs of a component that one task settles at most; those from which a component has a task of its own;
#: share of the links of a larger one that a round looks at, at most.
MOST, DEAL, BAND = 1 << 20, 1 << 16, 0.25


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sorted_pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias(a), F.greatest(a, b).alias(b)]


def _settled(table: pa.Table) -> pa.Table:
    """Takes links one by one, strongest first, in whole components: rows (x, y) say that group x is y now, rows (a, b, score) are refused.

    Every group holds the set of groups it must not join; of two that join, the smaller set moves.
    """
    link = table.column("link").to_numpy(zero_copy_only=False)
    names, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("x", "y")]), return_inverse=True)
    x, y = ends.reshape(2, -1)
    foes: dict[int, set[int]] = {}
    for i, j in zip(x[~link].tolist(), y[~link].tolist(), strict=True):
        foes.setdefault(i, set()).add(j)
        foes.setdefault(j, set()).add(i)
    root = list(range(len(names)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    held = np.flatnonzero(link)
    a, b, strength = (table.column(c).to_numpy()[held] for c in ("a", "b", "strength"))
    held, refused = held[np.lexsort((b, a, -strength, ~np.isnan(strength)))], []  # like Spark's order, NaN is strongest
    for k, i, j in zip(held.tolist(), x[held].tolist(), y[held].tolist(), strict=True):
        i, j = top(i), top(j)
        if i == j:
            continue
        if j in foes.get(i, ()):
            refused.append(k)
            continue
        if len(foes.get(i, ())) < len(foes.get(j, ())):
            i, j = j, i
        root[j] = i
        moved = foes.pop(j, None)
        if moved:
            for f in moved:
                foes[f].discard(j)
                foes[f].add(i)
            foes[i] |= moved
    tops = np.array([top(i) for i in range(len(names))], np.int64)
    least = np.full(len(names), len(names))
    np.minimum.at(least, tops, np.arange(len(names)))
    no = table.take(pa.array(refused, pa.int64())).select(["a", "b", "score"])
    groups = pa.table({"x": names, "y": names[least[tops]]})
    return pa.concat_tables([groups, no], promote_options="default").select(["x", "y", "a", "b", "score"])


def constrained(pairs: DataFrame, forbidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of pairs (a, b, score) that never join a forbidden pair (a, b): rows (node, component), and refused pairs.

    The result is that of taking pairs one by one, strongest first, equal scores by their ends, and refusing each that would bring a
    forbidden pair together. Components without a forbidden pair inside are right as they are. One with at most MOST open links and
    forbidden pairs is settled by a task, which takes its links in order; small ones share tasks. Larger ones go through rounds until no more
    than MOST are left: a pair of groups that hold a forbidden pair can never join, so its links are refused at once. Then come the strongest
    links, the share BAND or about half of MOST: they fall into components of their own, which nothing weaker can change, and tasks settle them. If
    one of these has more than MOST, as when very many scores are equal, a round is in the manner of Boruvka. A link that is the strongest of both its groups comes before all
    else that could change them, and is taken. A group that no forbidden pair names can wait for nothing: it joins along its strongest link
    whatever the other side has become. Each round settles the strongest open link at least; forbidden pairs of a group without open links
    are dropped, since it stays as it is. Null ends link nothing; repeated pairs count once with
    their best score; a score of null comes last.
    """
    own = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*_sorted_pair("a", "b"), "score")
    own = _kept(own.groupBy("a", "b").agg(F.max("score").alias("score")), "pairs")
    plain = _kept(components(own, "a", "b"), "plain")
    apart = forbidden.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*_sorted_pair("a", "b")).distinct()
    foes = _kept(apart.join(plain.toDF("a", "component"), "a").join(plain.toDF("b", "other"), "b").where("component = other").select("component", F.col("a").alias("x"), F.col("b").alias("y")), "foes")
    torn = foes.select("component").distinct()
    links_ = own.join(plain.toDF("a", "component"), "a").join(torn, "component", "left_semi")
    open_ = _kept(links_.select("component", F.col("a").alias("x"), F.col("b").alias("y"), "a", "b", "score"), "open")
    state = plain.join(torn, "component", "left_semi").select("node", F.col("node").alias("g"))
    refused = None
    strength = F.coalesce("score", F.lit(float("-inf")))
    order = F.struct(strength.alias("s"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))

    def renamed(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
        return df.join(to.toDF(column, "to_"), column, "left").withColumn(column, F.coalesce("to_", column)).drop("to_")

    def settled(links_: DataFrame, foes: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
        """Rows of each component, what tasks have settled of those with at most MOST, the most rows of one."""
        both = links_.select("*", strength.alias("strength"), F.lit(True).alias("link")).unionByName(foes.select("*", F.lit(False).alias("link")), allowMissingColumns=True)
        sizes = _kept(both.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
        few, most = sizes.agg(F.sum(F.when(F.col("n") <= MOST, F.col("n"))), F.max("n")).first()
        if not few:
            return sizes, None, most or 0
        alone = F.when(F.col("n") > DEAL, F.col("component"))
        deal = F.when(F.col("n") <= DEAL, F.pmod(F.xxhash64("component"), F.lit(1 + few // DEAL)))
        rows = both.join(sizes.where(F.col("n") <= MOST), "component").withColumns({"alone": alone, "deal": deal, "a": F.coalesce("a", F.lit(0)), "b": F.coalesce("b", F.lit(0))})
        return sizes, _kept(rows.groupBy("alone", "deal").applyInArrow(_settled, "x long, y long, a long, b long, score double"), "settled"), most

    def refuse(banned: DataFrame) -> None:
        nonlocal refused
        refused = banned if refused is None else refused.unionByName(banned)

    while True:
        sizes, done, most = settled(open_, foes)
        if done is not None:
            state = renamed(state, "g", done.where("x IS NOT NULL").select("x", "y"))
            refuse(done.where("x IS NULL").select("a", "b", "score"))
        if most <= MOST:
            break
        large = sizes.where(F.col("n") > MOST).select("component")
        open_, foes = open_.join(large, "component", "left_semi"), foes.join(large, "component", "left_semi")
        held = foes.select("x", "y")
        refuse(_kept(open_.join(held, ["x", "y"], "left_semi").select("a", "b", "score"), "refused"))
        free = _kept(open_.join(held, ["x", "y"], "left_anti"), "free")
        floor = free.groupBy("component").agg(F.percentile_approx(strength, 1 - min(BAND, MOST / (2 * most))).alias("floor"))
        band = free.join(floor, "component").where(strength >= F.col("floor")).drop("floor")
        part = _kept(components(band, "x", "y").withColumnRenamed("component", "part"), "parts")
        inside = foes.join(part.toDF("x", "part"), "x").join(part.toDF("y", "other"), "y").where("part = other").select(F.col("part").alias("component"), "x", "y")
        _, done, widest = settled(band.join(part.toDF("x", "part"), "x").drop("component").withColumnRenamed("part", "component"), inside)
        if done is not None and widest <= MOST:
            to = done.where("x IS NOT NULL").select("x", "y")
            refuse(done.where("x IS NULL").select("a", "b", "score"))
            free = free.join(band.select("a", "b"), ["a", "b"], "left_anti")
        else:
            named = held.select(F.explode(F.array("x", "y")).alias("g")).distinct().withColumn("named", F.lit(True))
            best = free.select(F.explode(F.array("x", "y")).alias("g"), "x", "y", order.alias("o")).groupBy("g").agg(F.max(F.struct("o", "x", "y")).alias("top"))
            votes = best.join(named, "g", "left").groupBy(F.col("top.x").alias("x"), F.col("top.y").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("named").isNull(), 1)).alias("unnamed"))
            to = _kept(components(votes.where("n = 2 OR unnamed > 0").select("x", "y"), "x", "y"), "joined")
        state = _kept(renamed(state, "g", to), "groups")
        open_ = _kept(renamed(renamed(free, "x", to), "y", to).where("x <> y").select("component", *_sorted_pair("x", "y"), "a", "b", "score"), "open")
        ends = open_.select(F.explode(F.array("x", "y")).alias("g")).distinct()
        moved = renamed(renamed(foes, "x", to), "y", to).select("component", *_sorted_pair("x", "y")).distinct()
        foes = _kept(moved.join(ends.toDF("x"), "x", "left_semi").join(ends.toDF("y"), "y", "left_semi").select("component", "x", "y"), "foes")
    kept = plain.join(torn, "component", "left_anti").select("node", "component").unionByName(state.select("node", F.col("g").alias("component")))
    return kept, own.limit(0) if refused is None else refused


def _forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts 'different': pairs of one label whose ids follow each other by at most 7."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    ahead = v.select("label", F.col("vec_id").alias("a"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 7)).alias("b"))
    return ahead.join(v.toDF("b", "label"), ["label", "b"]).select("a", "b")


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = links.links(spark, sf_dir).where("score >= 0.6").selectExpr("a_id AS a", "b_id AS b", "score")
    return constrained(pairs, _forbidden(spark, sf_dir))


def hard_negatives(names: DataFrame, ratio: float = ALIKE) -> DataFrame:
    """Pairs of different owners in names (owner, name) that share a token and read alike: owner a < b, ratio.

    Blocks are tokens and every pair is compared once, so the work is that of names that share a token; meant for names,
    whose tokens are rare, not for texts. Null names and owners have no tokens; repeated rows count once.
    """
    rows = names.where("owner IS NOT NULL AND name IS NOT NULL").distinct()
    parts = rows.withColumn("token", F.explode(F.array_distinct(F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda x: F.length(x) > 1))))
    left, right = (parts.select(F.col("token"), F.col("owner").alias(o), F.col("name").alias(n)) for o, n in (("a", "name_a"), ("b", "name_b")))
    pairs = left.join(right, "token").where("a < b").select("a", "b", "name_a", "name_b").distinct()

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p.lower(), q.lower()).ratio() for p, q in zip(x, y, strict=True)])

    return pairs.withColumn("ratio", F.round(alike("name_a", "name_b"), 6)).where(F.col("ratio") >= ratio).select("a", "b", "ratio")


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest pairs as auto, grey or dropped: auto wants a strong score and the guard that ids have one parity; the best score of a pair counts."""
    pairs = links.links(spark, sf_dir).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))
    band = F.when((F.col("score") >= 0.7) & (F.col("a") % 2 == F.col("b") % 2), "auto").when(F.col("score") >= 0.6, "grey").otherwise("dropped")
    return pairs.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("pairs"), F.max("score").alias("most"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark and their first words as names."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("owner"), F.substring_index("text", " ", 8).alias("name"))


QUERIES = {
    "grf06_constrained": lambda spark, sf_dir: _found(spark, sf_dir)[0],
    "grf10_refused": lambda spark, sf_dir: _found(spark, sf_dir)[1],
    "grf04_split": tiers,
    "joi25_hard_negatives": lambda spark, sf_dir: hard_negatives(_names(spark, sf_dir), 0.3),
}
ORACLES = {
    "grf04_split": f"""
WITH k AS (SELECT least(a_id, b_id) AS a, greatest(a_id, b_id) AS b, max(score) AS score FROM ({links.ORACLES["joi21_links"]}) l GROUP BY 1, 2)
SELECT CASE WHEN score >= 0.7 AND a % 2 = b % 2 THEN 'auto' WHEN score >= 0.6 THEN 'grey' ELSE 'dropped' END AS band, count(*) AS pairs, max(score) AS most FROM k GROUP BY 1"""
}
