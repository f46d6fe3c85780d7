"""Sets that share at least so many items: small sets meet by their subsets of that size, large ones by their items.

Two sets that share so many items hold a subset of that size in common, and few others do, so hardly any pair is made in vain: what is
shuffled follows the sets and the pairs that count, not all pairs with one item in common. Sets with more than MOST subsets meet through
each of their items instead. Items and subsets that many sets hold are dealt to several tasks.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.storage import fresh_folder

#: Subsets of a set at most, sets of one item or subset that meet in one task.
MOST, DEAL = 128, 512


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _subsets(items: str, size: int) -> Column:
    """All subsets of so many items of an array in order, as structs."""

    def grown(chosen: list[Column], after: Column, left: int) -> Column:
        rest = F.slice(items, after + 1, F.greatest(F.size(items) - after, F.lit(0)))
        if left == 1:
            return F.transform(rest, lambda x: F.struct(*[c.alias(f"i{k}") for k, c in enumerate([*chosen, x])]))
        return F.flatten(F.transform(rest, lambda x, k: grown([*chosen, x], after + k + 1, left - 1)))

    return grown([], F.lit(0), size)


def meets(left: DataFrame, right: DataFrame, on: list[str], wanted: Column) -> DataFrame:
    """a of left and b of right with equal values of on, and these; n, in both, is the number of rows of right with these values."""
    deals = F.ceil(F.col("n") / DEAL).cast("int")
    left = left.withColumn("deal", F.pmod(F.xxhash64("a"), deals).cast("int"))
    right = right.withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("n")
    return left.drop("n").join(right, [*on, "deal"]).where(wanted).drop("deal")


def shared(sets: DataFrame, least: int, asked: Column | None = None) -> DataFrame:
    """a, b, item: the items that two sets of sets (key, item) share, of all pairs that share so many.

    Pairs are a < b; with asked, a condition on key, they are those whose a is asked for, with b on either side of it. Null keys and
    items are left out, repeated rows count once. Sets are gathered only where they are small.
    """
    asks = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    wanted = F.col("a") < F.col("b") if asked is None else F.col("a") != F.col("b")
    known = sets.where("key IS NOT NULL AND item IS NOT NULL").select("key", "item").distinct()
    sized = _kept(known.withColumn("asks", asks).selectExpr("key", "item", "asks", "count(*) OVER (PARTITION BY key) AS size").where(F.col("size") >= least), "sets")
    top = max(n for n in range(least, least + MOST + 1) if comb(n, least) <= MOST)
    names = [f"i{k}" for k in range(least)]
    cut = sized.where(F.col("size") <= top).groupBy("key", "asks").agg(F.sort_array(F.collect_list("item")).alias("items")).select("key", "asks", F.explode(_subsets("items", least)).alias("s")).select("key", "asks", "s.*")
    same = ", ".join(names)
    often = _kept(cut.selectExpr("*", f"count(*) OVER (PARTITION BY {same}) AS n", f"bool_or(asks) OVER (PARTITION BY {same}) AS any_").where("n > 1 AND any_").drop("any_"), "subsets")
    few = meets(often.where("asks").drop("asks").withColumnRenamed("key", "a"), often.drop("asks").withColumnRenamed("key", "b"), names, wanted)
    few = few.select("a", "b", F.explode(F.array(*names)).alias("item")).distinct()
    if not sized.where(F.col("size") > top).limit(1).count():
        return few
    rows = sized.selectExpr("key", "item", "asks", f"size > {top} AS large", "count(*) OVER (PARTITION BY item) AS n", f"bool_or(size > {top}) OVER (PARTITION BY item) AS any_").where("any_").drop("any_")
    left, right = rows.where("asks").selectExpr("key AS a", "item", "large AS large_a", "n"), rows.selectExpr("key AS b", "item", "large AS large_b", "n")
    # without asked a pair is looked for from its lesser key, whichever of both is large
    many = meets(left, right, ["item"], wanted & (F.col("large_a") | F.col("large_b"))).select("a", "b", "item")
    return few.unionByName(many.selectExpr("*", "count(*) OVER (PARTITION BY a, b) AS n").where(F.col("n") >= least).drop("n"))


def counted(sets: DataFrame, least: int, asked: Column | None = None) -> DataFrame:
    """a, b, shared: the number of items that two sets share, of the pairs of shared."""
    return shared(sets, least, asked).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def listed(sets: DataFrame, most: int) -> DataFrame:
    """a, b, item: the first so many items that two sets share, a < b, of all pairs that share one.

    Pairs with several items are found first and numbered; all others have one row, which comes straight from its item.
    """
    known = _kept(sets.where("key IS NOT NULL AND item IS NOT NULL").select("key", "item").distinct(), "known")
    several = _kept(shared(known, 2), "several")
    first = several.selectExpr("*", "row_number() OVER (PARTITION BY a, b ORDER BY item) AS rn").where(F.col("rn") <= most).drop("rn")
    partners = several.groupBy("a").agg(F.collect_set("b").alias("partners"))
    rows = _kept(known.selectExpr("key", "item", "count(*) OVER (PARTITION BY item) AS n").where("n > 1"), "rows")
    left = rows.withColumnRenamed("key", "a").join(partners, "a", "left")
    single = (F.col("a") < F.col("b")) & ~F.coalesce(F.array_contains("partners", F.col("b")), F.lit(False))
    return meets(left, rows.withColumnRenamed("key", "b"), ["item"], single).select("a", "b", "item").unionByName(first)
