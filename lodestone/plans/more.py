"""Records through files, canonical rows, person rules, path shapes, gold recipes and replays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunks
from lodestone.operators.components import components
from lodestone.plans import links
from lodestone.plans.census import _nearest
from lodestone.plans.sql import query, register
from lodestone.sources import records
from lodestone.sources.storage import fresh_folder

#: Rows of a batch, likeness of an example that may answer, salt of blind labels.
BATCH, EXAMPLE, SALT = 1000, 0.4, "blind"
#: Pairs that one task makes, rows that one task joins.
TASK_PAIRS, TASK_ROWS = 1 << 22, 1 << 20
_PEOPLE = """
SELECT concat('c', CAST(c_custkey AS STRING)) AS id, 'c' AS source, c_custkey AS k, lower(c_name) AS name, concat(c_mktsegment, '@', CAST(c_nationkey AS STRING), '.', CAST(CAST(floor(c_acctbal / 50) AS BIGINT) AS STRING)) AS email FROM {customer}
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), 's', s_suppkey, lower(s_name), concat('S@', CAST(s_nationkey AS STRING), '.', CAST(CAST(floor(s_acctbal / 50) AS BIGINT) AS STRING)) FROM {supplier}"""
_ACTIVE = "SELECT DISTINCT concat('c', CAST(o_custkey AS STRING)) AS id, l_partkey AS item FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey UNION SELECT DISTINCT concat('s', CAST(l_suppkey AS STRING)), l_partkey FROM {lineitem}"
#: The person rules in the order of their strength: name, and the join that finds its pairs in p (people), a (activity).
_RULES = (
    ("email", "SELECT x.id AS a, y.id AS b FROM p x JOIN p y ON x.email = y.email AND x.id < y.id"),
    ("same name", "SELECT x.id, y.id FROM p x JOIN p y ON regexp_extract(x.name, '([0-9]+)', 1) = regexp_extract(y.name, '([0-9]+)', 1) AND x.source = 'c' AND y.source = 's'"),
    ("display and activity", "SELECT x.id, y.id FROM p x JOIN p y ON x.k = y.k AND x.source = 'c' AND y.source = 's' JOIN act m ON m.id = x.id JOIN act n ON n.id = y.id AND n.item = m.item"),
    ("alias", "SELECT x.id, y.id FROM p x JOIN p y ON y.k = x.k + 1 AND x.source = 's' AND y.source = 's' AND x.email = y.email"),
    ("user key", "SELECT x.id, y.id FROM p x JOIN p y ON x.k = y.k * 10 AND x.source = 'c' AND y.source = 's'"),
    ("stem", "SELECT x.id, y.id FROM p x JOIN p y ON substr(x.name, length(x.name) - 2, 3) = substr(y.name, length(y.name) - 2, 3) AND x.source = 'c' AND y.source = 's' AND x.k % 7 = 0"),
)
#: The same rules for people x and y that meet by a key: name, key of x, key of y, who x is, who y is, what else must hold.
_MEETS = (
    ("email", "email", "email", "true", "true", "x.id < y.id"),
    ("same name", "digits", "digits", "source = 'c'", "source = 's'", "true"),
    ("display and activity", "k", "k", "source = 'c' AND acts", "source = 's'", "true"),
    ("alias", "k + 1", "k", "source = 's'", "source = 's'", "x.email = y.email"),
    ("user key", "k", "k * 10", "source = 'c'", "source = 's'", "true"),
    ("stem", "stem", "stem", "source = 'c' AND k % 7 = 0", "source = 's'", "true"),
)
_SIDE = re.compile(r"\b(email|digits|stem|k|source|acts)\b")
_SHAPES = (
    ("person-item", "SELECT o_custkey AS x, o_orderkey AS y FROM {orders}"),
    ("item-thing", "SELECT DISTINCT l_orderkey, l_partkey FROM {lineitem}"),
    ("thing-source", "SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem}"),
    ("person-place", "SELECT c_custkey, c_nationkey FROM {customer}"),
    ("source-place", "SELECT s_suppkey, s_nationkey FROM {supplier}"),
    ("person-item-thing", "SELECT DISTINCT o_custkey, l_partkey FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey"),
    ("person-item-source", "SELECT DISTINCT o_custkey, l_suppkey FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey"),
    ("returned", "SELECT DISTINCT l_orderkey, l_partkey FROM {lineitem} WHERE l_returnflag = 'R'"),
    ("open", "SELECT o_custkey, o_orderkey FROM {orders} WHERE o_orderstatus = 'O'"),
    ("document-label", "SELECT doc_id, quality FROM {labels}"),
    ("user-status", "SELECT DISTINCT user_id, event_type FROM {events}"),
    ("place-region", "SELECT n_nationkey, n_regionkey FROM {nation}"),
)
_RECIPES = (
    ("most ordered part", "SELECT CAST(l_partkey AS STRING) AS answer FROM {lineitem} GROUP BY l_partkey ORDER BY count(*) DESC, l_partkey LIMIT 1"),
    ("first order", "SELECT CAST(o_orderkey AS STRING) AS answer FROM {orders} ORDER BY o_orderdate, o_orderkey LIMIT 1"),
    ("urgent open orders", "SELECT CAST(count(*) AS STRING) AS answer FROM {orders} WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'"),
    ("customers without orders", "SELECT CAST(count(*) AS STRING) AS answer FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)"),
    ("widest source", "SELECT source AS answer FROM {documents} GROUP BY source ORDER BY count(*) DESC, source LIMIT 1"),
    ("largest nation", "SELECT n_name AS answer FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY count(*) DESC, n_name LIMIT 1"),
    ("returned share", "SELECT CAST(CAST(floor(100 * count(*) FILTER (WHERE l_returnflag = 'R') / CAST(count(*) AS DOUBLE)) AS BIGINT) AS STRING) AS answer FROM {lineitem}"),
    ("last event type", "SELECT event_type AS answer FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 1"),
)
_BOTH = {
    "src19_batches": f"SELECT batch, count(*) AS n, min(k) AS first_key FROM (SELECT o_orderkey AS k, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / CAST({BATCH} AS DOUBLE)) AS BIGINT) AS batch FROM {{orders}}) t GROUP BY batch",
    # a change for each commit and, for each pull request, one owned by its earliest commit
    "prj04_changes": """
WITH c AS (SELECT l_orderkey AS sha, l_partkey % 50 AS pr, min(l_shipdate) AS at_, count(*) AS files FROM {lineitem} GROUP BY l_orderkey, l_partkey % 50),
r AS (SELECT pr, sha, row_number() OVER (PARTITION BY pr ORDER BY at_, sha) AS rn, count(*) OVER (PARTITION BY pr) AS commits FROM c)
SELECT 'commit' AS kind, CAST(sha AS STRING) AS id, sum_files AS n FROM (SELECT sha, CAST(sum(files) AS BIGINT) AS sum_files FROM c GROUP BY sha) t UNION ALL SELECT 'pr', concat('pr:', CAST(pr AS STRING), '@', CAST(sha AS STRING)), commits FROM r WHERE rn = 1""",
    # a pair by its strongest rule
    "grf01_persons": f"""
WITH p AS ({_PEOPLE}), act AS ({_ACTIVE}),
u AS ({" UNION ALL ".join(f"SELECT a, b, {k} AS tier, '{name}' AS rule FROM ({text.replace('SELECT x.id, y.id', 'SELECT x.id AS a, y.id AS b')}) r{k}" for k, (name, text) in enumerate(_RULES, 1))})
SELECT a, b, rule FROM (SELECT a, b, rule, row_number() OVER (PARTITION BY a, b ORDER BY tier) AS rn FROM (SELECT DISTINCT a, b, tier, rule FROM u) d) t WHERE rn = 1""",
    "grf18_shapes": " UNION ALL ".join(f"SELECT '{name}' AS shape, count(*) AS pool FROM ({text}) s{k}" for k, (name, text) in enumerate(_SHAPES)),
    "grf19_gold": " UNION ALL ".join(f"SELECT '{name}' AS question, answer FROM ({text}) g{k}" for k, (name, text) in enumerate(_RECIPES)),
    "grf26_binder": """
SELECT bound, count(*) AS n FROM (SELECT CASE WHEN text LIKE '%2024-%' OR text LIKE '%2023-%' THEN 'date' WHEN lower(text) LIKE '% and %' AND lower(text) LIKE '%version%' THEN 'versions' WHEN lower(text) LIKE '%who%' THEN 'people' ELSE 'timeline' END AS bound FROM {conversations} WHERE role = 'user') t GROUP BY bound""",
    "grf30_blind": f"SELECT l.label, count(DISTINCT d.doc_id) AS leaks FROM (SELECT substr(md5(concat('{SALT}', source)), 1, 6) AS label, source FROM (SELECT DISTINCT source FROM {{documents}} WHERE source IS NOT NULL) s) l LEFT JOIN {{documents}} d ON d.source = l.source AND d.text LIKE concat('%', l.label, '%') GROUP BY l.label",
    # the first of those that ask the same in other words of case and space
    "sec35_bank": "SELECT min(conv_id * 1000 + turn) AS first_asked, count(*) AS asked FROM {conversations} WHERE role = 'user' AND text IS NOT NULL AND length(trim(text)) > 0 GROUP BY md5(lower(trim(text)))",
    # ranked neighbours of an item end to end: anchors first, then weight by path and kind
    "top11_local": """
WITH a AS (SELECT l_orderkey AS anchor, l_partkey AS thing FROM {lineitem} WHERE l_orderkey % 20 = 0),
n AS (SELECT a.anchor, b.l_orderkey AS k, count(*) AS paths FROM a JOIN {lineitem} b ON b.l_partkey = a.thing AND b.l_orderkey <> a.anchor GROUP BY a.anchor, b.l_orderkey),
s AS (SELECT n.anchor, n.k, paths * CAST(0.55 AS DOUBLE) * CASE WHEN x.o_orderpriority = y.o_orderpriority THEN 2 ELSE 1 END AS score FROM n JOIN {orders} x ON x.o_orderkey = n.anchor JOIN {orders} y ON y.o_orderkey = n.k)
SELECT anchor, k, round(score, 6) AS score, CAST(rn AS BIGINT) AS place FROM (SELECT anchor, k, score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, k) AS rn FROM (SELECT anchor, k, score FROM s UNION ALL SELECT DISTINCT anchor, anchor, CAST(1000 AS DOUBLE) FROM a) t) u WHERE rn <= 10""",
}
_COSINE = (
    "aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a.embedding, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)) * sqrt(aggregate(b.embedding, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)))",
    "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))",
)
_PAIRS = {
    "grf25_example": tuple(f"SELECT vec_id, score >= (1 + {EXAMPLE}) / 2 AS answers FROM ({_nearest(c, 'b.vec_id % 3 = 0').replace('LIMIT 20', 'LIMIT 3')}) n" for c in _COSINE),
    # a page's ancestors are the parts of its address, each once, in order, as keys
    "prj03_pages": (
        "SELECT page_id, array_join(array_distinct(filter(split(regexp_replace(url, '^[a-z]+://', ''), '/'), x -> length(x) > 0)), '>') AS ancestors, size(split(url, '/')) - 1 AS depth FROM {pages} WHERE url IS NOT NULL",
        "SELECT page_id, array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: length(x) > 0), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), '>') AS ancestors, len(string_split(url, '/')) - 1 AS depth FROM {pages} WHERE url IS NOT NULL",
    ),
}
QUERIES, ORACLES = register(_BOTH, _PAIRS)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON lines and back, under their types."""
    path = fresh_folder(spark, "lines")
    records.write_lines(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return records.read_lines(spark, path, "c_custkey long, c_name string, c_acctbal double")


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sink says it has written, twice over the same place."""
    path, rows = fresh_folder(spark, "sink"), _table(spark, sf_dir, "orders").select("o_orderkey")
    told = [(k, records.write_lines(rows, path)) for k in (1, 2)]
    held = spark.read.schema("o_orderkey long").json(path).count()
    return spark.createDataFrame([(*t, held) for t in told], "run long, rows long, held long")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the files that a manifest lists are read, whatever else lies in the folder."""
    path, orders = fresh_folder(spark, "listed"), _table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(3)).alias("page"))
    orders.write.partitionBy("page").json(path)
    return spark.read.schema("o_orderkey long").json([f"{path}/page={k}" for k in (0, 2)])


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by shard out and back, with the shard of each taken from its file's path."""
    path, docs = fresh_folder(spark, "shards"), _table(spark, sf_dir, "documents").select("doc_id", "lang", F.pmod("doc_id", F.lit(4)).alias("shard"))
    docs.write.partitionBy("shard").json(path)
    back = spark.read.schema("doc_id long, lang string").json(f"{path}/shard=*")
    shard = F.regexp_extract("_metadata.file_path", "shard=([0-9]+)", 1).cast("long")
    return back.select(shard.alias("shard"), "doc_id").groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_id"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace log with broken lines, read for those that are whole."""
    path, rows = fresh_folder(spark, "log"), _table(spark, sf_dir, "events").select("event_id", "event_type")
    whole = F.to_json(F.struct("event_id", "event_type"))
    rows.select(F.when(F.pmod("event_id", F.lit(10)) == 3, F.left(whole, F.lit(9))).otherwise(whole).alias("value")).write.text(path)
    return records.read_tolerant(spark, path, "event_id long, event_type string").groupBy("event_type").agg(F.count("event_id").alias("n"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.issues(records._raw_issues(spark, sf_dir))
    return rows.select("key", "title", "status", F.date_format("updated", "yyyy-MM-dd").alias("day"), F.size("changelog").cast("long").alias("changes"))


def _acting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k of each customer that has ordered a part which the supplier of the same key supplies."""
    orders, lines, suppliers = (_table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    tasks = 1 + lines.count() // TASK_ROWS
    asked = orders.join(suppliers, F.col("o_custkey") == F.col("s_suppkey"), "left_semi").select("o_custkey", "o_orderkey")
    bought = lines.select("l_orderkey", "l_partkey").repartition(tasks, "l_orderkey").join(asked.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("k"), F.col("l_partkey").alias("item"))
    supplied = lines.select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("item"))
    return bought.repartition(tasks, "k", "item").join(supplied.repartition(tasks, "k", "item"), ["k", "item"], "left_semi").select("k").distinct()


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of people by its strongest rule: each rule leaves out what a stronger one finds, so pairs are written where they are made.

    Only pairs of an id that has several records, or none, are brought together, to the strongest rule of any of their records.
    As many tasks as the pairs of a rule need.
    """
    people = query(_PEOPLE)(spark, sf_dir).distinct()
    people = people.selectExpr("*", "regexp_extract(name, '([0-9]+)', 1) AS digits", "substr(name, length(name) - 2, 3) AS stem")
    records = people.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("several"))
    people = people.join(records, people.id.eqNullSafe(records.id)).drop(records.id).withColumn("several", F.col("several") | F.col("id").isNull())
    people = people.join(_acting(spark, sf_dir).withColumn("acts", F.lit(True)), "k", "left")
    path = fresh_folder(spark, "people")
    people.write.parquet(path)
    people = spark.read.schema(people.schema).parquet(path)
    size, several = people.agg(F.count(F.lit(1)), F.max("several")).first()

    def tasks(key: str, left: str, right: str) -> int:
        both = people.groupBy(F.expr(key)).agg(F.count_if(F.expr(left)).alias("l"), F.count_if(F.expr(right)).alias("r"))
        return 1 + max((both.agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 0) // TASK_PAIRS, size // TASK_ROWS)

    found = []
    for tier, (name, left, right, here, there, also) in enumerate(_MEETS):
        many = tasks(left, here, there) if left == right else 1 + size // TASK_ROWS
        x = people.where(here).withColumn("key", F.expr(left)).repartition(many, "key").alias("x")
        y = people.where(there).withColumn("key", F.expr(right)).repartition(many, "key").alias("y")
        pairs = x.join(y, F.expr(f"x.key = y.key AND {also}"))
        for _, stronger, other, at, to, too in _MEETS[:tier]:
            sides = (_SIDE.sub(rf"{side}.\1", text) for side, text in (("x", stronger), ("y", other), ("x", at), ("y", to)))
            one, two, at, to = sides
            pairs = pairs.where(f"NOT coalesce({one} = {two} AND {at} AND {to} AND {too}, false)")
        found.append(pairs.selectExpr("x.id AS a", "y.id AS b", f"{tier} AS tier", f"'{name}' AS rule", "x.several OR y.several AS several"))
    out = found[0]
    for pairs in found[1:]:
        out = out.unionByName(pairs)
    if not several:
        return out.select("a", "b", "rule")
    least = out.where("several").groupBy("a", "b").agg(F.min_by("rule", "tier").alias("rule"))
    return out.where("NOT several").select("a", "b", "rule").unionByName(least)


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups as they were after the first tier: only its links are applied."""
    first = links.links(spark, sf_dir).where("score >= 0.65 AND (a_id + b_id) % 2 = 0")
    return components(first, "a_id", "b_id")


QUERIES |= {"src01_lines": lines, "src02_written": written, "src10_listed": listed, "src23_shards": shards, "src24_log": log, "prj01_items": items, "sec12_replay": replay, "grf01_persons": persons}
ORACLES |= {
    "src01_lines": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "src02_written": "SELECT CAST(unnest([1, 2]) AS BIGINT) AS run, (SELECT count(*) FROM orders) AS rows, (SELECT count(*) FROM orders) AS held",
    "src10_listed": "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 1",
    "src23_shards": "SELECT doc_id % 4 AS shard, count(*) AS n, max(doc_id) AS last_id FROM documents GROUP BY 1",
    "src24_log": "SELECT event_type, count(*) AS n FROM events WHERE event_id % 10 <> 3 GROUP BY 1",
    "prj01_items": "SELECT 'ITEM-' || o_orderkey AS key, 'Order ' || o_orderkey AS title, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) FILTER (WHERE l_linenumber > 1) AS changes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderdate",
    "sec12_replay": f"""
WITH RECURSIVE l AS (SELECT a_id, b_id FROM ({links.ORACLES["joi21_links"]}) k WHERE score >= 0.65 AND (a_id + b_id) % 2 = 0), e AS (SELECT a_id AS u, b_id AS v FROM l UNION SELECT b_id, a_id FROM l),
r AS (SELECT u AS node, u AS seen FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node""",
}
