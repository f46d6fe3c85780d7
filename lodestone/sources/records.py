"""Records in and out: typed JSON lines, raw issues and commits into canonical rows, idempotent merges, deletes, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.sources.storage import fresh_folder

#: What separates records and fields of a commit log, and the fields that a record must have.
RECORD, FIELD, FIELDS = "\x1e", "\x1f", 7


def read_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped, a bad line ends the read with its path and text in the message."""
    kinds = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.length(F.trim("value")) > 0)
    parsed = raw.withColumn("row", F.from_json("value", kinds.add("_bad", "string") if "_bad" not in kinds.fieldNames() else kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad line in "), F.col("file"), F.lit(": "), F.left("value", F.lit(80)))).cast("string"))
    return parsed.where(checked.isNull()).select(*[F.col(f"row.`{f}`").alias(f) for f in kinds.fieldNames() if f != "_bad"])


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a log: broken ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_lines(rows: DataFrame, path: str) -> int:
    """Rows as JSON lines, in one commit that replaces what was there; returns the number of rows written."""
    count = F.count(F.lit(1)).alias("n")
    from pyspark.sql import Observation

    seen = Observation("written")
    rows.observe(seen, count).write.mode("overwrite").json(path)
    return seen.get["n"]


def commits(log: DataFrame) -> DataFrame:
    """Commits of log (value: whole log texts): sha, author, email, at, subject, body, files; records with fewer fields are skipped."""
    one = log.select(F.explode(F.split("value", RECORD)).alias("r")).where(F.length(F.trim("r")) > 0).select(F.split("r", FIELD).alias("f")).where(F.size("f") >= FIELDS)
    files = F.filter(F.transform(F.split(F.element_at("f", FIELDS), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    names = ("sha", "author", "email", "at", "subject", "body")
    return one.select(*[F.trim(F.col("f")[i]).alias(n) for i, n in enumerate(names)], files.alias("files"))


def squeezed(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, "\\s+", " ")), F.lit(""))


ISSUE = """key string, fields struct<summary: string, status: struct<name: string>, updated: string, components: array<struct<name: string>>,
issuelinks: array<struct<type: struct<name: string>, inwardIssue: struct<key: string>, outwardIssue: struct<key: string>>>>,
changelog struct<histories: array<struct<created: string, author: string, items: array<struct<field: string, `from`: string, fromString: string, `to`: string, toString: string>>>>>"""


def issues(raw: DataFrame) -> DataFrame:
    """Canonical items of raw issues: key, title, status, components, links in both directions, changelog; undated history is dropped."""
    link = lambda x, side, way: F.struct(F.lower(x["type"]["name"]).alias("type"), x[side]["key"].alias("target"), F.lit(way).alias("direction"))
    linked = F.coalesce(F.col("fields.issuelinks"), F.array().cast("array<struct<type:struct<name:string>,inwardIssue:struct<key:string>,outwardIssue:struct<key:string>>>"))
    both = F.concat(F.transform(linked, lambda x: link(x, "outwardIssue", "out")), F.transform(linked, lambda x: link(x, "inwardIssue", "in")))
    stamp = lambda h: F.try_to_timestamp(h["created"])
    item = lambda h: F.transform(h["items"], lambda i: F.struct(i["field"].alias("field"), F.coalesce(i["fromString"], i["from"]).alias("from"), F.coalesce(i["toString"], i["to"]).alias("to"), stamp(h).alias("at"), squeezed(h["author"]).alias("by")))
    dated = F.filter(F.col("changelog.histories"), lambda h: stamp(h).isNotNull())
    names = F.filter(F.transform("fields.components", lambda c: squeezed(c["name"])), lambda c: c.isNotNull())
    return raw.where("key IS NOT NULL").select(
        "key",
        squeezed(F.col("fields.summary")).alias("title"),
        squeezed(F.col("fields.status.name")).alias("status"),
        F.try_to_timestamp("fields.updated").alias("updated"),
        F.coalesce(names, F.array().cast("array<string>")).alias("components"),
        F.filter(both, lambda x: x["target"].isNotNull()).alias("links"),
        F.coalesce(F.flatten(F.transform(dated, item)), F.array().cast("array<struct<field:string,from:string,to:string,at:timestamp,by:string>>")).alias("changelog"),
    )


def latest(rows: DataFrame, key: str, recency: str, order: str) -> DataFrame:
    """One row per key: the most recent, of equals that of the first source in order; rows without a key are left out."""
    names = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*names), F.struct(F.col(recency).isNotNull().alias("dated"), recency, (-F.col(order)).alias("early")))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("best_of_key")).select(key, "best_of_key.*")


def merge_nodes(held: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """held with fresh merged by key: properties that fresh gives replace, missing ones stay; merging again changes nothing."""
    props = [c for c in held.columns if c != key]
    new = fresh.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(c) for c in props])
    both = held.alias("h").join(new.alias("n"), F.col(f"h.{key}") == F.col(f"n.{key}"), "full_outer")
    return both.select(F.coalesce(f"h.{key}", f"n.{key}").alias(key), *[F.coalesce(f"n.{c}", f"h.{c}").alias(c) for c in props])


def merge_edges(held: DataFrame, fresh: DataFrame, nodes: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """held (src, dst, ...) with the fresh edges whose both ends are nodes; one edge for each src, dst and identity."""
    known = nodes.select(F.col(key).alias("k")).distinct()
    sound = fresh.join(known, F.col("src") == F.col("k"), "left_semi").join(known, F.col("dst") == F.col("k"), "left_semi")
    return held.unionByName(sound.join(held.select("src", "dst", *identity), ["src", "dst", *identity], "left_anti").dropDuplicates(["src", "dst", *identity]))


def without(rows: DataFrame, where: Column) -> DataFrame:
    """rows without those of a layer or slice; a condition that is null deletes nothing."""
    return rows.where(~F.coalesce(where, F.lit(False)))


def digest(rows: DataFrame) -> DataFrame:
    """Number of rows and a digest that does not depend on their order."""
    one = F.conv(F.substring(F.sha1(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))), 1, 12), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sha1(F.coalesce(F.sum(one), F.lit(0)).cast("string")).alias("digest"))


def vectors(rows: DataFrame, column: str, width: int) -> DataFrame:
    """rows with the vector as floats; a vector of another width ends the job."""
    ok = F.col(column).isNull() | (F.size(column) == width)
    return rows.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.lit(f"a vector is not {width} wide")).cast("array<float>")).cast("array<float>"))


# queries: the given tables stand in for raw files; each goes out as JSON and comes back through the reader
def _raw_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    history = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("created"), "l_returnflag", "l_linestatus"))).alias("h"))
    made = orders.join(history, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("ITEM-"), "o_orderkey").alias("key"),
        F.struct(F.concat(F.lit(" Order  "), "o_orderkey").alias("summary"), F.struct(F.col("o_orderstatus").alias("name")).alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("updated")).alias("fields"),
        F.struct(F.transform("h", lambda x: F.struct(F.when(x["n"] > 1, x["created"]).alias("created"), F.lit("a  b").alias("author"), F.array(F.struct(F.lit("status").alias("field"), x["l_returnflag"].alias("fromString"), x["l_linestatus"].alias("toString"))).alias("items"))).alias("histories")).alias("changelog"),
    )
    path = fresh_folder(spark, "raw")
    made.write.json(path)
    return read_lines(spark, path, ISSUE)


def _changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = issues(_raw_issues(spark, sf_dir)).select("key", "title", "status", F.explode_outer("changelog").alias("c"))
    return rows.select("key", "title", "status", F.col("c.from").alias("old"), F.col("c.to").alias("new"), F.date_format("c.at", "yyyy-MM-dd").alias("day"), F.col("c.by").alias("author"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    files = F.array_join(F.sort_array(F.collect_set(F.concat(F.lit(" part/"), "l_partkey"))), "\n")
    one = lines.groupBy("l_orderkey").agg(files.alias("files"), F.min("l_shipdate").alias("at"))
    record = F.concat_ws(FIELD, F.sha1(F.col("l_orderkey").cast("string")), F.lit("a"), F.lit("a@b.c"), F.date_format("at", "yyyy-MM-dd"), F.concat(F.lit("change "), "l_orderkey"), F.lit(""), "files")
    path = fresh_folder(spark, "log")
    one.select(F.concat(F.lit(RECORD), record).alias("value")).write.option("lineSep", "\x00").text(path)
    found = commits(spark.read.option("lineSep", "\x00").text(path))
    return found.select("sha", "subject", "at", F.size("files").cast("long").alias("files"), F.element_at("files", 1).alias("first_file"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment", "c_acctbal")
    fresh = customers.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 1).alias("c_custkey"), F.lit(None).cast("string").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return merge_nodes(merge_nodes(customers, fresh, "c_custkey"), fresh, "c_custkey")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel"))
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size > 5").select("p_partkey")
    return merge_edges(lines.where("rel = 'A'").distinct(), lines, nodes, "p_partkey", ["rel"])


QUERIES = {
    "prj02_changelog": _changelog,
    "src06_commits": _log,
    "src17_nodes": _merged,
    "src18_edges": _edges,
    "src26_wiped": lambda spark, sf_dir: without(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "P"),
    "src20_vectors": lambda spark, sf_dir: vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", 64).select("vec_id", F.size("embedding").cast("long").alias("width")),
    "src12_first_of_equals": lambda spark, sf_dir: latest(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey", "o_orderkey", "CAST(o_orderdate AS DATE) AS day"), "o_custkey", "day", "o_orderkey").select("o_custkey", "o_orderkey"),
}
ORACLES = {
    "prj02_changelog": """
SELECT 'ITEM-' || o_orderkey AS key, 'Order ' || o_orderkey AS title, o_orderstatus AS status, l_returnflag AS old, l_linestatus AS new, strftime(l_shipdate, '%Y-%m-%d') AS day, CASE WHEN l_orderkey IS NOT NULL THEN 'a b' END AS author
FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber > 1) l ON l_orderkey = o_orderkey""",
    "src06_commits": "SELECT sha1(CAST(l_orderkey AS VARCHAR)) AS sha, 'change ' || l_orderkey AS subject, strftime(min(l_shipdate), '%Y-%m-%d') AS at, count(DISTINCT l_partkey) AS files, min('part/' || l_partkey) AS first_file FROM lineitem GROUP BY l_orderkey",
    "src17_nodes": "SELECT coalesce(c.c_custkey, n.k) AS c_custkey, c.c_mktsegment, coalesce(n.b, c.c_acctbal) AS c_acctbal FROM customer c FULL OUTER JOIN (SELECT c_custkey + 1 AS k, c_acctbal + 1 AS b FROM customer WHERE c_custkey % 3 = 0) n ON n.k = c.c_custkey",
    "src18_edges": """
SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_returnflag AS rel FROM lineitem
WHERE l_returnflag = 'A' OR (l_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 5) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5))""",
    "src26_wiped": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'",
    "src20_vectors": "SELECT vec_id, len(embedding) AS width FROM embeddings",
    "src12_first_of_equals": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS rn FROM orders) t WHERE rn = 1",
}
