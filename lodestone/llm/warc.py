"""Content-addressed WARC archive: payload bytes stored once, exact record headers apart, records by joins.

write_archive makes two Parquet tables. `payloads` has one row per distinct payload, under its SHA-256 digest;
`headers` has the exact header bytes of every record and the digest of the payload that the record stands for.
read_archive joins them back; a payload counts only if its bytes hash to the digest that it is stored under.

Defined results: a null payload is empty; a null url gives an empty target; CR and LF in a url are
percent-encoded, since a header line cannot hold them; equal page_ids with equal payloads are both the
response if theirs is the largest; records carry one WARC-Date, a parameter, since pages have none; a null page_id is smaller than any other and named "none"; an empty table
gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.storage import fresh_folder

#: Payloads below this many bytes are always written in full records.
REVISIT_BYTES = 1000
DATE, CONTENT_TYPE = "2024-01-01T00:00:00Z", "text/html; charset=utf-8"
EOL = "\r\n"


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def header(page_id: Column, url: Column, sha1: Column, size: Column, kind: Column, refers_to: Column, date: str = DATE) -> Column:
    """Exact WARC/1.1 header bytes; a revisit has an empty block and names the record that holds the payload."""
    target = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1" + EOL),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", _name(page_id)),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", target),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(revisit, _field("WARC-Refers-To", _name(refers_to))).otherwise(""),
        F.when(revisit, _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.when(revisit, "").otherwise(_field("Content-Type", F.lit(CONTENT_TYPE))),
        _field("Content-Length", F.when(revisit, F.lit(0)).otherwise(size).cast("string")),
        F.lit(EOL),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write headers and payloads of pages (page_id, url, payload binary) under path.

    Payloads and the page that answers for each are aggregated by digest, with partial sums on the map side, so
    a payload that fills a third of the pages travels once per task.
    """
    rows = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    stored = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    stored.write.parquet(f"{path}/payloads")
    facts = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    answers = facts.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("answer"))
    joined = facts.join(answers, "digest", "left")
    kind = F.when((F.col("size") < revisit_bytes) | F.col("page_id").eqNullSafe(F.col("answer")), "response").otherwise("revisit")
    head = header(F.col("page_id"), F.col("url"), F.col("sha1"), F.col("size"), kind, F.col("answer"))
    joined.select(head.alias("header"), "digest").write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: header, payload (the full one, also for revisits) and block (what the record holds)."""
    stored = spark.read.parquet(f"{path}/payloads").where(F.unhex(F.sha2("payload", 256)) == F.col("digest"))
    heads = spark.read.parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    kind = F.regexp_extract(text, "(?m)^WARC-Type: (\\w+)", 1)
    joined = heads.join(stored, "digest", "left")
    return joined.select("header", "payload", F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload")).alias("block"), kind.alias("record_type"))


def record_bytes(header: Column, block: Column) -> Column:
    """The record as it stands in a WARC file."""
    return F.concat(header, block, F.lit((EOL + EOL).encode()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    path = fresh_folder(spark, "warc")
    write_archive(pages, path)
    rec = read_archive(spark, path)
    text = F.decode("header", "UTF-8")

    def page(name: str) -> Column:
        return F.nullif(F.regexp_extract(text, f"(?m)^{name}: <urn:page:(-?\\d*)", 1), F.lit("")).cast("long")

    return rec.select(
        page("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", page("WARC-Refers-To")).alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS answer FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY h)
SELECT p.page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN g.h IS NULL OR p.page_id IS NOT DISTINCT FROM g.answer THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.h IS NULL OR p.page_id IS NOT DISTINCT FROM g.answer THEN NULL ELSE g.answer END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h"""
