"""Water-fill: an amount poured unit by unit into the lowest bucket of its group that still has room."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: units poured into each group of the query.
AMOUNT = 40

_FILL = """
WITH b AS (SELECT DISTINCT grp, bucket, held, least(coalesce(room, amount), amount) AS room, amount FROM {buckets} WHERE held IS NOT NULL AND amount > 0 AND coalesce(room, 1) > 0),
p AS (SELECT grp, level, sum(change) AS change, max(amount) AS amount FROM (SELECT grp, amount, explode(array(struct(held AS level, 1 AS change), struct(held + room AS level, -1 AS change))) AS c FROM b) LATERAL VIEW inline(array(c)) t AS level, change GROUP BY grp, level),
s AS (SELECT *, sum(change) OVER (PARTITION BY grp ORDER BY level) AS open, (lead(level) OVER (PARTITION BY grp ORDER BY level)) - level AS height FROM p),
v AS (SELECT *, coalesce(sum(open * height) OVER (PARTITION BY grp ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
m AS (SELECT grp, max_by(level, level) AS level, max_by(open, level) AS open, max(amount) - max_by(below, level) AS rest FROM v WHERE below <= amount GROUP BY grp),
l AS (SELECT grp, level + CASE WHEN open > 0 THEN rest DIV open ELSE 0 END AS level, CASE WHEN open > 0 THEN rest % open ELSE 0 END AS left_over FROM m),
q AS (SELECT b.*, l.level, l.left_over, held <= l.level AND l.level < held + room AS takes FROM b JOIN l ON b.grp <=> l.grp),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, takes ORDER BY bucket) AS place FROM q)
SELECT grp, bucket, held, least(greatest(level - held, 0), room) + CASE WHEN takes AND place <= left_over THEN 1 ELSE 0 END AS poured FROM r"""


def water_fill(buckets: DataFrame) -> DataFrame:
    """grp, bucket, held, poured of (grp, bucket, held, room, amount): whole units, ties to the first bucket by name.

    The level is found from running sums over the heights at which buckets open and fill up, so the work does not depend on the
    amount. A null room is without limit; what exceeds all room is not poured; buckets without room or contents that are
    unknown, and groups without an amount, have no row; repeated rows count once.
    """
    return buckets.sparkSession.sql(_FILL, buckets=buckets)


_BUCKETS = f"SELECT c_nationkey AS grp, c_mktsegment AS bucket, count(*) AS held, length(c_mktsegment) * 2 AS room, CAST({AMOUNT} AS BIGINT) AS amount FROM {{customer}} GROUP BY c_nationkey, c_mktsegment"


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to be won by nation, each for the market segment that is then the smallest."""
    buckets = spark.sql(_BUCKETS, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return water_fill(buckets.selectExpr("grp", "bucket", "held", "CAST(room AS BIGINT) AS room", "amount"))


QUERIES = {"top20_filled": filled}
#: One row a unit of room, and the lowest of them.
ORACLES = {
    "top20_filled": f"""
WITH b AS ({_BUCKETS.format(customer="customer")}), u AS (SELECT grp, bucket, held + k AS level FROM (SELECT grp, bucket, held, unnest(range(0, room)) AS k FROM b) t),
t AS (SELECT grp, bucket FROM u QUALIFY row_number() OVER (PARTITION BY grp ORDER BY level, bucket) <= {AMOUNT})
SELECT b.grp, b.bucket, b.held, count(t.bucket) AS poured FROM b LEFT JOIN t ON t.grp = b.grp AND t.bucket = b.bucket GROUP BY b.grp, b.bucket, b.held"""
}
