"""Which tool a question wants, by ordered rules over its text, as a column function: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Signals in order, each with its strategy, confidence and named patterns, of which the first that fits counts.
SIGNALS = (
    (
        "temporal",
        "s6",
        0.9,
        (
            ("iso-date", r"\b\d{4}-\d{2}-\d{2}\b"),
            ("over-time", r"\bover time\b|\bthrough time\b|\bhistory of\b|\btimeline\b"),
            ("as-of", r"\bas of\b|\bat the time\b|\bwas the status\b|\bstatus (?:of|on)\b.*\bon\b"),
            ("changed-in", r"\bwhat changed\b|\bwhat has changed\b"),
            ("between-versions", r"\bbetween\b[^?]*\b\d+\.\d+(?:\.\d+)?\b[^?]*\band\b"),
            ("he-over-time", "לאורך זמן|לאורך הזמן|היסטוריה|ציר זמן"),
            ("he-date", r"בתאריך|נכון ל־?\d|מה היה הסטטוס"),
            ("he-changed", "מה השתנה|אילו שינויים"),
            ("he-between", r"בין [^?]*\d+\.\d+[^?]*ל"),
        ),
    ),
    (
        "aggregation",
        "s4",
        0.8,
        (
            ("how-many", r"\bhow many\b|\bhow much\b|\bnumber of\b"),
            ("count", r"\bcount\b|\btotal\b"),
            ("superlative", r"\bmost\b|\bfewest\b|\bhighest\b|\blargest\b|\btop \d+\b|\bbiggest\b"),
            ("owns", r"\bwho owns\b|\bwho maintains\b"),
            ("which-have", r"\bwhich \w+s? (?:have|has|contain|with)\b"),
            ("he-count", "כמה |מספר ה"),
            ("he-superlative", "הכי |ביותר"),
            ("he-owns", "מי אחראי|מי הבעלים|בבעלות מי"),
        ),
    ),
    (
        "thematic",
        "s5",
        0.8,
        (
            ("themes", r"\bthemes?\b|\btopics?\b|\bpatterns?\b|\btrends?\b"),
            ("overview", r"\boverview\b|\bsummar(?:y|ise|ize)\b|\bin general\b|\blandscape\b"),
            ("he-themes", "נושאים|מגמות|דפוסים"),
            ("he-overview", "סקירה|תמונה כללית|באופן כללי"),
        ),
    ),
)
#: What a question may name: keys of items and pages, hashes of changes.
KEY = r"\b[A-Z][A-Z0-9]+-[0-9]+\b|\b[0-9a-f]{8,40}\b"
_WORD = r"[^\p{L}\p{N}_]+"


def strategy(question: Column) -> Column:
    """strategy, rule, reason, confidence and keys of a question; null asks nothing and falls to the default rule.

    A date is more specific than a key beside it, so signals of time come first, then of counting and of themes; then
    keys, alone (one other word at most) or in a sentence; the rest is left to search.
    """
    text = F.coalesce(question, F.lit(""))
    keys = F.array_distinct(F.regexp_extract_all(text, F.lit(KEY), F.lit(0)))
    others = F.filter(F.split(F.regexp_replace(text, KEY, " "), _WORD), lambda w: F.length(w) > 0)

    def result(to: str, rule: str, reason: Column, confidence: float) -> Column:
        return F.struct(F.lit(to).alias("strategy"), F.lit(rule).alias("rule"), reason.alias("reason"), F.lit(confidence).alias("confidence"), keys.alias("keys"))

    rules = [(text.rlike(f"(?i){p}"), result(to, name, F.lit(f"{signal} signal ({name})"), sure)) for signal, to, sure, patterns in SIGNALS for name, p in patterns]
    named = F.concat(F.lit("names "), F.array_join(F.slice(keys, 1, 3), ", "))
    rules += [((F.size(keys) > 0) & (F.size(others) <= 1), result("lookup", "bare-key", named, 0.95)), (F.size(keys) > 0, result("s3", "keys", named, 0.7))]
    chosen = F.when(*rules[0])
    for rule in rules[1:]:
        chosen = chosen.when(*rule)
    return chosen.otherwise(result("s2", "default", F.lit("no signal"), 0.4))


#: An order as a question, put one way a priority.
_QUESTION = """CASE o_orderpriority WHEN '1-URGENT' THEN 'ORD-' || o_orderkey WHEN '2-HIGH' THEN 'Status of ORD-' || o_orderkey || ' on ' || substr(CAST(o_orderdate AS STRING), 1, 10)
  WHEN '3-MEDIUM' THEN 'How many lines has ORD-' || o_orderkey || '?' WHEN '4-NOT SPECIFIED' THEN 'Themes around ORD-' || o_orderkey ELSE 'Why is ORD-' || o_orderkey || ' late?' END"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, every benchmark item and every order put as a question, by the strategy it would go to."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    asked = read("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text").unionByName(read("benchmark").select(F.col("item_id").cast("string").alias("id"), "text"))
    asked = asked.unionByName(read("orders").select(F.concat(F.lit("order "), "o_orderkey").alias("id"), F.expr(_QUESTION).alias("text")))
    return asked.select("id", strategy(F.col("text")).alias("r")).select("id", "r.strategy", "r.rule", "r.reason", "r.confidence", F.size("r.keys").cast("long").alias("keys"))


def _oracle() -> str:
    """The rules as a table: the first rule that fits a text."""
    rules = [(to, name, f"{signal} signal ({name})", sure, p) for signal, to, sure, patterns in SIGNALS for name, p in patterns]
    values = ", ".join(f"({k}, '{to}', '{name}', '{reason}', {sure}, '(?i){p}')" for k, (to, name, reason, sure, p) in enumerate(rules))
    return f"""
WITH rules(k, strategy, rule, reason, confidence, pattern) AS (VALUES {values}),
q AS (SELECT conv_id || '/' || turn AS id, coalesce(text, '') AS text FROM conversations UNION ALL SELECT CAST(item_id AS VARCHAR), coalesce(text, '') FROM benchmark
      UNION ALL SELECT 'order ' || o_orderkey, {_QUESTION} FROM orders),
n AS (SELECT row_number() OVER () AS row, id, text, list_distinct(regexp_extract_all(text, '{KEY}')) AS found,
        len(list_filter(regexp_split_to_array(regexp_replace(text, '{KEY}', ' ', 'g'), '{_WORD}'), lambda w: length(w) > 0)) AS others FROM q),
hit AS (SELECT n.row, min(k) AS k FROM n JOIN rules ON regexp_matches(n.text, rules.pattern) GROUP BY n.row)
SELECT id, coalesce(r.strategy, CASE WHEN len(found) = 0 THEN 's2' WHEN others <= 1 THEN 'lookup' ELSE 's3' END) AS strategy,
       coalesce(r.rule, CASE WHEN len(found) = 0 THEN 'default' WHEN others <= 1 THEN 'bare-key' ELSE 'keys' END) AS rule,
       coalesce(r.reason, CASE WHEN len(found) = 0 THEN 'no signal' ELSE 'names ' || array_to_string(list_distinct(regexp_extract_all(text, '{KEY}'))[1:3], ', ') END) AS reason,
       CAST(coalesce(r.confidence, CASE WHEN len(found) = 0 THEN 0.4 WHEN others <= 1 THEN 0.95 ELSE 0.7 END) AS DOUBLE) AS confidence, CAST(len(found) AS BIGINT) AS keys
FROM n LEFT JOIN hit ON hit.row = n.row LEFT JOIN rules r ON r.k = hit.k"""


QUERIES = {"str08_strategy": routed}
ORACLES = {"str08_strategy": _oracle()}
