from pyspark.sql import functions as F

from lodestone.functions.routing import strategy

ASKED = {
    "What was the status of ABC-12 on 2024-03-01?": ("s6", "iso-date"),
    "Show the HISTORY OF this page": ("s6", "over-time"),
    "what moved between 3.1 and 3.2": ("s6", "between-versions"),
    "How many items are open in ABC-12?": ("s4", "how-many"),
    "Who owns it": ("s4", "owns"),
    "Recurring themes": ("s5", "themes"),
    "mostly topical": ("s2", "default"),
    "ABC-12": ("lookup", "bare-key"),
    "lookup KIP-848": ("lookup", "bare-key"),
    "why does ABC-12 wait for 0a1b2c3d4e": ("s3", "keys"),
    "כמה פריטים": ("s4", "he-count"),
    "abc-12 is no key": ("s2", "default"),
    "": ("s2", "default"),
    None: ("s2", "default"),
}


def test_first_rule_counts(spark):
    rows = spark.createDataFrame([(q,) for q in ASKED], "q string").select("q", strategy(F.col("q")).alias("r")).collect()
    assert {r.q: (r.r.strategy, r.r.rule) for r in rows} == ASKED
    keys = next(r.r for r in rows if r.q and r.q.startswith("why"))
    assert keys["keys"] == ["ABC-12", "0a1b2c3d4e"] and keys.confidence == 0.7 and keys.reason == "names ABC-12, 0a1b2c3d4e"
