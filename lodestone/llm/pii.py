"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base spans come from four fixed patterns. Looser patterns propose further candidates (obfuscated addresses,
national phone formats, grouped digits that fail a checksum, IPv6), and base matches that fail their test are judged
too. Four labelers vote -1, 0 or 1 on every
candidate: a strict regex or checksum, a gazetteer, cue words before it, and signs against it. Expectation-
maximisation over the counts of vote patterns estimates each labeler's reliability and a posterior for each
pattern; a naive Bayes span classifier is then trained on those posteriors with the votes, the length and the
neighbouring character as features. Candidates it accepts are added; base spans always stay.

EM runs inside one SQL aggregate() per kind over at most 3**4 vote patterns, and the classifier's table has one
row per combination of categorical features, at most KINDS * 3**4 * 4 * 3 rows, whatever the corpus size.

Positions: split() and regexp_extract_all() find the same matches, so running sums of their lengths are the
code-point positions. Running sums and maxima go through blocks of blocks, spans are compared in one sorted sweep and
texts are cut through blocks of characters, so the work is in proportion to the matches of a text. Repetitions are possessive and starts are held to the edge of a run where that changes
no match, so that long runs of digits or letters stay linear and cannot exhaust the stack.

Defined results: null texts are empty and have no spans; equal texts have equal spans; spans of different kinds
may overlap; added spans never overlap a base span; an empty table gives no rows; other columns are kept by
redact(), under any name, and ignored by the query; n_chars, where there is one, follows the redacted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import documents, staged

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, in the order of KINDS.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
}
#: What a text must hold before a pattern is tried.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
LOOSE_NEEDS = {"email": "[\\[(](?:at|AT)[\\])]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9]{4}", "phone": "[0-9]{3}[-. ][0-9]{4}"}
#: Gazetteers: top-level domains, network prefixes of private use, issuer digits, calling or area codes.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])] ?)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "ip": r"^(?:10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|169\.254\.|100\.64\.|8\.8\.|1\.1\.1\.|[23][0-9A-Fa-f]{3}:|fe80:|fd)",
    "card": r"^(?:4|5[1-5]|3[47]|6(?:011|5)|2[2-7])",
    "phone": r"^(?:\+?(?:1|33|34|44|49)\b|\(?[2-9][0-9]{2}\)?[-. ])",
}
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|schreib|correo|adresse)[^A-Za-z]*$",
    "ip": r"(?i)(?:\bip|address|host|server|adresse|client|from)[^A-Za-z]*$",
    "card": r"(?i)(?:card|visa|credit|carte|karte|tarjeta|account|konto)[^A-Za-z]*$",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|handy|anruf|llam\w*|number|appel\w*)[^A-Za-z]*$",
}
AGAINST = r"(?i)(?:isbn|version|\bv|order|invoice|ref|serial|build|chapter|part|sku)[^A-Za-z]*$"
ROUNDS = 20
#: Elements of a block of running totals, and characters of a block of text.
BLOCK, CUT = 32, 1024
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.coalesce(F.when(i % 2 == 0, twice).otherwise(d), F.lit(0))

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The test that a base match must pass."""
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(f"^(?:{_OCTET}\\.){{3}}{_OCTET}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _found(text: str, name: str, pattern: str, needs: str) -> list[tuple[str, Column]]:
    wanted = F.col(text).contains("@") if needs == "@" else F.col(text).rlike(needs)
    none = F.array().cast("array<string>")
    return [
        (f"{name}_m", F.when(wanted, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none)),
        (f"{name}_s", F.when(wanted, F.split(F.col(text), pattern, -1)).otherwise(none)),
    ]


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join) -> Column:
    """Running totals of an array of non-negative ints before each element (0 first), in blocks of blocks of BLOCK."""

    def totals(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(v, k * BLOCK + 1, F.lit(BLOCK)), F.lit(0), join))

    def spread(v: Column, heads: Column) -> Column:
        return F.transform(v, lambda _, i: F.aggregate(F.slice(v, i - i % BLOCK + 1, i % BLOCK), heads[F.floor(i / BLOCK).cast("int")], join))

    def plain(v: Column) -> Column:
        return F.transform(v, lambda _, i: F.aggregate(F.slice(v, F.lit(1), i), F.lit(0), join))

    def over(v: Column) -> Column:
        of_blocks = lambda t: let(totals(t), lambda tt: let(plain(tt), lambda heads: spread(t, heads)))
        blocked = let(totals(v), lambda t: let(of_blocks(t), lambda heads: spread(v, heads)))
        return F.when(F.size(v) > BLOCK, blocked).when(F.size(v) > 0, plain(v)).otherwise(F.array().cast("array<int>"))

    return let(values, over)


def _placed(name: str) -> Column:
    """Structs of start, end, match, the text before and the character after, for one pattern's matches."""
    m, s = F.col(f"{name}_m"), F.col(f"{name}_s")

    def place(at: Column) -> Column:
        def one(match: Column, i: Column) -> Column:
            start = at[i] + F.char_length(s[i])
            return F.struct(start.alias("start"), (start + F.char_length(match)).alias("end"), match.alias("match"), F.right(s[i], F.lit(24)).alias("before"), F.left(s[i + 1], F.lit(1)).alias("after"))

        return F.transform(m, one)

    steps = F.transform(m, lambda match, i: F.char_length(s[i]) + F.char_length(match))
    empty = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")
    return F.when(F.size(m) > 0, let(running(steps, lambda x, y: x + y), place)).otherwise(empty)


def apart(found: Column, others: Column) -> Column:
    """Those spans of found that overlap none of others: one sweep over starts of others and ends of found."""
    none = F.get(found, F.lit(-1))  # null, of the type of a span
    marks = F.concat(
        F.transform(others, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("side"), b["end"].alias("reach"), none.alias("c"))),
        F.transform(found, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("side"), F.lit(0).alias("reach"), c.alias("c"))),
    )

    def swept(e: Column) -> Column:
        reach = running(F.transform(e, lambda x: x["reach"]), lambda x, y: F.greatest(x, y))
        free = let(reach, lambda r: F.filter(e, lambda x, i: (x["side"] == 0) & (r[i] <= x["c"]["start"])))
        return F.transform(free, lambda x: x["c"])

    return F.when((F.size(found) > 0) & (F.size(others) > 0), let(F.array_sort(marks), swept)).otherwise(found)


def _judged(kind: str, spot: Column, base: bool, failed: bool = False) -> Column:
    """A candidate: place, kind, votes and features as small integers."""
    match, before = spot["match"], spot["before"]
    if base or failed:
        strict = F.lit(1 if base else -1)
    elif kind == "card":
        strict = F.when(luhn(_digits(match)), 1).otherwise(-1)
    elif kind == "phone":
        strict = F.when(match.rlike(r"^\(?[2-9][0-9]{2}\)?[-. ]{0,2}[2-9]"), 1).otherwise(-1)
    else:
        strict = F.lit(0)
    gazette = F.when(match.rlike(GAZETTEER[kind]), 1).otherwise(-1 if kind in ("card", "phone") else 0)
    context = F.when(before.rlike(CUES[kind]), 1).otherwise(0)
    against = F.when(before.rlike(AGAINST), -1).when(before.rlike("[A-Za-z0-9_]$") | spot["after"].rlike("[A-Za-z0-9_]"), -1).otherwise(0)
    size = F.least(F.floor(F.char_length(match) / 8), F.lit(3)).cast("int")
    edge = F.when(spot["after"].isin("", " ", "\n"), 0).when(spot["after"].rlike("[.,;:)!?]"), 1).otherwise(2)
    return F.struct(
        spot["start"].alias("start"),
        F.lit(KINDS.index(kind)).alias("kind"),
        spot["end"].alias("end"),
        F.lit(base).alias("base"),
        strict.alias("v0"),
        gazette.alias("v1"),
        context.alias("v2"),
        against.alias("v3"),
        size.alias("f0"),
        edge.alias("f1"),
    )


_CODE = ("kind", "v0", "v1", "v2", "v3", "f0", "f1")


def candidates(docs: DataFrame) -> DataFrame:
    """The columns of docs but text as a struct named row, text, and cands: base and proposed spans with votes and features, by start."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), "text")
    rows = rows.withColumn("whole", F.coalesce(F.col("text"), F.lit("")))
    for k in KINDS:
        rows = rows.withColumns(dict(_found("whole", f"b_{k}", BASE[k], NEEDS[k]) + _found("whole", f"l_{k}", LOOSE[k], LOOSE_NEEDS[k])))
    rows = rows.withColumns({f"{p}_{k}": _placed(f"{p}_{k}") for p in "bl" for k in KINDS})

    def judged(k: str, spots: Column, base: bool, failed: bool = False) -> Column:
        return F.transform(spots, lambda x: _judged(k, x, base, failed))

    def tested(k: str, passed: bool) -> Column:
        return F.filter(F.col(f"b_{k}"), lambda x: valid(k, x["match"]) == F.lit(passed))

    kept = [judged(k, tested(k, True), True) for k in KINDS]
    more = [judged(k, F.col(f"l_{k}"), False) for k in KINDS]
    poor = [judged(k, tested(k, False), False, True) for k in ("ip", "phone")]
    rows = rows.withColumns({"base": F.concat(*kept), "more": F.concat(*more), "poor": F.concat(*poor)})
    rows = rows.withColumn("more", apart(F.col("more"), F.col("base")))
    rows = rows.withColumn("firm", F.concat("base", "more"))
    rows = rows.withColumn("cands", F.array_sort(F.concat("firm", apart(F.col("poor"), F.col("firm")))))
    return rows.select("row", "text", "cands")


#: Expectation-maximisation over pats, an array of (votes, n): posterior of each pattern after ROUNDS rounds.
_EM = f"""
aggregate(
  sequence(1, {ROUNDS}),
  transform(pats, p -> 1 / (1 + exp(-cast(aggregate(p.votes, 0, (s, v) -> s + v) as double)))),
  (post, round) ->
    transform(
      array(named_struct(
        'prior', (1 + aggregate(zip_with(pats, post, (p, w) -> p.n * w), 0D, (s, x) -> s + x))
                 / (2 + aggregate(pats, 0D, (s, p) -> s + p.n)),
        'yes', transform(sequence(0, 3), j -> transform(sequence(-1, 1), v ->
                 (IF(v = 1, 2, 1) + aggregate(zip_with(pats, post, (p, w) -> IF(p.votes[j] = v, p.n * w, 0D)), 0D, (s, x) -> s + x))
                 / (4 + aggregate(zip_with(pats, post, (p, w) -> p.n * w), 0D, (s, x) -> s + x)))),
        'no', transform(sequence(0, 3), j -> transform(sequence(-1, 1), v ->
                 (IF(v = -1, 2, 1) + aggregate(zip_with(pats, post, (p, w) -> IF(p.votes[j] = v, p.n * (1 - w), 0D)), 0D, (s, x) -> s + x))
                 / (4 + aggregate(zip_with(pats, post, (p, w) -> p.n * (1 - w)), 0D, (s, x) -> s + x))))
      )),
      m -> transform(pats, p -> 1 / (1 + exp(-(
        ln(m.prior) - ln(1 - m.prior)
        + aggregate(sequence(0, 3), 0D, (s, j) -> s + ln(m.yes[j][p.votes[j] + 1]) - ln(m.no[j][p.votes[j] + 1])))))))[0]
)
"""


def posteriors(counts: DataFrame) -> DataFrame:
    """EM per kind over counts (kind, v0..v3, n): kind, v0..v3, posterior."""
    pats = counts.groupBy("kind", "v0", "v1", "v2", "v3").agg(F.sum("n").cast("double").alias("n"))
    listed = pats.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(F.array("v0", "v1", "v2", "v3").alias("votes"), "n"))).alias("pats"))
    solved = listed.select("kind", F.explode(F.arrays_zip("pats", F.expr(_EM).alias("post"))).alias("x"))
    return solved.select("kind", *[F.col("x.pats.votes")[j].alias(f"v{j}") for j in range(4)], F.col("x.post").alias("posterior"))


def classifier(counts: DataFrame) -> DataFrame:
    """Log-odds of each feature combination (kind, v0..v3, f0, f1) by naive Bayes on the posteriors."""
    soft = counts.join(posteriors(counts), ["kind", "v0", "v1", "v2", "v3"])
    yes, no = F.col("n") * F.col("posterior"), F.col("n") * (1 - F.col("posterior"))
    kind = Window.partitionBy("kind")
    odds = F.log((F.sum(yes).over(kind) + 1) / (F.sum(no).over(kind) + 1))
    for f in _CODE[1:]:
        own = Window.partitionBy("kind", f)
        odds = odds + F.log((F.sum(yes).over(own) + 1) / (F.sum(yes).over(kind) + 4)) - F.log((F.sum(no).over(own) + 1) / (F.sum(no).over(kind) + 4))
    return soft.select(*_CODE, odds.alias("log_odds"))


def _code(c: Column) -> Column:
    return F.concat_ws(",", *[c[f].cast("string") for f in _CODE])


def detect(found: DataFrame) -> DataFrame:
    """found (with cands, materialised) with the columns base and spans: arrays of (start, kind, end)."""
    votes = found.select(F.explode("cands").alias("c")).groupBy(*[F.col(f"c.{f}").alias(f) for f in _CODE]).agg(F.count(F.lit(1)).alias("n"))
    accepted = classifier(votes).where("log_odds > 0").select(F.concat_ws(",", *[F.col(f).cast("string") for f in _CODE]))
    codes = sorted(r[0] for r in accepted.collect())  # bounded by the feature combinations
    known = F.array(*[F.lit(c) for c in codes]) if codes else F.array().cast("array<string>")
    bare = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    chosen = F.filter("cands", lambda c: c["base"] | F.array_contains(known, _code(c)))
    return found.withColumns({"base": F.transform(F.filter("cands", lambda c: c["base"]), bare), "spans": F.transform(chosen, bare)})


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(spans, lambda c: F.concat(names[c["kind"]], F.lit(":"), c["start"].cast("string"), F.lit(":"), c["end"].cast("string")))
    return F.array_join(one, ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; of overlapping spans the first names them all."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    int_ = lambda c: F.floor(c).cast("int")

    def cut(blocks: Column):
        def piece(a: Column, b: Column) -> Column:
            i, j = int_(a / CUT), int_(b / CUT)
            head, tail = F.get(blocks, i), F.coalesce(F.substring(F.get(blocks, j), F.lit(1), b % CUT), F.lit(""))
            across = F.concat(F.substring(head, a % CUT + 1, F.lit(CUT)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), tail)
            return F.when(a >= b, "").when(i == j, F.substring(head, a % CUT + 1, b - a)).otherwise(across)

        def joined_(ends: Column) -> Column:
            shown = F.transform(spans, lambda c, i: F.when(c["start"] >= ends[i], F.concat(piece(ends[i], c["start"]), names[c["kind"]])).otherwise(""))
            return F.concat(F.array_join(shown, ""), piece(F.array_max(F.transform(spans, lambda c: c["end"])), F.char_length(text)))

        return let(running(F.transform(spans, lambda c: c["end"]), lambda x, y: F.greatest(x, y)), joined_)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(blocks, cut)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; n_chars follows, other columns stay."""
    rows = detect(staged(candidates(docs), "pii")).select("row", redacted(F.col("text"), F.col("spans")).alias("text"))
    made = {"text": F.col("text"), "n_chars": F.coalesce(F.char_length("text"), F.lit(0)).cast("long")}
    return rows.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = detect(staged(candidates(docs).select("row", "cands"), "pii"))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda c: c["kind"] == i)).cast("long")

    return rows.select(
        "row.doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
