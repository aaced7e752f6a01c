"""Operator 3: personal data by weak supervision (DataFrame functions only).

Fixed patterns give the base spans. Wider patterns give more candidates (local
phone numbers, identity numbers, secrets in assignments, failed base matches). On
every candidate a few labelers vote for, against or not at all: strict regular
expressions, a gazetteer of words before the span, and its context. Votes are
counted by pattern, and expectation-maximisation over the at most 3^6 patterns
estimates how often each labeler is right and how likely each pattern is private.
These probabilities are the targets of the final span classifier, a logistic model
on the span's own features that is fitted on counts too. Candidates that it accepts
are added; base spans stay whatever it says, and nothing is added over them.

Positions come from the pieces between matches: a match starts after the lengths of
all pieces and matches before it, summed over the rows of its document.

Defined results: a null text is empty and has no spans; repeated rows and ids are
judged row by row; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, table

#: Kinds in the order of the report; the first four have base spans.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
#: Candidate patterns. The first four find what the fixed base patterns find; a match
#: starts where no match could have started earlier, and quantifiers do not give back,
#: so that long runs are read once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "local": r"(?<![0-9+(])\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?:token|secret|password|passwd|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9/+_.-]{12,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to match; most texts do not.
NEEDS = {"email": "@", "phone": "+", "local": "-", "ssn": "-"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Gazetteer: words that announce personal data.
ANNOUNCE = r"(?i)(?:mail|e-mail|contact|phone|tel|call|fax|mobile|card|visa|account|ssn|social|address|host|server|ip|token|secret|key|password)\W{0,3}$"
AGAINST = r"(?i)(?:version|ver|v|section|chapter|page|isbn|issue|no|figure|table|part|build|#|\$|€)\W{0,2}$"
NEAR, EM_STEPS, FIT_STEPS, CUT = 24, 25, 200, 0.5


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, i, match, gap, before, after): gap is the length of the text
    between the match before and this one, before and after stand beside it."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    one = lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), m.alias("match"), F.char_length(gaps[i]).alias("gap"),
        F.right(gaps[i], F.lit(NEAR)).alias("before"), F.left(gaps[i + 1], F.lit(NEAR)).alias("after"))
    empty = F.array().cast("array<struct<kind:string,i:int,match:string,gap:int,before:string,after:string>>")
    there = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]") if kind != "secret" else text.rlike("[=:]")
    return F.when(there, F.transform(found, one)).otherwise(empty)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, kind, start, end (code points, end exclusive), match, before, after,
    base; a row without kind for a document without matches."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    pieces = F.concat(*[_matches(F.col("text"), k) for k in PATTERNS])
    rows = d.select("id", "row", F.explode_outer(pieces).alias("m")).select("id", "row", "m.*")
    # one exchange by document serves the running sums and what is gathered later
    rows = rows.repartition(partitions(docs.sparkSession), "row")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.char_length("match")).over(before), F.lit(0)) + F.col("gap")
    rows = rows.withColumn("start", start.cast("long"))
    value = F.when(F.col("kind") == "secret", F.regexp_extract("match", r"[A-Za-z0-9/+_.-]{12,}+$", 0)).otherwise(F.col("match"))
    rows = (rows.withColumn("whole", F.col("match")).withColumn("match", value)
            .withColumn("start", F.col("start") + F.char_length("whole") - F.char_length("match"))
            .withColumn("end", F.col("start") + F.char_length("match")))
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.char_length(digits)
    base = (F.when(F.col("kind") == "email", True)
            .when(F.col("kind") == "ip", F.col("match").rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"))
            .when(F.col("kind") == "card", F.when((n >= 12) & (n <= 19), F.call_function("luhn_check", digits)).otherwise(False))
            .when(F.col("kind") == "phone", (n >= 9) & (n <= 15)).otherwise(False))
    return rows.select("row", "id", F.when(F.col("kind") == "local", "phone").otherwise(F.col("kind")).alias("kind"),
                       "start", "end", "match", "whole", "before", "after", base.alias("base"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def votes() -> Column:
    """One vote of each labeler for a candidate: 1, -1, or 0 for none."""
    match, kind, before, after = (F.col(c) for c in ("match", "kind", "before", "after"))
    n = F.char_length(F.regexp_replace(match, "[^0-9]", ""))
    varied = F.size(F.array_distinct(F.split(F.regexp_replace(match, "[^0-9A-Za-z]", ""), "")))
    return F.array(
        _vote(F.col("base") | match.rlike(r"^\(?[0-9]{3}\)? [0-9]{3}-[0-9]{4}$"),  # the strict pattern
              ((kind == "ip") & ~F.col("base")) | ((kind == "card") & ~n.between(12, 19)) | ((kind == "phone") & ~n.between(9, 15))),
        _vote(F.concat(before, F.regexp_replace("whole", r"[A-Za-z0-9/+_.-]+$", "")).rlike(ANNOUNCE) | (kind == "secret"), F.lit(False)),  # gazetteer
        _vote(F.lit(False), before.rlike(AGAINST)),  # numbers of other things
        _vote((kind != "card") & before.rlike(r"(?:^|[\s(\[<\"'=:,;|])$") & after.rlike(r"^(?:$|[\s)\]>\"',;|.!?])"),
              before.rlike(r"[A-Za-z0-9]$") | after.rlike(r"^[A-Za-z0-9]")),  # stands alone
        _vote((kind == "secret") & match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (varied >= 8), varied <= 3),  # variety
        _vote(match.rlike(r"^(?:[0-9]{4}[ -]?){3,4}[0-9]{0,4}$") & F.col("base") | match.rlike("^[0-9a-f]{32,}$"),
              (kind == "card") & ~F.col("base")))  # regular groups


def features() -> list[Column]:
    """0/1 features of a candidate for the final classifier."""
    match = F.col("match")
    own = [F.col("kind") == k for k in KINDS]
    return [c.cast("int") for c in (
        *own, F.col("base"), F.col("before").rlike(r"[A-Za-z0-9]$") | F.col("after").rlike(r"^[A-Za-z0-9]"), F.col("before").rlike(AGAINST),
        F.concat("before", F.regexp_replace("whole", r"[A-Za-z0-9/+_.-]+$", "")).rlike(ANNOUNCE),
        F.char_length(match) >= 32, match.rlike("[0-9]") & match.rlike("[A-Za-z]"), match.rlike("[ ()]"))]


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(arr: Column, of) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + of(x))


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _vote_odds(p: Column, v: Column) -> Column:
    """Log-odds of being private given votes, under (share, right on private, right on others)."""
    terms = F.zip_with(F.arrays_zip(p["a"].alias("a"), p["b"].alias("b")), v, lambda q, x:
                       F.when(x > 0, F.log(q["a"] / (F.lit(1.0) - q["b"]))).when(x < 0, F.log((F.lit(1.0) - q["a"]) / q["b"])).otherwise(0.0))
    return F.log(p["share"] / (F.lit(1.0) - p["share"])) + _sum(terms, lambda t: t)


def reliabilities(found: DataFrame, labelers: int = 6, steps: int = EM_STEPS) -> DataFrame:
    """One row (share, a, b) by expectation-maximisation over counted vote patterns: a
    labeler that votes is right with probability a on private spans, b on others. Every
    estimate starts at 0.8 and keeps the weight of ten such votes."""
    counted = found.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    all_of = counted.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("t"))  # at most 3^labelers
    start = F.struct(F.lit(0.5).alias("share"), *[F.array(*[F.lit(0.8)] * labelers).alias(x) for x in "ab"])

    def step(p, _):
        judged = F.transform("t", lambda x: F.struct(x["votes"].alias("v"), x["n"].alias("n"), _sigmoid(_vote_odds(p, x["votes"])).alias("q")))

        def update(t):
            rate = lambda k, sign, weight: (_sum(t, lambda x: F.when(x["v"][k] == sign, weight(x)).otherwise(0.0)) + 8.0) / (
                _sum(t, lambda x: F.when(x["v"][k] != 0, weight(x)).otherwise(0.0)) + 10.0)
            ones = (_sum(t, lambda x: x["n"] * x["q"]) + 1.0) / (_sum(t, lambda x: x["n"]) + 2.0)
            return F.struct(ones.alias("share"), F.array(*[rate(k, 1, lambda x: x["n"] * x["q"]) for k in range(labelers)]).alias("a"),
                            F.array(*[rate(k, -1, lambda x: x["n"] * (F.lit(1.0) - x["q"])) for k in range(labelers)]).alias("b"))
        return _let(judged, update)

    return all_of.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("p")).select("p.*")


def classifier(found: DataFrame, steps: int = FIT_STEPS, rate: float = 2.0, ridge: float = 0.01) -> DataFrame:
    """One row (w: weights, the last one the intercept) of a logistic model for the
    probability q, by gradient steps over counted feature patterns (at most 2^features)."""
    counted = found.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("q").alias("q"))
    all_of = counted.agg(F.sort_array(F.collect_list(F.struct("x", "n", "q"))).alias("t"), F.sum("n").alias("total"))
    width = len(features()) + 1
    score = lambda w, x: _sum(F.zip_with(w, x, lambda a, b: a * b), lambda s: s)

    def step(w, _):
        off = F.transform("t", lambda r: F.struct(r["x"].alias("x"), (r["n"] * (_sigmoid(score(w, r["x"])) - r["q"]) / F.col("total")).alias("g")))
        return _let(off, lambda t: F.transform(w, lambda a, k: a * (1 - rate * ridge) - _sum(t, lambda r: r["g"] * r["x"][k]) * rate))

    start = F.array(*[F.lit(0.0)] * width)
    return all_of.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("w"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and added: arrays of (start, order, end, kind), one row per document."""
    found = materialize(candidates(docs, id_col, text_col), "candidates")
    only = found.where("kind is not null")
    p = reliabilities(only.withColumn("votes", votes())).first()
    given = F.struct(F.lit(p["share"]).alias("share"), *[F.array(*map(F.lit, p[x])).alias(x) for x in "ab"])
    x = F.array(*[c.cast("double") for c in features()], F.lit(1.0))
    trained = classifier(only.withColumn("x", x).withColumn("q", _sigmoid(_vote_odds(given, votes()))).select("x", "q")).first()
    w = [float(v) for v in trained["w"]]
    z = reduce(lambda s, t: s + t, [c * v for c, v in zip(features(), w)], F.lit(w[-1]))
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    span = F.struct("start", order.alias("order"), "end", "kind")
    # the exchange by document is kept by the files' order only in memory, so it is made anew on few small rows
    per = found.withColumn("p", _sigmoid(z)).groupBy("row", "id").agg(
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.sort_array(F.collect_set(F.when(~F.col("base") & (F.col("p") >= CUT), span))).alias("more"))
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return per.select(F.col("id").alias(id_col), "base", free.alias("added"))


def _text(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_weak_privacy(spark, sf_dir):
    s = spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long").alias(f"n_{k}")
    return s.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
                    _text(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
