"""Operator 8 against Python sets of the same pieces."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pairgrid.llm import fingerprint as X


def pieces(t):
    return set(re.findall(r"[^\n]{1,120}+[^.!?\n]{0,180}+[.!?\n ]*+|\n++", t or ""))


def jaccard(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(docs):
    """docs: distinct ids (null ones too), in any order."""
    order = sorted(docs, key=lambda x: (x[0] is None, -(x[0] or 0)))
    out = {}
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(t, e), 9), round(jaccard(t, nxt), 9))
    return out


@pytest.mark.parametrize("parts", [1, 8])
def test_against_sets(spark, parts):
    rnd = random.Random(parts)
    sentences = [" ".join(rnd.choices(["aé", "b", "😀c", "dd", "eee"], k=rnd.randrange(1, 30))) + rnd.choice([". ", "!\n", "? ", "\n\n"]) for _ in range(400)]
    docs = [(i * 7 - 40, "".join(rnd.choices(sentences, k=rnd.randrange(40)))) for i in range(60)]
    docs += [(1000, None), (1001, ""), (1002, "one"), (1003, "x" * 1000), (1004, "".join(f"s{i}. " for i in range(3000))),
             (1005, "".join(f"s{i}. " for i in range(3000) if i % 700)), (None, "no id. here"), (1006, docs[3][1]), (1007, docs[3][1])]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, key string, next int").repartition(parts)
    rows = X.edited_likeness(df).collect()
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows}
    assert len(rows) == len(docs) and got == brute(docs)
    prints = {}
    for r in rows:
        prints.setdefault(dict(docs)[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in prints.values()) and len({v for s in prints.values() for v in s}) == len(prints)


def test_peeling_recovers_digests(spark):
    rnd = random.Random(9)
    rows = []
    for n in (0, 1, 3, 5, 12, 60, 300):
        common = [rnd.getrandbits(64) - 2**63 for _ in range(40)]
        a, b = ([rnd.getrandbits(64) - 2**63 for _ in range(k)] for k in (n, n // 2))
        rows.append((common + a, b + common, sorted(a), sorted(b)))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, a array<long>, b array<long>")
    df = df.withColumn("tx", X.sketch(F.col("x"), X.CELLS)).withColumn("ty", X.sketch(F.col("y"), X.CELLS))
    for r in X.with_differences(df, [("x", "tx", "y", "ty")], "d").collect():
        assert sorted(k for _, k, n in r["d"] if n == 1) == r["a"] and sorted(k for _, k, n in r["d"] if n == -1) == r["b"]


def test_repeated_ids_one_row_and_none(spark):
    schema = "doc_id long, text string"
    one = X.edited_likeness(spark.createDataFrame([(5, "a. b. c.")], schema)).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["n_chars"] == 8
    same = X.edited_likeness(spark.createDataFrame([(5, "a. b."), (5, "a. b."), (None, "z."), (None, "z.")], schema)).collect()
    assert len(same) == 4 and sorted(r["near_next"] for r in same) == [0.0, 0.0, 1.0, 1.0]
    assert X.edited_likeness(spark.createDataFrame([], schema)).collect() == []
