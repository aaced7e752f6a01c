"""Operator 3: base spans against plain Python, the estimation against known answers."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from pairgrid.llm import privacy as P

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    t = [int(c) for c in reversed(d)]
    return sum(t[::2] + [x * 2 - 9 * (x > 4) for x in t[1::2]]) % 10 == 0


def brute(text):
    out = []
    for o, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), o, m.end(), kind))
    return sorted(out)


def odd_texts():
    rnd = random.Random(6)
    texts = [None, "", "a@b.cc_x@d.ee", "😀é a.b@c.d-e.ff.g, 1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
             "+1 (017) 555-7713. +49.30.1234567890-x +12", "a" * 50_000, "1" * 30_000, "a@" * 9000, "x@y" + ".z" * 20_000, "1." * 20_000, "9 " * 20_000,
             'token = "908038b7daaf91e730d2f64001c52934d43d9336", call (017) 555-7713 or 078-05-1120', "no data, version 1.2.3.4"]
    alphabet = "0123456789 .-+()@ab_é😀"
    texts += ["".join(rnd.choices(alphabet, k=rnd.randrange(120))) for _ in range(300)]
    return texts


def test_base_spans(spark):
    texts = odd_texts()
    rows = [(i if i != 2 else None, t, "k", 1) for i, t in enumerate(texts)] + [(3, texts[3], "k", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, row int").repartition(4)
    got = sorted(((r["doc_id"], [tuple(s) for s in r["base"]]) for r in P.spans(df).collect()), key=str)
    assert got == sorted(((i, brute(t)) for i, t, _, _ in rows), key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = P.op3_weak_privacy(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(text)
    secrets = 0
    for r in rows:
        base = brute(text[r["doc_id"]])
        said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(b[3] == k for b in base) for k in BASE]
        assert set(said.split(",")) - {""} <= set(r["spans"].split(","))
        secrets += r["spans"].count("secret:")
    assert secrets == sum(len(re.findall('token = "[0-9a-f]{40}"', t)) for t in text.values()) > 0


def test_estimation(spark):
    """Votes drawn from known reliabilities give them back."""
    rnd = random.Random(1)
    a, b, rows = [.95, .9, .7, .85, .6, .8], [.9, .97, .8, .7, .9, .75], []
    for _ in range(6000):
        y = rnd.random() < .4
        rows.append(([(1 if (rnd.random() < (a if y else b)[k]) == y else -1) if rnd.random() < .9 else 0 for k in range(6)],))
    p = P.reliabilities(spark.createDataFrame(rows, "votes array<int>"), steps=60).first()
    assert abs(p["share"] - .4) < .03
    assert all(abs(x - y) < .05 for x, y in zip([*p["a"], *p["b"]], [*a, *b]))


def test_classifier_follows_targets(spark):
    rnd = random.Random(2)
    n = len(P.features())
    rows = []
    for _ in range(400):
        x = [float(rnd.random() < .5) for _ in range(n)] + [1.0]
        rows.append((x, .95 if x[0] else .05))
    w = P.classifier(spark.createDataFrame(rows, "x array<double>, q double")).first()["w"]
    assert w[0] > 2 and all(abs(v) < .5 for v in w[1:-1]) and w[-1] < -.5  # the ridge holds the weights below the log-odds of the targets


def test_empty(spark):
    assert P.spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert F is not None
