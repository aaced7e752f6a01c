"""Operator 4 against a plain scan of all windows."""

import re

from pairgrid.llm import decontaminate as D


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[p:p + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, pos, ids = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in wins:
                    pos |= set(range(p, p + n))
                    ids |= wins[tuple(w[p:p + n])]
        out.append((d, len(w), tuple(sorted(pos)), tuple(sorted(i for i in ids if i is not None))))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(25))
    items = [(1, long), (2, "One, TWO three"), (3, None), (4, "..."), (2, "alpha beta gamma delta eps zeta eta theta iota"),
             (5, "É" + long[2:40]), (None, "lone item words that have no id at all but mark ten words"), (6, "single")]
    docs = [(i, " ".join(f"w{j}" for j in range(i, i + 12)) + f" x{i} one two three") for i in range(16)]
    docs += [(20, None), (21, ""), (22, "--- !!"), (23, "ONE two\nThree"), (24, "Single"), (24, "Single"), (25, "one two"), (None, long.upper()),
             (26, "é" + long[2:40] + " É" + long[2:40]), (27, "a lone item words that have no id at all but mark ten words"),
             (28, " ".join([long] * 40)), (29, "w1 " * 3000), (30, "alpha beta gamma delta eps zeta eta theta iota kappa")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, w string, n int").repartition(3)
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, window int")
    got = sorted(((r[0], r[1], tuple(r[2]), tuple(r[3])) for r in D.hits(df, bench).collect()), key=str)
    assert got == brute(docs, items)
    clean = D.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    bad = {d for d, _, pos, _ in brute(docs, items) if pos}
    assert sorted(map(str, [r["doc_id"] for r in clean.collect()])) == sorted(str(d) for d, _ in docs if d not in bad)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert D.hits(none, bench).collect() == []
    assert [tuple(r) for r in D.hits(one, bench).collect()] == [(1, 2, [], [])]


def test_clean_rows_of_a_contaminated_id_stay(spark):
    hit = " ".join(f"w{i}" for i in range(12))
    docs = [(None, hit), (None, "clean one"), (None, None), (None, "clean one"), (7, hit), (7, "clean two"), (7, ""), (8, hit + " more")]
    df = spark.createDataFrame([(t, d, i) for i, (d, t) in enumerate(docs)], "text string, doc_id long, at int")
    bench = spark.createDataFrame([(1, hit)], "item_id long, text string")
    clean = D.drop_contaminated(df, bench)
    assert clean.columns == df.columns and sorted(r["at"] for r in clean.collect()) == [1, 2, 3, 5, 6]
