"""Folds, closed-form ridge, features and sinks (FIXTURES §3–§4)."""

import heapq
import math
from collections import Counter

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairgrid.operators import features as FT
from pairgrid.operators import folds as V
from pairgrid.operators.models import closed_form as CF
from pairgrid.operators.models import ffm as M
from pairgrid.sources import readers as R
from pairgrid.sources import writers as K


def heap_folds(counts, k):
    """(key, count) → fold, one group at a time: the lightest fold, the lowest one on ties."""
    heap, out = [(0, f) for f in range(1, k + 1)], {}
    for key, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        load, f = heapq.heappop(heap)
        out[key] = f
        heapq.heappush(heap, (load + n, f))
    return out


def test_greedy_assign_fixture(spark):
    counts = list(zip("abcdef", [5, 4, 3, 3, 2, 1]))
    r = V.greedy_fold_map(spark.createDataFrame(counts, "key string, n bigint"), "key", "n", 3)
    got = {x["key"]: x["fold"] for x in r.collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 3, "e": 2, "f": 1}
    loads = [sum(n for key, n in counts if got[key] == f) for f in (1, 2, 3)]
    assert loads == [6, 6, 6]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40) | st.sampled_from([1, 1, 2, 500]), max_size=60), st.integers(1, 7))
def test_greedy_segments_equal_heap(sizes, k):
    counts = [(f"{i:03d}", n) for i, n in enumerate(sizes)]
    hist = sorted(Counter(sizes).items(), reverse=True)
    rank, got = Counter(), {}
    segments = V.greedy_segments(hist, k)
    for key, n in counts:
        r = rank[n]
        rank[n] += 1
        got[key] = next(f[(r - lo) % len(f)] for c, lo, hi, f in segments if c == n and lo <= r < hi)
    assert got == heap_folds(counts, k)


def test_greedy_folds_equal_heap_in_parts(spark):
    rnd = np.random.default_rng(4)
    rows = [(int(p), f"g{i}", int(n)) for p in range(3) for i, n in enumerate(rnd.zipf(1.6, 300).clip(1, 400))]
    r = V.greedy_fold_map(spark.createDataFrame(rows, "p int, g string, n bigint").repartition(4), "g", "n", 5, part=["p"])
    got = {(x["p"], x["g"]): x["fold"] for x in r.collect()}
    assert got == {(p, g): f for p in range(3) for g, f in heap_folds([x[1:] for x in rows if x[0] == p], 5).items()}


def test_greedy_folds_spark_no_leak(spark):
    rows = [(k, i) for k, n in zip("abcdef", [5, 4, 3, 3, 2, 1]) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, i int")
    f = V.assign_folds(df, ["key"], 3, "greedy")
    chk = V.leakage_check(f, ["key"], "fold").first()
    assert chk.n_leaking == 0 and chk.min_fold_rows == 6 and chk.max_fold_rows == 6


def test_hash_folds_partition_rows(spark):
    df = spark.range(5000).select((F.col("id") % 97).alias("g"))
    f = V.assign_folds(df, ["g"], 5, "hash")
    chk = V.leakage_check(f, ["g"], "fold").first()
    assert chk.n_leaking == 0
    assert f.count() == 5000


def test_nested_folds_disjoint(spark):
    df = spark.range(2000).select(F.col("id").alias("r"), (F.col("id") % 50).alias("g"))
    df = V.assign_folds(df, ["g"], 5, "hash")
    n = V.nested_folds(df, ["g"], "fold", 5, 5, "greedy")
    # each row appears in the 4 outer training sets it belongs to, never in its own fold
    assert n.filter(F.col("outer") == F.col("fold")).count() == 0
    assert n.count() == 4 * 2000
    leak = n.groupBy("outer", "g").agg(F.countDistinct("inner").alias("k")).agg(F.max("k")).first()[0]
    assert leak == 1


def test_shrunk_mean_closed_form(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 1), ("b", 5.0, 1), ("c", 9.0, 2)], "g string, y double, f int")
    cells = CF.cell_stats(df, ["g", "f"])
    st = CF.split_stats(cells, ["g"], "f", 2).filter("o = 2").withColumn("alpha", F.lit(1.0))
    p = {r.g: r for r in CF.group_predictions(st, ["o"], "g", "alpha").collect()}
    assert math.isclose(p["a"].intercept, 3.285714, rel_tol=1e-6)
    assert math.isclose(p["a"].y_pred, 2.428571, rel_tol=1e-6)
    assert math.isclose(p["b"].y_pred, 4.142857, rel_tol=1e-6)
    assert math.isclose(p["c"].y_pred, 3.285714, rel_tol=1e-6)  # unseen level → intercept


def test_shrunk_mean_alpha_to_zero_gives_group_means(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 1), ("b", 5.0, 1), ("c", 9.0, 2)], "g string, y double, f int")
    st = CF.split_stats(CF.cell_stats(df, ["g", "f"]), ["g"], "f", 2).filter("o = 2").withColumn("alpha", F.lit(1e-9))
    p = {r.g: r.y_pred for r in CF.group_predictions(st, ["o"], "g", "alpha").collect()}
    assert math.isclose(p["a"], 2.0, rel_tol=1e-6) and math.isclose(p["b"], 5.0, rel_tol=1e-6)


def test_sse_formula_matches_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{rng.integers(0, 6)}", float(rng.normal()), int(rng.integers(1, 4))) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, y double, f int")
    st = CF.split_stats(CF.cell_stats(df, ["g", "f"]), ["g"], "f", 3)
    sc = {r.o: r for r in CF.score_shrunk_mean(st, ["o"], [2.0]).collect()}
    pr = CF.group_predictions(st.withColumn("alpha", F.lit(2.0)), ["o"], "g", "alpha")
    j = df.join(pr, (df.g == pr.g) & (df.f == pr.o)).select("o", ((F.col("y") - F.col("y_pred")) ** 2).alias("e"))
    sse = {r.o: r.s for r in j.groupBy("o").agg(F.sum("e").alias("s")).collect()}
    for o in sse:
        assert math.isclose(sc[o].sse, sse[o], rel_tol=1e-9)


def test_field_map_and_interaction_index(spark):
    fm = FT.field_map(spark, [2, 3, 1]).orderBy("feature").collect()
    assert [r.field for r in fm] == [0, 0, 1, 1, 1, 2]
    rows = spark.createDataFrame([(1, 2, "c")], "row int, code int, chem string")
    fp = spark.createDataFrame([("c", 7, 1.0)], "chem string, bit int, val double")
    assert FT.interaction_terms(rows, "row", "code", "chem", fp, 1024).first().feature == 2055


def test_libsvm_and_libffm_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, [0, 1, 2], [1.0, 0.0, 2.0], [0, 0, 1])], "y double, i array<int>, v array<double>, f array<int>")
    line = df.select(K.libsvm_line(F.col("y"), F.col("i"), F.col("v")).alias("l")).first().l
    assert line == "1.0000 0:1.0000 2:2.0000"
    ffm = df.select(K.libffm_line(F.col("y"), F.col("f"), F.col("i"), F.col("v")).alias("l")).first().l
    assert ffm == "1.0000 0:0:1.0000 1:2:2.0000"
    p = str(tmp_path / "svm")
    K.write_libsvm(df, "y", "i", "v", p)
    back = R.scan_sparse_rows(spark, p).first()
    assert back.label == 1.0 and back.idx == [0, 2] and back.val == [1.0, 2.0]
    p2 = str(tmp_path / "ffm")
    K.write_libffm(df, "y", "f", "i", "v", p2)
    b2 = R.scan_sparse_rows(spark, p2, ffm=True).first()
    assert b2.field == [0, 1] and b2.idx == [0, 2]


def test_ffm_score_matches_pairwise(spark):
    rng = np.random.default_rng(0)
    n_feat, n_fields, k = 12, 3, 4
    V_ = rng.normal(size=(n_feat, n_fields, k))
    w = rng.normal(size=n_feat)
    field = np.arange(n_feat) % n_fields
    rows = []
    for r in range(40):
        feats = rng.choice(n_feat, size=5, replace=False)
        for f in feats:
            rows.append((r, int(f), int(field[f]), float(rng.uniform(0.1, 2))))
    long = spark.createDataFrame(rows, "idx long, feature int, field int, val double")
    fac = spark.createDataFrame([(i, b, t, float(V_[i, b, t])) for i in range(n_feat) for b in range(n_fields)
                                 for t in range(k)], "feature int, tfield int, pos int, v double")
    lin = spark.createDataFrame([(i, float(w[i])) for i in range(n_feat)], "feature int, w double")
    got = {r.idx: r.y_pred for r in M.score_ffm(long, fac, lin, 0.5).collect()}
    pdf = pd.DataFrame(rows, columns=["idx", "feature", "field", "val"])
    for r, g in pdf.groupby("idx"):
        e = g.to_numpy()
        s = 0.5 + sum(w[int(f)] * x for _, f, _, x in e)
        for a in range(len(e)):
            for b in range(a + 1, len(e)):
                fa, fb = int(e[a][1]), int(e[b][1])
                s += V_[fa, int(e[b][2])] @ V_[fb, int(e[a][2])] * e[a][3] * e[b][3]
        assert math.isclose(got[r], s, rel_tol=1e-9, abs_tol=1e-9)
