"""Aggregations, windows and curve operators on hand-worked cases (FIXTURES §3)."""

import math

from pyspark.sql import functions as F

from pairgrid.operators import report as G
from pairgrid.operators import reshape as W


def test_best_per_group_ties_and_nulls(spark):
    df = spark.createDataFrame([("k", 10.0, 0.9), ("k", 10.0, 0.8), ("k", 1.0, 0.8), ("k", 5.0, None)],
                               "key string, alpha double, rmse double")
    best = W.best_per_group(df, ["key"], ["rmse", "alpha"]).collect()
    assert len(best) == 1 and best[0].rmse == 0.8 and best[0].alpha == 1.0


def test_describe_counts(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "n int")
    r = G.describe_counts(df, "n").first()
    assert r["count"] == 4 and r["mean"] == 4.0 and math.isclose(r["std"], 4.082483, rel_tol=1e-6)
    assert (r.q25, r.q50, r.q75) == (1.75, 2.5, 4.75)


def test_pooled_and_fold_mean_rmse(spark):
    df = spark.createDataFrame([("m", 1, 0.0, 1.0), ("m", 1, 0.0, 1.0), ("m", 2, 0.0, 3.0)],
                               "model string, fold int, y double, y_pred double")
    pooled = G.rmse_pooled(df, ["model"]).first().rmse
    assert math.isclose(pooled, 1.914854, rel_tol=1e-6)
    assert math.isclose(G.rmse_fold_mean(df, ["model"], "fold").first().rmse_fold_mean, 2.0)


def test_curve_mean_and_argmin(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 2.0), ("a", 3, 2.5), ("b", 1, 3.0), ("b", 2, 2.0)],
                               "curve string, round int, rmse double").withColumn("k", F.lit(1))
    m = G.curve_mean(df, ["k"])
    assert [r.rmse for r in m.orderBy("round").collect()] == [3.0, 2.0, 2.5]
    assert G.curve_argmin(m, ["k"]).first().best_round == 2
    flat = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0)], "k int, round int, rmse double")
    assert G.curve_argmin(flat, ["k"]).first().best_round == 1


def test_early_stop(spark):
    df = spark.createDataFrame([(1, r + 1, float(v)) for r, v in enumerate([5, 4, 4.1, 4.2, 3])],
                               "k int, round int, rmse double")
    r = G.early_stop_round(df, ["k"], 2).first()
    assert r.stop_round == 4
    # the best round among those seen before stopping is 2
    cut = df.filter(F.col("round") <= r.stop_round)
    assert G.curve_argmin(cut, ["k"]).first().best_round == 2


def test_variance_decomposition(spark):
    df = spark.createDataFrame([(1.67, 0.98, 0.88, 0.54)], "a double, b double, c double, d double")
    r = G.variance_decomposition(df, "a", "b", "c", "d").first()
    got = [round(r.share_means, 4), round(r.share_interactions, 4), round(r.share_possible, 4), round(r.share_noise, 4)]
    assert got == [0.6556, 0.0667, 0.1731, 0.1046]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    assert sorted(r.bin for r in G.histogram(df, "x", 100).collect()) == [0, 99]


def test_band_coverage(spark):
    df = spark.createDataFrame([("m", 0.0, 1.0), ("m", 0.0, 1.0), ("m", 0.0, 3.0)], "model string, y double, y_pred double")
    r = G.band_coverage(df, ["model"]).first()
    assert math.isclose(r.within_1, 2 / 3) and r.within_2 == 1.0 and r.within_3 == 1.0


def test_global_row_index_dense(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    idx = W.global_row_index(df, ["k"], buckets=7)
    got = sorted(r["index"] for r in idx.collect())
    assert got == list(range(1000))
