"""Plan shape and skew: what the optimiser produces, and behaviour with a hot key."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from pairgrid.operators.models import closed_form as CF
from tests.conftest import SF_SMALL

PLAN_QUERIES = ["holdout_report", "grid_search", "predict_holdout", "curate_table", "group_kfold_greedy",
                "leakage_check", "variance_decomposition", "score_ffm", "reindex_grid", "histogram",
                "hashed_count_fingerprint_docs", "rmse_by_density", "cross_grid"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_no_cartesian_or_nested_loop(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, p


def test_flagship_prunes_columns_and_reuses_cells(spark):
    df = E.queries()["holdout_report"](spark, SF_SMALL)
    df.collect()
    p = _plan(df)
    # only the columns the model needs are read from the line items
    for unused in ["l_shipdate", "l_returnflag", "l_comment", "l_tax", "l_discount"]:
        assert unused not in p
    assert "ReusedExchange" in p or "ShuffleQueryStage" in p


def test_hot_key_grid_matches_bruteforce(spark):
    """One group holds a third of all rows; the cell-sum grid equals a row-level brute force."""
    rng = np.random.default_rng(7)
    n = 3000
    g = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 60, n))
    y = rng.normal(size=n) + g * 0.05
    f = (np.arange(n) % 5) + 1
    pdf = pd.DataFrame({"g": g.astype(np.int64), "y": y, "f": f.astype(np.int32)})
    df = spark.createDataFrame(pdf).repartition(8)
    st = CF.split_stats(CF.cell_stats(df, ["g", "f"]), ["g"], "f", 5)
    got = {(r.o, r.alpha): r.rmse for r in CF.score_shrunk_mean(st, ["o"], [0.1, 10.0]).collect()}
    for (o, a), r in got.items():
        tr, te = pdf[pdf.f != o], pdf[pdf.f == o]
        s = tr.groupby("g")["y"].agg(["count", "mean"])
        c = s["count"] * a / (s["count"] + a)
        b = (c * s["mean"]).sum() / c.sum()
        pred = te["g"].map(b + s["count"] * (s["mean"] - b) / (s["count"] + a)).fillna(b)
        assert math.isclose(r, math.sqrt(((te["y"] - pred) ** 2).mean()), rel_tol=1e-9)


def test_hot_key_partial_aggregation(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("g"),
                                   F.rand(1).alias("y"), ((F.col("id") % 5) + 1).alias("f"))
    p = _plan(CF.cell_stats(df, ["g", "f"]))
    assert "partial_count" in p or "partial_sum" in p
