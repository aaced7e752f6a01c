"""Hand-worked cases for the column functions and curation predicates (FIXTURES §3)."""

import math

from pyspark.sql import functions as F

from pairgrid.functions.columns import cut_right_closed, format_registry_number, hash_bucket, parse_number
from pairgrid.operators import curate as C


def test_parse_number_junk(spark):
    df = spark.createDataFrame([("NR",), ("1.5*",), (">3",), (" 2e-3 ",), (None,)], "x string")
    kept = C.filter_numeric_text(df, "x").select(parse_number("x").alias("v")).collect()
    assert [r.v for r in kept] == [0.002]


def test_duration_normalise_and_limits(spark):
    rows = [("48", "h"), ("60", "mi"), ("30", "mi"), ("1", "wk"), ("1", "mo"), ("3", "dpf")]
    df = spark.createDataFrame(rows, "v string, u string")
    d = C.normalize_duration(df, "v", "u", "d")
    d = C.filter_range(C.filter_range(d, "d", hi=7.0), "d", lo=1 / 24, digits=5)
    got = sorted(r.d for r in d.collect())
    assert [round(x, 6) for x in got] == [0.041667, 2.0, 3.0, 7.0]


def test_concentration_normalise_and_limits(spark):
    rows = [("5", "ug/L"), ("12", "g/L"), ("3", "ng/L"), ("2", "ppt"), ("0.5", "pg/L"), ("4", "ppm")]
    df = spark.createDataFrame(rows, "v string, u string")
    d = C.filter_range(C.normalize_concentration(df, "v", "u", "c"), "c", lo=1e-9, hi=1e4)
    got = sorted(r.c for r in d.collect())
    expect = sorted([0.005, 3e-6, 2e-9, 4.0])
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got, expect)) and len(got) == 4


def test_exposure_not_in_drops_null(spark):
    df = spark.createDataFrame([("FD",), ("AQUA",), (None,)], "e string")
    assert [r.e for r in C.filter_not_in(df, "e", C.EXCLUDED_EXPOSURE).collect()] == ["AQUA"]


def test_registry_number(spark):
    df = spark.createDataFrame([(50000,), (7732185,), (50001,)], "n long")
    got = [r.c for r in df.select(format_registry_number("n").alias("c")).collect()]
    assert got == ["50-00-0", "7732-18-5", None]


def test_cut_right_closed(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.5, 1.0, 1.5, 4.0, 7.0, 7.5]], "x double")
    got = [r.b for r in df.select(cut_right_closed("x", [0, 1, 2, 4, 7]).alias("b")).collect()]
    assert got == [None, 1, 1, 2, 3, 4, None]
    inf = float("inf")
    df2 = spark.createDataFrame([(x,) for x in [-5.0, 0.0, 0.1, 3.0, 9.0]], "x double")
    got2 = [r.b for r in df2.select(cut_right_closed("x", [-inf, 0, 1, 2, 3, inf]).alias("b")).collect()]
    assert got2 == [1, 1, 2, 4, 5]


def test_frequent_edges(spark):
    rows = [(1.0,)] * 300 + [(2.0,)] * 199 + [(4.0,)] * 200 + [(7.0,)] * 5
    df = spark.createDataFrame(rows, "v double")
    assert C.frequent_edges(df, "v", min_count=200) == [0.0, 1.0, 4.0, 7.0]


def test_log_ratio_scale(spark):
    df = spark.createDataFrame([("a", 0, 1), ("b", 0, 3)], "k string, bit int, cnt int")
    got = {r.k: r.val for r in C.log_ratio_scale(df).collect()}
    assert math.isclose(got["a"], 0.5) and math.isclose(got["b"], 1.0)


def test_hash_bucket_words(spark):
    df = spark.createDataFrame([("small",), ("ring",)], "w string")
    assert [r.b for r in df.select(hash_bucket(F.col("w"), 1024).alias("b")).collect()] == [921, 344]


def test_null_safe_join_matches_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "id int, k string")
    b = spark.createDataFrame([(None, "n"), ("x", "y")], "k string, v string")
    got = sorted((r.id, r.v) for r in C.join_null_safe(a, b, ["k"]).collect())
    assert got == [(1, "n"), (2, "y")]


def test_cross_grid_legal_pairs(spark):
    legal = spark.createDataFrame([("s1", "A"), ("s2", "B")], "setting string, model string")
    g = C.cross_grid(spark, {"model": ["A", "B"], "setting": ["s1", "s2"], "alpha": [1.0, 2.0]}, legal)
    assert g.count() == 4
    assert {(r.setting, r.model) for r in g.collect()} == {("s1", "A"), ("s2", "B")}


def test_int_hash_matches_duckdb(spark):
    import duckdb
    import numpy as np
    from pairgrid.functions.columns import HASH_P, int_fold, int_fold_sql, int_hash, int_hash_sql
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(0, 2**40, 300), rng.integers(0, 10**6, 300))]
    rows += [(0, 0), (HASH_P, HASH_P - 1), (2**62, 7)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", int_hash([F.col("a"), F.col("b")], "s").alias("h"),
                    int_fold([F.col("a")], 5, "inner").alias("f")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (a BIGINT, b BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    exp = {(a, b): (h, f) for a, b, h, f in con.execute(
        f"SELECT a, b, {int_hash_sql(['a', 'b'], 's')}, {int_fold_sql(['a'], 5, 'inner')} FROM t").fetchall()}
    assert all(exp[(r.a, r.b)] == (r.h, r.f) for r in got)
    folds = [r.f for r in got]
    assert set(folds) == {1, 2, 3, 4, 5}
