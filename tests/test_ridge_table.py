"""Ridge with its coefficients as a table, against dense solves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgrid.operators.models import ridge_table as RT

X = "x array<struct<feature:bigint,val:double>>"


def dense(rows, keep, alpha, without=()):
    feats = sorted({f for r in rows for f, _ in r[4]} - set(without))
    x = np.zeros((len(rows), len(feats) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        for f, v in r[4]:
            if f not in without:
                x[i, feats.index(f)] = v
    n = np.array([r[2] if keep(r) else 0 for r in rows], float)
    sy = np.array([r[3] if keep(r) else 0.0 for r in rows])
    pen = alpha * np.eye(len(feats) + 1)
    pen[-1, -1] = 0
    w = np.linalg.solve((x.T * n) @ x + pen, x.T @ sy)
    return dict(zip([*feats, RT.INTERCEPT], w)), x @ w


def made(seed=3, rows=150, scale=1):
    rnd = random.Random(seed)
    out = []
    for i in range(rows):
        feats = sorted({0 if rnd.random() < .4 else rnd.randrange(25) for _ in range(5)})
        x = [(f * scale, rnd.choice([1.0, 1.0, rnd.uniform(.1, 2)])) for f in feats]
        n = rnd.randrange(1, 4)
        out.append((i, rnd.randrange(1, 4), n, n * (4 + sum(v * ((f // scale) % 5 - 2) for f, v in x) + rnd.gauss(0, .3)), x))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, f"row long, fold int, n long, sy double, {X}").repartition(4)


def test_equals_dense_solves(spark):
    """Several fits at once, with ids up to 3,000,000 x 1,024, beyond 32 bits."""
    scale = 3_000_000 * 1024 // 24
    rows = made(scale=scale)
    d = RT.design(frame(spark, rows), ["row", "fold"])
    fits = [RT.Fit(F.col("fold") != 1, .5), RT.Fit(F.col("fold") != 2, 10.0), RT.Fit(F.lit(True), 100.0, F.col("feature").isin(3 * scale, 7 * scale))]
    w = RT.fit(d, fits).checkpoint()
    got = {r["feature"]: r for r in w.collect()}
    pred = {r["row"]: r for r in RT.predict(d, w).collect()}
    plain = [dense(rows, lambda r: r[1] != 1, .5), dense(rows, lambda r: r[1] != 2, 10.0), dense(rows, lambda r: True, 100.0, {3 * scale, 7 * scale})]
    for i, (want, y) in enumerate(plain):
        for f, v in want.items():
            assert got[f][f"w{i}"] == pytest.approx(v, abs=1e-7)
        assert [pred[r[0]][f"w{i}"] for r in rows] == pytest.approx(list(y), abs=1e-7)
    assert got[3 * scale]["w2"] == got[7 * scale]["w2"] == 0
    assert max(RT.violations(d, w, fits)) < 1e-6
    assert max(got) > 2 ** 31


def test_hot_features_are_dealt_to_salts(spark, monkeypatch):
    monkeypatch.setattr(RT, "SHARES", 20)
    rows = made(rows=200)
    d = RT.design(frame(spark, rows), ["row", "fold"])
    share = -(-sum(len(r[4]) + 1 for r in rows) // 20)
    salts = {r["feature"]: r["salts"] for r in d.hot.collect()}
    assert len(salts) < 20 and salts[RT.INTERCEPT] == -(-200 // share) and 0 in salts
    per = d.entries.groupBy("feature", "salt").count().agg(F.max("count")).first()[0]
    assert per <= 2 * share
    fits = [RT.Fit(F.lit(True), 1.0)]
    want = dense(rows, lambda r: True, 1.0)[0]
    got = {r["feature"]: r["w0"] for r in RT.fit(d, fits).collect()}
    assert all(got[f] == pytest.approx(v, abs=1e-7) for f, v in want.items())


def test_odd_tables(spark):
    empty = RT.design(frame(spark, []), ["row", "fold"])
    assert RT.fit(empty, [RT.Fit(F.lit(True), 1.0)]).collect() == []
    rows = [(1, 1, 2, 6.0, []), (2, 1, 1, 6.0, None), (3, 2, 1, 5.0, [(9, 0.0)])]
    d = RT.design(frame(spark, rows), ["row", "fold"])
    got = {r["feature"]: r for r in RT.fit(d, [RT.Fit(F.col("fold") == 1, 1.0), RT.Fit(F.col("fold") > 5, 1.0)]).collect()}
    assert list(got) == [RT.INTERCEPT] and got[RT.INTERCEPT]["w0"] == pytest.approx(4.0)
    with pytest.raises(ArithmeticError):
        RT.fit(RT.design(frame(spark, made()), ["row", "fold"]), [RT.Fit(F.lit(True), .5)], max_steps=2)
