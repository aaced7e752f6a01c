"""Design rows gathered without exchanging single entries, and fits of several folds in the same passes."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgrid.operators.models import ffm as M
from pairgrid.plans import design as D
from pairgrid.plans.learner_plans import holdout

N_FIELDS, WIDTH = 3, 12


def coded(spark):
    rows = [(i, float(i), i % 7, i % 3, i % 4, None if i % 5 == 0 else i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "idx long, y double, chem long, sp_code long, ch_code long, du_code long")
    fp = spark.createDataFrame([(c, b, 0.5 + b / 100) for c in range(6) for b in range(c, 1000, 90)], "chem long, bit int, val double")
    return D.Coded(df, fp, 3, 4, 2)


@pytest.mark.parametrize("names", [["species", "chem", "dur", "fp"], ["species", "dur", "fp", "inter"]])
def test_arrays_hold_the_entries_of_the_long_form(spark, names):
    c = coded(spark)
    long, width = D.design_long(c, names)
    want = sorted((r.idx, r.feature, r.val) for r in long.where("feature IS NOT NULL").collect())
    got, same_width = D.design_arrays(c, names, ["idx"])
    rows = got.collect()
    sizes = np.cumsum(D.block_sizes(c, names))
    assert same_width == width and sorted((r.idx, f, v) for r in rows for f, v in zip(r.fi, r.fv)) == want
    assert all(b == np.searchsorted(sizes, f, side="right") for r in rows for f, b in zip(r.fi, r.ff))
    text = io.StringIO()
    with redirect_stdout(text):
        got.explain(True)
    assert "Generate" not in text.getvalue()


def test_models_are_as_wide_as_the_bits_that_occur(spark):
    c, names = coded(spark), ["species", "dur", "fp", "inter"]
    few = D.occurring_bits(c)
    bits = sorted(r["bit"] for r in c.fp.select("bit").distinct().collect())
    assert few.n_bits == len(bits) < D.N_BITS and D.design_arrays(few, names, ["idx"])[1] == 3 + 2 + len(bits) * 4
    at, width = 5, D.N_BITS

    def entries(c, back):
        rows = D.design_arrays(c, names, ["idx"])[0].collect()
        return sorted((r.idx, back(f), v, b) for r in rows for f, v, b in zip(r.fi, r.fv, r.ff))
    old = lambda f: f if f < at else at + (f - at) // len(bits) * width + bits[(f - at) % len(bits)]
    assert entries(few, old) == entries(c, lambda f: f)
    assert D.occurring_bits(D.replace(c, fp=c.fp.where("false"))).n_bits == 0


def rows_of(spark, n=60):
    rng = np.random.default_rng(2)
    out = []
    for i in range(n):
        fi = rng.permutation(WIDTH)[:rng.integers(1, 6)]
        out.append((i, float(rng.normal()), int(i % 3 + 1) if i % 20 else None, [int(x) for x in fi], [float(x) for x in rng.uniform(0.2, 1.5, len(fi))], [int(x % N_FIELDS) for x in fi]))
    return spark.createDataFrame(out, "idx long, y double, fold int, fi array<int>, fv array<double>, ff array<int>").repartition(3).cache()


def error(rows, predict, *params):
    return sum((r.y - r.y_pred) ** 2 for r in predict(rows, *params).collect())


@pytest.mark.parametrize("together", [1, 10_000])
def test_folds_together_equal_fits_of_each_training_set(spark, monkeypatch, together):
    monkeypatch.setattr(M, "TOGETHER", together)
    rows = rows_of(spark)
    ffm = M.fit_ffm_folds(rows, [1, 2, 3], WIDTH, N_FIELDS, k=2, epochs=4)
    net = M.fit_hidden_layer_folds(rows, [1, 2, 3], WIDTH, m=4, epochs=4)
    for o in (1, 2, 3):
        train = rows.where(F.col("fold") != o)
        for got, want in ((ffm[o - 1], M.fit_ffm(train, WIDTH, N_FIELDS, k=2, epochs=4)), (net[o - 1], M.fit_hidden_layer(train, WIDTH, m=4, epochs=4))):
            assert all(np.allclose(a, b, rtol=1e-7, atol=1e-9) for a, b in zip(got, want))


def test_steps_follow_the_slope_of_the_squared_error(spark, monkeypatch):
    rows = rows_of(spark)
    seen = {}
    monkeypatch.setattr(M.Adam, "step", lambda self, w, g: (seen.setdefault("w", w.copy()), seen.setdefault("g", g.copy()), w)[2])
    n = rows.count()
    for fit, predict, unpack in (
            (lambda: M.fit_ffm(rows, WIDTH, N_FIELDS, k=2, epochs=1, reg=0.0), lambda r, p: M.predict_ffm(r, p, N_FIELDS, 2),
             lambda t: (t[0], t[1:1 + WIDTH], t[1 + WIDTH:].reshape(WIDTH, N_FIELDS, 2))),
            (lambda: M.fit_hidden_layer(rows, WIDTH, m=4, epochs=1, penalty=0.0), M.predict_hidden_layer,
             lambda t: (t[:48].reshape(WIDTH, 4), t[48:52], t[52:56], t[56]))):
        seen.clear()
        fit()
        for at in np.linspace(0, len(seen["w"]) - 1, 5).astype(int):
            up, down = seen["w"].copy(), seen["w"].copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            slope = (error(rows, predict, unpack(up)) - error(rows, predict, unpack(down))) / 2e-5 / 2 / n
            assert seen["g"][at] == pytest.approx(slope, rel=1e-4, abs=1e-7)


def test_all_folds_cost_one_job_an_epoch(spark, monkeypatch):
    calls = []
    passes = M.fold_sums
    monkeypatch.setattr(M, "fold_sums", lambda *a: (calls.append(len(a[4])), passes(*a))[1])
    rows = rows_of(spark)
    p = holdout(rows, None, lambda te, prm: M.predict_ffm(te, prm, N_FIELDS, 2), 3, lambda r, folds: M.fit_ffm_folds(r, folds, WIDTH, N_FIELDS, k=2, epochs=4))
    assert calls == [3] * 4 and p.count() == rows.where("fold IS NOT NULL").count()


def test_kernel_rows_are_summed_by_row(spark):
    rows = rows_of(spark)
    params = M.fit_kernel_linear(rows, WIDTH, m=8, gamma=0.1)
    Z, zz, root, w, gamma = params
    x = np.zeros((60, WIDTH))
    for r in rows.collect():
        x[r.idx, r.fi] = r.fv
    phi = np.hstack([np.exp(-gamma * ((x[:, None] - Z[None]) ** 2).sum(-1)) @ root, np.ones((60, 1))])
    got = {r.idx: r.y_pred for r in M.predict_kernel_linear(rows, params).collect()}
    assert np.allclose([got[i] for i in range(60)], phi @ w)
    y = np.array([r.y for r in rows.orderBy("idx").collect()])
    assert np.allclose(w, np.linalg.solve(phi.T @ phi + np.eye(9) / 2, phi.T @ y))
