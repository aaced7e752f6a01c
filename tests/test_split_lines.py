"""Fold cells as one line per group: splits without an exchange of expanded rows, predictions per group."""

import io
import math
from contextlib import redirect_stdout

import numpy as np

from pairgrid.operators.models import closed_form as CF
from pairgrid.plans import shrunk_means as SM
from pairgrid.plans.roles import with_folds

KEYS = ["setting", "model", "g"]


def observations(spark, n=600, seed=3):
    """Rows with null keys, null targets and a species that holds a third of them."""
    rng = np.random.default_rng(seed)
    rows = [(i, None if rng.random() < 0.03 else int(rng.integers(0, 9)) if rng.random() < 0.66 else 1, None if rng.random() < 0.03 else int(rng.integers(0, 40)),
             None if rng.random() < 0.03 else float(rng.normal())) for i in range(n)]
    return with_folds(spark.createDataFrame(rows, "idx long, species long, chem long, y double"))


def splits_by_rows(cells, k):
    """Nested sums of every (key, o, i) from a plain loop over cells; None where no cell of the side has a value."""
    out = {}
    for c in cells:
        for o in range(1, k + 1):
            if c["f"] is None or c["f"] == o:
                continue
            for i in range(1, k + 1):
                t = out.setdefault((*[c[x] for x in KEYS], o, i), {"tn": 0, "vn": 0, "tsy": [], "vsy": [], "vsyy": []})
                val = c["j"] == i
                t["vn" if val else "tn"] += c["n"]
                t["tsy"].append(0.0 if val else c["sy"])
                t["vsy"].append(c["sy"] if val else 0.0)
                t["vsyy"].append(c["syy"] if val else 0.0)
    total = lambda v: None if all(x is None for x in v) else sum(x for x in v if x is not None)
    return {key: {n: total(v) if isinstance(v, list) else v for n, v in t.items()} for key, t in out.items()}


def test_nested_sums_equal_a_loop_over_cells(spark):
    cells = SM.model_cells(observations(spark)).cache()
    want = splits_by_rows(cells.collect(), 5)
    got = {tuple(r[x] for x in [*KEYS, "o", "i"]): r for r in CF.split_stats(cells, KEYS, "f", 5, "j", 5).collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        for name, x in w.items():
            y = got[key][name]
            assert (x is None and y is None) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (key, name)


def test_groups_without_a_fold_keep_their_outer_splits(spark):
    cells = spark.createDataFrame([(None, None, 2, 3.0, 5.0), (7, 1, 1, 1.0, 1.0)], "g long, f int, n long, sy double, syy double")
    got = CF.split_stats(cells, ["g"], "f", 3).collect()
    assert sorted((r.g or 0, r.o, r.tn, r.vn) for r in got) == [(0, 1, 0, 0), (0, 2, 0, 0), (0, 3, 0, 0), (7, 1, 0, 1), (7, 2, 1, 0), (7, 3, 1, 0)]


def test_grouped_lines_give_splits_without_an_exchange(spark, tmp_path):
    lines = CF.group_cells(SM.model_cells(observations(spark)), KEYS, "f", 5, "j", 5)
    lines.write.parquet(str(tmp_path / "cells"))
    lines = spark.read.parquet(str(tmp_path / "cells"))
    for inner in ([], ["j", 5]):
        text = io.StringIO()
        with redirect_stdout(text):
            CF.split_stats(lines, KEYS, "f", 5, *inner).explain()
        assert "Exchange" not in text.getvalue()


def test_predictions_equal_a_join_of_exploded_rows(spark):
    obs = observations(spark).cache()
    cells = SM.model_cells(obs)
    best = spark.createDataFrame([(s, m, o, 10.0 / o) for s, m, _ in SM.MODEL_SPECS for o in range(1, 6) if (m, o) != ("LM1", 2)], "setting string, model string, fold int, alpha double")
    outer = CF.split_stats(cells, KEYS, "f", 5).join(best.withColumnRenamed("fold", "o"), ["setting", "model", "o"])
    preds = CF.group_predictions(outer, ["setting", "model", "o"], "g", "alpha")
    rows = SM.long_rows(obs).withColumnRenamed("f", "o").join(preds, ["setting", "model", "o", "g"])
    want = sorted((r.model, r.setting, r.o, r.idx, round(r.y_pred, 9)) for r in rows.collect())
    got = SM.holdout_predictions(obs, cells, best)
    assert got.columns == ["model", "setting", "fold", "index", "y_pred", "y"]
    assert sorted((r.model, r.setting, r.fold, r["index"], round(r.y_pred, 9)) for r in got.collect()) == want
    bare = SM.holdout_predictions(obs.drop("idx"), cells, best)
    assert bare.columns == ["model", "setting", "fold", "y_pred", "y"] and bare.count() == len(want)


def test_rows_meet_each_factor_once(spark):
    obs = observations(spark)
    plan = SM.wide_predictions(obs, SM.model_cells(obs), spark.createDataFrame([("setting1", "LM1", 1, 1.0)], "setting string, model string, fold int, alpha double"))
    text = io.StringIO()
    with redirect_stdout(text):
        plan.explain(True)
    optimized = text.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("Join LeftOuter") == 4  # the two null models by fold, species, chemical


def test_lines_of_rows_equal_lines_of_cells(spark):
    obs = observations(spark, n=900).cache()
    names = ["c_n", "c_sy", "c_syy", "f_n", "f_sy", "f_syy"]
    flat = lambda r: [None if x is None else round(x, 9) for c in names for x in r[c]]
    want = {tuple(r[k] for k in KEYS): r for r in CF.group_cells(SM.model_cells(obs), KEYS, "f", 5, "j", 5).collect()}
    hot = CF.split_hot(obs, ["species", "chem"])["species"][1]
    assert hot.where("species = 1").count() == obs.where("species = 1").count()
    for share in (CF.HOT_SHARE, 0.3, 1.0):  # most groups, one group, no group summed before the exchange
        CF.HOT_SHARE, kept = share, CF.HOT_SHARE
        try:
            got = SM.model_lines(obs).collect()
        finally:
            CF.HOT_SHARE = kept
        assert len(got) == len(want)
        for r in got:
            w = want[tuple(r[k] for k in KEYS)]
            assert flat(r) == flat(w) and [x > 0 for x in r["f_cells"]] == [x > 0 for x in w["f_cells"]]


def test_usual_rows_are_exchanged_once_per_factor(spark):
    obs = observations(spark)
    text = io.StringIO()
    with redirect_stdout(text):
        CF.group_rows(obs, "species", [("setting1", "LM1", "fold1", "inner1"), ("setting2", "LM1", "fold2", "inner2")], 5, 5).explain()
    assert text.getvalue().count("Exchange hashpartitioning") == 1
