"""Sparse lines are made where the rows lie: no entry of a row is exchanged by itself."""

from pairgrid.plans import design as D
from pairgrid.plans import feature_plans as FP
from tests.conftest import SF_SMALL


def test_lines_are_those_of_the_long_design(spark):
    c, g, width = FP._lm4_long_with_label(spark, SF_SMALL)
    plan = g._jdf.queryExecution().toString()
    assert "Generate explode" not in plan and "ObjectHashAggregate(keys=[idx" not in plan
    lg, wide = D.design_long(c, D.blocks("LM4", "setting1"))
    want = {}
    for r in lg.collect():
        want.setdefault(r["idx"], []).append((r["feature"], r["val"]))
    got = {r["idx"]: [(x["feature"], x["val"]) for x in r["e"]] for r in g.collect()}
    assert width == wide and got == {k: sorted(v) for k, v in want.items()}


def test_a_null_code_is_an_entry_without_a_feature(spark):
    rows = spark.createDataFrame([(0, 1.0, 7, None, 0, None), (1, 2.0, None, None, None, None), (2, 3.0, 8, 0, 1, 1)], "idx long, y double, chem long, sp_code long, ch_code long, du_code long")
    fp = spark.createDataFrame([(7, 3, .5)], "chem long, bit int, val double")
    coded = D.Coded(rows, fp, 1, 2, 2)
    kept, FP.D.coded_observations = FP.D.coded_observations, lambda *a: coded
    try:
        got = {r["idx"]: [tuple(x) for x in r["e"]] for r in FP._lm4_long_with_label(spark, None)[1].collect()}
    finally:
        FP.D.coded_observations = kept
    assert got == {0: [(None, 1.0), (None, 1.0), (1, 1.0), (8, .5)], 1: [(None, 1.0)] * 3, 2: [(0, 1.0), (2, 1.0), (4, 1.0)]}
