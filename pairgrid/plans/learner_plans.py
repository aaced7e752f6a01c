"""Learner queries (R3–R11 for the model families, R13, U1).

Design rows are built once per (model, setting) and checkpointed to the
shared checkpoint folder: iterative fits then read a short lineage, and a
lost executor recomputes from the checkpoint, not from the raw tables.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgrid.functions.columns import cut_right_closed
from pairgrid.operators import curate as CU
from pairgrid.operators import features as FT
from pairgrid.operators import report as G
from pairgrid.operators.models import boosting as B
from pairgrid.operators.models import closed_form as CF
from pairgrid.operators.models import ffm as M
from pairgrid.operators.models import learners as L
from pairgrid.operators.models import ridge_path as RP
from pairgrid.operators.reshape import best_per_group, union_predictions
from pairgrid.plans import design as D
from pairgrid.plans import shrunk_means as SM
from pairgrid.plans.curation import EDGES_SQL
from pairgrid.plans.feature_plans import CHEM_TEXT_SQL, CODES_SQL, DESIGN4_SQL, FP_SQL
from pairgrid.plans.roles import K_FOLDS, OBS_SQL, observations, with_sql
from pairgrid.session import ensure_checkpoint_dir

FOLD_COL = {"setting1": "fold1", "setting2": "fold2"}
INNER_COL = {"setting1": "inner1", "setting2": "inner2"}


def design_rows(spark, sf_dir, model: str, setting: str, coded: D.Coded | None = None, vectors: bool = True):
    """(idx, y, fold, features) or, with ``vectors=False``, per-row arrays
    (idx, y, fold, fi, fv, ff) and the chemical as grp for the numpy kernels, rows of one
    chemical together; plus the width."""
    c = coded or D.coded_observations(spark, sf_dir)
    names = D.blocks(model, setting)
    c = replace(c, rows=c.rows.withColumn("fold", F.col(FOLD_COL[setting])).withColumn("inner", F.col(INNER_COL[setting])))
    labels = ["idx", "y", "fold", "inner"]
    if vectors:
        rows, width = D.design_arrays(c, names, labels)
        rows = FT.vectors_from_arrays(rows, labels, width)
    else:
        near = c.rows.withColumn("grp", F.col("chem").cast("long")).repartitionByRange(B.tasks_for(c.rows), "grp", "idx")
        rows, width = D.design_arrays(replace(c, rows=near), names, [*labels, "grp"])
        rows = rows.sortWithinPartitions("grp", "idx")
    ensure_checkpoint_dir(spark)
    return rows.checkpoint(eager=True), width, len(names)


def holdout(rows: DataFrame, fit, predict=None, k: int = K_FOLDS, fit_all=None) -> DataFrame:
    """Fit on ``fold <> o``, predict ``fold = o``, for every outer fold o (R11). ``fit_all``
    makes the models of several folds in the same passes over the rows."""
    models = fit_all(rows, range(1, k + 1)) if fit_all else (fit(rows.filter(F.col("fold") != o)) for o in range(1, k + 1))
    outs = []
    for o, model in zip(range(1, k + 1), models):
        test = rows.filter(F.col("fold") == o)
        p = predict(test, model) if predict else model.transform(test)
        outs.append(p.select(F.col("idx").alias("index"), F.lit(o).alias("fold"), "y", "y_pred"))
    return reduce(lambda a, b: a.unionByName(b), outs)


def fold_report(pred: DataFrame, model: str, setting: str) -> DataFrame:
    """Per-fold RMSE and rows of a holdout run, with the model and setting."""
    r = G.rmse_pooled(pred, ["fold"])
    return r.select(F.lit(model).alias("model"), F.lit(setting).alias("setting"), "fold",
                    F.round("rmse", 6).alias("rmse"), "n")


#: Fields of LM4 in setting1 that a row does not share with the others of its chemical: species, bin.
OWN = (0, 2)
RIDGE_ALPHA = 10.0


def ridge_predictions(spark, sf_dir, model: str, setting: str, alpha: float = RIDGE_ALPHA, coded=None):
    rows, _, _ = design_rows(spark, sf_dir, model, setting, coded)
    return holdout(rows, lambda tr: L.fit_ridge(tr, alpha))


def ridge_problem(spark, sf_dir) -> RP.Problem:
    """LM3 and LM4 of both settings as fold cells; rows need no id for that."""
    ensure_checkpoint_dir(spark)
    obs = observations(spark, sf_dir, index=False)
    edges = CU.frequent_edges(obs, "duration", lo=0.0, min_share=D.EDGE_SHARE)
    rows = CU.category_code(obs.withColumn("d", cut_right_closed("duration", edges) - 1), "species", "s")
    fp = CU.log_ratio_scale(D.chem_fingerprint(spark, sf_dir, obs), "bit", "cnt", "val")
    rows = rows.select("s", F.col("chem").alias("c"), "d", "y", "fold1", "fold2", "inner1", "inner2")
    return RP.problem(rows, fp.select(F.col("chem").alias("c"), "bit", "val"), SM.SETTING_FOLDS, K_FOLDS)


def ridge_path(spark, sf_dir):
    """The problem, its narrow weights, all validation errors and the chosen penalties."""
    p = ridge_problem(spark, sf_dir)
    weights = RP.solve(p, CF.ALPHA_GRID)
    scores = RP.score(p, weights).checkpoint(eager=True)
    return p, weights, scores, SM.best_alphas(RP.grid(scores)).select("setting", "model", "fold", "alpha").checkpoint(eager=True)


def q_grid_search_ridge(spark, sf_dir):
    """R12 for LM3 and LM4: all penalties on nested folds from one scan."""
    p = ridge_problem(spark, sf_dir)
    return RP.grid(RP.score(p, RP.solve(p, CF.ALPHA_GRID))).select("setting", "model", "fold", "alpha", F.round("rmse", 6).alias("rmse"))


def _chosen_scores(scores: DataFrame, best: DataFrame) -> DataFrame:
    return scores.where("i = 0").withColumnRenamed("o", "fold").join(F.broadcast(best), ["setting", "model", "fold", "alpha"])


def q_fit_ridge(spark, sf_dir):
    """The outer fits at the penalty that nested folds choose."""
    _, _, scores, best = ridge_path(spark, sf_dir)
    return _chosen_scores(scores, best).select("model", "setting", "fold", F.round(F.sqrt(F.col("sse") / F.col("n")), 6).alias("rmse"), "n")


def q_ridge_normal_equations(spark, sf_dir):
    """What any right fit fulfils: per outer fold of LM3 and LM4 the rows, the largest
    violated normal equation (from predictions, not from the solver's sums) and whether
    the training error is no worse than that of the training mean."""
    p, weights, _, best = ridge_path(spark, sf_dir)
    predicted, narrow, of_chems = RP.fitted(p, weights, best)
    predicted = predicted.checkpoint(eager=True)
    keys = ["setting", "model", "fold"]
    residual = RP.normal_equations(p, predicted, narrow.union(of_chems))
    train, test = F.col("f") != F.col("fold"), F.col("f") == F.col("fold")
    total = lambda c, side: F.sum(F.when(side, F.col(c)).otherwise(0))
    loss = F.col("n") * F.col("y_pred") * F.col("y_pred") - 2 * F.col("sy") * F.col("y_pred")  # squared error less the sum of y^2
    sums = predicted.groupBy(*keys).agg(total("n", train).alias("n_train"), total("n", test).alias("n_test"), total("sy", train).alias("sy"), F.sum(F.when(train, loss).otherwise(0.0)).alias("loss"))
    null = -F.col("sy") * F.col("sy") / F.col("n_train")
    return sums.join(residual, keys).select(*keys, F.col("n_train").cast("long").alias("n_train"), F.col("n_test").cast("long").alias("n_test"),
                                            F.round("residual", 6).alias("residual"), (F.col("loss") <= null + 1e-6).alias("fits_training"))


def ridge_row_predictions(spark, sf_dir) -> DataFrame:
    """R11 for LM3 and LM4: (model, setting, fold, index, y_pred, y) of every row."""
    p, weights, _, best = ridge_path(spark, sf_dir)
    cells = RP.fitted(p, weights, best)[0].where("f = fold").select("setting", "model", "fold", "s", "c", "d", "y_pred")
    obs = observations(spark, sf_dir)
    edges = CU.frequent_edges(obs, "duration", lo=0.0, min_share=D.EDGE_SHARE)
    rows = CU.category_code(obs.withColumn("d", cut_right_closed("duration", edges) - 1), "species", "s")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("setting"), F.col(f).cast("int").alias("fold")) for s, (f, _) in SM.SETTING_FOLDS.items()]))
    rows = rows.select(each.alias("x"), F.col("s").cast("long").alias("s"), F.col("chem").cast("long").alias("c"), F.coalesce(F.col("d").cast("long"), F.lit(-1).cast("long")).alias("d"), "idx", "y").select("x.*", "s", "c", "d", "idx", "y")
    return rows.join(cells, ["setting", "fold", "s", "c", "d"]).select("model", "setting", "fold", F.col("idx").alias("index"), "y_pred", "y")


def q_fit_ridge_interactions(spark, sf_dir):
    c = D.occurring_bits(D.coded_observations(spark, sf_dir))
    return union_predictions([fold_report(ridge_predictions(spark, sf_dir, "LM5", s, coded=c), "LM5", s)
                              for s in ["setting1", "setting2"]])


#: The reference's number of trees, share of features and of rows, and least leaf (RF_optimal.csv); zeros are
#: parted from other values as there; trees end at depth 12.
FOREST = {"n_estimators": 300, "max_features": 0.25, "max_samples": 0.5, "min_leaf": 1, "max_depth": 12, "alone": True}


def q_fit_forest(spark, sf_dir):
    blocks, _ = boosted_blocks(spark, sf_dir)
    fits, trees = L.fit_forest(blocks, SM.SETTING_FOLDS, "setting1", range(1, K_FOLDS + 1), **FOREST)
    # a fold's rows are predicted by its own trees alone
    p = union_predictions([B.predict(blocks, SM.SETTING_FOLDS, [f], [t]).select("index", "fold", "y", "y_pred") for f, t in zip(fits, trees)])
    return fold_report(p, "RF", "setting1")


#: Boosting of the registered queries; the grid's other axes are parameters of ``B.Fit``.
BOOST = {"depth": 4, "l2": 10.0, "gamma": 0.0, "subsample": 0.75}
BOOST_ROUNDS, BOOST_PATIENCE = 20, 5
#: Leaf penalty and start of the query that shows the first cut: far from the targets, the penalty leaves the first root whole.
CUT_L2, CUT_START = 1.0, 4.5


def boosted_blocks(spark, sf_dir):
    """LM4's features of both settings in blocks, and the chem range that setting2 hides."""
    c = D.coded_observations(spark, sf_dir)
    chems, durations, bits = c.n_species, c.n_species + c.n_chem, c.n_species + c.n_chem + c.n_bins
    fp = B.binned(c.fp.where("val != 0"), "bit", "val")
    per_chem = fp.groupBy("chem").agg(F.sort_array(F.collect_list(F.struct((F.col("bit") + F.lit(bits)).cast("long").alias("feature"), "bin"))).alias("fp"))
    one = lambda at: F.array(F.struct(at.cast("long").alias("feature"), F.lit(0).alias("bin")))
    none = F.array().cast("array<struct<feature:bigint,bin:int>>")
    cells = F.concat(one(F.col("sp_code")), one(F.col("ch_code") + F.lit(chems)),
                     F.when(F.col("du_code").isNotNull(), one(F.col("du_code") + F.lit(durations))).otherwise(none), F.coalesce("fp", none))
    rows = c.rows.join(per_chem, "chem", "left").withColumn("cells", cells)
    ensure_checkpoint_dir(spark)
    blocks = B.pack(rows.select("idx", "y", F.col("cells.feature").alias("features"), F.col("cells.bin").alias("bins"), (F.col("ch_code") + F.lit(chems)).cast("long").alias("own"),
                                *[f for pair in SM.SETTING_FOLDS.values() for f in pair]), SM.SETTING_FOLDS, B.tasks_for(c.rows), "own")
    return blocks, {"setting2": (chems, durations)}


def boosted_grid(spark, sf_dir):
    """Blocks, the grown inner and outer fits of both settings and all folds, and their curves."""
    blocks, hidden = boosted_blocks(spark, sf_dir)
    fits = [B.Fit(s, o, i, **BOOST) for s in SM.SETTING_FOLDS for o in range(1, K_FOLDS + 1) for i in range(K_FOLDS + 1)]
    grown = B.Booster(blocks, fits, SM.SETTING_FOLDS, hidden).grow(BOOST_ROUNDS, BOOST_PATIENCE)
    return blocks, grown, B.curve_table(spark, grown)


def boosted_predictions(spark, sf_dir, held_only: bool = True) -> DataFrame:
    """Rows predicted by the fit of the outer training set, cut at the round where the
    mean curve over its inner folds is least; rows of the test fold, or all with ``held``."""
    blocks, grown, curves = boosted_grid(spark, sf_dir)
    keys = ["setting", "fold"]
    best = {(r["setting"], r["fold"]): r["best_round"] for r in G.curve_argmin(G.curve_mean(curves, keys), keys).collect()}
    outer = [k for k, f in enumerate(grown.fits) if not f.i]
    trees = [grown.trees[k][:best[grown.fits[k].setting, grown.fits[k].o]] for k in outer]
    return B.predict(blocks, SM.SETTING_FOLDS, [grown.fits[k] for k in outer], trees, held_only).withColumn("model", F.lit("XGB"))


def q_boosted_early_stop(spark, sf_dir):
    """G12-G14 on the validation curves of boosting: every inner fold's stop, the mean curve's best round."""
    _, _, curves = boosted_grid(spark, sf_dir)
    keys = ["setting", "fold"]
    stops = G.early_stop_round(curves, [*keys, "inner"], BOOST_PATIENCE).groupBy(*keys).agg(F.max("stop_round").alias("stop_round"))
    best = G.curve_argmin(G.curve_mean(curves, keys), keys)
    return stops.join(best, keys).select(*keys, "stop_round", "best_round", F.round("best_score", 6).alias("best_score"))


def q_fit_boosted(spark, sf_dir):
    """R6 in both settings, as what any right nested run fulfils: every row predicted once by the
    fold that holds it, and a training error no worse than that of the training mean."""
    p = boosted_predictions(spark, sf_dir, held_only=False)
    held, train = F.col("held"), lambda c: F.sum(F.when(~F.col("held"), c).otherwise(0.0))
    sums = p.groupBy("model", "setting", "fold").agg(
        F.sum(held.cast("long")).alias("n"), F.countDistinct(F.when(held, F.col("index"))).alias("n_index"), F.sum((~held).cast("long")).alias("n_train"),
        train(F.col("y")).alias("sy"), train(F.col("y") * F.col("y")).alias("syy"), train((F.col("y") - F.col("y_pred")) ** 2).alias("sse"))
    null = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n_train")
    return sums.select("model", "setting", "fold", "n", "n_index", "n_train", (F.col("sse") <= null + 1e-6).alias("fits_training"))


def q_boosted_first_cut(spark, sf_dir):
    """The first tree's root over whole outer training sets: rows, best gain and the gradient sums of its sides."""
    blocks, hidden = boosted_blocks(spark, sf_dir)
    fits = [B.Fit(s, o, 0, depth=1, l2=CUT_L2, start=CUT_START) for s in SM.SETTING_FOLDS for o in range(1, K_FOLDS + 1)]
    grown = B.Booster(blocks, fits, SM.SETTING_FOLDS, hidden).grow(1, 1)
    rows = [(f.setting, f.o, float(t[0].gain[0]), float(max(t[0].value[1:])), float(min(t[0].value[1:]))) for f, t in zip(grown.fits, grown.trees) if t[0].feature[0] >= 0]
    out = spark.createDataFrame(rows, "setting string, fold int, gain double, high double, low double")
    return out.select("setting", "fold", *[F.round(c, 6).alias(c) for c in ("gain", "high", "low")])


def q_fit_fm(spark, sf_dir):
    rows, width, _ = design_rows(spark, sf_dir, "LM4", "setting1", vectors=False)
    p = holdout(rows, None, lambda te, prm: M.predict_fm(te, prm),
                fit_all=lambda r, folds: M.fit_fm_folds(r, folds, width, k=8, reg=1e-4, epochs=40, step=0.03, own=OWN))
    return fold_report(p, "XL5a", "setting1")


FFM_K = 4


def ffm_tables(spark, sf_dir):
    c = D.coded_observations(spark, sf_dir)
    names = D.blocks("LM4", "setting1")
    rows, width = D.design_arrays(c, names, ["idx"])
    # a row is exchanged as one line and its entries are laid out where it lies
    lg = rows.repartition("idx").select("idx", F.explode(F.arrays_zip("fi", "fv", "ff")).alias("_e"))
    lg = lg.select("idx", F.col("_e.fi").alias("feature"), F.col("_e.fv").alias("val"), F.col("_e.ff").alias("field"))
    feats = spark.range(width).select(F.col("id").cast("int").alias("feature"))
    return lg, M.hashed_factors(feats, len(names), FFM_K), M.hashed_linear(feats), width * len(names) * FFM_K


def q_score_ffm(spark, sf_dir):
    lg, factors, linear, n_factor_rows = ffm_tables(spark, sf_dir)
    s = M.score_ffm(lg, factors, linear, 4.0, factor_rows=n_factor_rows, together=True)
    return s.select("idx", F.round("y_pred", 6).alias("y_pred"))


def q_fit_ffm(spark, sf_dir):
    rows, width, n_fields = design_rows(spark, sf_dir, "LM4", "setting1", vectors=False)
    p = holdout(rows, None, lambda te, prm: M.predict_ffm(te, prm, n_fields, FFM_K),
                fit_all=lambda r, folds: M.fit_ffm_folds(r, folds, width, n_fields, k=FFM_K, reg=1e-5, epochs=15, lr=0.05, own=OWN))
    return fold_report(p, "XL5b", "setting1")


def q_fit_kernel_linear(spark, sf_dir):
    rows, width, _ = design_rows(spark, sf_dir, "LM4", "setting1", vectors=False)
    p = holdout(rows, None, lambda te, prm: M.predict_kernel_linear(te, prm),
                fit_all=lambda r, folds: M.fit_kernel_linear_folds(r, folds, width, m=64, gamma=0.02, c=1.0, own=OWN))
    return fold_report(p, "SVR", "setting1")


def q_fit_hidden_layer(spark, sf_dir):
    rows, width, _ = design_rows(spark, sf_dir, "LM4", "setting1", vectors=False)
    p = holdout(rows, None, lambda te, prm: M.predict_hidden_layer(te, prm),
                fit_all=lambda r, folds: M.fit_hidden_layer_folds(r, folds, width, m=32, penalty=1e-4, epochs=25, lr=0.02, own=OWN))
    return fold_report(p, "TF5", "setting1")


def all_predictions(spark, sf_dir) -> DataFrame:
    """Closed-form family ∪ ridge family at chosen penalties, one long prediction table."""
    return union_predictions([SM.predictions(spark, sf_dir), ridge_row_predictions(spark, sf_dir)])


def q_union_predictions(spark, sf_dir):
    p = all_predictions(spark, sf_dir)
    return p.groupBy("model", "setting").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("index").alias("n_index"))


def q_predict_holdout_learners(spark, sf_dir):
    """R11 across families, reported as pooled RMSE per (model, setting)."""
    r = G.rmse_pooled(all_predictions(spark, sf_dir), ["model", "setting"])
    return r.select("model", "setting", F.round("rmse", 6).alias("rmse"), "n")


# --- R13: second grid around the first grid's choice ------------------------------------

REFINE_FACTORS = [0.25, 0.5, 1.0, 2.0, 4.0]


def refine_grid(cells: DataFrame, best: DataFrame) -> DataFrame:
    """Score α·f for f in REFINE_FACTORS around each (setting, model, fold)'s
    first choice, on the same nested folds; keep the best refined α."""
    nested = CF.split_stats(cells, ["setting", "model", "g"], "f", K_FOLDS, "j", K_FOLDS)
    b = best.select("setting", "model", F.col("fold").alias("o"), F.col("alpha").alias("alpha0"))
    s = nested.join(F.broadcast(b), ["setting", "model", "o"]) \
              .withColumn("alpha", F.explode(F.array(*[F.col("alpha0") * F.lit(f) for f in REFINE_FACTORS])))
    per_inner = CF.score_shrunk_mean(s, ["setting", "model", "o", "i"], alpha_col="alpha")
    grid = per_inner.groupBy("setting", "model", "o", "alpha").agg(F.avg("rmse").alias("rmse")) \
                    .withColumnRenamed("o", "fold")
    return best_per_group(grid, ["setting", "model", "fold"],
                          [F.round("rmse", CF.SCORE_DIGITS).asc_nulls_last(), F.col("alpha").asc()])


def q_grid_refine(spark, sf_dir):
    cells = SM.materialized_cells(spark, sf_dir)
    r = refine_grid(cells, SM.best_alphas(SM.grid_scores(cells)))
    return r.select("setting", "model", "fold", "alpha", F.round("rmse", 6).alias("rmse"))


QUERIES = {
    "grid_search_ridge": q_grid_search_ridge,
    "fit_ridge": q_fit_ridge,
    "ridge_normal_equations": q_ridge_normal_equations,
    "fit_ridge_interactions": q_fit_ridge_interactions,
    "fit_forest": q_fit_forest,
    "fit_boosted": q_fit_boosted,
    "boosted_early_stop": q_boosted_early_stop,
    "boosted_first_cut": q_boosted_first_cut,
    "fit_fm": q_fit_fm,
    "score_ffm": q_score_ffm,
    "fit_ffm": q_fit_ffm,
    "fit_kernel_linear": q_fit_kernel_linear,
    "fit_hidden_layer": q_fit_hidden_layer,
    "union_predictions": q_union_predictions,
    "predict_holdout_learners": q_predict_holdout_learners,
    "grid_refine": q_grid_refine,
}

# --- oracles ---------------------------------------------------------------------------------

_FFM_SQL = f"""
nfeat AS (SELECT ns + nc + nb + 1024 AS width FROM sizes),
feats AS (SELECT CAST(range AS INTEGER) AS feature FROM nfeat, range(0, width)),
fld AS (SELECT d.idx, d.feature, d.val, CASE WHEN feature < ns THEN 0 WHEN feature < ns + nc THEN 1
               WHEN feature < ns + nc + nb THEN 2 ELSE 3 END AS field FROM design d, sizes),
fac AS (SELECT f.feature, t.tf AS tfield, p.pos,
               (CAST(('0x' || substr(md5(concat(concat_ws('|', CAST(f.feature AS VARCHAR), CAST(t.tf AS VARCHAR),
                 CAST(p.pos AS VARCHAR)), '#ffm')), 1, 8)) AS BIGINT) / 4294967296.0 - 0.5) * ({0.5 / FFM_K ** 0.5!r}) AS v
        FROM feats f, (SELECT CAST(range AS INTEGER) AS tf FROM range(0, 4)) t,
             (SELECT CAST(range AS INTEGER) AS pos FROM range(0, {FFM_K})) p),
facl AS MATERIALIZED (SELECT feature, tfield, list(v ORDER BY pos) AS vl FROM fac GROUP BY feature, tfield),
lin AS (SELECT feature, (CAST(('0x' || substr(md5(concat(CAST(feature AS VARCHAR), '#ffm-w')), 1, 8)) AS BIGINT)
                         / 4294967296.0 - 0.5) * 0.1 AS w FROM feats),
pr AS MATERIALIZED (SELECT a.idx, a.feature AS fa_, a.field AS la, a.val AS xa, b.feature AS fb_, b.field AS lb, b.val AS xb
                    FROM fld a JOIN fld b ON a.idx = b.idx AND a.feature < b.feature),
pa AS MATERIALIZED (SELECT pr.*, va.vl AS vla FROM pr JOIN facl va ON va.feature = pr.fa_ AND va.tfield = pr.lb),
pairs AS (SELECT pa.idx, sum(list_dot_product(pa.vla, vb.vl) * pa.xa * pa.xb) AS inter
          FROM pa JOIN facl vb ON vb.feature = pa.fb_ AND vb.tfield = pa.la
          GROUP BY pa.idx),
lsum AS (SELECT idx, sum(w * val) AS lin FROM fld JOIN lin USING (feature) GROUP BY idx)"""

ORACLES = {
    "ridge_normal_equations": with_sql(OBS_SQL) + """
SELECT m.setting, m.model, o.fold, count(*) FILTER (f <> o.fold) AS n_train, count(*) FILTER (f = o.fold) AS n_test,
       0.0::DOUBLE AS residual, true AS fits_training
FROM (SELECT 'setting1' AS setting, fold1 AS f FROM obs UNION ALL SELECT 'setting2', fold2 FROM obs) r
JOIN (VALUES ('setting1', 'LM3'), ('setting1', 'LM4'), ('setting2', 'LM4')) m(setting, model) USING (setting),
     (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS fold) o
GROUP BY ALL""",
    "fit_boosted": with_sql(OBS_SQL) + """
SELECT 'XGB' AS model, setting, fold, count(*) FILTER (f = fold) AS n, count(DISTINCT idx) FILTER (f = fold) AS n_index,
       count(*) FILTER (f <> fold) AS n_train, true AS fits_training
FROM (SELECT 'setting1' AS setting, fold1 AS f, idx FROM obs UNION ALL SELECT 'setting2', fold2, idx FROM obs),
     (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS fold) GROUP BY ALL""",
    # every distinct value is a cut, absent entries on either side
    "boosted_first_cut": with_sql(OBS_SQL, EDGES_SQL, CHEM_TEXT_SQL, FP_SQL, CODES_SQL, DESIGN4_SQL) + f""",
r AS (SELECT 'setting1' AS setting, fold1 AS f, idx, {CUT_START} - y AS g FROM obs
      UNION ALL SELECT 'setting2', fold2, idx, {CUT_START} - y FROM obs),
cell AS (SELECT setting, f, feature, val, sum(g) AS g, count(*) AS h
         FROM r JOIN design d USING (idx), sizes
         WHERE d.val <> 0 AND (setting = 'setting1' OR feature < ns OR feature >= ns + nc) GROUP BY ALL),
fold AS (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS fold),
total AS (SELECT setting, fold, sum(g) AS gt, count(*) AS ht FROM r, fold WHERE f <> fold GROUP BY ALL),
upto AS (SELECT setting, fold, feature, val, sum(g) AS g, sum(h) AS h FROM cell, fold WHERE f <> fold GROUP BY ALL),
cum AS (SELECT setting, fold, sum(g) OVER (w ORDER BY val) AS gl, sum(h) OVER (w ORDER BY val) AS hl, sum(g) OVER w AS gp, sum(h) OVER w AS hp
        FROM upto WINDOW w AS (PARTITION BY setting, fold, feature)),
side AS (SELECT setting, fold, gl, hl, gt, ht FROM cum JOIN total USING (setting, fold)
         UNION ALL SELECT setting, fold, gl + gt - gp, hl + ht - hp, gt, ht FROM cum JOIN total USING (setting, fold)),
gain AS (SELECT *, round(gl * gl / (hl + {CUT_L2}) + (gt - gl) * (gt - gl) / (ht - hl + {CUT_L2}) - gt * gt / (ht + {CUT_L2}), 9) AS gain,
                -{B.STEP} * gl / (hl + {CUT_L2}) AS a, -{B.STEP} * (gt - gl) / (ht - hl + {CUT_L2}) AS b
         FROM side WHERE hl >= 1 AND ht - hl >= 1)
SELECT setting, fold, round(max(c.gain), 6) AS gain, round(arg_max(greatest(a, b), c.gain), 6) AS high, round(arg_max(least(a, b), c.gain), 6) AS low
FROM gain c WHERE c.gain > {B.LEAST} GROUP BY setting, fold""",
    "union_predictions": with_sql(OBS_SQL) + """
SELECT m.model, m.setting, count(*) AS n, count(DISTINCT idx) AS n_index
FROM obs, (VALUES ('LM0', 'setting1'), ('LM1', 'setting1'), ('LM2', 'setting1'), ('LM3', 'setting1'), ('LM4', 'setting1'),
                  ('LM0', 'setting2'), ('LM1', 'setting2'), ('LM4', 'setting2')) m(model, setting) GROUP BY ALL""",
    "score_ffm": with_sql(OBS_SQL, EDGES_SQL, CHEM_TEXT_SQL, FP_SQL, CODES_SQL, DESIGN4_SQL, _FFM_SQL)
    + "SELECT l.idx, round(4.0 + l.lin + coalesce(p.inter, 0), 6) AS y_pred FROM lsum l LEFT JOIN pairs p USING (idx)",
    "grid_refine": with_sql(OBS_SQL, SM.LONG_SQL, SM.GRID_SQL) + """,
ra AS (SELECT setting, model, fold AS o, alpha * f AS alpha FROM best, (SELECT unnest(""" + repr(REFINE_FACTORS) + """) AS f)),
rtr AS (SELECT l.setting, l.model, s.o, s.i, l.g, count(*) AS n, sum(l.y) AS sy
        FROM long l JOIN splits s ON l.f <> s.o AND l.j <> s.i GROUP BY ALL),
rfit AS (SELECT rtr.*, ra.alpha, n * ra.alpha / (n + ra.alpha) AS c, sy / n AS m FROM rtr JOIN ra USING (setting, model, o)),
ricpt AS (SELECT setting, model, o, i, alpha, sum(c * m) / sum(c) AS b FROM rfit GROUP BY ALL),
rval AS (SELECT l.setting, l.model, s.o, s.i, ra.alpha, l.y,
                coalesce(ic.b + rfit.n * (rfit.m - ic.b) / (rfit.n + ra.alpha), ic.b) AS p
         FROM long l JOIN splits s ON l.f <> s.o AND l.j = s.i
         JOIN ra ON ra.setting = l.setting AND ra.model = l.model AND ra.o = s.o
         JOIN ricpt ic ON ic.setting = l.setting AND ic.model = l.model AND ic.o = s.o AND ic.i = s.i AND ic.alpha = ra.alpha
         LEFT JOIN rfit ON rfit.setting = l.setting AND rfit.model = l.model AND rfit.o = s.o AND rfit.i = s.i
                       AND rfit.alpha = ra.alpha AND rfit.g = l.g),
rgrid AS (SELECT setting, model, o AS fold, alpha, avg(r) AS rmse FROM
          (SELECT setting, model, o, i, alpha, sqrt(avg((y - p) * (y - p))) AS r FROM rval GROUP BY ALL) GROUP BY ALL)
SELECT setting, model, fold, alpha, round(rmse, 6) AS rmse FROM (
  SELECT *, row_number() OVER (PARTITION BY setting, model, fold ORDER BY round(rmse, 9), alpha) AS rn FROM rgrid)
WHERE rn = 1""",
}
