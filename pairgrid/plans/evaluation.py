"""Evaluation and data-description queries.

Predictions come from the closed-form family (R0–R2 via nested CV); the
descriptive queries read the observation table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrid.operators import report as G
from pairgrid.operators import reshape as W
from pairgrid.operators.curate import join_predictions, semi_membership
from pairgrid.operators.folds import split_cells
from pairgrid.operators.models.closed_form import cell_stats, score_shrunk_mean, split_stats
from pairgrid.plans import shrunk_means as SM
from pairgrid.plans.roles import (
    K_FOLDS, LI_HASH_KEYS, LI_SQL, LI_TIEBREAK, OBS_SQL, ROW_SEED, index_buckets, load, observations, with_sql)
from pairgrid.sources import writers as K


def predictions(spark: SparkSession, sf_dir: str, index: bool = True) -> DataFrame:
    return SM.predictions(spark, sf_dir, index)


def _r6(c: str):
    return F.round(c, 6).alias(c)


# --- descriptive (observation table) --------------------------------------------------

def q_count_by(spark, sf_dir):
    return G.count_by(observations(spark, sf_dir, index=False), ["species"])


def q_value_counts(spark, sf_dir):
    return G.value_counts(observations(spark, sf_dir, index=False), ["duration"])


def q_count_distinct(spark, sf_dir):
    return G.count_distinct(observations(spark, sf_dir, index=False), ["species", "chem", "duration"])


def q_count_distinct_approx(spark, sf_dir):
    """HyperLogLog++ form of G3 (rsd 1%): checked by tolerance, not by SQL."""
    return G.count_distinct(observations(spark, sf_dir, index=False), ["species", "chem", "duration"], approx=True)


def q_distinct_per_group(spark, sf_dir):
    return G.distinct_per_group(observations(spark, sf_dir, index=False), "chem", "species")


def q_distinct_keep_first(spark, sf_dir):
    obs = observations(spark, sf_dir).select("chem", "idx", "species", "duration")
    return W.best_per_group(obs, ["chem"], ["idx"])


def q_coverage_density(spark, sf_dir):
    d = G.coverage_density(observations(spark, sf_dir, index=False), "chem", "species")
    return d.select("n_chem", "n_species", "n_pairs", _r6("density_pct"))


def q_mean_log_by_pair(spark, sf_dir):
    m = G.mean_log_by_pair(observations(spark, sf_dir, index=False), "chem", "species", "value")
    return m.select("chem", "species", F.round("mean_log", 6).alias("mean_log"))


def q_describe_counts(spark, sf_dir):
    per_chem = G.count_by(observations(spark, sf_dir, index=False), ["chem"])
    d = G.describe_counts(per_chem, "n")
    return d.select("count", *[_r6(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


# Rows-per-key bins of the sparsity report.
COUNT_BIN_EDGES = [0, 1, 2, 4, 8, 16, 128, 1024, 8192]


def q_share_by_bin(spark, sf_dir):
    s = G.share_by_bin(observations(spark, sf_dir, index=False), "chem", COUNT_BIN_EDGES)
    return s.select("bin", "n_keys", _r6("pct"))


def q_histogram(spark, sf_dir):
    return G.histogram(observations(spark, sf_dir, index=False), "y", 100)


# --- prediction reports ---------------------------------------------------------------------

def q_rmse_pooled(spark, sf_dir):
    return G.rmse_pooled(predictions(spark, sf_dir, index=False), ["model", "setting"]).select("model", "setting", _r6("rmse"), "n")


def written_observations(spark, sf_dir) -> DataFrame:
    """The indexed observations, written once for plans that read them on both sides of a
    join: the row id sorts the whole table."""
    path = K.scratch_path(spark, "observations")
    obs = observations(spark, sf_dir).select("idx", "species", "chem", "duration", "y", "fold1", "fold2")
    K.write_table(obs, path)
    return spark.read.schema(obs.schema).parquet(path)


def joined_predictions(spark, sf_dir, obs: DataFrame, left: DataFrame) -> DataFrame:
    """``left`` ⋈ the predictions of ``obs`` on the index. The join moves one line per row,
    which is exploded into the legal pairs afterwards."""
    cells = SM.materialized_cells(spark, sf_dir)
    mine = obs.select("idx", "y", "species", "chem", "fold1", "fold2")
    wide = SM.wide_predictions(mine, cells, SM.best_alphas(SM.grid_scores(cells)))
    wide = wide.drop("species", "chem").withColumnRenamed("idx", "index")
    return SM.long_predictions(join_predictions(left, wide, ["index"]))


def density_predictions(spark, sf_dir) -> DataFrame:
    obs = written_observations(spark, sf_dir)
    flag = G.density_flag(obs.select("idx", "chem", "species"), "chem", "species")
    return joined_predictions(spark, sf_dir, obs, flag.select(F.col("idx").alias("index"), "high_density"))


def q_rmse_by_density(spark, sf_dir):
    p = density_predictions(spark, sf_dir)
    return G.rmse_by_density(p, ["model", "setting"]).select("model", "setting", "high_density", _r6("rmse"), "n")


def q_rmse_fold_mean(spark, sf_dir):
    r = G.rmse_fold_mean(predictions(spark, sf_dir, index=False), ["model", "setting"], "fold")
    return r.select("model", "setting", _r6("rmse_fold_mean"))


# Class edges of the binned confusion table (log10 units).
CONFUSION_EDGES = [float("-inf"), 3.5, 4.0, 4.5, float("inf")]


def q_confusion_bins(spark, sf_dir):
    p = predictions(spark, sf_dir, index=False).filter((F.col("model") == "LM2") & (F.col("setting") == "setting1"))
    return G.confusion_bins(p, "y", "y_pred", CONFUSION_EDGES)


def q_band_coverage(spark, sf_dir):
    b = G.band_coverage(predictions(spark, sf_dir, index=False), ["model", "setting"])
    return b.select("model", "setting", *[_r6(f"within_{k}") for k in (1, 2, 3)],
                    *[f"normal_{k}" for k in (1, 2, 3)])


def noise_floor(obs: DataFrame) -> DataFrame:
    """Within-experiment RMSE: each row against its (chemical, species, duration) mean."""
    g = cell_stats(obs, ["chem", "species", "duration"])
    return g.agg(F.sqrt(F.sum(F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")) / F.sum("n")).alias("noise"))


def q_variance_decomposition(spark, sf_dir):
    obs = observations(spark, sf_dir, index=False)
    cells = SM.materialized_cells(spark, sf_dir)
    pooled = SM.pooled_rmse(SM.holdout_scores(cells, SM.best_alphas(SM.grid_scores(cells))))
    wide = pooled.groupBy("setting").agg(
        F.max(F.when(F.col("model") == "LM0", F.col("rmse"))).alias("rmse_null"),
        F.max(F.when(F.col("model") == "LM1", F.col("rmse"))).alias("rmse_means"),
        F.min("rmse").alias("rmse_best"))
    # the noise floor is one number: read back and used as a literal
    wide = wide.withColumn("noise", F.lit(noise_floor(obs).first()["noise"]))
    v = G.variance_decomposition(wide, "rmse_null", "rmse_means", "rmse_best", "noise")
    return v.select("setting", *[_r6(c) for c in ["rmse_null", "rmse_means", "rmse_best", "noise", "share_means",
                                                   "share_interactions", "share_possible", "share_noise"]])


# --- validation curves along the penalty path (G12–G14) -------------------------------------
# "Round" r is the r-th penalty of a decreasing path: the curve has the
# shape of an early-stopping curve (error falls, then rises as the penalty
# vanishes) and every point is exact, so the curve operators get oracles.

PATH = [10.0 ** (4 - 0.5 * r) for r in range(17)]
PATIENCE = 3


def penalty_curves(spark, sf_dir) -> DataFrame:
    """(setting, model, outer, inner, round, rmse) for every point of the path."""
    cells = SM.materialized_cells(spark, sf_dir)
    nested = split_stats(cells, ["setting", "model", "g"], "f", K_FOLDS, "j", K_FOLDS)
    s = score_shrunk_mean(nested, ["setting", "model", "o", "i"], PATH)
    rnd = F.array_position(F.array(*[F.lit(a) for a in PATH]), F.col("alpha")).cast("int")
    return s.select("setting", "model", "o", "i", rnd.alias("round"), F.round("rmse", 9).alias("rmse"))


def _stopped(curves: DataFrame) -> DataFrame:
    """Each inner curve cut at its early-stop round: curves become ragged."""
    stop = G.early_stop_round(curves, ["setting", "model", "o", "i"], PATIENCE)
    return curves.join(stop.select("setting", "model", "o", "i", "stop_round"), ["setting", "model", "o", "i"]) \
                 .filter(F.col("round") <= F.col("stop_round")).drop("stop_round")


def q_early_stop_round(spark, sf_dir):
    return G.early_stop_round(penalty_curves(spark, sf_dir), ["setting", "model", "o", "i"], PATIENCE)


def q_curve_mean(spark, sf_dir):
    c = G.curve_mean(_stopped(penalty_curves(spark, sf_dir)), ["setting", "model", "o"])
    return c.select("setting", "model", "o", "round", F.round("rmse", 6).alias("rmse"), "n_curves")


def q_curve_argmin(spark, sf_dir):
    c = G.curve_mean(_stopped(penalty_curves(spark, sf_dir)), ["setting", "model", "o"])
    c = c.withColumn("rmse", F.round("rmse", 9))
    a = G.curve_argmin(c, ["setting", "model", "o"])
    return a.select("setting", "model", "o", "best_round", F.round("best_score", 6).alias("best_score"))


# --- windows, limits, reshapes -----------------------------------------------------------------

def q_global_row_index(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(*LI_HASH_KEYS, *LI_TIEBREAK)
    out = W.global_row_index(li, LI_HASH_KEYS, ROW_SEED, index_buckets(li), LI_TIEBREAK)
    return out.select(*LI_HASH_KEYS, "index")


def chem_counts(spark, sf_dir) -> DataFrame:
    return G.count_by(observations(spark, sf_dir, index=False), ["chem"])


def q_top_k(spark, sf_dir):
    return W.top_k(chem_counts(spark, sf_dir), ["-n", "chem"], 10)


def q_head_tail_select(spark, sf_dir):
    return W.head_tail_select(chem_counts(spark, sf_dir), "chem", "n", 100, 25)


def q_pivot_matrix(spark, sf_dir):
    best = SM.best_alphas(SM.grid_scores(SM.model_cells(observations(spark, sf_dir, index=False))))
    return W.pivot_matrix(best, ["setting", "fold"], "model", "alpha", ["LM0", "LM1", "LM2"])


def q_pivot_two_level(spark, sf_dir):
    p = density_predictions(spark, sf_dir)
    r = G.rmse_by_density(p, ["model", "setting"]).withColumn("rmse", F.round("rmse", 6))
    return W.pivot_two_level(r, ["model"], ["setting", "high_density"], "rmse",
                             ["setting1_false", "setting1_true", "setting2_false", "setting2_true"])


def q_reindex_grid(spark, sf_dir):
    obs = observations(spark, sf_dir, index=False)
    chems = W.head_tail_select(G.count_by(obs, ["chem"]), "chem", "n", 10, 5).select("chem").distinct()
    species = W.head_tail_select(G.count_by(obs, ["species"]), "species", "n", 10, 5).select("species").distinct()
    sub = semi_membership(semi_membership(obs, chems, "chem"), species, "species")
    vals = G.mean_log_by_pair(sub, "species", "chem", "value")
    out = W.reindex_grid(vals, species, chems, "species", "chem", "mean_log")
    return out.select("species", "chem", F.round("mean_log", 6).alias("mean_log"))


def q_order_output(spark, sf_dir):
    return W.order_output(G.count_by(observations(spark, sf_dir, index=False), ["species"]), ["-n", "species"])


def q_sample_rows(spark, sf_dir):
    p = W.sample_rows(predictions(spark, sf_dir), 2000, ["model", "setting", "index"], "42")
    return p.select("model", "setting", "index", _r6("y_pred"), _r6("y"))


def q_filter_slice(spark, sf_dir):
    g = SM.grid_scores(SM.model_cells(observations(spark, sf_dir, index=False)))
    s = W.filter_slice(g, {"fold": 1, "model": ["LM1", "LM2"]})
    return s.select("setting", "model", "fold", "alpha", _r6("rmse"))


# --- set operations and joins ---------------------------------------------------------------

def _head_tail_sets(spark, sf_dir):
    ht = W.head_tail_select(chem_counts(spark, sf_dir), "chem", "n", 100, 25)
    return ht.filter(F.col("side") == "head").select("chem"), ht.filter(F.col("side") == "tail").select("chem")


def q_union_key_sets(spark, sf_dir):
    head, tail = _head_tail_sets(spark, sf_dir)
    return W.union_key_sets(head, tail)


def q_semi_membership(spark, sf_dir):
    head, tail = _head_tail_sets(spark, sf_dir)
    return semi_membership(observations(spark, sf_dir), W.union_key_sets(head, tail), "chem").select("idx", "chem")


def q_distinct_labels(spark, sf_dir):
    return W.distinct_labels(predictions(spark, sf_dir, index=False), ["model", "setting"])


def q_complement_split(spark, sf_dir):
    obs = split_cells(observations(spark, sf_dir), "species", "chem", 0.2)
    test = obs.filter("is_test")
    return W.complement_split(obs, test, ["idx"]).select("idx", "species", "chem")


def q_join_predictions(spark, sf_dir):
    obs = written_observations(spark, sf_dir)
    j = joined_predictions(spark, sf_dir, obs, obs.select(F.col("idx").alias("index"), "species", "chem", "duration"))
    return j.select("index", "model", "setting", "species", "chem", "duration", _r6("y_pred"))


QUERIES = {
    "count_by": q_count_by,
    "value_counts": q_value_counts,
    "count_distinct": q_count_distinct,
    "count_distinct_approx": q_count_distinct_approx,
    "distinct_per_group": q_distinct_per_group,
    "distinct_keep_first": q_distinct_keep_first,
    "coverage_density": q_coverage_density,
    "mean_log_by_pair": q_mean_log_by_pair,
    "describe_counts": q_describe_counts,
    "share_by_bin": q_share_by_bin,
    "histogram": q_histogram,
    "rmse_pooled": q_rmse_pooled,
    "rmse_by_density": q_rmse_by_density,
    "rmse_fold_mean": q_rmse_fold_mean,
    "confusion_bins": q_confusion_bins,
    "band_coverage": q_band_coverage,
    "variance_decomposition": q_variance_decomposition,
    "early_stop_round": q_early_stop_round,
    "curve_mean": q_curve_mean,
    "curve_argmin": q_curve_argmin,
    "global_row_index": q_global_row_index,
    "top_k": q_top_k,
    "head_tail_select": q_head_tail_select,
    "pivot_matrix": q_pivot_matrix,
    "pivot_two_level": q_pivot_two_level,
    "reindex_grid": q_reindex_grid,
    "order_output": q_order_output,
    "sample_rows": q_sample_rows,
    "filter_slice": q_filter_slice,
    "union_key_sets": q_union_key_sets,
    "semi_membership": q_semi_membership,
    "distinct_labels": q_distinct_labels,
    "complement_split": q_complement_split,
    "join_predictions": q_join_predictions,
}


# --- DuckDB oracles ------------------------------------------------------------------------------

_PRED = with_sql(*SM.PRED_CTES)
_DENS = """,
cc AS (SELECT chem, count(*) AS n FROM obs GROUP BY chem),
cs AS (SELECT species, count(*) AS n FROM obs GROUP BY species),
dens AS (SELECT o.idx AS index, cc.n > 16 AND cs.n > 16 AS high_density
         FROM obs o JOIN cc USING (chem) JOIN cs USING (species)),
pd AS (SELECT * FROM pred JOIN dens USING (index))
"""


def _edges_sql(edges) -> str:
    return "[" + ", ".join("'-inf'::DOUBLE" if e == float("-inf") else "'inf'::DOUBLE" if e == float("inf")
                           else repr(float(e)) for e in edges) + "]"


def _cut_sql(x: str, edges) -> str:
    arr = _edges_sql(edges)
    return (f"(CASE WHEN {x} IS NULL OR {x} <= {arr}[1] OR {x} > {arr}[-1] THEN NULL "
            f"ELSE CAST(len(list_filter({arr}, lambda e: e < {x})) AS INTEGER) END)")


_PATH_SQL = "[" + ", ".join(repr(a) for a in PATH) + "]"
_CURVES_SQL = SM.grid_ctes(_PATH_SQL) + """,
path AS (SELECT unnest(range(1, 18)) AS round, unnest(""" + _PATH_SQL + """) AS alpha),
curves AS (SELECT setting, model, o, i, CAST(path.round AS INTEGER) AS round, round(rmse, 9) AS rmse
           FROM per_inner JOIN path USING (alpha)),
marks AS (SELECT *, min(rmse) OVER w1 AS prev_min FROM curves
          WINDOW w1 AS (PARTITION BY setting, model, o, i ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lastimp AS (SELECT *, max(CASE WHEN prev_min IS NULL OR rmse < prev_min THEN round END) OVER
                 (PARTITION BY setting, model, o, i ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp
            FROM marks),
stops AS (SELECT setting, model, o, i,
                 coalesce(min(CASE WHEN round - last_imp >= """ + str(PATIENCE) + """ THEN round END), max(round)) AS stop_round,
                 first(round ORDER BY rmse, round) AS best_round
          FROM lastimp GROUP BY ALL),
ragged AS (SELECT c.* FROM curves c JOIN stops s USING (setting, model, o, i) WHERE c.round <= s.stop_round),
cmean AS (SELECT setting, model, o, round, avg(rmse) AS rmse, count(rmse) AS n_curves FROM ragged GROUP BY ALL)"""

_ORDERED_COUNTS = "SELECT chem, count(*) AS n FROM obs GROUP BY chem"

_HT_SQL = f"""
cn AS ({_ORDERED_COUNTS}),
head AS (SELECT chem, n, 'head' AS side FROM cn ORDER BY n DESC, chem ASC LIMIT 100),
tail AS (SELECT chem, n, 'tail' AS side FROM cn ORDER BY n ASC, chem DESC LIMIT 25)"""

_SHARE_CELLS = ("(CAST(('0x' || substr(md5(concat(concat_ws('|', CAST(species AS VARCHAR), CAST(chem AS VARCHAR)), "
                "'#cells')), 1, 8)) AS BIGINT) / 4294967296.0)")

ORACLES = {
    "count_by": with_sql(OBS_SQL) + "SELECT species, count(*) AS n FROM obs GROUP BY species",
    "value_counts": with_sql(OBS_SQL) + "SELECT duration, count(*) AS n FROM obs GROUP BY duration",
    "count_distinct": with_sql(OBS_SQL)
    + "SELECT count(DISTINCT species) AS n_species, count(DISTINCT chem) AS n_chem, "
      "count(DISTINCT duration) AS n_duration FROM obs",
    "distinct_per_group": with_sql(OBS_SQL) + "SELECT chem, count(DISTINCT species) AS n_species FROM obs GROUP BY chem",
    "distinct_keep_first": with_sql(OBS_SQL)
    + "SELECT chem, idx, species, duration FROM (SELECT *, row_number() OVER (PARTITION BY chem ORDER BY idx) AS rn "
      "FROM obs) WHERE rn = 1",
    "coverage_density": with_sql(OBS_SQL)
    + "SELECT count(DISTINCT chem) AS n_chem, count(DISTINCT species) AS n_species, "
      "count(DISTINCT (chem, species)) AS n_pairs, round(count(DISTINCT (chem, species)) * 100.0 / "
      "(count(DISTINCT chem) * count(DISTINCT species)), 6) AS density_pct FROM obs",
    "mean_log_by_pair": with_sql(OBS_SQL)
    + "SELECT chem, species, round(avg(log10(value)), 6) AS mean_log FROM obs GROUP BY ALL",
    "describe_counts": with_sql(OBS_SQL) + """
SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, round(CAST(min(n) AS DOUBLE), 6) AS min,
       round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS q50,
       round(quantile_cont(n, 0.75), 6) AS q75, round(CAST(max(n) AS DOUBLE), 6) AS max
FROM (SELECT chem, count(*) AS n FROM obs GROUP BY chem)""",
    "share_by_bin": with_sql(OBS_SQL)
    + f"SELECT bin, count(*) AS n_keys, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM "
      f"(SELECT {_cut_sql('CAST(n AS DOUBLE)', COUNT_BIN_EDGES)} AS bin FROM "
      f"(SELECT chem, count(*) AS n FROM obs GROUP BY chem)) GROUP BY bin",
    "histogram": with_sql(OBS_SQL)
    + "SELECT CAST(CASE WHEN (mx - mn) / 100 = 0 THEN 0 ELSE least(floor((y - mn) / ((mx - mn) / 100)), 99) END AS INTEGER) "
      "AS bin, count(*) AS n FROM obs, (SELECT min(y) AS mn, max(y) AS mx FROM obs) WHERE y IS NOT NULL GROUP BY 1",
    "rmse_pooled": _PRED + "SELECT model, setting, round(sqrt(avg((y_pred - y) * (y_pred - y))), 6) AS rmse, "
                           "count(*) AS n FROM pred GROUP BY ALL",
    "rmse_by_density": _PRED + _DENS
    + "SELECT model, setting, high_density, round(sqrt(avg((y_pred - y) * (y_pred - y))), 6) AS rmse, count(*) AS n "
      "FROM pd GROUP BY ALL",
    "rmse_fold_mean": _PRED
    + "SELECT model, setting, round(avg(r), 6) AS rmse_fold_mean FROM (SELECT model, setting, fold, "
      "sqrt(avg((y_pred - y) * (y_pred - y))) AS r FROM pred GROUP BY ALL) GROUP BY ALL",
    "confusion_bins": _PRED
    + f"SELECT class_pred, class_true, count(*) AS observations FROM (SELECT "
      f"{_cut_sql('y', CONFUSION_EDGES)} AS class_true, {_cut_sql('y_pred', CONFUSION_EDGES)} AS class_pred "
      f"FROM pred WHERE model = 'LM2' AND setting = 'setting1') GROUP BY ALL",
    "band_coverage": _PRED + """,
r AS (SELECT model, setting, sqrt(avg((y_pred - y) * (y_pred - y))) AS rmse FROM pred GROUP BY ALL)
SELECT model, setting,
       round(avg(CASE WHEN abs(y - y_pred) <= 1 * rmse THEN 1.0 ELSE 0.0 END), 6) AS within_1,
       round(avg(CASE WHEN abs(y - y_pred) <= 2 * rmse THEN 1.0 ELSE 0.0 END), 6) AS within_2,
       round(avg(CASE WHEN abs(y - y_pred) <= 3 * rmse THEN 1.0 ELSE 0.0 END), 6) AS within_3,
       0.6827 AS normal_1, 0.9545 AS normal_2, 0.9973 AS normal_3
FROM pred JOIN r USING (model, setting) GROUP BY ALL""",
    "variance_decomposition": _PRED + """,
pooled AS (SELECT model, setting, sqrt(avg((y_pred - y) * (y_pred - y))) AS rmse FROM pred GROUP BY ALL),
wide AS (SELECT setting, max(CASE WHEN model = 'LM0' THEN rmse END) AS rmse_null,
                max(CASE WHEN model = 'LM1' THEN rmse END) AS rmse_means, min(rmse) AS rmse_best FROM pooled GROUP BY setting),
nf AS (SELECT sqrt(sum(ss) / sum(n)) AS noise FROM (SELECT count(*) AS n, sum(y * y) - sum(y) * sum(y) / count(*) AS ss
       FROM obs GROUP BY chem, species, duration)),
adj AS (SELECT *, (rmse_null ^ 2 - rmse_means ^ 2) / rmse_null ^ 2 AS am, (rmse_null ^ 2 - rmse_best ^ 2) / rmse_null ^ 2 AS ab,
               (rmse_null ^ 2 - noise ^ 2) / rmse_null ^ 2 AS an FROM wide, nf)
SELECT setting, round(rmse_null, 6) AS rmse_null, round(rmse_means, 6) AS rmse_means, round(rmse_best, 6) AS rmse_best,
       round(noise, 6) AS noise, round(am, 6) AS share_means, round(ab - am, 6) AS share_interactions,
       round(an - ab, 6) AS share_possible, round(1 - an, 6) AS share_noise FROM adj""",
    "early_stop_round": with_sql(OBS_SQL, SM.LONG_SQL, _CURVES_SQL)
    + "SELECT setting, model, o, i, stop_round, best_round FROM stops",
    "curve_mean": with_sql(OBS_SQL, SM.LONG_SQL, _CURVES_SQL)
    + "SELECT setting, model, o, round, round(rmse, 6) AS rmse, n_curves FROM cmean",
    "curve_argmin": with_sql(OBS_SQL, SM.LONG_SQL, _CURVES_SQL)
    + "SELECT setting, model, o, first(round ORDER BY round(rmse, 9), round) AS best_round, "
      "round(min(round(rmse, 9)), 6) AS best_score FROM cmean GROUP BY ALL",
    "global_row_index": with_sql(LI_SQL) + "SELECT " + ", ".join(LI_HASH_KEYS) + ", idx AS index FROM li",
    "top_k": with_sql(OBS_SQL) + _ORDERED_COUNTS + " ORDER BY n DESC, chem LIMIT 10",
    "head_tail_select": with_sql(OBS_SQL, _HT_SQL) + "SELECT * FROM head UNION ALL SELECT * FROM tail",
    "pivot_matrix": with_sql(OBS_SQL, SM.LONG_SQL, SM.GRID_SQL)
    + "SELECT setting, fold, max(CASE WHEN model = 'LM0' THEN alpha END) AS LM0, "
      "max(CASE WHEN model = 'LM1' THEN alpha END) AS LM1, max(CASE WHEN model = 'LM2' THEN alpha END) AS LM2 "
      "FROM best GROUP BY ALL",
    "pivot_two_level": _PRED + _DENS + """,
r AS (SELECT model, setting, high_density, round(sqrt(avg((y_pred - y) * (y_pred - y))), 6) AS rmse FROM pd GROUP BY ALL)
SELECT model,
  max(CASE WHEN setting = 'setting1' AND NOT high_density THEN rmse END) AS setting1_false,
  max(CASE WHEN setting = 'setting1' AND high_density THEN rmse END) AS setting1_true,
  max(CASE WHEN setting = 'setting2' AND NOT high_density THEN rmse END) AS setting2_false,
  max(CASE WHEN setting = 'setting2' AND high_density THEN rmse END) AS setting2_true
FROM r GROUP BY model""",
    "reindex_grid": with_sql(OBS_SQL) + """,
cc AS (SELECT chem, count(*) AS n FROM obs GROUP BY chem),
cs AS (SELECT species, count(*) AS n FROM obs GROUP BY species),
chems AS (SELECT chem FROM (SELECT chem FROM cc ORDER BY n DESC, chem LIMIT 10)
          UNION SELECT chem FROM (SELECT chem FROM cc ORDER BY n ASC, chem DESC LIMIT 5)),
sps AS (SELECT species FROM (SELECT species FROM cs ORDER BY n DESC, species LIMIT 10)
        UNION SELECT species FROM (SELECT species FROM cs ORDER BY n ASC, species DESC LIMIT 5)),
vals AS (SELECT species, chem, avg(log10(value)) AS mean_log FROM obs
         WHERE chem IN (SELECT chem FROM chems) AND species IN (SELECT species FROM sps) GROUP BY ALL)
SELECT s.species, c.chem, round(v.mean_log, 6) AS mean_log FROM sps s CROSS JOIN chems c
LEFT JOIN vals v ON v.species = s.species AND v.chem = c.chem""",
    "order_output": with_sql(OBS_SQL) + "SELECT species, count(*) AS n FROM obs GROUP BY species ORDER BY n DESC, species",
    "sample_rows": _PRED
    + "SELECT model, setting, index, round(y_pred, 6) AS y_pred, round(y, 6) AS y FROM pred ORDER BY "
      "CAST(('0x' || substr(md5(concat(concat_ws('|', model, setting, CAST(index AS VARCHAR)), '#42')), 1, 8)) AS BIGINT), "
      "model, setting, index LIMIT 2000",
    "filter_slice": with_sql(OBS_SQL, SM.LONG_SQL, SM.GRID_SQL)
    + "SELECT setting, model, fold, alpha, round(rmse, 6) AS rmse FROM grid WHERE fold = 1 AND model IN ('LM1', 'LM2')",
    "union_key_sets": with_sql(OBS_SQL, _HT_SQL) + "SELECT chem FROM head UNION SELECT chem FROM tail",
    "semi_membership": with_sql(OBS_SQL, _HT_SQL)
    + "SELECT idx, chem FROM obs WHERE chem IN (SELECT chem FROM head UNION SELECT chem FROM tail)",
    "distinct_labels": _PRED + "SELECT DISTINCT concat_ws(' x ', model, setting) AS label FROM pred",
    "complement_split": with_sql(OBS_SQL) + f"SELECT idx, species, chem FROM obs WHERE NOT ({_SHARE_CELLS} < 0.2)",
    "join_predictions": _PRED
    + "SELECT p.index, p.model, p.setting, o.species, o.chem, o.duration, round(p.y_pred, 6) AS y_pred "
      "FROM obs o JOIN pred p ON p.index = o.idx",
}
