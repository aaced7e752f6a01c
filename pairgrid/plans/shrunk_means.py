"""Null and one-factor ridge models over both holdout settings.

Spark side: one scan of the line items, exploded into the five legal
(setting, model) pairs, summed per (group, outer fold, inner fold) cell.
Everything after that works on cell sums, one line per group. The DuckDB oracles below are the
brute-force form: they rebuild each training set by join and predict each
validation row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrid.operators.models.closed_form import (
    ALPHA_GRID, SCORE_DIGITS, cell_stats, group_cells, group_predictions, group_rows, score_shrunk_mean, split_hot, split_stats)
from pairgrid.operators.reshape import best_per_group, pivot_matrix
from pairgrid.plans.roles import K_FOLDS, OBS_SQL, observations, with_sql
from pairgrid.sources.writers import scratch_path, write_table

# Legal (setting, model, factor) triples; setting2 holds out whole
# chemicals, so a chemical-only model has nothing to learn there.
MODEL_SPECS = [
    ("setting1", "LM0", None),
    ("setting1", "LM1", "species"),
    ("setting1", "LM2", "chem"),
    ("setting2", "LM0", None),
    ("setting2", "LM1", "species"),
]
SETTING_FOLDS = {"setting1": ("fold1", "inner1"), "setting2": ("fold2", "inner2")}


def long_rows(obs: DataFrame, specs=MODEL_SPECS) -> DataFrame:
    """(setting, model, g, f, j, idx, y): one row per observation and legal pair."""
    entries = []
    for setting, model, factor in specs:
        fold, inner = SETTING_FOLDS[setting]
        g = F.lit(0).cast("bigint") if factor is None else F.col(factor).cast("bigint")
        entries.append(F.struct(F.lit(setting).alias("setting"), F.lit(model).alias("model"),
                                g.alias("g"), F.col(fold).alias("f"), F.col(inner).alias("j")))
    keep = [c for c in ("idx", "y") if c in obs.columns]
    return obs.select(*keep, F.explode(F.array(*entries)).alias("s")).select("s.*", *keep)


def model_cells(obs: DataFrame) -> DataFrame:
    return cell_stats(long_rows(obs), ["setting", "model", "g", "f", "j"])


def model_lines(obs: DataFrame) -> DataFrame:
    """Fold cells of all legal pairs, one line per (setting, model, group). Rows are
    exchanged once per factor; the null model and hot groups are summed before."""
    keys = ["setting", "model", "g"]
    of = {f: [x for x in MODEL_SPECS if x[2] == f] for f in dict.fromkeys(f for _, _, f in MODEL_SPECS)}

    def summed(rows: DataFrame, specs) -> DataFrame:
        return group_cells(cell_stats(long_rows(rows, specs), [*keys, "f", "j"]), keys, "f", K_FOLDS, "j", K_FOLDS)

    parts = [summed(obs, of.pop(None))]
    for factor, (usual, hot) in split_hot(obs, list(of)).items():
        parts.append(group_rows(usual, factor, [(s, m, *SETTING_FOLDS[s]) for s, m, _ in of[factor]], K_FOLDS, K_FOLDS))
        if hot is not None:
            parts.append(summed(hot, of[factor]))
    return reduce(DataFrame.unionByName, parts)


def materialized_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold cells, one line per (setting, model, group), written once to the shared folder.

    Every plan below reads the cells more than once (nested grid, outer
    holdout, intercepts). A line holds at most 25 cells, so the table is small;
    writing it cuts the lineage back to the scan, makes the reuse independent
    of the planner, and no later split exchanges cells again.
    """
    cells = model_lines(observations(spark, sf_dir, index=False))
    path = scratch_path(spark, "cells")
    write_table(cells, path)
    return spark.read.schema(cells.schema).parquet(path)


def grid_scores(cells: DataFrame, alphas=ALPHA_GRID) -> DataFrame:
    """Score of every (setting, model, outer fold, α) = mean inner-fold RMSE."""
    nested = split_stats(cells, ["setting", "model", "g"], "f", K_FOLDS, "j", K_FOLDS)
    per_inner = score_shrunk_mean(nested, ["setting", "model", "o", "i"], alphas)
    return (per_inner.groupBy("setting", "model", "o", "alpha").agg(F.avg("rmse").alias("rmse"))
                     .select("setting", "model", F.col("o").alias("fold"), "alpha", "rmse"))


def best_alphas(grid: DataFrame) -> DataFrame:
    """Lowest score per (setting, model, fold); ties → smaller α."""
    return best_per_group(grid, ["setting", "model", "fold"],
                          [F.round("rmse", SCORE_DIGITS).asc_nulls_last(), F.col("alpha").asc()])


def _outer_with_alpha(cells: DataFrame, best: DataFrame) -> DataFrame:
    outer = split_stats(cells, ["setting", "model", "g"], "f", K_FOLDS)
    # best has one row per (setting, model, fold): a fixed-size table
    b = best.select("setting", "model", F.col("fold").alias("o"), "alpha")
    return outer.join(F.broadcast(b), ["setting", "model", "o"])


def holdout_scores(cells: DataFrame, best: DataFrame) -> DataFrame:
    """Per (setting, model, fold): test SSE and rows with the chosen α."""
    scored = score_shrunk_mean(_outer_with_alpha(cells, best), ["setting", "model", "o"], alpha_col="alpha")
    return scored.select("setting", "model", F.col("o").alias("fold"), "alpha", "sse", "n_val", "rmse")


def pooled_rmse(scores: DataFrame) -> DataFrame:
    """G9 from per-fold sums: √(Σ SSE / Σ n) per (model, setting)."""
    return scores.groupBy("model", "setting").agg(
        F.sqrt(F.sum("sse") / F.sum("n_val")).alias("rmse"), F.sum("n_val").alias("n"))


def _of_fold(entries: str, fold: str):
    return F.filter(entries, lambda e: e["o"] == F.col(fold))


def wide_predictions(obs: DataFrame, cells: DataFrame, best: DataFrame) -> DataFrame:
    """R11 with one line per row of ``obs``: y, fold1, fold2, its other columns, and per
    legal pair a struct with the prediction (null where the row has none).

    Predictions depend on the row's group and fold alone. They are gathered per group
    (at most one entry per model and fold) and rows meet the table of each factor once,
    before they are exploded.
    """
    preds = group_predictions(_outer_with_alpha(cells, best), ["setting", "model", "o"], "g", "alpha")
    rows = obs
    # the factor with the most predictions comes last: what a row has found is exchanged with it
    for factor in sorted(dict.fromkeys(f for _, _, f in MODEL_SPECS), key=lambda x: (x is None, sum(f == x for _, _, f in MODEL_SPECS))):
        names = [(s, m) for s, m, f in MODEL_SPECS if f == factor]
        mine = preds.where(F.concat_ws("|", "setting", "model").isin([f"{s}|{m}" for s, m in names]))
        if factor is None:  # one group: a line per fold
            for setting, model in names:
                of_fold = mine.where((F.col("setting") == setting) & (F.col("model") == model)).select(F.col("o").alias("_o"), F.struct("y_pred").alias(f"{setting}_{model}"))
                rows = rows.join(F.broadcast(of_fold), F.col(SETTING_FOLDS[setting][0]) == F.col("_o"), "left").drop("_o")
            continue
        lists = [F.collect_list(F.when((F.col("setting") == s) & (F.col("model") == m), F.struct("o", "y_pred"))).alias(f"_{s}_{m}") for s, m in names]
        per_group = mine.groupBy(F.col("g").alias("_g")).agg(*lists)
        rows = rows.join(per_group, F.col(factor).cast("bigint") == F.col("_g"), "left")
        # only the entry of the row's own fold goes on
        own = [_of_fold(f"_{s}_{m}", SETTING_FOLDS[s][0]).alias(f"_{s}_{m}") for s, m in names]
        kept = [c for c in rows.columns if c not in {"_g", *(f"_{s}_{m}" for s, m in names)}]
        rows = rows.select(*kept, *own)
        rows = rows.select(*kept, *[F.when(F.size(f"_{s}_{m}") > 0, F.struct(F.col(f"_{s}_{m}")[0]["y_pred"].alias("y_pred"))).alias(f"{s}_{m}") for s, m in names])
    return rows


def long_predictions(wide: DataFrame) -> DataFrame:
    """Lines of ``wide_predictions`` -> one row per legal pair: model, setting, fold, y_pred and the other columns."""
    names = [f"{s}_{m}" for s, m, _ in MODEL_SPECS]
    gone = {*names, *(f for pair in SETTING_FOLDS.values() for f in pair)}
    each = [F.when(F.col(f"{s}_{m}").isNotNull(), F.struct(F.lit(m).alias("model"), F.lit(s).alias("setting"), F.col(SETTING_FOLDS[s][0]).alias("fold"),
                                                          F.col(f"{s}_{m}.y_pred").alias("y_pred"))) for s, m, _ in MODEL_SPECS]
    kept = [c for c in wide.columns if c not in gone]
    return wide.select(*kept, F.explode(F.filter(F.array(*each), lambda e: e.isNotNull())).alias("_p")).select("_p.*", *kept)


def holdout_predictions(obs: DataFrame, cells: DataFrame, best: DataFrame) -> DataFrame:
    """Out-of-fold prediction for every row and legal pair; without ``index`` where
    ``obs`` has no row id."""
    keep = [c for c in ("idx", "y", "species", "chem", "fold1", "fold2") if c in obs.columns]
    long = long_predictions(wide_predictions(obs.select(*keep), cells, best))
    index = [F.col("idx").alias("index")] if "idx" in obs.columns else []
    return long.select("model", "setting", "fold", *index, "y_pred", "y")


# --- registered queries --------------------------------------------------------

def q_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_scores(model_cells(observations(spark, sf_dir, index=False)))
    return g.select("setting", "model", "fold", "alpha", F.round("rmse", 6).alias("rmse"))


def q_best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_alphas(grid_scores(model_cells(observations(spark, sf_dir, index=False))))
    return best.select("setting", "model", "fold", "alpha", F.round("rmse", 6).alias("rmse"))


def predictions(spark: SparkSession, sf_dir: str, index: bool = True) -> DataFrame:
    """R11 per-row predictions: the grid runs on index-free cells (one scan,
    cells read by the nested and outer splits); only the per-row output reads
    the observations, with their row id unless ``index`` is False."""
    cells = materialized_cells(spark, sf_dir)
    return holdout_predictions(observations(spark, sf_dir, index=index), cells, best_alphas(grid_scores(cells)))


def q_predict_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return p.select("model", "setting", "fold", "index", F.round("y_pred", 6).alias("y_pred"),
                    F.round("y", 6).alias("y"))


def q_holdout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: nested-CV α choice → holdout → pooled RMSE, model × setting."""
    cells = materialized_cells(spark, sf_dir)
    pooled = pooled_rmse(holdout_scores(cells, best_alphas(grid_scores(cells))))
    wide = pivot_matrix(pooled.select("model", "setting", F.round("rmse", 6).alias("rmse")),
                        ["model"], "setting", "rmse", ["setting1", "setting2"])
    return wide


def q_fit_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training mean per (setting, outer fold)."""
    obs = observations(spark, sf_dir, index=False)
    specs = [s for s in MODEL_SPECS if s[1] == "LM0"]
    cells = cell_stats(long_rows(obs, specs), ["setting", "model", "g", "f"])
    outer = split_stats(cells, ["setting"], "f", K_FOLDS)
    return outer.select("setting", F.col("o").alias("fold"),
                        F.round(F.col("tsy") / F.col("tn"), 6).alias("train_mean"),
                        F.col("tn").cast("bigint").alias("n_train"))


def q_fit_shrunk_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (setting, model, fold, group) prediction at a fixed α = 10."""
    obs = observations(spark, sf_dir, index=False)
    specs = [s for s in MODEL_SPECS if s[2] is not None]
    cells = cell_stats(long_rows(obs, specs), ["setting", "model", "g", "f"])
    outer = split_stats(cells, ["setting", "model", "g"], "f", K_FOLDS).withColumn("alpha", F.lit(10.0))
    p = group_predictions(outer, ["setting", "model", "o"], "g", "alpha")
    return p.select("setting", "model", F.col("o").alias("fold"), F.col("g").alias("grp"),
                    F.round("intercept", 6).alias("intercept"), F.round("y_pred", 6).alias("y_pred"))


# --- DuckDB oracles ---------------------------------------------------------------

_ALPHAS_SQL = "[" + ", ".join(repr(float(a)) for a in ALPHA_GRID) + "]"

LONG_SQL = """
long AS (
  SELECT 'setting1' AS setting, 'LM0' AS model, CAST(0 AS BIGINT) AS g, fold1 AS f, inner1 AS j, idx, y FROM obs
  UNION ALL SELECT 'setting1', 'LM1', species, fold1, inner1, idx, y FROM obs
  UNION ALL SELECT 'setting1', 'LM2', chem, fold1, inner1, idx, y FROM obs
  UNION ALL SELECT 'setting2', 'LM0', CAST(0 AS BIGINT), fold2, inner2, idx, y FROM obs
  UNION ALL SELECT 'setting2', 'LM1', species, fold2, inner2, idx, y FROM obs
)"""

def grid_ctes(alphas_sql: str = _ALPHAS_SQL) -> str:
    """Brute-force nested-CV scores up to ``per_inner`` (setting, model, o, i, alpha, rmse)."""
    return f"""
splits AS (SELECT CAST(a.range AS INTEGER) AS o, CAST(b.range AS INTEGER) AS i FROM range(1, 6) a, range(1, 6) b),
alphas AS (SELECT unnest({alphas_sql}) AS alpha),
tr AS (SELECT l.setting, l.model, s.o, s.i, l.g, count(*) AS n, sum(l.y) AS sy
       FROM long l JOIN splits s ON l.f <> s.o AND l.j <> s.i GROUP BY ALL),
fit AS (SELECT tr.*, a.alpha, n * a.alpha / (n + a.alpha) AS c, sy / n AS m FROM tr, alphas a),
icpt AS (SELECT setting, model, o, i, alpha, sum(c * m) / sum(c) AS b FROM fit GROUP BY ALL),
val AS (
  SELECT l.setting, l.model, s.o, s.i, a.alpha, l.y,
         coalesce(ic.b + fit.n * (fit.m - ic.b) / (fit.n + a.alpha), ic.b) AS p
  FROM long l JOIN splits s ON l.f <> s.o AND l.j = s.i
  CROSS JOIN alphas a
  JOIN icpt ic ON ic.setting = l.setting AND ic.model = l.model AND ic.o = s.o AND ic.i = s.i AND ic.alpha = a.alpha
  LEFT JOIN fit ON fit.setting = l.setting AND fit.model = l.model AND fit.o = s.o AND fit.i = s.i
               AND fit.alpha = a.alpha AND fit.g = l.g),
per_inner AS (SELECT setting, model, o, i, alpha, sqrt(avg((y - p) * (y - p))) AS rmse FROM val GROUP BY ALL)"""


GRID_SQL = grid_ctes() + f""",
grid AS (SELECT setting, model, o AS fold, alpha, avg(rmse) AS rmse FROM per_inner GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY setting, model, fold
                                                      ORDER BY round(rmse, {SCORE_DIGITS}), alpha) AS rn FROM grid)
         WHERE rn = 1)"""

HOLDOUT_SQL = """
otr AS (SELECT l.setting, l.model, b.fold AS o, b.alpha, l.g, count(*) AS n, sum(l.y) AS sy
        FROM long l JOIN best b ON b.setting = l.setting AND b.model = l.model AND l.f <> b.fold GROUP BY ALL),
ofit AS (SELECT *, n * alpha / (n + alpha) AS c, sy / n AS m FROM otr),
oicpt AS (SELECT setting, model, o, sum(c * m) / sum(c) AS b FROM ofit GROUP BY ALL),
pred AS (
  SELECT l.model, l.setting, l.f AS fold, l.idx AS index, l.y,
         coalesce(ic.b + ofit.n * (ofit.m - ic.b) / (ofit.n + ofit.alpha), ic.b) AS y_pred
  FROM long l JOIN oicpt ic ON ic.setting = l.setting AND ic.model = l.model AND ic.o = l.f
  LEFT JOIN ofit ON ofit.setting = l.setting AND ofit.model = l.model AND ofit.o = l.f AND ofit.g = l.g)"""

PRED_CTES = (OBS_SQL, LONG_SQL, GRID_SQL, HOLDOUT_SQL)

ORACLES = {
    "grid_search": with_sql(OBS_SQL, LONG_SQL, GRID_SQL)
    + "SELECT setting, model, fold, alpha, round(rmse, 6) AS rmse FROM grid",
    "best_per_group": with_sql(OBS_SQL, LONG_SQL, GRID_SQL)
    + "SELECT setting, model, fold, alpha, round(rmse, 6) AS rmse FROM best",
    "predict_holdout": with_sql(*PRED_CTES)
    + "SELECT model, setting, fold, index, round(y_pred, 6) AS y_pred, round(y, 6) AS y FROM pred",
    "holdout_report": with_sql(*PRED_CTES) + """
SELECT model,
       max(CASE WHEN setting = 'setting1' THEN rmse END) AS setting1,
       max(CASE WHEN setting = 'setting2' THEN rmse END) AS setting2
FROM (SELECT model, setting, round(sqrt(avg((y - y_pred) * (y - y_pred))), 6) AS rmse FROM pred GROUP BY ALL)
GROUP BY model""",
    "fit_mean": with_sql(OBS_SQL, LONG_SQL) + """
SELECT l.setting, CAST(o.range AS INTEGER) AS fold, round(avg(l.y), 6) AS train_mean, count(*) AS n_train
FROM long l JOIN range(1, 6) o ON l.f <> o.range
WHERE l.model = 'LM0' GROUP BY ALL""",
    "fit_shrunk_mean": with_sql(OBS_SQL, LONG_SQL) + """,
tr AS (SELECT l.setting, l.model, CAST(o.range AS INTEGER) AS o, l.g, count(*) AS n, sum(l.y) AS sy
       FROM long l JOIN range(1, 6) o ON l.f <> o.range WHERE l.model <> 'LM0' GROUP BY ALL),
fit AS (SELECT *, n * 10.0 / (n + 10.0) AS c, sy / n AS m FROM tr),
icpt AS (SELECT setting, model, o, sum(c * m) / sum(c) AS b FROM fit GROUP BY ALL),
grp AS (SELECT DISTINCT l.setting, l.model, CAST(o.range AS INTEGER) AS o, l.g
        FROM long l, range(1, 6) o WHERE l.model <> 'LM0')
SELECT grp.setting, grp.model, grp.o AS fold, grp.g AS grp, round(ic.b, 6) AS intercept,
       round(coalesce(ic.b + fit.n * (fit.m - ic.b) / (fit.n + 10.0), ic.b), 6) AS y_pred
FROM grp JOIN icpt ic USING (setting, model, o)
LEFT JOIN fit USING (setting, model, o, g)""",
}

QUERIES = {
    "grid_search": q_grid_search,
    "best_per_group": q_best_per_group,
    "predict_holdout": q_predict_holdout,
    "holdout_report": q_holdout_report,
    "fit_mean": q_fit_mean,
    "fit_shrunk_mean": q_fit_shrunk_mean,
}
