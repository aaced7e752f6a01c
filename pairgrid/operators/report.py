"""Aggregations and evaluation reports.

All are groupBy/agg plans with map-side partial aggregation; exact
distinct counts and percentiles are the default, with the approximate
forms available for very large key sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgrid.functions.columns import cut_right_closed


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per key (G1)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, cols: Sequence[str], name: str = "n") -> DataFrame:
    """Frequency table ordered by value."""
    return count_by(df, cols, name).orderBy(*cols)


def count_distinct(df: DataFrame, cols: Sequence[str], approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct values of each column (G3), one row; ``approx`` uses HyperLogLog++."""
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.countDistinct
    return df.agg(*[fn(c).alias(f"n_{c}") for c in cols])


def distinct_per_group(df: DataFrame, key: str, col: str, name: str | None = None) -> DataFrame:
    """Distinct values of ``col`` per key."""
    return df.groupBy(key).agg(F.countDistinct(col).alias(name or f"n_{col}"))


def coverage_density(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed (a, b) pairs ÷ possible pairs × 100 (G6), one aggregation."""
    na = F.countDistinct(a)
    nb = F.countDistinct(b)
    npair = F.countDistinct(a, b)
    return df.agg(na.alias(f"n_{a}"), nb.alias(f"n_{b}"), npair.alias("n_pairs"),
                  (npair * 100.0 / (na * nb)).alias("density_pct"))


def mean_log_by_pair(df: DataFrame, a: str, b: str, value: str, name: str = "mean_log") -> DataFrame:
    """Mean log10 of a positive value per (a, b)."""
    return df.groupBy(a, b).agg(F.avg(F.log10(value)).alias(name))


def describe_counts(df: DataFrame, col: str) -> DataFrame:
    """count, mean, sample std, min, quartiles, max (G8); exact percentiles."""
    return df.agg(
        F.count(col).cast("bigint").alias("count"), F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"), F.min(col).cast("double").alias("min"),
        F.percentile(col, 0.25).alias("q25"), F.percentile(col, 0.5).alias("q50"),
        F.percentile(col, 0.75).alias("q75"), F.max(col).cast("double").alias("max"))


def _sq_err(y: str, yhat: str) -> Column:
    d = F.col(yhat) - F.col(y)
    return d * d


def rmse_pooled(df: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "y_pred") -> DataFrame:
    """√mean((y − ŷ)²) over all rows of each key."""
    return df.groupBy(*keys).agg(F.sqrt(F.avg(_sq_err(y, yhat))).alias("rmse"),
                                 F.count(F.lit(1)).alias("n"))


def density_flag(df: DataFrame, a: str, b: str, min_n: int = 16, name: str = "high_density") -> DataFrame:
    """True when both entities of a row have more than ``min_n`` rows (J7 by counts).

    Per-entity counts are joined back; AQE broadcasts them when they are small.
    """
    ca = df.groupBy(a).agg(F.count(F.lit(1)).alias("_na"))
    cb = df.groupBy(b).agg(F.count(F.lit(1)).alias("_nb"))
    return (df.join(ca, a).join(cb, b)
              .withColumn(name, (F.col("_na") > min_n) & (F.col("_nb") > min_n))
              .drop("_na", "_nb"))


def rmse_by_density(pred: DataFrame, keys: Sequence[str], flag: str = "high_density",
                    y: str = "y", yhat: str = "y_pred") -> DataFrame:
    """Pooled RMSE per key and density class."""
    return rmse_pooled(pred, [*keys, flag], y, yhat)


def rmse_fold_mean(df: DataFrame, keys: Sequence[str], fold: str = "fold",
                   y: str = "y", yhat: str = "y_pred") -> DataFrame:
    """Mean over folds of the per-fold RMSE (G11, the grid's selection score)."""
    per_fold = rmse_pooled(df, [*keys, fold], y, yhat)
    return per_fold.groupBy(*keys).agg(F.avg("rmse").alias("rmse_fold_mean"))


def curve_mean(df: DataFrame, keys: Sequence[str], round_col: str = "round", score: str = "rmse") -> DataFrame:
    """Mean curve over inner folds; ragged curves average what is present."""
    return df.groupBy(*keys, round_col).agg(F.avg(score).alias(score), F.count(score).alias("n_curves"))


def curve_argmin(curve: DataFrame, keys: Sequence[str], round_col: str = "round", score: str = "rmse") -> DataFrame:
    """First round with the least mean score (G13): min by (score, round)."""
    best = F.min(F.struct(F.col(score), F.col(round_col)))
    return curve.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col(f"_b.{round_col}").alias("best_round"), F.col(f"_b.{score}").alias("best_score"))


def early_stop_round(curve: DataFrame, keys: Sequence[str], patience: int, round_col: str = "round",
                     score: str = "rmse") -> DataFrame:
    """Round where training stops after ``patience`` rounds without a new best.

    Running minimum by window; the gap is the distance to the last round that
    set a new minimum. Stop = first round whose gap reaches ``patience``, or
    the last round. Windows are partitioned by the curve keys only.
    """
    w = Window.partitionBy(*keys).orderBy(round_col)
    prev_min = F.min(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    improved = prev_min.isNull() | (F.col(score) < prev_min)
    c = curve.withColumn("_imp", improved)
    c = c.withColumn("_last", F.max(F.when(F.col("_imp"), F.col(round_col))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("_gap", F.col(round_col) - F.col("_last"))
    return c.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("_gap") >= patience, F.col(round_col))), F.max(round_col)).alias("stop_round"),
        F.min(F.struct(F.col(score), F.col(round_col)))[round_col].alias("best_round"))


def confusion_bins(df: DataFrame, y: str, yhat: str, edges: Sequence[float]) -> DataFrame:
    """Cross-count of binned observed and predicted values."""
    return (df.select(cut_right_closed(y, edges).alias("class_true"),
                      cut_right_closed(yhat, edges).alias("class_pred"))
              .groupBy("class_pred", "class_true").agg(F.count(F.lit(1)).alias("observations")))


def variance_decomposition(df: DataFrame, null: str, mean: str, best: str, noise: str) -> DataFrame:
    """Shares of variance: means, interactions, possible, noise.

    From four RMSE columns: r² ratios against the null model's r².
    """
    r0 = F.col(null) * F.col(null)
    adj = lambda c: (r0 - F.col(c) * F.col(c)) / r0
    return df.select("*",
                     adj(mean).alias("share_means"),
                     (adj(best) - adj(mean)).alias("share_interactions"),
                     (adj(noise) - adj(best)).alias("share_possible"),
                     (1 - adj(noise)).alias("share_noise"))


def all_zero_rows(entities: DataFrame, df_long: DataFrame, key: str) -> DataFrame:
    """Entities with no non-zero feature (G17), a left-anti join."""
    return entities.select(key).distinct().join(df_long.select(key), key, "left_anti")


def all_zero_columns(bits: DataFrame, df_long: DataFrame, bit: str = "bit") -> DataFrame:
    """Feature columns that are zero for every entity."""
    return bits.join(df_long.select(bit), bit, "left_anti")


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Equal-width bins on [min, max], the last bin closed.

    The two bounds are one aggregate row read back to the driver and used as
    literals, so the binning itself is a plain projection + aggregation.
    """
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, n bigint")
    width = (float(hi) - float(lo)) / bins
    if width == 0:
        b = F.lit(0)
    else:
        b = F.least(F.floor((F.col(col) - F.lit(float(lo))) / F.lit(width)), F.lit(bins - 1))
    return (df.filter(F.col(col).isNotNull()).select(b.cast("int").alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))


def share_by_bin(df: DataFrame, key: str, edges: Sequence[float]) -> DataFrame:
    """Percent of keys per row-count bin (G19): counts per key → bins → share."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    binned = per_key.select(cut_right_closed(F.col("_n").cast("double"), edges).alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_keys"))
    # the bin table has at most len(edges) rows, so the total is a tiny window
    return counts.withColumn("pct", F.col("n_keys") * 100.0 / F.sum("n_keys").over(Window.partitionBy()))


def band_coverage(pred: DataFrame, keys: Sequence[str], ks: Sequence[int] = (1, 2, 3),
                  y: str = "y", yhat: str = "y_pred") -> DataFrame:
    """Share of rows with |y − ŷ| ≤ k·RMSE per key (G20), next to normal shares.

    The RMSE per key is an aggregate joined back (one row per key).
    """
    r = rmse_pooled(pred, keys, y, yhat).select(*keys, "rmse")
    err = F.abs(F.col(y) - F.col(yhat))
    j = pred.join(r, list(keys))
    # P(|Z| <= k) of a standard normal, k = 1, 2, 3.
    normal = {1: 0.6827, 2: 0.9545, 3: 0.9973}
    aggs = []
    for k in ks:
        aggs.append(F.avg((err <= k * F.col("rmse")).cast("double")).alias(f"within_{k}"))
    out = j.groupBy(*keys).agg(*aggs)
    return out.select("*", *[F.lit(normal[k]).alias(f"normal_{k}") for k in ks if k in normal])
