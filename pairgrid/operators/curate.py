"""Curation: projections, predicates, unit normalisation and joins.

Filters are plain Column predicates, so Catalyst combines consecutive ones
(CombineFilters), turns long OR-lists into InSet, pushes them into the
Parquet scan, and rewrites outer joins that a later filter makes
NULL-rejecting into inner joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairgrid.functions.columns import parse_number
from pairgrid.session import ensure_checkpoint_dir

# Unit → factor to days, for the accepted duration units.
DURATION_FACTORS = {"h": 1 / 24, "hpf": 1 / 24, "mi": 1 / 60 / 24, "wk": 7.0, "mo": 30.0, "d": 1.0, "dpf": 1.0}

# Unit → factor to mg/L, for the accepted concentration units
# (ppt is divided by 1e9, like pg/L, as in the reference).
CONC_FACTORS = {
    "g/L": 1000.0, "mg/ml": 1000.0,
    "ug/L": 1e-3, "AI ug/L": 1e-3, "ppb": 1e-3, "AI ppb": 1e-3, "ng/ml": 1e-3, "AI ng/mL": 1e-3, "pg/ul": 1e-3,
    "ng/L": 1e-6, "AI ng/L": 1e-6, "pg/ml": 1e-6,
    "pg/L": 1e-9, "ppt": 1e-9,
    "AI mg/L": 1.0, "AI ppm": 1.0, "AI ug/ml": 1.0, "mg/L": 1.0, "ppm": 1.0, "ug/ml": 1.0,
}

# The curation's code filters.
EFFECT_CODES = ["MOR", "~MOR", "~MOR/", "MOR/"]
LOCATION_CODES = ["LAB", "NR"]
EXCLUDED_EXPOSURE = ["FD", "IJ", "IP", "IV", "IVT", "YK"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- P1–P7: projection and predicates ---------------------------------------

def select_rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep and rename columns (P1); the Parquet scan reads only these."""
    return df.select(*[F.col(a).alias(b) for a, b in mapping.items()])


def filter_equal(df: DataFrame, col: str, v) -> DataFrame:
    return df.filter(F.col(col) == F.lit(v))


def filter_in(df: DataFrame, col: str, vs: Sequence) -> DataFrame:
    return df.filter(F.col(col).isin(list(vs)))


def filter_not_in(df: DataFrame, col: str, vs: Sequence) -> DataFrame:
    """Exclude listed values; NULL is dropped too (SQL three-valued logic)."""
    return df.filter(~F.col(col).isin(list(vs)))


def filter_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull())


def filter_not_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def filter_numeric_text(df: DataFrame, col: str) -> DataFrame:
    """Keep rows whose text parses as a number and is not ``NR``."""
    return df.filter((F.col(col) != "NR") & parse_number(col).isNotNull())


def filter_range(df: DataFrame, col, lo: float | None = None, hi: float | None = None,
                 digits: int | None = None, exclude_zero: bool = False) -> DataFrame:
    """lo ≤ x ≤ hi, optionally after rounding both sides to ``digits``."""
    x = _c(col)
    preds = []
    if exclude_zero:
        preds.append(x != 0)
    if lo is not None:
        preds.append((F.round(x, digits) >= F.round(F.lit(lo), digits)) if digits is not None else (x >= lo))
    if hi is not None:
        preds.append((F.round(x, digits) <= F.round(F.lit(hi), digits)) if digits is not None else (x <= hi))
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


# --- P8/P9: unit normalisation ------------------------------------------------

def unit_table(spark: SparkSession, factors: Mapping[str, float], unit: str = "unit") -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in factors.items()], f"{unit} string, factor double")


def _normalize(df: DataFrame, value: str, unit: str, out: str, factors: Mapping[str, float],
               table: DataFrame | None) -> DataFrame:
    t = table if table is not None else unit_table(df.sparkSession, factors)
    t = t.withColumnRenamed("unit", "_unit").withColumnRenamed("factor", "_factor")
    # the unit table is a fixed list of codes: a broadcast of bounded size
    j = df.join(F.broadcast(t), F.col(unit) == F.col("_unit"), "left")
    # unknown units pass through unchanged, as in the reference's last branch
    return j.withColumn(out, parse_number(value) * F.coalesce(F.col("_factor"), F.lit(1.0))).drop("_unit", "_factor")


def normalize_duration(df: DataFrame, value: str, unit: str, out: str = "duration_d",
                       table: DataFrame | None = None) -> DataFrame:
    """(value text, unit) → days."""
    return _normalize(df, value, unit, out, DURATION_FACTORS, table)


def normalize_concentration(df: DataFrame, value: str, unit: str, out: str = "conc_mgl",
                            table: DataFrame | None = None) -> DataFrame:
    """(value text, unit) → mg/L."""
    return _normalize(df, value, unit, out, CONC_FACTORS, table)


# --- P11–P23: scalar and table transforms ---------------------------------------

def patch_value(df: DataFrame, col: str, old, new) -> DataFrame:
    """Replace one literal value."""
    return df.withColumn(col, F.when(F.col(col) == F.lit(old), F.lit(new)).otherwise(F.col(col)))


def log10_target(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.log10(col))


def frequent_edges(df: DataFrame, col: str, min_count: int | None = None, lo: float = 0.0,
                   min_share: float | None = None, max_edges: int = 100_000) -> list[float]:
    """Bin edges = lo ∪ {values with ≥ min_count rows} ∪ {max}.

    ``min_share`` states the threshold as a share of the rows instead. The
    edges are read back to the driver as a list: their number is checked
    against ``max_edges`` first (each edge needs ``min_count`` rows, so there
    are at most rows / min_count of them).
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.max(col).alias("mx")).first()
    if stats["n"] == 0:
        return [lo]
    thr = min_count if min_share is None else min_share * stats["n"]
    freq = counts.filter(F.col("_n") >= F.lit(thr)).select(col).limit(max_edges + 1).collect()
    if len(freq) > max_edges:
        raise ValueError(f"frequent_edges: more than {max_edges} edges")
    return sorted({float(lo), float(stats["mx"]), *[float(r[0]) for r in freq]})


def category_code(df: DataFrame, col: str, out: str) -> DataFrame:
    """Dense 0-based code of each value in sorted order.

    Codes are computed on the distinct values only: a range-partitioned sort, written once
    with each value's place in its partition, and the partitions' offsets, so no task
    holds all values and later reads don't sort again. The code table is joined back; AQE
    broadcasts it when it is small.
    """
    ensure_checkpoint_dir(df.sparkSession)
    place = F.monotonically_increasing_id()  # the partition's number in the bits above 33
    vals = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).withColumn("_at", place).checkpoint(eager=True)
    part = F.shiftright("_at", 33)
    # one row per partition
    counts = vals.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))
    code_df = vals.withColumn("_p", part).join(F.broadcast(offsets), "_p").select(col, (F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint").alias(out))
    return df.join(code_df, col, "left")


def collapse_fold_flags(df: DataFrame, flags: Sequence[str], out: str) -> DataFrame:
    """Boolean fold columns → one fold id, 0 when none is set."""
    expr = F.coalesce(*[F.when(F.col(f), F.lit(i + 1)) for i, f in enumerate(flags)], F.lit(0))
    return df.withColumn(out, expr.cast("int"))


def expand_fold_flags(df: DataFrame, fold: str, k: int, prefix: str) -> DataFrame:
    """Fold id → k boolean columns."""
    return df.select("*", *[(F.col(fold) == i).alias(f"{prefix}{i}") for i in range(1, k + 1)])


def relabel(df: DataFrame, col: str, mapping: Mapping[str, str], out: str | None = None) -> DataFrame:
    """Map codes to display names; unmapped values stay."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return df.withColumn(out or col, F.coalesce(m[F.col(col)], F.col(col)))


def fill_default(df: DataFrame, col: str, v) -> DataFrame:
    """NULL → default."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(v)))


def restore_null(df: DataFrame, col: str, v) -> DataFrame:
    """default → NULL, the inverse of :func:`fill_default`."""
    return df.withColumn(col, F.when(F.col(col) != F.lit(v), F.col(col)))


def round_report(df: DataFrame, cols: Sequence[str], digits: int) -> DataFrame:
    """Round for display (P22); half-up, unlike numpy's half-even."""
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def log_ratio_scale(df_long: DataFrame, bit: str = "bit", cnt: str = "cnt", out: str = "val",
                    fit_on: DataFrame | None = None) -> DataFrame:
    """log(1 + count) ÷ its maximum per feature column.

    The maximum is taken over ``fit_on`` (default: all entities, as the
    reference does). Zeros have no row in the long form, so all-zero
    columns never divide 0 by 0. The per-feature maxima are one row per
    feature (bounded by the feature width).
    """
    src = fit_on if fit_on is not None else df_long
    mx = src.groupBy(bit).agg(F.max(F.log1p(F.col(cnt).cast("double"))).alias("_mx"))
    return (df_long.join(F.broadcast(mx), bit, "left")
                   .withColumn(out, F.log1p(F.col(cnt).cast("double")) / F.col("_mx")).drop("_mx"))


# --- J1–J10: joins ----------------------------------------------------------------

def join_left_fact(df: DataFrame, other: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Large ⟕ large equi-join (J1), sort-merge on the key."""
    return df.join(other, on, "left")


def join_left_dim(df: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """⟕ a dimension (J2). Dimensions that grow with the data are not forced
    to broadcast; AQE switches to a broadcast join when the measured size is
    under ``spark.sql.autoBroadcastJoinThreshold``."""
    return df.join(dim, on, how)


def join_inner_annotate(df: DataFrame, dim: DataFrame, on) -> DataFrame:
    """⋈ an approved list."""
    return df.join(dim, on, "inner")


def join_left_features(df: DataFrame, fp: DataFrame, key: str) -> DataFrame:
    """Observations ⟕ per-entity features."""
    return df.join(fp, key, "left")


def join_match_check(df: DataFrame, fp: DataFrame, key: str) -> DataFrame:
    """Rows, rows with a feature match, rows without (J5), one aggregation.

    The entity list is de-duplicated first, so the semi-join cannot inflate.
    """
    keys = fp.select(key).distinct().withColumn("_hit", F.lit(1))
    j = df.select(key).join(keys, key, "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count("_hit").alias("n_matched"),
                 F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).cast("bigint").alias("n_missing"))


def join_predictions(df: DataFrame, pred: DataFrame, on: Sequence[str] = ("index",)) -> DataFrame:
    """Observations ⋈ predictions with an explicit key list."""
    return df.join(pred, list(on), "inner")


def semi_membership(df: DataFrame, keys_df: DataFrame, on) -> DataFrame:
    """Rows whose key is in a set (J7), a left-semi join."""
    return df.join(keys_df, on, "left_semi")


def anti_holdout(df: DataFrame, fold: str, i: int) -> DataFrame:
    """Training rows of fold i: every row not in it."""
    return df.filter(F.col(fold) != i)


def join_null_safe(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "left",
                   suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join where NULL keys match NULL keys (J9, ``<=>``); clashing non-key
    names get suffixes, as R's merge does."""
    shared = (set(df.columns) & set(other.columns)) - set(on)
    a = df.select(*[F.col(c).alias(c + suffixes[0]) if c in shared else F.col(c) for c in df.columns])
    b = other.select(*[F.col(c).alias(c + suffixes[1]) if c in shared else
                       (F.col(c).alias("_r_" + c) if c in on else F.col(c)) for c in other.columns])
    cond = reduce(lambda x, y: x & y, [a[c].eqNullSafe(b["_r_" + c]) for c in on])
    out = a.join(b, cond, how)
    if how in ("right", "right_outer"):
        out = out.select(*[F.coalesce(F.col(c), F.col("_r_" + c)).alias(c) if c in on else F.col(c)
                           for c in a.columns], *[c for c in b.columns if not c.startswith("_r_")])
        return out
    return out.drop(*["_r_" + c for c in on])


def cross_grid(spark: SparkSession, axes: Mapping[str, Sequence], legal: DataFrame | None = None,
               on: Sequence[str] | None = None) -> DataFrame:
    """Cartesian product of grid axes, restricted to legal combinations.

    Each axis is a literal array exploded in turn (a Generate, no join); the
    legal pairs are a fixed, small list joined as a broadcast left-semi.
    """
    names = list(axes)
    first = names[0]
    df = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in axes[first]])).alias(first))
    for n in names[1:]:
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in axes[n]])).alias(n))
    if legal is not None:
        df = df.join(F.broadcast(legal), list(on or legal.columns), "left_semi")
    return df
