"""Grouped cross-validation folds (V1–V7).

Folds are a column, never a materialised copy of the data: a row's fold is
a function of its group key (hash, V2) or a small (key → fold) map joined
back (greedy, V1). Nested folds (V4) are a second column per outer fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairgrid.functions.columns import hash_fold, hash_share, int_fold, pair_key
from pairgrid.session import ensure_checkpoint_dir


def _key(keys: Sequence[str]):
    return pair_key(keys) if len(keys) > 1 else F.col(keys[0]).cast("string")


_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def _hash_fold(df: DataFrame, keys: Sequence[str], k: int, salt: str = ""):
    """V2 fold: arithmetic hash for integer keys, md5 of the joined key otherwise."""
    types = dict(df.dtypes)
    if all(types[c] in _INTEGRAL for c in keys):
        return int_fold([F.col(c) for c in keys], k, salt)
    return hash_fold(_key(keys), k, salt)


def greedy_segments(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Greedy folds of equal-sized groups at a time: (size, from, to, folds).

    ``sizes`` holds (size, number of groups), the largest size first; each group goes
    to the lightest fold (lowest fold on ties). With loads ``L``, the r-th group of
    size c goes to the fold of the r-th smallest of all ``L[f] + c·t``. Written as
    c·level + rest, those values run level by level in (rest, fold) order over the
    folds that have reached the level. The folds in reach change at most k times, so
    a size takes at most k segments; inside one, group r gets
    ``folds[(r - from) % len(folds)]``.
    """
    loads = [0] * k
    out = []
    for c, m in sizes:
        level = [load // c for load in loads]
        taken, now, at = [0] * k, min(level), 0
        while at < m:
            reach = sorted((loads[f] % c, f) for f in range(k) if level[f] <= now)
            ahead = [x for x in level if x > now]
            length = min(m - at, (min(ahead) - now) * len(reach) if ahead else m - at)
            for i, (_, f) in enumerate(reach):
                taken[f] += length // len(reach) + (i < length % len(reach))
            out.append((c, at, at + length, [f + 1 for _, f in reach]))
            at += length
            now = min(ahead, default=now)
        loads = [load + c * t for load, t in zip(loads, taken)]
    return out


def assign_folds(df: DataFrame, keys: Sequence[str], k: int = 5, method: str = "hash",
                 out: str = "fold", salt: str = "") -> DataFrame:
    """Attach a group fold 1..k to every row (V1 greedy, V2 hash).

    ``hash``: an arithmetic hash for integer keys, an md5 bucket of the joined key
    otherwise; no shuffle, streams, any scale.
    ``greedy``: rows → per-group counts (partial aggregation) →
    :func:`greedy_fold_map` → the (key → fold) map is joined back.
    """
    if callable(method):
        # user splitter (Y4): a function (key Column, k) → fold Column
        return df.withColumn(out, method(_key(keys), k).cast("int"))
    if method == "hash":
        return df.withColumn(out, _hash_fold(df, keys, k, salt))
    if method != "greedy":
        raise ValueError(method)
    kcol = "_gkey"
    d = df.withColumn(kcol, _key(keys))
    counts = d.groupBy(kcol).agg(F.count(F.lit(1)).alias("_n"))
    fmap = greedy_fold_map(counts, kcol, "_n", k)
    return d.join(fmap, kcol, "left").withColumnRenamed("fold", out).drop(kcol)


def greedy_fold_map(counts: DataFrame, key: str, n: str, k: int, part: Sequence[str] = ()) -> DataFrame:
    """(part…, key, count) → (part…, key, fold), exact greedy at any number of groups.

    Groups are taken in (count descending, key ascending) order, each to the lightest
    fold. The histogram of group sizes has at most √(2 · rows) lines a part; from it
    :func:`greedy_segments` tells where the r-th group of a size goes. Ranks come from
    a range-partitioned sort: a rank inside its range plus the groups of lower ranges.
    """
    spark = counts.sparkSession
    part = list(part)
    ensure_checkpoint_dir(spark)
    ways = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ranges = (counts.select(*part, key, F.col(n).alias("_c")).repartitionByRange(ways, *part, "_c", key)
              .withColumn("_range", F.spark_partition_id()).checkpoint())
    per = ranges.groupBy(*part, "_c", "_range").agg(F.count(F.lit(1)).alias("_m"))
    lower = Window.partitionBy(*part, "_c").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = per.withColumn("_off", F.coalesce(F.sum("_m").over(lower), F.lit(0))).drop("_m")
    rank = F.row_number().over(Window.partitionBy(*part, "_c", "_range").orderBy(key)) - 1
    ranked = ranges.withColumn("_r", rank).join(offsets, [*part, "_c", "_range"]).withColumn("_r", F.col("_r") + F.col("_off"))
    hist: dict[tuple, list] = {}
    for row in per.groupBy(*part, "_c").agg(F.sum("_m").alias("_m")).collect():  # at most √(2 · rows) a part
        hist.setdefault(tuple(row[p] for p in part), []).append((row["_c"], row["_m"]))
    plan = [(*own, *seg) for own, sizes in hist.items() for seg in greedy_segments(sorted(sizes, reverse=True), k)]
    types = dict(counts.dtypes)
    schema = ", ".join([*(f"{p} {types[p]}" for p in part), "_c bigint, _from bigint, _to bigint, _folds array<int>"])
    plan_df = spark.createDataFrame(plan, schema)
    both = ranked.join(plan_df, [*part, "_c"]).where("_r >= _from and _r < _to")
    return both.select(*part, key, F.element_at("_folds", ((F.col("_r") - F.col("_from")) % F.size("_folds")).cast("int") + 1).alias("fold"))


def holdout(df: DataFrame, setting: str, k: int = 5, method: str = "hash", out: str = "fold",
            pair: Sequence[str] = ("chem", "species"), entity: Sequence[str] = ("chem",)) -> DataFrame:
    """setting1 holds out (chemical, species) pairs; setting2 whole chemicals (V3)."""
    keys = list(pair) if setting == "setting1" else list(entity)
    return assign_folds(df, keys, k, method, out)


def nested_folds(df: DataFrame, keys: Sequence[str], fold: str = "fold", k: int = 5, k_inner: int = 5,
                 method: str = "hash", salt: str = "inner") -> DataFrame:
    """(row…, outer, inner) for every row of every outer training set (V4).

    Each row appears once per outer fold it trains in (k − 1 copies): that
    is the definition of nested sets. Aggregating learners should use fold
    columns directly instead (see models.closed_form), which needs no copy.
    ``hash``: inner = salted key hash, the same in every outer set.
    ``greedy``: inner folds are rebuilt inside each outer training set from
    its group counts.
    """
    kcol = "_gkey"
    d = df.withColumn(kcol, _key(keys))
    outer = F.explode(F.filter(F.array(*[F.lit(o) for o in range(1, k + 1)]), lambda o: o != F.col(fold)))
    rows = d.select("*", outer.alias("outer"))
    if method == "hash":
        return rows.withColumn("inner", _hash_fold(df, keys, k_inner, salt)).drop(kcol)
    counts = rows.groupBy("outer", kcol).agg(F.count(F.lit(1)).alias("_n"))
    fmap = greedy_fold_map(counts, kcol, "_n", k_inner, part=["outer"]).withColumnRenamed("fold", "inner")
    return rows.join(fmap, ["outer", kcol]).drop(kcol)


def read_folds(df: DataFrame, setting_col: str = "setting", fold: str = "fold") -> DataFrame:
    """Test and training sizes of every stored fold in one job (V5)."""
    per = df.groupBy(setting_col, fold).agg(F.count(F.lit(1)).alias("n_test"))
    tot = df.groupBy(setting_col).agg(F.count(F.lit(1)).alias("_tot"))
    return per.join(tot, setting_col).select(setting_col, fold, "n_test",
                                             (F.col("_tot") - F.col("n_test")).alias("n_train"))


def leakage_check(df: DataFrame, keys: Sequence[str], fold: str = "fold") -> DataFrame:
    """Groups spread over more than one fold (should be none) and fold balance (V6)."""
    per_group = df.groupBy(*keys).agg(F.countDistinct(fold).alias("_nf"))
    per_fold = df.groupBy(fold).agg(F.count(F.lit(1)).alias("_rows"))
    g = per_group.agg(F.count(F.lit(1)).alias("n_groups"),
                      F.sum(F.when(F.col("_nf") > 1, 1).otherwise(0)).cast("bigint").alias("n_leaking"),
                      F.max("_nf").cast("bigint").alias("max_folds_per_group"))
    f = per_fold.agg(F.count(F.lit(1)).alias("n_folds"), F.min("_rows").alias("min_fold_rows"),
                     F.max("_rows").alias("max_fold_rows"))
    return _one_row_pair(g, f)


def _one_row_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Put two one-row aggregates side by side: stack them as structs and take
    the non-NULL one of each (a two-row aggregate, no join)."""
    sa = F.struct(*[F.col(c) for c in a.columns])
    sb = F.struct(*[F.col(c) for c in b.columns])
    u = (a.select(sa.alias("_a"), F.lit(None).cast(_struct_type(b)).alias("_b"))
          .unionByName(b.select(F.lit(None).cast(_struct_type(a)).alias("_a"), sb.alias("_b"))))
    r = u.agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return r.select("_a.*", "_b.*")


def _struct_type(df: DataFrame):
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("s")).schema["s"].dataType


def split_cells(df: DataFrame, a: str, b: str, share: float = 0.2, salt: str = "cells", out: str = "is_test") -> DataFrame:
    """Mark whole (a, b) cells as test with probability ``share`` by key hash (V7)."""
    return df.withColumn(out, hash_share(pair_key([a, b]), salt) < share)


def split_columns(df: DataFrame, b: str, share: float = 0.2, salt: str = "columns", out: str = "is_test") -> DataFrame:
    """Mark whole columns (all rows of one b) as test by key hash (V7)."""
    return df.withColumn(out, hash_share(F.col(b).cast("string"), salt) < share)
