"""Windows, sorts, limits, reshapes and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgrid.functions.columns import hash_unit, pair_key


def _order(cols: Sequence[str | Column]) -> list[Column]:
    out = []
    for c in cols:
        if isinstance(c, Column):
            out.append(c)
        elif c.startswith("-"):
            out.append(F.col(c[1:]).desc_nulls_last())
        else:
            out.append(F.col(c).asc_nulls_last())
    return out


def best_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key by a total order (W1; also G5 ``distinct_keep_first``).

    ``order`` entries are names (``-name`` for descending) or Columns; NULL
    scores sort last. Spark plans this as a WindowGroupLimit, which keeps
    only the best row per key on the map side before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_k(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    """k first rows by a total order (W3): a TakeOrderedAndProject, no full sort."""
    return df.orderBy(*_order(order)).limit(k)


def head_tail_select(df: DataFrame, key: str, score: str, n_head: int, n_tail: int) -> DataFrame:
    """Keys in the top ``n_head`` or bottom ``n_tail`` by score.

    Ties are broken by the key. Each side is a bounded top-k (per-partition
    top-k, then a merge of at most k rows per partition), never a global sort.
    """
    head = (df.select(key, score).orderBy(F.col(score).desc(), F.col(key).asc()).limit(n_head)
              .withColumn("side", F.lit("head")))
    tail = (df.select(key, score).orderBy(F.col(score).asc(), F.col(key).desc()).limit(n_tail)
              .withColumn("side", F.lit("tail")))
    return head.unionByName(tail)


def pivot_matrix(df: DataFrame, index: Sequence[str], column: str, value: str,
                 values: Sequence) -> DataFrame:
    """Long → wide, one column per listed value (W5). Duplicate keys would be
    ambiguous, so callers aggregate first; ``first`` picks the single value."""
    return df.groupBy(*index).pivot(column, list(values)).agg(F.first(value))


def pivot_two_level(df: DataFrame, index: Sequence[str], columns: Sequence[str], value: str,
                    values: Sequence[str], sep: str = "_") -> DataFrame:
    """Pivot on the joined key of several columns."""
    key = F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])
    return df.withColumn("_k", key).groupBy(*index).pivot("_k", list(values)).agg(F.first(value))


def reindex_grid(values: DataFrame, rows: DataFrame, cols: DataFrame, row_key: str, col_key: str,
                 value: str, max_cols: int = 10_000) -> DataFrame:
    """Dense (row × column) frame over fixed key lists, gaps NULL.

    The column-key list is a chosen, bounded set (W4 picks at most
    n_head + n_tail keys); its size is checked before it is inlined as a
    literal array, and each row key is expanded by it (a Generate, not a join).
    """
    keys = [r[0] for r in cols.select(col_key).distinct().limit(max_cols + 1).collect()]
    if len(keys) > max_cols:
        raise ValueError(f"reindex_grid: more than {max_cols} column keys")
    keys.sort()
    grid = rows.select(row_key, F.explode(F.array(*[F.lit(k) for k in keys])).alias(col_key))
    return grid.join(values.select(row_key, col_key, value), [row_key, col_key], "left")


def order_output(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    """Total order of a result."""
    return df.orderBy(*_order(cols))


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: str = "42") -> DataFrame:
    """n rows in a repeatable pseudo-random order (W9): the n smallest key hashes.

    Unlike ``sample`` the result does not depend on partitioning; the limit
    is the feature (a fixed-size sample) and runs as a top-k, no full sort.
    """
    h = hash_unit(pair_key(keys), seed)
    return df.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")


def filter_slice(df: DataFrame, conds: Mapping[str, object]) -> DataFrame:
    """Conjunction of equality / membership conditions."""
    preds = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else (F.col(c) == F.lit(v))
             for c, v in conds.items()]
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def global_row_index(df: DataFrame, keys: Sequence[str], seed: str = "42", buckets: int = 256,
                     tiebreak: Sequence[str] = (), out: str = "index") -> DataFrame:
    """Dense 0-based row id in seeded-shuffle order.

    The order is (hash of ``keys`` with ``seed``, ``keys``, ``tiebreak``);
    together they must identify a row. Rows go to ``buckets`` contiguous
    ranges of the 32-bit hash (uniform and deterministic: no sampling), are
    numbered inside their bucket, and shifted by the row count of all lower
    buckets. The offset table has one row per bucket, so no step holds more
    than one bucket of rows.
    """
    h = hash_unit(pair_key(keys), seed)
    d = df.withColumn("_h", h).withColumn("_b", (F.col("_h") * buckets / F.lit(4294967296.0)).cast("int"))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # one row per bucket: a bounded table, summed in bucket order
    offsets = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_off"))
    w = Window.partitionBy("_b").orderBy("_h", *keys, *tiebreak)
    d = d.withColumn("_r", F.row_number().over(w))
    return (d.join(F.broadcast(offsets), "_b")
             .withColumn(out, (F.col("_off") + F.col("_r") - 1).cast("bigint"))
             .drop("_h", "_b", "_r", "_off"))


# --- set operations ----------------------------------------------------------

def union_predictions(dfs: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_key_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set union of two key lists."""
    return a.union(b).distinct()


def distinct_labels(df: DataFrame, cols: Sequence[str], sep: str = " x ") -> DataFrame:
    """Distinct joined labels such as ``model x setting``."""
    return df.select(F.concat_ws(sep, *cols).alias("label")).distinct()


def complement_split(df: DataFrame, part: DataFrame, on: Sequence[str]) -> DataFrame:
    """All rows minus the rows of ``part`` by key (U4), as a left-anti join."""
    return df.join(part.select(*on), list(on), "left_anti")
