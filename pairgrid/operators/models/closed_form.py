"""Closed-form learners scored from fold-cell sums.

Ridge on a single one-hot factor with a free intercept has a closed form
(Σ over groups g, n_g rows, mean m_g, penalty α):

    c_g = n_g α / (n_g + α)
    b   = Σ c_g m_g / Σ c_g                       (intercept)
    ŷ_g = b · α/(n_g + α) + n_g m_g/(n_g + α)     (b for a level unseen in training)

The null model (R0, mean of y) is the same formula on one constant group.

Every quantity is a sum over rows, so a whole nested cross-validation grid
needs only per-(group, outer fold, inner fold) sums: the rows are read
once, partially aggregated on the map side (a hot group costs one row per
partition), and no per-fold copy of the data is ever made. Because ŷ_g is
linear in b, the validation error of every (split, α) is

    SSE = A + B·b + C·b²

with A, B, C plain sums over groups, so scoring is one more aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ridge penalty grid of the reference's linear models.
ALPHA_GRID = [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0]

# Scores closer than this are ties (broken by the smaller penalty), so the
# choice does not depend on the summation order of one engine.
SCORE_DIGITS = 9


def cell_stats(df: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """Row count, Σy and Σy² per key combination (partial aggregation)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("sy"),
        F.sum(F.col(y) * F.col(y)).alias("syy"),
    )


def group_cells(cells: DataFrame, keys: Sequence[str], fold: str = "f", k: int = 5,
                inner: str | None = None, k_inner: int | None = None) -> DataFrame:
    """One line per group: its cells laid out as arrays by outer fold (``f_*``) and, with
    ``inner``, by outer and inner fold (``c_*``). Folds count from 1; an array holds at
    most k·k_inner entries, so every split of a group follows from its line alone.
    ``f_cells`` counts a fold's cells; a sum without values is null.
    """
    # cells, not partial lines of arrays, are exchanged
    return cells.repartition(*keys).groupBy(*keys).agg(*_line(F.col(fold), k, F.col(inner) if inner else None, k_inner, F.col("n"), F.col("sy"), F.col("syy")))


def _line(f: Column, k: int, j: Column | None, k_inner: int | None, n: Column, sy: Column, syy: Column) -> list[Column]:
    """The aggregates that lay a group's sums out by fold."""
    of = {"f": [f == o for o in range(1, k + 1)]}
    if j is not None:
        of["c"] = [(f == o) & (j == i) for o in range(1, k + 1) for i in range(1, k_inner + 1)]
    found = [F.array(*[F.sum(F.when(at, x)) for at in tests]).alias(f"{kind}_{c}") for kind, tests in of.items() for c, x in (("n", n), ("sy", sy), ("syy", syy))]
    return [*found, F.array(*[F.count(F.when(at, 1)) for at in of["f"]]).alias("f_cells")]


#: A group with this share of the rows is summed where its rows lie before it is exchanged.
HOT_SHARE = 0.01


def split_hot(rows: DataFrame, names: Sequence[str]) -> dict[str, tuple[DataFrame, DataFrame | None]]:
    """For each grouping column the rows of its usual groups and those of its hot ones
    (None: there are none). Every group that holds ``HOT_SHARE`` of the rows is hot, at
    most 1 / HOT_SHARE of them are found, in one pass without an exchange."""
    found = rows.select(*names).freqItems(list(names), HOT_SHARE).first()
    out = {}
    for at, name in enumerate(names):
        items = found[at] or []
        hot = F.coalesce(F.col(name).isin([x for x in items if x is not None]), F.lit(False)) | (F.col(name).isNull() & F.lit(None in items))
        out[name] = (rows.where(~hot), rows.where(hot)) if items else (rows, None)
    return out


def group_rows(rows: DataFrame, group: str, entries: Sequence[tuple[str, str, str, str]], k: int, k_inner: int, y: str = "y") -> DataFrame:
    """Lines of :func:`group_cells` (setting, model, g) straight from rows, for ``entries``
    (setting, model, outer fold column, inner fold column) over one grouping column.

    Where few rows share a cell, cells are as many as rows: a row is exchanged once, as its
    group, its folds in one number and ``y``, for all entries. ``f_cells`` counts rows.
    """
    base = max(k, k_inner) + 1
    folds = list(dict.fromkeys(c for _, _, f, j in entries for c in (f, j)))
    code = sum((F.coalesce(F.col(c).cast("bigint"), F.lit(0)) * base ** x for x, c in enumerate(folds)), F.lit(0).cast("bigint"))
    sent = rows.select(F.col(group).cast("bigint").alias("g"), code.alias("_folds"), F.col(y).alias("_y")).repartition("g")

    def own(c: str) -> Column:
        return F.floor(F.col("_folds") / F.lit(base ** folds.index(c))).cast("int") % base
    each = F.array(*[F.struct(F.lit(s).alias("setting"), F.lit(m).alias("model"), own(f).alias("f"), own(j).alias("j")) for s, m, f, j in entries])
    long = sent.select("g", "_y", F.explode(each).alias("_e")).select("_e.*", "g", "_y")
    return long.groupBy("setting", "model", "g").agg(*_line(F.col("f"), k, F.col("j"), k_inner, F.lit(1).cast("bigint"), F.col("_y"), F.col("_y") * F.col("_y")))


def _split_sums(train: np.ndarray, val: np.ndarray, others: np.ndarray | None, names: list[tuple[int, ...]]):
    """Lines of cells (n, sy, syy as arrays, cells by fold, keys) -> their splits as a list of structs.

    ``train`` and ``val`` mark a split's cells, ``others`` the folds of which one
    must have a cell (None: every group has all splits).
    A sum is null where none of its cells has a value and the other side has no cell.
    """
    def table(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)

    def total(x: np.ndarray, side: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gone = np.isnan(x)
        return np.where(gone, 0.0, x) @ side.T, (other > 0) | ((~gone).astype(float) @ side.T > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sy, syy, cells = (table(batch.column(i)) for i in range(4))
            n = np.nan_to_num(n)
            tn, vn = n @ train.T, n @ val.T
            sums = [total(sy, train, vn), total(sy, val, tn), total(syy, val, tn)]
            there = np.ones(tn.shape, bool) if others is None else cells @ others.T > 0
            row, split = np.nonzero(there)
            ids = [pa.array(np.array(x, np.int32)[split]) for x in zip(*names)]
            tsy, vsy, vsyy = (pa.array(v[there], mask=~ok[there]) for v, ok in sums)
            found = pa.StructArray.from_arrays([*ids, pa.array(tn[there].astype(np.int64)), tsy, pa.array(vn[there].astype(np.int64)), vsy, vsyy],
                                               names=[*("o", "i")[:len(ids)], "tn", "tsy", "vn", "vsy", "vsyy"])
            ends = np.r_[0, np.cumsum(there.sum(1))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], pa.ListArray.from_arrays(pa.array(ends), found)], names=[*batch.schema.names[4:], "_s"])
    return run


def split_stats(cells: DataFrame, keys: Sequence[str], fold: str = "f", k: int = 5,
                inner: str | None = None, k_inner: int | None = None) -> DataFrame:
    """Training and validation sums per (keys, outer fold o[, inner fold i]).

    Outer only: training = rows with ``fold <> o``; validation = ``fold = o``.
    Nested (``inner`` given): both sides lie inside the outer training set;
    training = ``fold <> o AND inner <> i``, validation = ``fold <> o AND inner = i``.

    ``cells`` are cells or the lines of :func:`group_cells`. A line's splits, at most
    k·k_inner, are sums over its own cells, taken in Arrow batches: no exchange and no
    grouping of expanded rows.
    """
    lines = cells if "f_cells" in cells.columns else group_cells(cells, keys, fold, k, inner, k_inner)
    ki = k_inner if inner else 1
    names = [(o, i) if inner else (o,) for o in range(1, k + 1) for i in range(1, ki + 1)]
    f, j = np.repeat(np.arange(1, k + 1), ki), np.tile(np.arange(1, ki + 1), k)
    if inner:
        val = np.array([(f != o) & (j == i) for o, i in names])
        train = np.array([(f != o) & (j != i) for o, i in names])
        kind, others = "c", np.array([np.arange(1, k + 1) != o for o, _ in names])
    else:
        val = np.array([f == o for o, in names])
        train, kind, others = ~val, "f", None
    body = "o: int, " + ("i: int, " if inner else "") + "tn: bigint, tsy: double, vn: bigint, vsy: double, vsyy: double"
    # names that any key may have are kept from the schema text
    plain = [f"k{x}" for x in range(len(keys))]
    sent = lines.select(*[f"{kind}_{c}" for c in ("n", "sy", "syy")], "f_cells", *[F.col(c).alias(p) for c, p in zip(keys, plain)])
    schema = ", ".join(f"{p} {lines.schema[c].dataType.simpleString()}" for c, p in zip(keys, plain))
    run = _split_sums(train.astype(float), val.astype(float), others, names)
    out = sent.mapInArrow(run, f"{schema}, _s array<struct<{body}>>").select(*plain, F.explode("_s").alias("_s"))
    return out.select(*[F.col(p).alias(c) for c, p in zip(keys, plain)], "_s.*")


def _shrink_terms(alpha: Column) -> tuple[Column, Column, Column, Column]:
    """Per-group (c, c·m, w, mm) with ŷ = b·w + mm; groups absent from training give (0, 0, 1, 0)."""
    tn = F.col("tn").cast("double")
    seen = F.col("tn") > 0
    c = F.when(seen, tn * alpha / (tn + alpha)).otherwise(0.0)
    cm = F.when(seen, F.col("tsy") * alpha / (tn + alpha)).otherwise(0.0)   # c · m
    w = F.when(seen, alpha / (tn + alpha)).otherwise(1.0)
    mm = F.when(seen, F.col("tsy") / (tn + alpha)).otherwise(0.0)          # n·m/(n+α)
    return c, cm, w, mm


def score_shrunk_mean(stats: DataFrame, by: Sequence[str], alphas: Sequence[float] | None = None,
                      alpha_col: str | None = None) -> DataFrame:
    """Validation SSE / RMSE of the closed-form ridge for every (by, α).

    ``stats`` comes from :func:`split_stats` with the model's group column
    among its keys; ``by`` lists the split columns (e.g. setting, model, o, i).
    Either a literal α grid (exploded, a fixed factor) or a column holding
    the α chosen per split is used.
    """
    if alpha_col is None:
        grid = F.array(*[F.lit(float(a)) for a in (alphas or ALPHA_GRID)])
        s = stats.select("*", F.explode(grid).alias("alpha"))
    else:
        s = stats.withColumnRenamed(alpha_col, "alpha")
    c, cm, w, mm = _shrink_terms(F.col("alpha"))
    vn, vsy, vsyy = F.col("vn"), F.col("vsy"), F.col("vsyy")
    s = s.select(*by, "alpha", c.alias("c"), cm.alias("cm"),
                 (vsyy - 2 * mm * vsy + vn * mm * mm).alias("a_"),
                 (-2 * w * vsy + 2 * vn * w * mm).alias("b_"),
                 (vn * w * w).alias("c_"), vn.alias("vn"))
    agg = s.groupBy(*by, "alpha").agg(
        F.sum("c").alias("sc"), F.sum("cm").alias("scm"),
        F.sum("a_").alias("A"), F.sum("b_").alias("B"), F.sum("c_").alias("C"),
        F.sum("vn").alias("n_val"))
    b = F.col("scm") / F.col("sc")
    sse = F.greatest(F.col("A") + F.col("B") * b + F.col("C") * b * b, F.lit(0.0))
    return agg.select(*by, "alpha", b.alias("intercept"), sse.alias("sse"),
                      F.col("n_val").cast("bigint").alias("n_val"),
                      F.sqrt(sse / F.col("n_val")).alias("rmse"))


def group_predictions(stats: DataFrame, by: Sequence[str], group: str, alpha_col: str = "alpha") -> DataFrame:
    """ŷ per (by, group) for the α in ``alpha_col`` (R1/R2 ``transform``).

    The intercept table has one row per split (bounded by settings × models ×
    folds), so joining it back is a broadcast of a fixed-size table.
    """
    c, cm, w, mm = _shrink_terms(F.col(alpha_col))
    terms = stats.select(*by, group, alpha_col, c.alias("c"), cm.alias("cm"), w.alias("w"), mm.alias("mm"))
    icpt = terms.groupBy(*by).agg((F.sum("cm") / F.sum("c")).alias("intercept"))
    return (terms.join(F.broadcast(icpt), list(by))
                 .select(*by, group, "intercept", (F.col("intercept") * F.col("w") + F.col("mm")).alias("y_pred")))


def fold_mean_score(grid: DataFrame, by: Sequence[str], score: str = "rmse") -> DataFrame:
    """Mean of per-inner-fold scores (G11: the grid's selection score)."""
    return grid.groupBy(*by).agg(F.avg(score).alias(score))


def rank_score(col: str = "rmse") -> Column:
    return F.round(F.col(col), SCORE_DIGITS)
