"""Ridge of any width with its coefficients as a table.

The weights are a DataFrame (feature BIGINT, one column per fit), never a vector on
the driver, so the width may pass what one process holds: species x 1,024 interaction
bits, for instance. All fits (settings, folds, penalties) are solved together by
conjugate gradients with a diagonal preconditioner. A step is

    join weights to the stored entries by feature -> sums by row -> residuals of each
    fit's training rows -> sums by feature

and the driver sees four sums a fit. Penalised is sum(n (y - x w)^2) + alpha |w|^2; the
intercept (feature -1) is free.

Some features (intercept, bins, a frequent species) are in a large share of the rows.
Features with more than 1 / ``SHARES`` of all entries, of which there are fewer than
``SHARES``, are dealt to salts in proportion, so that the join by feature stays even.

Each step cuts the lineage with ``checkpoint()``; the session's
``spark.cleaner.referenceTracking.cleanCheckpoints`` says whether old steps are removed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = -1
SHARES = 2000


@dataclass
class Fit:
    train: Column                # over the key columns: rows of the training set
    alpha: float
    without: Column | None = None  # over ``feature``: features that the fit does not have


@dataclass
class Design:
    """Rows (keys, n, sy, x) and their entries by feature, both checkpointed."""
    rows: DataFrame
    entries: DataFrame  # keys, feature, salt, val
    keys: list[str]
    hot: DataFrame      # feature, salts


def design(rows: DataFrame, keys: Sequence[str]) -> Design:
    """``rows``: keys (not null, one row each), n, sy (sum of y over the n rows that
    it stands for), x: array<struct<feature bigint, val double>>, a feature once a row.
    Rows without features keep the intercept; entries of value 0 are left out."""
    keys = list(keys)
    unit = F.array(F.struct(F.lit(INTERCEPT).cast("long").alias("feature"), F.lit(1.0).alias("val")))
    some = F.filter(F.coalesce("x", F.array().cast("array<struct<feature:bigint,val:double>>")), lambda e: e["val"] != 0)
    rows = rows.select(*keys, "n", "sy", F.concat(some, unit).alias("x")).checkpoint(eager=True)
    long = rows.select(*keys, F.explode("x").alias("e")).select(*keys, "e.feature", "e.val")
    share = max(1, -(-long.count() // SHARES))
    hot = long.groupBy("feature").count().where(F.col("count") > share)
    hot = hot.select("feature", F.ceil(F.col("count") / share).cast("int").alias("salts")).checkpoint(eager=True)
    salt = F.coalesce(F.pmod(F.xxhash64(*keys), F.col("salts")), F.lit(0)).cast("int")
    entries = long.join(F.broadcast(hot), "feature", "left").select(*keys, "feature", salt.alias("salt"), "val")
    return Design(rows, entries.checkpoint(eager=True), keys, hot)


def _names(letter: str, fits: Sequence) -> list[str]:
    return [f"{letter}{i}" for i in range(len(fits))]


def _times(d: Design, vector: DataFrame, names: Sequence[str]) -> DataFrame:
    """(keys, names): the product of every row with the columns of ``vector``."""
    salted = vector.join(F.broadcast(d.hot), "feature", "left")
    salted = salted.select("feature", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), *names)
    return d.entries.join(salted, ["feature", "salt"]).groupBy(*d.keys).agg(*[F.sum(F.col("val") * F.col(c)).alias(c) for c in names])


def _by_feature(d: Design, rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, names): the transposed product; ``rows`` has x and the columns ``names``."""
    each = rows.select(F.explode("x").alias("e"), *names).select("e.feature", "e.val", *names)
    return each.groupBy("feature").agg(*[F.sum(F.col("val") * F.col(c)).alias(c) for c in names])


def _when(fit: Fit, value: Column) -> Column:
    return F.when(fit.train, value).otherwise(0.0)


def _penalty(fit: Fit) -> Column:
    return F.when(F.col("feature") == INTERCEPT, 0.0).otherwise(float(fit.alpha))


def fit(d: Design, fits: Sequence[Fit], tol: float = 1e-10, max_steps: int = 1000) -> DataFrame:
    """(feature, w0, w1, ...): the weights of every fit. A fit is done when no entry of its
    gradient exceeds ``tol`` times the largest one at the start; one that is not
    done after ``max_steps`` is an error. A fit without training rows has weights 0."""
    w, r, p, v, a = (_names(c, fits) for c in "wrpva")
    n, sy = d.rows.agg(F.sum("n"), F.sum("sy")).first()
    centre = float(sy / n) if n else 0.0
    sums = d.rows.select("x", *[_when(f, F.col("sy") - F.col("n") * centre).alias(c) for f, c in zip(fits, r)])
    start = _by_feature(d, sums, r)
    squares = d.rows.select(F.transform("x", lambda e: F.struct(e["feature"].alias("feature"), (e["val"] * e["val"]).alias("val"))).alias("x"),
                            *[_when(f, F.col("n").cast("double")).alias(c) for f, c in zip(fits, v)])
    start = start.join(_by_feature(d, squares, v), "feature")

    def inverse(f: Fit, c: str) -> Column:
        whole = F.col(c) + _penalty(f)
        there = whole > 0 if f.without is None else (whole > 0) & ~f.without
        return F.when(there, 1 / whole).otherwise(0.0)

    start = start.select("feature", *[F.lit(0.0).alias(c) for c in w], *r, *[inverse(f, c).alias(c) for f, c in zip(fits, v)])
    state = start.select("*", *[(F.col(x) * F.col(y)).alias(c) for x, y, c in zip(r, v, p)]).checkpoint(eager=True)
    first: list[float] | None = None
    for _ in range(max_steps + 1):
        moved = d.rows.join(_times(d, state, p), d.keys)
        moved = moved.select("x", *[_when(f, F.col("n") * F.col(c)).alias(c) for f, c in zip(fits, p)])
        pulled = _by_feature(d, moved, p).select("feature", *[F.col(c).alias(b) for c, b in zip(p, a)])
        state = state.join(pulled, "feature").select("feature", *w, *r, *p, *v, *[(F.col(b) + _penalty(f) * F.col(c)).alias(b) for f, c, b in zip(fits, p, a)]).checkpoint(eager=True)
        # a feature that a fit leaves out has v = 0 and takes no part
        got = state.agg(*[F.max(F.when(F.col(y) > 0, F.abs(x)).otherwise(0.0)).alias(f"top{i}") for i, (x, y) in enumerate(zip(r, v))],
                        *[F.sum(F.col(x) * F.col(y)).alias(name) for i in range(len(fits)) for name, x, y in
                          ((f"pap{i}", p[i], a[i]),)],
                        *[F.sum(F.col(v[i]) * F.col(r[i]) * F.col(r[i])).alias(f"rr{i}") for i in range(len(fits))],
                        *[F.sum(F.col(v[i]) * F.col(r[i]) * F.col(a[i])).alias(f"ra{i}") for i in range(len(fits))],
                        *[F.sum(F.col(v[i]) * F.col(a[i]) * F.col(a[i])).alias(f"aa{i}") for i in range(len(fits))]).first().asDict()
        top = [got[f"top{i}"] or 0.0 for i in range(len(fits))]
        first = first or top
        left = [i for i in range(len(fits)) if top[i] > tol * first[i]]
        if not left:
            at_intercept = F.col("feature") == INTERCEPT
            there = [F.when(at_intercept & (F.col(y) > 0), F.col(c) + centre).otherwise(F.col(c)).alias(c) for c, y in zip(w, v)]
            return state.select("feature", *there)
        step, turn = [0.0] * len(fits), [0.0] * len(fits)
        for i in left:
            rr, ra, aa = got[f"rr{i}"], got[f"ra{i}"], got[f"aa{i}"]
            step[i] = rr / got[f"pap{i}"]
            turn[i] = max(rr - 2 * step[i] * ra + step[i] ** 2 * aa, 0.0) / rr
        state = state.select("feature", *[(F.col(c) + F.col(x) * s).alias(c) for c, x, s in zip(w, p, step)], *v,
                             *[(F.col(c) - F.col(x) * s).alias(c) for c, x, s in zip(r, a, step)],
                             *[F.col(x).alias(x) for x in p], *a)
        changed = {i: turn[i] for i in left}
        state = state.select("feature", *w, *r, *v, *[(F.col(v[i]) * F.col(r[i]) + F.col(p[i]) * changed[i] if i in changed else F.col(p[i])).alias(p[i]) for i in range(len(fits))])
    raise ArithmeticError(f"{len(left)} of {len(fits)} fits not done after {max_steps} steps")


def predict(d: Design, weights: DataFrame) -> DataFrame:
    """(keys, w0, w1, ...): the prediction of every row by every fit."""
    return _times(d, weights, [c for c in weights.columns if c != "feature"])


def violations(d: Design, weights: DataFrame, fits: Sequence[Fit]) -> list[float]:
    """Largest violated normal equation of each fit, from its predictions."""
    w, g = _names("w", fits), _names("g", fits)
    rest = d.rows.join(predict(d, weights), d.keys).select("x", *[_when(f, F.col("sy") - F.col("n") * F.col(c)).alias(b) for f, c, b in zip(fits, w, g)])
    both = weights.join(_by_feature(d, rest, g), "feature")
    gap = [F.max(F.when(f.without if f.without is not None else F.lit(False), 0.0).otherwise(F.abs(F.col(b) - _penalty(f) * F.col(c)))).alias(b) for f, c, b in zip(fits, w, g)]
    return [x or 0.0 for x in both.agg(*gap).first()]
