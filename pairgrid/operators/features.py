"""Feature engineering.

The working form of a sparse design matrix is long: (row, feature, value)
with zeros omitted. It joins, aggregates and shuffles like any table, and
turns into ``ml.linalg.SparseVector`` only at the learner boundary
(:func:`vectors_from_long`). Per-entity features (fingerprints) are
computed once per distinct entity and joined to rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrid.functions.columns import hash_bucket, hash_share

# Token rule. ASCII letters and digits form tokens; anything
# else separates them. Lower-casing happens after the split.
TOKEN_SPLIT = "[^A-Za-z0-9]+"


def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.filter(F.split(t, TOKEN_SPLIT), lambda s: s != ""), lambda s: F.lower(s))


def word_ngrams(toks: Column, n: int) -> Column:
    """Space-joined word n-grams of a token array column (empty when too short).

    Built by zipping the array with its shifted slices: linear in the text
    length. ``toks`` should be a materialised column, not an expression.
    """
    if n == 1:
        return toks
    grams = toks
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(toks, k + 1, F.greatest(F.size(toks) - k, F.lit(1))),
                           lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.filter(grams, lambda g: g.isNotNull())


def hashed_count_fingerprint(df: DataFrame, key: str, text: str, n_bits: int = 1024,
                             ngrams: Sequence[int] = (1,)) -> DataFrame:
    """Entity → counts of its hashed word n-grams in ``n_bits`` buckets (F2).

    Long form ``(key, bit, cnt)``; the bucket is the md5 bucket of the
    n-gram. The whole text of every distinct entity is tokenised once;
    counts are summed with map-side partial aggregation.
    """
    ents = df.select(key, text).dropDuplicates([key]).select(key, tokens(text).alias("_t"))
    t = F.col("_t")
    grams = F.flatten(F.array(*[word_ngrams(t, n) for n in ngrams])) if len(ngrams) > 1 else word_ngrams(t, ngrams[0])
    g = ents.select(key, F.explode(grams).alias("_g"))
    return (g.select(key, hash_bucket(F.col("_g"), n_bits).alias("bit"))
             .groupBy(key, "bit").agg(F.count(F.lit(1)).cast("int").alias("cnt")))


def key_fingerprint(df: DataFrame, key: str, text: str, patterns: Sequence[str]) -> DataFrame:
    """Entity → 0/1 per pattern of a fixed regex dictionary (F3), long form.

    Each pattern is a literal (compiled once per task); the matches form an
    array and only the set bits are exploded.
    """
    ents = df.select(key, text).dropDuplicates([key])
    hits = F.array(*[F.when(F.col(text).rlike(p), F.lit(i)) for i, p in enumerate(patterns)])
    return (ents.select(key, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("bit"))
                .withColumn("cnt", F.lit(1)))


def fingerprint(df: DataFrame, key: str, text: str, fn, width: int) -> DataFrame:
    """Per-entity user feature function (Y3), long form (key, bit, cnt).

    ``fn`` is a vectorised ``pandas.Series[str] → Series[list[int]]`` of
    length-``width`` count vectors. It runs once per **distinct** entity in
    Arrow batches; a NULL result (text the function cannot parse) becomes
    all zeros, i.e. no rows in the long form.
    """
    @F.pandas_udf("array<int>")
    def _fp(s: pd.Series) -> pd.Series:
        out = fn(s)
        return out.map(lambda v: [0] * width if v is None else [int(x) for x in v])

    ents = df.select(key, text).dropDuplicates([key])
    arr = ents.select(key, _fp(F.col(text)).alias("_a"))
    return (arr.select(key, F.posexplode("_a").alias("bit", "cnt"))
               .filter(F.col("cnt") != 0).select(key, F.col("bit").cast("int"), F.col("cnt").cast("int")))


def letter_counts(s: pd.Series) -> pd.Series:
    """Example user function: counts of the letters a–z (case-insensitive)."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return s.map(lambda t: None if t is None else [t.lower().count(c) for c in letters])


def one_hot_long(df: DataFrame, row: str, codes: Sequence[tuple[str, int]], block_names: Sequence[str] | None = None
                 ) -> DataFrame:
    """Indicator blocks in long form (F1): (row, block, feature) with value 1.

    ``codes`` lists (code column, block size) in stacking order; feature =
    block offset + code. Codes come from ``category_code`` (sorted order,
    none dropped), so this equals OneHotEncoder(dropLast=False) stacked.
    """
    names = list(block_names or [c for c, _ in codes])
    offs, o = [], 0
    for _, size in codes:
        offs.append(o)
        o += size
    arr = F.array(*[F.struct(F.lit(n).alias("block"), (F.col(c) + F.lit(off)).cast("int").alias("feature"))
                    for (c, _), n, off in zip(codes, names, offs)])
    return df.select(row, F.explode(arr).alias("_e")).select(row, "_e.block", "_e.feature",
                                                              F.lit(1.0).alias("val"))


def field_map(spark: SparkSession, block_sizes: Sequence[int]) -> DataFrame:
    """Feature index → field id for stacked blocks of the given sizes."""
    offs, o = [], 0
    for s in block_sizes:
        offs.append(o)
        o += s
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(off).alias("off"), F.lit(s).alias("size"))
                      for f, (off, s) in enumerate(zip(offs, block_sizes))])
    b = spark.range(1).select(F.explode(parts).alias("b")).filter(F.col("b.size") > 0)
    e = b.select(F.explode(F.sequence(F.col("b.off"), F.col("b.off") + F.col("b.size") - 1)).alias("feature"),
                 F.col("b.field").alias("field"))
    return e.select(F.col("feature").cast("int"), F.col("field").cast("int"))


def interaction_terms(rows: DataFrame, row: str, code: str, entity: str, fp_long: DataFrame,
                      n_bits: int, bit: str = "bit", val: str = "val", offset: int = 0) -> DataFrame:
    """Species × fingerprint-bit products in long form.

    feature = offset + code · n_bits + bit, value = the bit's value. Only
    non-zero bits exist in the long form, so the output has as many entries
    per row as the row's entity has set bits (no n_species × n_bits block).
    Features are BIGINT: the width passes 2³¹ at two million species.
    """
    j = rows.select(row, code, entity).join(fp_long.select(entity, bit, val), entity)
    return j.select(row, (F.lit(offset) + F.col(code).cast("long") * n_bits + F.col(bit)).cast("long").alias("feature"),
                    F.col(val).cast("double").alias("val"))


def to_long_sparse(df: DataFrame, row: str, vec: str) -> DataFrame:
    """Vector column → (row, feature, val) for the non-zero entries (F8). A sparse
    vector is never widened: its stored indices and values are exploded."""
    entry = lambda i, v: F.struct(i.cast("int").alias("feature"), v.alias("val"))
    stored = F.when(F.col("_u.type") == 0, F.zip_with("_u.indices", "_u.values", entry)) \
              .otherwise(F.transform("_u.values", lambda v, i: entry(i, v)))
    return (df.select(row, F.unwrap_udt(vec).alias("_u")).select(row, F.explode(stored).alias("_e"))
              .select(row, "_e.feature", "_e.val").filter(F.col("val") != 0))


@F.udf(returnType=VectorUDT())
def _sparse_vec(size, idx, vals):
    order = np.argsort(np.asarray(idx, dtype=np.int64), kind="stable")
    i = np.asarray(idx, dtype=np.int64)[order]
    v = np.asarray(vals, dtype=np.float64)[order]
    return SparseVector(int(size), i.tolist(), v.tolist())


def vectors_from_long(df_long: DataFrame, row: str, size: int, feature: str = "feature", val: str = "val",
                      out: str = "features") -> DataFrame:
    """(row, feature, val) → (row, SparseVector) (F8, the way back).

    Entries are gathered per row (bounded by one row's non-zeros) and the
    vector is built by a small Python helper: Spark SQL has no vector
    constructor, and vector types cannot cross Arrow.
    """
    g = df_long.groupBy(row).agg(F.collect_list(feature).alias("_i"), F.collect_list(val).alias("_v"))
    return vectors_from_arrays(g, [row], size, "_i", "_v", out)


def vectors_from_arrays(df: DataFrame, keep: Sequence[str], size: int, idx: str = "fi", val: str = "fv", out: str = "features") -> DataFrame:
    """``keep`` and a SparseVector of each row's arrays of features and values."""
    return df.select(*keep, _sparse_vec(F.lit(size), idx, val).alias(out))


def stack_blocks(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Concatenate vector blocks in order (F5): VectorAssembler."""
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def rbf_landmark_map(df: DataFrame, key: str, vec: str, m: int, gamma: float, seed: str = "landmarks",
                     out: str = "phi") -> DataFrame:
    """Nyström features (F9): φ(x) = K(x, Z) · K_ZZ^(-1/2) for M landmarks Z.

    Landmarks are the M rows with the smallest key hash (a bounded top-M);
    the M × M inverse root is computed once on the driver (M is a parameter,
    not a data size) and shipped inside the UDF closure. Rows are mapped in
    Arrow batches by a pandas UDF.
    """
    lm = (df.select(key, vec).withColumn("_h", hash_share(F.col(key).cast("string"), seed))
            .orderBy("_h", key).limit(m).collect())
    Z = np.array([np.asarray(r[vec], dtype=np.float64) for r in lm])
    kzz = np.exp(-gamma * _sqdist(Z, Z))
    w, v = np.linalg.eigh(kzz)
    w = np.maximum(w, 1e-12)
    root = (v / np.sqrt(w)) @ v.T

    @F.pandas_udf("array<double>")
    def phi(col: pd.Series) -> pd.Series:
        X = np.stack(col.map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
        K = np.exp(-gamma * _sqdist(X, Z))
        return pd.Series(list(K @ root))

    return df.withColumn(out, phi(F.col(vec)))


def _sqdist(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    d = (A * A).sum(1)[:, None] + (B * B).sum(1)[None, :] - 2.0 * A @ B.T
    return np.maximum(d, 0.0)
