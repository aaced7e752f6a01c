"""Column expressions (Column in, Column out), all JVM-side built-ins.

Nothing here runs Python per row; every helper composes
``pyspark.sql.functions`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- numbers stored as text (P6) -------------------------------------------

def parse_number(col) -> Column:
    """Text → DOUBLE; junk such as ``NR``, ``1.5*``, ``>3``, ``5d`` or ``NaN`` becomes NULL.

    Only plain decimal and exponent forms count, with blanks around them, so
    `` 2e-3 `` parses to 0.002; a cast alone would also take the suffixes
    ``d`` and ``f`` and the words for infinity and NaN.
    """
    c = _c(col)
    plain = c.cast("string").rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")
    return F.when(plain, c.try_cast("double"))


# --- right-closed bins (P13) ------------------------------------------------

def cut_right_closed(col, edges: Sequence[float] | Column) -> Column:
    """Bin number of ``x`` in right-closed intervals ``(e[i-1], e[i]]``.

    Bins count from 1. Values at or below the first edge, above the last
    edge, or NULL give NULL. ``edges`` is a sorted list of literals or an
    array column (for edges computed by a query). Spark's Bucketizer and
    ``width_bucket`` are left-closed, hence the edge count instead.
    """
    x = _c(col)
    arr = edges if isinstance(edges, Column) else F.array(*[F.lit(float(e)) for e in edges])
    first = F.element_at(arr, 1)
    last = F.element_at(arr, -1)
    n_below = F.size(F.filter(arr, lambda e: e < x))
    return (F.when(x.isNull() | F.isnan(x) | (x <= first) | (x > last), F.lit(None).cast("int"))
            .otherwise(n_below.cast("int")))


def bin_label(bin_col, edges: Sequence[float]) -> Column:
    """Interval label ``(lo, hi]`` for a bin number from ``cut_right_closed``."""
    labels = [f"({_fmt(edges[i - 1])}, {_fmt(edges[i])}]" for i in range(1, len(edges))]
    return F.element_at(F.array(*[F.lit(s) for s in labels]), _c(bin_col))


def _fmt(v: float) -> str:
    if v == float("inf"):
        return "inf"
    if v == float("-inf"):
        return "-inf"
    return repr(float(v))


# --- registry number (P10) ---------------------------------------------------

def format_registry_number(col) -> Column:
    """Integer id → ``dddd-dd-d`` when the check digit is right, else NULL.

    The check digit is the last digit; it must equal the sum of the other
    digits, each times its position counted from the right (1-based), mod 10.
    Ids need at least 5 digits (2 + 2 + 1).
    """
    s = _c(col).cast("bigint").cast("string")
    n = F.length(s)
    head = F.substring(s, 1, n - 1)
    check = F.substring(s, -1, 1).cast("int")
    # digits of the body, reversed so position 1 is the rightmost
    rev = F.reverse(head)
    digits = F.transform(F.split(rev, ""), lambda d: d.cast("int"))
    weighted = F.aggregate(
        F.zip_with(digits, F.sequence(F.lit(1), F.size(digits)), lambda d, i: d * i),
        F.lit(0), lambda acc, v: acc + v)
    formatted = F.concat_ws("-", F.substring(s, 1, n - 3), F.substring(s, n - 2, 2), F.substring(s, -1, 1))
    ok = (n >= 5) & (F.pmod(weighted, F.lit(10)) == check)
    return F.when(_c(col).isNotNull() & ok, formatted)


# --- keys and folds ----------------------------------------------------------

def pair_key(cols: Sequence[str], sep: str = "|") -> Column:
    """Joined group key of several columns."""
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in cols])


def hash_unit(key: Column, salt: str = "") -> Column:
    """Deterministic unsigned 32-bit hash of a key: first 8 hex digits of md5.

    Same value in Spark and DuckDB, independent of partitioning and of the
    run, so folds and samples are repeatable and need no shuffle.
    """
    src = key if not salt else F.concat(key, F.lit("#" + salt))
    return F.conv(F.substring(F.md5(src.cast("string")), 1, 8), 16, 10).cast("bigint")


def hash_bucket(key: Column, n: int, salt: str = "") -> Column:
    """Bucket 0..n-1 of ``hash_unit`` (F2 feature hashing, V2 folds)."""
    return F.pmod(hash_unit(key, salt), F.lit(n)).cast("int")


def hash_fold(key: Column, k: int, salt: str = "") -> Column:
    """Fold 1..k by key hash (V2); every row of one group lands in one fold."""
    return (hash_bucket(key, k, salt) + 1).cast("int")


# Modulus (the prime 2^31 - 1) and multiplier of the integer key hash.
HASH_P = 2147483647
HASH_A = 1103515245
HASH_C = 12345


def salt_constant(salt: str) -> int:
    """Per-salt constant (< 2^28), the same in every engine."""
    import hashlib
    return int(hashlib.md5(("k" + salt).encode()).hexdigest()[:7], 16)


def int_hash(cols: Sequence[Column], salt: str = "") -> Column:
    """Arithmetic hash in [0, 2^31 - 1) of integer key columns.

    Multiply–add and squaring rounds modulo a prime; every intermediate stays
    below 2^62, so 64-bit arithmetic never overflows and the value is
    identical in Spark and DuckDB. Pure arithmetic: it stays in generated
    code and costs far less per row than a digest.
    """
    s = F.lit(salt_constant(salt)).cast("bigint")
    p = F.lit(HASH_P).cast("bigint")
    x = s
    for c in cols:
        x = F.pmod(x * HASH_A + F.pmod(c.cast("bigint"), p), p)
        x = F.pmod(x * x + s, p)
    x = F.pmod(x * x + HASH_C, p)
    return F.pmod(x * x + s, p)


def int_fold(cols: Sequence[Column], k: int, salt: str = "") -> Column:
    """Fold 1..k of integer keys by :func:`int_hash` (V2 for integer keys)."""
    return (F.pmod(int_hash(cols, salt), F.lit(k)) + 1).cast("int")


def int_hash_sql(cols: Sequence[str], salt: str = "") -> str:
    """DuckDB twin of :func:`int_hash` over SQL expressions of BIGINT keys."""
    s = f"CAST({salt_constant(salt)} AS BIGINT)"
    x = s
    for c in cols:
        x = f"(({x}) * {HASH_A} + (CAST({c} AS BIGINT) % {HASH_P})) % {HASH_P}"
        x = f"(({x}) * ({x}) + {s}) % {HASH_P}"
    x = f"(({x}) * ({x}) + {HASH_C}) % {HASH_P}"
    return f"(({x}) * ({x}) + {s}) % {HASH_P}"


def int_fold_sql(cols: Sequence[str], k: int, salt: str = "") -> str:
    return f"CAST(({int_hash_sql(cols, salt)}) % {k} + 1 AS INTEGER)"


def hash_share(key: Column, salt: str = "") -> Column:
    """Uniform number in [0, 1) from a key hash (V7 splits, W9 samples)."""
    return hash_unit(key, salt) / F.lit(4294967296.0)


# --- small scalar helpers ----------------------------------------------------

def strip_suffix(col, suffix: str) -> Column:
    """Remove a trailing literal suffix (P20)."""
    c = _c(col)
    return F.when(c.endswith(suffix), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def has_suffix(col, suffix: str) -> Column:
    return _c(col).endswith(suffix)


def round6(col) -> Column:
    return F.round(_c(col), 6)
