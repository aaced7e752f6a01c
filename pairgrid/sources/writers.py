"""Sinks (K1–K6) and the scratch-folder rule.

Intermediate files go under the shared folder the cluster names in
``spark.checkpoint.dir`` (never a machine-local temp folder), so they
survive the loss of an executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrid.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/pairgrid-scratch/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None) -> None:
    """Write a table with a header (K1)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def libsvm_line(label: Column, idx: Column, val: Column) -> Column:
    """``label idx:val …`` with 0-based ids, zeros omitted, four decimals."""
    pairs = F.filter(F.arrays_zip(idx.alias("i"), val.alias("v")), lambda e: e["v"] != 0)
    body = F.transform(pairs, lambda e: F.format_string("%d:%.4f", e["i"], e["v"]))
    return F.concat_ws(" ", F.format_string("%.4f", label), F.array_join(body, " "))


def libffm_line(label: Column, field: Column, idx: Column, val: Column) -> Column:
    """``label field:idx:val …``; ``field`` holds each feature's field id."""
    pairs = F.filter(F.arrays_zip(field.alias("f"), idx.alias("i"), val.alias("v")), lambda e: e["v"] != 0)
    body = F.transform(pairs, lambda e: F.format_string("%d:%d:%.4f", e["f"], e["i"], e["v"]))
    return F.concat_ws(" ", F.format_string("%.4f", label), F.array_join(body, " "))


def write_libsvm(df: DataFrame, label: str, idx: str, val: str, path: str, order: Sequence[str] = ()) -> None:
    """Sparse rows as libsvm text (K2). Spark's own libsvm writer is 1-based,
    hence the text writer. ``order`` sorts rows within each file."""
    out = df
    if order:
        out = out.sortWithinPartitions(*order)
    out.select(libsvm_line(F.col(label), F.col(idx), F.col(val)).alias("value")).write.mode("overwrite").text(path)


def write_libffm(df: DataFrame, label: str, field: str, idx: str, val: str, path: str,
                 order: Sequence[str] = ()) -> None:
    """Sparse rows with field ids as libffm text (K3)."""
    out = df.sortWithinPartitions(*order) if order else df
    out.select(libffm_line(F.col(label), F.col(field), F.col(idx), F.col(val)).alias("value")) \
       .write.mode("overwrite").text(path)


def write_fold_sets(df: DataFrame, path: str, partition_by: Sequence[str] = ("setting", "fold")) -> None:
    """All fold sets in one write, one folder per (setting, fold) (K4).

    Readers filter on the partition columns and Spark prunes the other
    folders, so each fold's set is read without scanning the rest.
    """
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_log(df: DataFrame, path: str, partition_by: Sequence[str] = ("family",)) -> None:
    """Append grid-result rows (K5); one job writes a whole grid's rows, and
    Spark's commit protocol replaces the reference's unlocked appends."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_predictions(df: DataFrame, path: str, partition_by: Sequence[str] = ("model",)) -> None:
    """Append prediction rows (K6)."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
