"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrid.session import ensure_checkpoint_dir, small_batches, table_path  # noqa: F401

#: Rows of a table that may be broadcast; beyond it the operators use shuffle joins.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, which cuts
    its lineage: a lost executor costs a re-read, not the plan before it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pairgrid-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows; an empty one stays."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the cluster is set to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def small_side(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a materialised table when its counted rows are within ``bound``;
    else leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
