"""Operator 7: reproducible shuffle into shards by a Feistel permutation.

Rows get global numbers 0..N-1 in the order of a hash of (id, text CRC, size), so
the numbering depends on the rows alone and not on how they are partitioned. A
keyed Feistel network permutes the numbers; a value outside [0, N) is permuted
again (cycle walking) until it falls inside. The shard is the permuted number
modulo the shard count and the slot its quotient, so shard sizes differ by one
row at most, and ``place``/``row_at`` compute either side without any data.

Defined results: a null text has size 8 and CRC 0; a null id is a value like any
other; repeated rows are separate rows (they take consecutive numbers); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, table

ROUNDS = 6
#: Copies of one row that are expanded from one element of the first explode.
CHUNK = 65_536


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser: multiply and xor-shift."""
    x = x + np.uint64((key * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


def _sides(n: int) -> tuple[int, int]:
    a = max(1, int(np.ceil(np.sqrt(float(n)))))
    return a, max(1, -(-n // a))


def _network(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """One pass over [0, a·b), the smallest near-square domain that holds n:
    the halves take turns in being shifted by a hash of the other one."""
    a, b = (np.uint64(v) for v in _sides(n))
    left, right = x // b, x % b
    rounds = range(ROUNDS)
    for i in reversed(rounds) if inverse else rounds:
        if i % 2 == 0:
            s = _mix(right, key + i) % a
            left = (left + (a - s if inverse else s)) % a
        else:
            s = _mix(left, key + i) % b
            right = (right + (b - s if inverse else s)) % b
    return left * b + right


def permute(rows, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The permutation of [0, n): the network, walked until it lands inside."""
    x = np.asarray(rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = _network(x, n, key, inverse)
        out = np.flatnonzero(x >= np.uint64(n))
        while len(out):
            x[out] = _network(x[out], n, key, inverse)
            out = out[x[out] >= np.uint64(n)]
    return x.astype(np.int64)


def place(rows, n: int, shards: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of global row numbers."""
    p = permute(rows, n, key)
    return p % shards, p // shards


def row_at(shard, slot, n: int, shards: int, key: int) -> np.ndarray:
    """Global row number at (shard, slot): the inverse of ``place``."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, key, inverse=True)


def shard_rows(df: DataFrame, shards: int = 24, key: int = 20_240_607,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, row (global number), shard, slot for every row.

    The text is read once for its size and CRC and never shuffled. Equal rows are
    counted before the shuffle and expanded after numbering, so a group of
    repeated rows is one row until the last step.
    """
    spark = df.sparkSession
    raw = F.col(text_col).cast("binary")
    light = df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("crc"))
    counted = light.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("m"))
    # buckets: the top bits of the hash, so that their order is the order of the hash
    bits = max(1, min(20, (4 * partitions(spark) - 1).bit_length()))
    h = F.xxhash64("id", "crc", "size")
    counted = materialize(counted.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits)), "rows")
    n = counted.agg(F.sum("m")).first()[0] or 0
    per_bucket = counted.groupBy("bucket").agg(F.sum("m").alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("bucket").orderBy("h", "id", "crc", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce(F.sum("m").over(inside), F.lit(0)) + F.col("offset")
    numbered = (counted.join(F.broadcast(offsets), "bucket")  # at most 2^20 buckets
                .withColumn("first", first)
                .withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(CHUNK).cast("long"))))
                .withColumn("copy", F.explode(F.sequence(F.col("at"), F.least("m", F.col("at") + CHUNK) - 1)))
                .withColumn("row", F.col("first") + F.col("copy")))

    @F.pandas_udf("long")
    def permuted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(permute(rows.to_numpy(), n, key))

    p = permuted("row")
    return (numbered.withColumn("p", p)
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "row",
                    (F.col("p") % shards).cast("int").alias("shard"),
                    F.expr(f"p div {shards}").alias("slot")))


def op7_feistel_shards(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row")
