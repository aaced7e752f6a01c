"""Streaming forms of two batch operators.

X1 applies the curation predicates and unit normalisation to rows as they
arrive (stateless; a stream–static join with the dimension tables).
X2 keeps the best grid point per key as result rows arrive, as a table in the
shared folder that each micro-batch upserts by its batch id.

Both run with ``trigger(availableNow=True)``: every file present is
processed in bounded micro-batches, then the query stops. Checkpoints live
in the shared checkpoint folder, so a restarted query resumes exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pairgrid.operators import curate as C
from pairgrid.session import ensure_checkpoint_dir


def stream_curate(sdf: DataFrame, chemicals: DataFrame, species: DataFrame) -> DataFrame:
    """Curation predicates + unit normalisation over arriving result rows."""
    d = C.filter_equal(sdf, "endpoint", "LC50")
    d = C.filter_in(d, "effect", C.EFFECT_CODES)
    d = C.filter_null(d, "conc1_mean_op")
    d = C.filter_numeric_text(d, "conc1_mean")
    d = C.filter_in(d, "conc1_unit", list(C.CONC_FACTORS))
    d = C.filter_numeric_text(d, "obs_duration_mean")
    d = C.filter_null(d, "obs_duration_mean_op")
    d = C.filter_in(d, "obs_duration_unit", list(C.DURATION_FACTORS))
    d = C.normalize_duration(d, "obs_duration_mean", "obs_duration_unit", "duration_d")
    d = C.filter_range(d, "duration_d", hi=7.0)
    d = C.filter_range(d, "duration_d", lo=1 / 24, digits=5)
    d = C.normalize_concentration(d, "conc1_mean", "conc1_unit", "conc_mgl")
    d = C.filter_range(d, "conc_mgl", lo=1e-9, hi=1e4)
    d = d.join(chemicals, d.test_cas == chemicals.cas_number, "left")
    return d.join(species, "species_number", "left")


def stream_best(sdf: DataFrame, keys: Sequence[str], score: str, params: Sequence[str],
                digits: int = 9) -> DataFrame:
    """Best row per key: min of (rounded score, params…, score). Merges with itself, so
    best rows of parts may be merged in any order and any number of times."""
    best = F.min(F.struct(F.round(score, digits).alias("_s"), *[F.col(p) for p in params], F.col(score).alias("_raw")))
    return sdf.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, *[F.col(f"_b.{p}").alias(p) for p in params], F.col("_b._raw").alias(score))


def _checkpoint(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/pairgrid-stream/{name}-{uuid.uuid4().hex}"


def run_to_files(sdf: DataFrame, out: str, name: str) -> None:
    """Append-mode stream into Parquet files, processing all available input."""
    q = (sdf.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", _checkpoint(sdf.sparkSession, name))
            .trigger(availableNow=True).start(out))
    q.awaitTermination()


def run_to_best(sdf: DataFrame, out: str, name: str, keys: Sequence[str], score: str, params: Sequence[str],
                digits: int = 9, every: int = 16, checkpoint: str | None = None) -> DataFrame:
    """Keep the best row per key (``stream_best``) in the table at ``out`` and return it.

    A micro-batch writes its own best rows, overwriting what an earlier try of the same
    batch id left; every ``every`` batches all rows so far are merged into a base, which
    counts once its one-file mark is written. A restart with the same ``checkpoint`` may
    replay a batch: it stores the same rows again, and the best of equal rows is that
    row. Deltas under a base are no longer read; removing them is the folder's retention.
    """
    spark = sdf.sparkSession
    schema = stream_best(sdf, keys, score, params, digits).schema

    def write(rows: DataFrame, step: int, kind: str) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/rows/step={step}/kind={kind}")

    def mark(step: int) -> None:
        spark.range(1).select(F.lit(step).cast("long").alias("base")).coalesce(1).write.mode("overwrite").parquet(f"{out}/bases/{step}")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        write(stream_best(batch, keys, score, params, digits), batch_id, "delta")
        if (batch_id + 1) % every == 0:
            write(best_table(spark, out, schema, keys, score, params, digits), batch_id, "base")
            mark(batch_id)

    write(spark.createDataFrame([], schema), -1, "delta")  # the table exists before the first batch
    mark(-1)
    q = (sdf.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint or _checkpoint(spark, name))
            .trigger(availableNow=True).start())
    q.awaitTermination()
    return best_table(spark, out, schema, keys, score, params, digits)


def best_table(spark: SparkSession, out: str, schema: StructType, keys: Sequence[str], score: str, params: Sequence[str],
               digits: int = 9) -> DataFrame:
    """The best row per key as stored at ``out``: the last marked base and the deltas after it."""
    base = spark.read.parquet(f"{out}/bases/*").agg(F.max("base")).first()[0]
    stored = StructType([*schema.fields, StructField("step", LongType()), StructField("kind", StringType())])
    rows = spark.read.schema(stored).parquet(f"{out}/rows")
    rows = rows.where(((F.col("kind") == "base") & (F.col("step") == base)) | ((F.col("kind") == "delta") & (F.col("step") > base)))
    return stream_best(rows.drop("step", "kind"), keys, score, params, digits)
