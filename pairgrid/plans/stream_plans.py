"""Streaming queries (X1, X2): arriving files → same answer as the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairgrid.plans import shrunk_means as SM
from pairgrid.plans.curation import CONC_UNITS, DUR_UNITS, _sql_case, _sql_list
from pairgrid.plans.roles import (
    RAW_CHEMICALS_SQL, RAW_RESULTS_SQL, RAW_SPECIES_SQL, observations, raw_chemicals, raw_results, raw_species,
    with_sql)
from pairgrid.operators import curate as C
from pairgrid.sources import writers as K
from pairgrid.streaming import stream as X

N_FILES = 6


def q_stream_curate(spark, sf_dir):
    raw = raw_results(spark, sf_dir)
    src = K.scratch_path(spark, "arriving_results")
    raw.repartition(N_FILES).write.mode("overwrite").parquet(src)
    sdf = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(src)
    out = K.scratch_path(spark, "curated_stream")
    X.run_to_files(X.stream_curate(sdf, raw_chemicals(spark, sf_dir), raw_species(spark, sf_dir)), out, "curate")
    return spark.read.parquet(out).select("result_id", "chemical_name", "latin_name", "duration_d", "conc_mgl")


def q_stream_best(spark, sf_dir):
    grid = SM.grid_scores(SM.model_cells(observations(spark, sf_dir)))
    src = K.scratch_path(spark, "arriving_grid")
    grid.repartition(N_FILES).write.mode("overwrite").parquet(src)
    sdf = spark.readStream.schema(grid.schema).option("maxFilesPerTrigger", 1).parquet(src)
    best = X.run_to_best(sdf, K.scratch_path(spark, "best_stream"), "stream_best", ["setting", "model", "fold"], "rmse", ["alpha"], every=4)
    return best.select("setting", "model", "fold", "alpha", F.round("rmse", 6).alias("rmse"))


QUERIES = {
    "stream_curate": q_stream_curate,
    "stream_best": q_stream_best,
}

ORACLES = {
    "stream_curate": with_sql(RAW_RESULTS_SQL, RAW_CHEMICALS_SQL, RAW_SPECIES_SQL) + f"""
SELECT result_id, chemical_name, latin_name, duration_d, conc_mgl FROM (
  SELECT *, try_cast(obs_duration_mean AS DOUBLE) * {_sql_case('obs_duration_unit', C.DURATION_FACTORS)} AS duration_d,
            try_cast(conc1_mean AS DOUBLE) * {_sql_case('conc1_unit', C.CONC_FACTORS)} AS conc_mgl
  FROM results
  WHERE endpoint = 'LC50' AND effect IN {_sql_list(C.EFFECT_CODES)} AND conc1_mean_op IS NULL
    AND conc1_mean <> 'NR' AND try_cast(conc1_mean AS DOUBLE) IS NOT NULL AND conc1_unit IN {_sql_list(CONC_UNITS)}
    AND obs_duration_mean <> 'NR' AND try_cast(obs_duration_mean AS DOUBLE) IS NOT NULL
    AND obs_duration_mean_op IS NULL AND obs_duration_unit IN {_sql_list(DUR_UNITS)}) r
LEFT JOIN chemicals ON r.test_cas = chemicals.cas_number LEFT JOIN species USING (species_number)
WHERE duration_d <= 7.0 AND round(duration_d, 5) >= round(1.0 / 24, 5) AND conc_mgl >= 1e-9 AND conc_mgl <= 1e4""",
    "stream_best": SM.ORACLES["best_per_group"],
}
