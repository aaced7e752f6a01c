"""Curation queries: raw relational tables → curated observation table.

Each operator of the curation (P1–P22, J1–J3, J8–J10) and the scans and
sinks that carry its data (A1–A4, K1, K4–K6) is registered on its own, plus
the whole chain as ``curate_table``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrid.functions.columns import cut_right_closed, format_registry_number, pair_key, parse_number, strip_suffix
from pairgrid.operators import curate as C
from pairgrid.plans import shrunk_means as SM
from pairgrid.plans.roles import (
    OBS_SQL, RAW_CHEMICALS_SQL, RAW_REFERENCES_SQL, RAW_RESULTS_SQL, RAW_SPECIES_SQL, RAW_TESTS_SQL, load,
    observations, raw_chemicals, raw_references, raw_results, raw_species, raw_tests, with_sql)
from pairgrid.sources import readers as R
from pairgrid.sources import writers as K

ALL_RAW = (RAW_TESTS_SQL, RAW_RESULTS_SQL, RAW_CHEMICALS_SQL, RAW_SPECIES_SQL, RAW_REFERENCES_SQL)

DUR_UNITS = list(C.DURATION_FACTORS)
CONC_UNITS = list(C.CONC_FACTORS)


def _sql_list(vs) -> str:
    return "(" + ", ".join("'" + v + "'" for v in vs) + ")"


def _sql_case(col: str, factors: dict[str, float]) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in factors.items())
    return f"(CASE {col} {arms} ELSE 1.0 END)"


# --- the whole chain ------------------------------------------------------------

def joined_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tests ⟕ results ⟕ chemicals ⟕ species ⟕ references."""
    t = raw_tests(spark, sf_dir)
    r = raw_results(spark, sf_dir)
    j = C.join_left_fact(t, r, "test_id")
    j = C.join_left_dim(j, raw_chemicals(spark, sf_dir), j.test_cas == F.col("cas_number"))
    j = C.join_left_dim(j, raw_species(spark, sf_dir), "species_number")
    return C.join_left_dim(j, raw_references(spark, sf_dir), "reference_number")


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = joined_raw(spark, sf_dir)
    d = C.filter_equal(d, "endpoint", "LC50")
    d = C.filter_in(d, "effect", C.EFFECT_CODES)
    d = C.filter_equal(d, "organism_habitat", "Water")
    d = C.filter_null(d, "conc1_mean_op")
    d = C.filter_in(d, "test_location", C.LOCATION_CODES)
    d = C.filter_not_in(d, "exposure_type", C.EXCLUDED_EXPOSURE)
    d = C.filter_numeric_text(d, "conc1_mean")
    d = C.filter_range(d, parse_number("conc1_mean"), exclude_zero=True)
    d = C.filter_in(d, "conc1_unit", CONC_UNITS)
    d = C.filter_numeric_text(d, "obs_duration_mean")
    d = C.filter_range(d, parse_number("obs_duration_mean"), exclude_zero=True)
    d = C.filter_null(d, "obs_duration_mean_op")
    d = C.filter_in(d, "obs_duration_unit", DUR_UNITS)
    d = C.normalize_duration(d, "obs_duration_mean", "obs_duration_unit", "duration_d")
    d = C.filter_range(d, "duration_d", hi=7.0)
    d = C.filter_range(d, "duration_d", lo=1 / 24, digits=5)
    d = C.normalize_concentration(d, "conc1_mean", "conc1_unit", "conc_mgl")
    d = C.filter_range(d, "conc_mgl", lo=1e-9, hi=1e4)
    return d.withColumn("CAS", format_registry_number("test_cas"))


CURATED_COLS = ["result_id", "test_cas", "CAS", "chemical_name", "dtxsid", "latin_name", "common_name",
                "kingdom", "phylum_division", "duration_d", "conc_mgl", "endpoint", "author", "title",
                "source", "publication_year"]


def q_curate_table(spark, sf_dir):
    return curated(spark, sf_dir).select(*CURATED_COLS)


def _registry_sql(col: str) -> str:
    s = f"CAST(CAST({col} AS BIGINT) AS VARCHAR)"
    head = f"reverse(substr({s}, 1, length({s}) - 1))"
    weighted = (f"list_sum(list_transform(range(1, length({head}) + 1), "
                f"lambda k: CAST(substr({head}, CAST(k AS INTEGER), 1) AS INTEGER) * k))")
    fmt = f"substr({s}, 1, length({s}) - 3) || '-' || substr({s}, length({s}) - 2, 2) || '-' || right({s}, 1)"
    return (f"(CASE WHEN {col} IS NOT NULL AND length({s}) >= 5 AND "
            f"{weighted} % 10 = CAST(right({s}, 1) AS INTEGER) THEN {fmt} END)")


CURATED_SQL = f"""
joined AS (
  SELECT * FROM tests LEFT JOIN results USING (test_id)
  LEFT JOIN chemicals ON results.test_cas = chemicals.cas_number
  LEFT JOIN species USING (species_number)
  LEFT JOIN refs USING (reference_number)
),
cur0 AS (
  SELECT *, try_cast(obs_duration_mean AS DOUBLE) * {_sql_case('obs_duration_unit', C.DURATION_FACTORS)} AS duration_d,
            try_cast(conc1_mean AS DOUBLE) * {_sql_case('conc1_unit', C.CONC_FACTORS)} AS conc_mgl
  FROM joined
  WHERE endpoint = 'LC50' AND effect IN {_sql_list(C.EFFECT_CODES)} AND organism_habitat = 'Water'
    AND conc1_mean_op IS NULL AND test_location IN {_sql_list(C.LOCATION_CODES)}
    AND exposure_type NOT IN {_sql_list(C.EXCLUDED_EXPOSURE)}
    AND conc1_mean <> 'NR' AND try_cast(conc1_mean AS DOUBLE) IS NOT NULL AND try_cast(conc1_mean AS DOUBLE) <> 0
    AND conc1_unit IN {_sql_list(CONC_UNITS)}
    AND obs_duration_mean <> 'NR' AND try_cast(obs_duration_mean AS DOUBLE) IS NOT NULL
    AND try_cast(obs_duration_mean AS DOUBLE) <> 0
    AND obs_duration_mean_op IS NULL AND obs_duration_unit IN {_sql_list(DUR_UNITS)}
),
cur AS (
  SELECT *, {_registry_sql('test_cas')} AS CAS FROM cur0
  WHERE duration_d <= 7.0 AND round(duration_d, 5) >= round(1.0 / 24, 5)
    AND conc_mgl >= 1e-9 AND conc_mgl <= 1e4
)"""

CUR_CTES = (*ALL_RAW, CURATED_SQL)


# --- P1–P22 one by one -------------------------------------------------------------

def q_select_rename(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return C.select_rename(li, {"l_suppkey": "species", "l_partkey": "chem", "l_quantity": "duration",
                                "l_extendedprice": "value", "l_linenumber": "line"})


def q_filter_equal(spark, sf_dir):
    return C.filter_equal(raw_results(spark, sf_dir), "endpoint", "LC50").select("result_id", "endpoint")


def q_filter_in(spark, sf_dir):
    return C.filter_in(raw_results(spark, sf_dir), "conc1_unit", CONC_UNITS).select("result_id", "conc1_unit")


def q_filter_not_in(spark, sf_dir):
    return C.filter_not_in(raw_tests(spark, sf_dir), "exposure_type", C.EXCLUDED_EXPOSURE) \
        .select("test_id", "exposure_type")


def q_filter_null(spark, sf_dir):
    return C.filter_null(raw_results(spark, sf_dir), "conc1_mean_op").select("result_id")


def q_filter_not_null(spark, sf_dir):
    return C.filter_not_null(raw_results(spark, sf_dir), "obs_duration_mean_op") \
        .select("result_id", "obs_duration_mean_op")


def q_filter_numeric_text(spark, sf_dir):
    d = C.filter_numeric_text(raw_results(spark, sf_dir), "conc1_mean")
    return d.select("result_id", "conc1_mean", parse_number("conc1_mean").alias("conc_value"))


def q_normalize_duration(spark, sf_dir):
    d = C.filter_in(raw_results(spark, sf_dir), "obs_duration_unit", DUR_UNITS)
    d = C.normalize_duration(d, "obs_duration_mean", "obs_duration_unit", "duration_d")
    return d.select("result_id", "obs_duration_unit", "duration_d")


def q_filter_range(spark, sf_dir):
    d = C.normalize_duration(raw_results(spark, sf_dir), "obs_duration_mean", "obs_duration_unit", "duration_d")
    d = C.filter_range(d, "duration_d", hi=7.0)
    d = C.filter_range(d, "duration_d", lo=1 / 24, digits=5)
    return d.select("result_id", "duration_d")


def q_normalize_concentration(spark, sf_dir):
    d = C.filter_in(raw_results(spark, sf_dir), "conc1_unit", CONC_UNITS)
    d = C.normalize_concentration(d, "conc1_mean", "conc1_unit", "conc_mgl")
    return d.select("result_id", "conc1_unit", "conc_mgl")


def q_format_registry_number(spark, sf_dir):
    r = raw_results(spark, sf_dir).select("test_cas").distinct()
    return r.select("test_cas", format_registry_number("test_cas").alias("CAS"))


def q_patch_value(spark, sf_dir):
    c = C.patch_value(raw_chemicals(spark, sf_dir), "chemical_name", "small ring", "small ring (fixed)")
    return c.select("cas_number", "chemical_name")


def q_log10_target(spark, sf_dir):
    o = C.log10_target(load(spark, sf_dir, "lineitem"), "l_extendedprice", "y")
    return o.select("l_orderkey", "l_linenumber", "l_partkey", F.round("y", 6).alias("y"))


# Share of rows a duration value needs to become a bin edge (the reference
# used 200 rows; 2% of the line items gives about as many edges at sf0.01).
EDGE_SHARE = 0.02


def duration_edges(obs: DataFrame) -> list[float]:
    return C.frequent_edges(obs, "duration", lo=0.0, min_share=EDGE_SHARE)


def q_data_driven_edges(spark, sf_dir):
    edges = duration_edges(observations(spark, sf_dir, index=False))
    obs = observations(spark, sf_dir, index=False)
    # one row per edge, tied to the data through the bin counts of each edge
    binned = obs.select(cut_right_closed("duration", edges).alias("edge_no")).groupBy("edge_no").count()
    e = spark.createDataFrame([(i, float(v)) for i, v in enumerate(edges)], "edge_no int, edge double")
    return e.join(binned, "edge_no", "left").select("edge_no", "edge", F.coalesce("count", F.lit(0)).alias("n_rows"))


def q_cut_right_closed(spark, sf_dir):
    obs = observations(spark, sf_dir)
    edges = duration_edges(obs)
    return obs.select("idx", cut_right_closed("duration", edges).alias("dur_bin"))


def q_pair_key(spark, sf_dir):
    obs = observations(spark, sf_dir, index=False)
    return obs.groupBy(pair_key(["chem", "species"]).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def q_category_code(spark, sf_dir):
    obs = observations(spark, sf_dir, index=False).select("species")
    return C.category_code(obs.distinct(), "species", "species_code")


def q_expand_fold_flags(spark, sf_dir):
    return C.expand_fold_flags(observations(spark, sf_dir).select("idx", "fold2"), "fold2", 5, "setting2_test")


def q_collapse_fold_flags(spark, sf_dir):
    d = C.expand_fold_flags(observations(spark, sf_dir).select("idx", "fold1"), "fold1", 5, "t")
    d = C.collapse_fold_flags(d, [f"t{i}" for i in range(1, 6)], "fold")
    return d.select("idx", "fold1", "fold")


# Display names of the model codes.
DISPLAY_NAMES = {"LM0": "Null model", "LM1": "Species means", "LM2": "Chemical means",
                 "LM3": "Species + chemical", "LM4": "Linear model", "LM5": "Linear + interactions"}


def q_relabel(spark, sf_dir):
    rep = SM.q_holdout_report(spark, sf_dir)
    return C.relabel(rep, "model", DISPLAY_NAMES, "label")


def q_strip_suffix(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", strip_suffix("p_name", " ring").alias("base_name"),
                    F.col("p_name").endswith(" ring").alias("had_suffix"))


def q_fill_default(spark, sf_dir):
    r = raw_results(spark, sf_dir).select("result_id", "obs_duration_mean_op")
    f = C.fill_default(r, "obs_duration_mean_op", "=").withColumnRenamed("obs_duration_mean_op", "filled")
    back = C.restore_null(f.withColumn("restored", F.col("filled")), "restored", "=")
    return back.select("result_id", "filled", "restored")


def q_round_report(spark, sf_dir):
    return C.round_report(SM.q_holdout_report(spark, sf_dir), ["setting1", "setting2"], 3)


# --- J1–J3, J8–J10 ------------------------------------------------------------------

def q_join_left_fact(spark, sf_dir):
    j = C.join_left_fact(raw_tests(spark, sf_dir), raw_results(spark, sf_dir), "test_id")
    return j.groupBy("test_id").agg(F.count("result_id").alias("n_results"))


def q_join_left_dim(spark, sf_dir):
    r = raw_results(spark, sf_dir)
    j = C.join_left_dim(r, raw_chemicals(spark, sf_dir), r.test_cas == F.col("cas_number"))
    j = C.join_left_dim(j, raw_species(spark, sf_dir), "species_number")
    return j.select("result_id", "chemical_name", "latin_name", "kingdom")


def annotations(spark, sf_dir) -> DataFrame:
    """Approved-structure list: one row per chemical, some discarded with a reason."""
    p = load(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") + 50000).alias("test_cas"),
                    F.concat_ws("#", "p_name", "p_brand").alias("structure"),
                    F.when(F.col("p_size") > 45, F.lit("inorganic")).alias("reason_discarded"))


ANNOT_SQL = """
annot AS (SELECT p_partkey + 50000 AS test_cas, concat_ws('#', p_name, p_brand) AS structure,
                 CASE WHEN p_size > 45 THEN 'inorganic' END AS reason_discarded FROM part)"""


def q_join_inner_annotate(spark, sf_dir):
    ok = C.filter_null(annotations(spark, sf_dir), "reason_discarded").select("test_cas", "structure")
    return C.join_inner_annotate(curated(spark, sf_dir), ok, "test_cas").select("result_id", "structure")


def q_anti_holdout(spark, sf_dir):
    return C.anti_holdout(observations(spark, sf_dir), "fold2", 1).select("idx", "fold2")


def q_join_null_safe(spark, sf_dir):
    t = raw_tests(spark, sf_dir)
    # route descriptions keyed by the (nullable) exposure code, NULL included
    routes = t.select("exposure_type").distinct().select(
        "exposure_type", F.coalesce(F.concat(F.lit("route "), "exposure_type"), F.lit("unspecified")).alias("route"))
    j = C.join_null_safe(t, routes, ["exposure_type"], "left")
    return j.groupBy("exposure_type", "route").agg(F.count(F.lit(1)).alias("n"))


def q_cross_grid(spark, sf_dir):
    legal = spark.createDataFrame([(s, m) for s, m, _ in SM.MODEL_SPECS], "setting string, model string")
    grid = C.cross_grid(spark, {"model": ["LM0", "LM1", "LM2"], "setting": ["setting1", "setting2"],
                                "fold": [1, 2, 3, 4, 5], "alpha": [float(a) for a in SM.ALPHA_GRID]},
                        legal, ["setting", "model"])
    # keep folds that occur in the data, so the grid follows the table
    folds = observations(spark, sf_dir, index=False).select(F.col("fold1").alias("fold")).distinct()
    return grid.join(folds, "fold", "left_semi")


# --- A1–A4, K1, K4–K6: scans and sinks, each a write then a read ------------------------

def q_scan_delimited(spark, sf_dir):
    raw = raw_results(spark, sf_dir)
    path = K.scratch_path(spark, "results_txt")
    raw.write.mode("overwrite").option("sep", "|").option("header", True).option("nullValue", "NA").csv(path)
    return R.scan_delimited(spark, path, R.all_string_schema(raw.columns))


def q_scan_csv(spark, sf_dir):
    obs = observations(spark, sf_dir).select("idx", "species", "chem", "duration", "value")
    path = K.scratch_path(spark, "obs_csv")
    K.write_table(obs, path, "csv")
    return R.scan_csv(spark, path, "idx bigint, species bigint, chem bigint, duration double, value double")


def q_scan_headerless_log(spark, sf_dir):
    g = SM.grid_scores(SM.model_cells(observations(spark, sf_dir, index=False)))
    path = K.scratch_path(spark, "lm_log")
    g.select("model", "setting", "fold", "alpha", F.round("rmse", 6).alias("rmse")) \
     .write.mode("overwrite").option("header", False).csv(path)
    return R.scan_headerless_log(spark, path, "LM")


def q_scan_params(spark, sf_dir):
    grid = SM.grid_scores(SM.materialized_cells(spark, sf_dir))
    path = K.scratch_path(spark, "lm_optimal")
    K.write_table(SM.best_alphas(grid).select("setting", "model", "fold", "alpha"), path, "csv")
    params = R.scan_params(spark, path, "LM")
    # lookup: the chosen α's score for every (setting, model, fold)
    return grid.join(F.broadcast(params), ["setting", "model", "fold", "alpha"], "left_semi") \
               .select("setting", "model", "fold", "alpha", F.round("rmse", 6).alias("rmse"))


def q_write_table(spark, sf_dir):
    path = K.scratch_path(spark, "curated")
    K.write_table(curated(spark, sf_dir).select(*CURATED_COLS), path, "parquet")
    return spark.read.parquet(path)


def q_write_fold_sets(spark, sf_dir):
    obs = observations(spark, sf_dir)
    long = obs.select("idx", "y", F.explode(F.array(
        F.struct(F.lit("setting1").alias("setting"), F.col("fold1").alias("fold")),
        F.struct(F.lit("setting2").alias("setting"), F.col("fold2").alias("fold")))).alias("s")).select("idx", "y", "s.*")
    path = K.scratch_path(spark, "folds")
    K.write_fold_sets(long, path)
    # partition pruning: only the setting2/fold=3 folder is read
    return spark.read.parquet(path).filter((F.col("setting") == "setting2") & (F.col("fold") == 3)) \
                .select("idx", F.round("y", 6).alias("y"), "setting", "fold")


def q_append_log(spark, sf_dir):
    g = SM.grid_scores(SM.model_cells(observations(spark, sf_dir, index=False)))
    rows = g.select("model", "setting", "fold", "alpha", F.round("rmse", 6).alias("rmse"), F.lit("LM").alias("family"))
    path = K.scratch_path(spark, "log")
    K.append_log(rows.filter(F.col("setting") == "setting1"), path)
    K.append_log(rows.filter(F.col("setting") == "setting2"), path)
    return spark.read.parquet(path).select("model", "setting", "fold", "alpha", "rmse", "family")


def q_append_predictions(spark, sf_dir):
    p = SM.q_predict_holdout(spark, sf_dir)
    path = K.scratch_path(spark, "pred")
    K.append_predictions(p, path)
    return spark.read.parquet(path).groupBy("model", "setting").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("y_pred"), 6).alias("mean_pred"))


QUERIES = {
    "curate_table": q_curate_table,
    "select_rename": q_select_rename,
    "filter_equal": q_filter_equal,
    "filter_in": q_filter_in,
    "filter_not_in": q_filter_not_in,
    "filter_null": q_filter_null,
    "filter_not_null": q_filter_not_null,
    "filter_numeric_text": q_filter_numeric_text,
    "filter_range": q_filter_range,
    "normalize_duration": q_normalize_duration,
    "normalize_concentration": q_normalize_concentration,
    "format_registry_number": q_format_registry_number,
    "patch_value": q_patch_value,
    "log10_target": q_log10_target,
    "cut_right_closed": q_cut_right_closed,
    "data_driven_edges": q_data_driven_edges,
    "pair_key": q_pair_key,
    "category_code": q_category_code,
    "collapse_fold_flags": q_collapse_fold_flags,
    "expand_fold_flags": q_expand_fold_flags,
    "relabel": q_relabel,
    "strip_suffix": q_strip_suffix,
    "fill_default": q_fill_default,
    "round_report": q_round_report,
    "join_left_fact": q_join_left_fact,
    "join_left_dim": q_join_left_dim,
    "join_inner_annotate": q_join_inner_annotate,
    "anti_holdout": q_anti_holdout,
    "join_null_safe": q_join_null_safe,
    "cross_grid": q_cross_grid,
    "scan_delimited": q_scan_delimited,
    "scan_csv": q_scan_csv,
    "scan_headerless_log": q_scan_headerless_log,
    "scan_params": q_scan_params,
    "write_table": q_write_table,
    "write_fold_sets": q_write_fold_sets,
    "append_log": q_append_log,
    "append_predictions": q_append_predictions,
}

_CUR_COLS_SQL = ", ".join(CURATED_COLS)

EDGES_SQL = f"""
cnt AS (SELECT duration, count(*) AS n FROM obs GROUP BY duration),
tot AS (SELECT count(*) AS n, max(duration) AS mx FROM obs),
edges AS (SELECT DISTINCT e FROM (
            SELECT 0.0 AS e UNION ALL SELECT mx FROM tot
            UNION ALL SELECT duration FROM cnt, tot WHERE cnt.n >= {EDGE_SHARE!r} * tot.n)),
edge_list AS (SELECT CAST(row_number() OVER (ORDER BY e) - 1 AS INTEGER) AS edge_no, e AS edge FROM edges),
bounds AS (SELECT min(e) AS lo, max(e) AS hi FROM edges),
binned AS (SELECT o.idx, CASE WHEN o.duration <= b.lo OR o.duration > b.hi THEN NULL
                         ELSE (SELECT CAST(count(*) AS INTEGER) FROM edges WHERE e < o.duration) END AS dur_bin
           FROM obs o, bounds b)"""

_RAW_COLS = ["result_id", "test_id", "test_cas", "species_number", "endpoint", "effect", "conc1_mean_op",
             "conc1_mean", "conc1_unit", "obs_duration_mean_op", "obs_duration_mean", "obs_duration_unit"]

ORACLES = {
    "curate_table": with_sql(*CUR_CTES) + f"SELECT {_CUR_COLS_SQL} FROM cur",
    "select_rename": "SELECT l_suppkey AS species, l_partkey AS chem, l_quantity AS duration, "
                     "l_extendedprice AS value, l_linenumber AS line FROM lineitem",
    "filter_equal": with_sql(RAW_RESULTS_SQL) + "SELECT result_id, endpoint FROM results WHERE endpoint = 'LC50'",
    "filter_in": with_sql(RAW_RESULTS_SQL)
    + f"SELECT result_id, conc1_unit FROM results WHERE conc1_unit IN {_sql_list(CONC_UNITS)}",
    "filter_not_in": with_sql(RAW_TESTS_SQL)
    + f"SELECT test_id, exposure_type FROM tests WHERE exposure_type NOT IN {_sql_list(C.EXCLUDED_EXPOSURE)}",
    "filter_null": with_sql(RAW_RESULTS_SQL) + "SELECT result_id FROM results WHERE conc1_mean_op IS NULL",
    "filter_not_null": with_sql(RAW_RESULTS_SQL)
    + "SELECT result_id, obs_duration_mean_op FROM results WHERE obs_duration_mean_op IS NOT NULL",
    "filter_numeric_text": with_sql(RAW_RESULTS_SQL)
    + "SELECT result_id, conc1_mean, try_cast(conc1_mean AS DOUBLE) AS conc_value FROM results "
      "WHERE conc1_mean <> 'NR' AND try_cast(conc1_mean AS DOUBLE) IS NOT NULL",
    "normalize_duration": with_sql(RAW_RESULTS_SQL)
    + f"SELECT result_id, obs_duration_unit, try_cast(obs_duration_mean AS DOUBLE) * "
      f"{_sql_case('obs_duration_unit', C.DURATION_FACTORS)} AS duration_d FROM results "
      f"WHERE obs_duration_unit IN {_sql_list(DUR_UNITS)}",
    "filter_range": with_sql(RAW_RESULTS_SQL)
    + f"SELECT result_id, duration_d FROM (SELECT result_id, try_cast(obs_duration_mean AS DOUBLE) * "
      f"{_sql_case('obs_duration_unit', C.DURATION_FACTORS)} AS duration_d FROM results) "
      f"WHERE duration_d <= 7.0 AND round(duration_d, 5) >= round(1.0 / 24, 5)",
    "normalize_concentration": with_sql(RAW_RESULTS_SQL)
    + f"SELECT result_id, conc1_unit, try_cast(conc1_mean AS DOUBLE) * {_sql_case('conc1_unit', C.CONC_FACTORS)} "
      f"AS conc_mgl FROM results WHERE conc1_unit IN {_sql_list(CONC_UNITS)}",
    "format_registry_number": with_sql(RAW_RESULTS_SQL)
    + f"SELECT test_cas, {_registry_sql('test_cas')} AS CAS FROM (SELECT DISTINCT test_cas FROM results)",
    "patch_value": with_sql(RAW_CHEMICALS_SQL)
    + "SELECT cas_number, CASE WHEN chemical_name = 'small ring' THEN 'small ring (fixed)' ELSE chemical_name END "
      "AS chemical_name FROM chemicals",
    "log10_target": "SELECT l_orderkey, l_linenumber, l_partkey, round(log10(l_extendedprice), 6) AS y FROM lineitem",
    "cut_right_closed": with_sql(OBS_SQL, EDGES_SQL) + "SELECT idx, dur_bin FROM binned",
    "data_driven_edges": with_sql(OBS_SQL, EDGES_SQL)
    + "SELECT l.edge_no, l.edge, coalesce(c.n, 0) AS n_rows FROM edge_list l "
      "LEFT JOIN (SELECT dur_bin, count(*) AS n FROM binned GROUP BY dur_bin) c ON c.dur_bin = l.edge_no",
    "pair_key": with_sql(OBS_SQL)
    + "SELECT concat_ws('|', CAST(chem AS VARCHAR), CAST(species AS VARCHAR)) AS pair, count(*) AS n FROM obs GROUP BY 1",
    "category_code": with_sql(OBS_SQL)
    + "SELECT species, CAST(dense_rank() OVER (ORDER BY species) - 1 AS BIGINT) AS species_code "
      "FROM (SELECT DISTINCT species FROM obs)",
    "collapse_fold_flags": with_sql(OBS_SQL) + "SELECT idx, fold1, fold1 AS fold FROM obs",
    "expand_fold_flags": with_sql(OBS_SQL)
    + "SELECT idx, fold2, " + ", ".join(f"fold2 = {i} AS setting2_test{i}" for i in range(1, 6)) + " FROM obs",
    "relabel": None,  # filled below
    "strip_suffix": "SELECT p_partkey, CASE WHEN suffix(p_name, ' ring') THEN substr(p_name, 1, length(p_name) - 5) "
                    "ELSE p_name END AS base_name, suffix(p_name, ' ring') AS had_suffix FROM part",
    "fill_default": with_sql(RAW_RESULTS_SQL)
    + "SELECT result_id, coalesce(obs_duration_mean_op, '=') AS filled, "
      "CASE WHEN coalesce(obs_duration_mean_op, '=') <> '=' THEN obs_duration_mean_op END AS restored FROM results",
    "round_report": None,  # filled below
    "join_left_fact": with_sql(RAW_TESTS_SQL, RAW_RESULTS_SQL)
    + "SELECT test_id, count(result_id) AS n_results FROM tests LEFT JOIN results USING (test_id) GROUP BY test_id",
    "join_left_dim": with_sql(RAW_RESULTS_SQL, RAW_CHEMICALS_SQL, RAW_SPECIES_SQL)
    + "SELECT result_id, chemical_name, latin_name, kingdom FROM results "
      "LEFT JOIN chemicals ON results.test_cas = chemicals.cas_number LEFT JOIN species USING (species_number)",
    "join_inner_annotate": with_sql(*CUR_CTES, ANNOT_SQL)
    + "SELECT result_id, structure FROM cur JOIN annot USING (test_cas) WHERE annot.reason_discarded IS NULL",
    "anti_holdout": with_sql(OBS_SQL) + "SELECT idx, fold2 FROM obs WHERE fold2 <> 1",
    "join_null_safe": with_sql(RAW_TESTS_SQL)
    + "SELECT t.exposure_type, r.route, count(*) AS n FROM tests t LEFT JOIN "
      "(SELECT DISTINCT exposure_type, coalesce('route ' || exposure_type, 'unspecified') AS route FROM tests) r "
      "ON t.exposure_type IS NOT DISTINCT FROM r.exposure_type GROUP BY ALL",
    "cross_grid": with_sql(OBS_SQL)
    + "SELECT m.model, s.setting, CAST(f.fold AS INTEGER) AS fold, a.alpha FROM "
      "(SELECT unnest(['LM0', 'LM1', 'LM2']) AS model) m, (SELECT unnest(['setting1', 'setting2']) AS setting) s, "
      "(SELECT DISTINCT fold1 AS fold FROM obs) f, (SELECT unnest(" + SM._ALPHAS_SQL + ") AS alpha) a "
      "WHERE (s.setting, m.model) IN (" + ", ".join(f"('{s}', '{m}')" for s, m, _ in SM.MODEL_SPECS) + ")",
    "scan_delimited": with_sql(RAW_RESULTS_SQL)
    + "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _RAW_COLS) + " FROM results",
    "scan_csv": with_sql(OBS_SQL) + "SELECT idx, species, chem, duration, value FROM obs",
    "scan_headerless_log": SM.ORACLES["grid_search"].replace(
        "SELECT setting, model, fold, alpha, round(rmse, 6) AS rmse FROM grid",
        "SELECT model, setting, fold, alpha, round(round(rmse, 6), 6) AS rmse FROM grid"),
    "scan_params": SM.ORACLES["best_per_group"],
    "write_table": with_sql(*CUR_CTES) + f"SELECT {_CUR_COLS_SQL} FROM cur",
    "write_fold_sets": with_sql(OBS_SQL) + "SELECT idx, round(y, 6) AS y, 'setting2' AS setting, fold2 AS fold "
                                           "FROM obs WHERE fold2 = 3",
    "append_log": SM.ORACLES["grid_search"].replace(
        "SELECT setting, model, fold, alpha, round(rmse, 6) AS rmse FROM grid",
        "SELECT model, setting, fold, alpha, round(rmse, 6) AS rmse, 'LM' AS family FROM grid"),
    "append_predictions": with_sql(*SM.PRED_CTES)
    + "SELECT model, setting, count(*) AS n, round(avg(round(y_pred, 6)), 6) AS mean_pred FROM pred GROUP BY ALL",
}

_REPORT_BODY = SM.ORACLES["holdout_report"]
ORACLES["relabel"] = _REPORT_BODY.replace(
    "SELECT model,\n", "SELECT model, " + "CASE model " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY_NAMES.items()) + " ELSE model END AS label,\n", 1)
ORACLES["round_report"] = "SELECT model, round(setting1, 3) AS setting1, round(setting2, 3) AS setting2 FROM (" \
    + _REPORT_BODY + ")"
