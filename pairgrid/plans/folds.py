"""Fold queries (V1–V7) over the observation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairgrid.operators import folds as V
from pairgrid.plans.roles import OBS_SQL, observations, with_sql
from pairgrid.sources import writers as K


def q_group_kfold_greedy(spark, sf_dir):
    """V1 on chemicals: exact greedy folds."""
    obs = observations(spark, sf_dir, index=False).select("chem")
    return V.assign_folds(obs, ["chem"], 5, "greedy").select("chem", "fold").distinct()


def q_group_kfold_greedy_pairs(spark, sf_dir):
    """V1 on (chemical, species) pairs; checked by properties, not by SQL."""
    obs = observations(spark, sf_dir, index=False).select("chem", "species")
    f = V.assign_folds(obs, ["chem", "species"], 5, "greedy")
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.countDistinct("chem", "species").alias("n_groups"))


def q_group_kfold_hash(spark, sf_dir):
    obs = observations(spark, sf_dir, index=False).select("chem")
    return V.assign_folds(obs, ["chem"], 5, "hash").select("chem", "fold").distinct()


def q_assign_folds_custom(spark, sf_dir):
    """A user splitter passed as a callable (here: last digit of the chemical key, mod k)."""
    def by_last_digit(key, k):
        return F.pmod(F.substring(key, -1, 1).cast("int"), F.lit(k)) + 1
    f = V.assign_folds(observations(spark, sf_dir, index=False).select("chem"), ["chem"], 5, by_last_digit)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("chem").alias("n_groups"))


def q_holdout_by_pair(spark, sf_dir):
    f = V.holdout(observations(spark, sf_dir, index=False).select("chem", "species"), "setting1")
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.countDistinct("chem", "species").alias("n_groups"))


def q_holdout_by_entity(spark, sf_dir):
    f = V.holdout(observations(spark, sf_dir, index=False).select("chem", "species"), "setting2")
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("chem").alias("n_groups"))


def q_nested_folds(spark, sf_dir):
    obs = observations(spark, sf_dir, index=False).select("chem", "fold2")
    n = V.nested_folds(obs, ["chem"], "fold2", 5, 5, "hash")
    return n.groupBy("outer", "inner").agg(F.count(F.lit(1)).alias("n_rows"),
                                           F.countDistinct("chem").alias("n_groups"))


def q_nested_folds_greedy(spark, sf_dir):
    """V4 with inner folds rebuilt greedily inside each outer training set."""
    obs = observations(spark, sf_dir, index=False).select("chem", "fold2")
    n = V.nested_folds(obs, ["chem"], "fold2", 5, 5, "greedy")
    return n.groupBy("outer", "inner").agg(F.count(F.lit(1)).alias("n_rows"),
                                           F.countDistinct("chem").alias("n_groups"))


def q_read_folds(spark, sf_dir):
    obs = observations(spark, sf_dir)
    long = obs.select("idx", F.explode(F.array(
        F.struct(F.lit("setting1").alias("setting"), F.col("fold1").alias("fold")),
        F.struct(F.lit("setting2").alias("setting"), F.col("fold2").alias("fold")))).alias("s")).select("idx", "s.*")
    path = K.scratch_path(spark, "fold_sets")
    K.write_fold_sets(long, path)
    return V.read_folds(spark.read.parquet(path))


def q_leakage_check(spark, sf_dir):
    obs = observations(spark, sf_dir, index=False)
    a = V.leakage_check(obs, ["chem", "species"], "fold1").withColumn("setting", F.lit("setting1"))
    b = V.leakage_check(obs, ["chem"], "fold2").withColumn("setting", F.lit("setting2"))
    return a.unionByName(b)


def q_split_cells(spark, sf_dir):
    s = V.split_cells(observations(spark, sf_dir, index=False), "species", "chem", 0.2)
    return s.groupBy("is_test").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.countDistinct("species", "chem").alias("n_cells"))


def q_split_columns(spark, sf_dir):
    s = V.split_columns(observations(spark, sf_dir, index=False), "chem", 0.2)
    return s.groupBy("is_test").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("chem").alias("n_chem"))


QUERIES = {
    "group_kfold_greedy": q_group_kfold_greedy,
    "group_kfold_greedy_pairs": q_group_kfold_greedy_pairs,
    "group_kfold_hash": q_group_kfold_hash,
    "holdout_by_pair": q_holdout_by_pair,
    "assign_folds_custom": q_assign_folds_custom,
    "holdout_by_entity": q_holdout_by_entity,
    "nested_folds": q_nested_folds,
    "nested_folds_greedy": q_nested_folds_greedy,
    "read_folds": q_read_folds,
    "leakage_check": q_leakage_check,
    "split_cells": q_split_cells,
    "split_columns": q_split_columns,
}


def _share_sql(key_sql: str, salt: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat({key_sql}, '#{salt}')), 1, 8)) AS BIGINT) / 4294967296.0)"


_GREEDY_SQL = """
g AS (SELECT CAST(chem AS VARCHAR) AS key, count(*) AS n FROM obs GROUP BY 1),
ord AS (SELECT key, n, row_number() OVER (ORDER BY n DESC, key) AS rn FROM g),
r(rn, key, fold, loads) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL
  SELECT ord.rn, ord.key, CAST(list_position(r.loads, list_min(r.loads)) AS INTEGER),
         list_transform(range(1, 6), lambda x: r.loads[x] +
             CASE WHEN x = list_position(r.loads, list_min(r.loads)) THEN ord.n ELSE 0 END)
  FROM r JOIN ord ON ord.rn = r.rn + 1)"""

_NESTED_GREEDY_SQL = """
g AS (SELECT CAST(o.range AS INTEGER) AS side, CAST(chem AS VARCHAR) AS key, count(*) AS n
      FROM obs JOIN range(1, 6) o ON obs.fold2 <> o.range GROUP BY ALL),
ord AS (SELECT side, key, n, row_number() OVER (PARTITION BY side ORDER BY n DESC, key) AS rn FROM g),
r(rn, side, n, fold, loads) AS (
  SELECT CAST(0 AS BIGINT), CAST(range AS INTEGER), CAST(0 AS BIGINT), CAST(NULL AS INTEGER), [0, 0, 0, 0, 0]::BIGINT[] FROM range(1, 6)
  UNION ALL
  SELECT ord.rn, ord.side, ord.n, CAST(list_position(r.loads, list_min(r.loads)) AS INTEGER),
         list_transform(range(1, 6), lambda x: r.loads[x] +
             CASE WHEN x = list_position(r.loads, list_min(r.loads)) THEN ord.n ELSE 0 END)
  FROM r JOIN ord ON ord.rn = r.rn + 1 AND ord.side = r.side)"""

ORACLES = {
    "nested_folds_greedy": with_sql(OBS_SQL, _NESTED_GREEDY_SQL, recursive=True)
    + "SELECT side AS outer, fold AS inner, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups FROM r WHERE rn > 0 GROUP BY ALL",
    "assign_folds_custom": with_sql(OBS_SQL)
    + "SELECT CAST(CAST(right(CAST(chem AS VARCHAR), 1) AS INTEGER) % 5 + 1 AS INTEGER) AS fold, count(*) AS n_rows, "
      "count(DISTINCT chem) AS n_groups FROM obs GROUP BY 1",
    "group_kfold_greedy": with_sql(OBS_SQL, _GREEDY_SQL, recursive=True)
    + "SELECT CAST(key AS BIGINT) AS chem, fold FROM r WHERE rn > 0",
    "group_kfold_hash": with_sql(OBS_SQL) + "SELECT DISTINCT chem, fold2 AS fold FROM obs",
    "holdout_by_pair": with_sql(OBS_SQL)
    + "SELECT fold1 AS fold, count(*) AS n_rows, count(DISTINCT (chem, species)) AS n_groups FROM obs GROUP BY 1",
    "holdout_by_entity": with_sql(OBS_SQL)
    + "SELECT fold2 AS fold, count(*) AS n_rows, count(DISTINCT chem) AS n_groups FROM obs GROUP BY 1",
    "nested_folds": with_sql(OBS_SQL)
    + "SELECT CAST(o.range AS INTEGER) AS outer, inner2 AS inner, count(*) AS n_rows, count(DISTINCT chem) AS n_groups "
      "FROM obs JOIN range(1, 6) o ON obs.fold2 <> o.range GROUP BY ALL",
    "read_folds": with_sql(OBS_SQL)
    + "SELECT setting, fold, count(*) AS n_test, max(tot) - count(*) AS n_train FROM ("
      "SELECT 'setting1' AS setting, fold1 AS fold, count(*) OVER () AS tot FROM obs UNION ALL "
      "SELECT 'setting2', fold2, count(*) OVER () FROM obs) GROUP BY ALL",
    "leakage_check": with_sql(OBS_SQL) + """,
pg1 AS (SELECT count(DISTINCT fold1) AS nf FROM obs GROUP BY chem, species),
pf1 AS (SELECT count(*) AS r FROM obs GROUP BY fold1),
pg2 AS (SELECT count(DISTINCT fold2) AS nf FROM obs GROUP BY chem),
pf2 AS (SELECT count(*) AS r FROM obs GROUP BY fold2)
SELECT * FROM (SELECT count(*) AS n_groups, CAST(sum(CASE WHEN nf > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaking,
                      CAST(max(nf) AS BIGINT) AS max_folds_per_group FROM pg1),
              (SELECT count(*) AS n_folds, min(r) AS min_fold_rows, max(r) AS max_fold_rows FROM pf1),
              (SELECT 'setting1' AS setting)
UNION ALL
SELECT * FROM (SELECT count(*), CAST(sum(CASE WHEN nf > 1 THEN 1 ELSE 0 END) AS BIGINT), CAST(max(nf) AS BIGINT) FROM pg2),
              (SELECT count(*), min(r), max(r) FROM pf2), (SELECT 'setting2')""",
    "split_cells": with_sql(OBS_SQL)
    + "SELECT is_test, count(*) AS n_rows, count(DISTINCT (species, chem)) AS n_cells FROM (SELECT *, "
    + _share_sql("concat_ws('|', CAST(species AS VARCHAR), CAST(chem AS VARCHAR))", "cells")
    + " < 0.2 AS is_test FROM obs) GROUP BY is_test",
    "split_columns": with_sql(OBS_SQL)
    + "SELECT is_test, count(*) AS n_rows, count(DISTINCT chem) AS n_chem FROM (SELECT *, "
    + _share_sql("CAST(chem AS VARCHAR)", "columns") + " < 0.2 AS is_test FROM obs) GROUP BY is_test",
}
