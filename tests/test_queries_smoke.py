"""Every registered query runs on the smallest tables; the entry contract holds."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

# the optional training-data queries have tests of their own
OWN = [n for n in E.queries() if n != "pipeline" and not re.match(r"op\d+_", n)]
CHECKED = [n for n in OWN if n in E.oracle_sql() and n not in {"union_predictions", "stack_blocks"}]
ROWS_ONLY = ["group_kfold_greedy_pairs", "count_distinct_approx", "rbf_landmark_map"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) == {"model", "setting1", "setting2"} and len(rows) == 3


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_oracle_has_rows(spark, name):
    assert name not in E.oracle_sql()
    assert E.queries()[name](spark, SF_SMALL).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle_small(spark, duck, name):
    sys_path = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    import sys
    sys.path.insert(0, os.path.join(sys_path, "tools"))
    from check_oracles import compare
    ok, msg = compare(spark, duck, SF_SMALL, name)
    assert ok, msg
