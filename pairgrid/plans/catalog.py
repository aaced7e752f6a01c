"""Registry of every query: name → (Spark builder, DuckDB oracle or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Plan modules, each exporting QUERIES (name → callable) and ORACLES (name → SQL).
_MODULES = [
    "pairgrid.plans.shrunk_means",
    "pairgrid.plans.curation",
    "pairgrid.plans.folds",
    "pairgrid.plans.evaluation",
    "pairgrid.plans.feature_plans",
    "pairgrid.plans.learner_plans",
    "pairgrid.plans.stream_plans",
]


def _load():
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}
    for m in _MODULES:
        mod = importlib.import_module(m)
        for k, fn in mod.QUERIES.items():
            if k in queries:
                raise ValueError(f"duplicate query {k}")
            queries[k] = fn
        oracles.update(getattr(mod, "ORACLES", {}))
    missing = set(oracles) - set(queries)
    if missing:
        raise ValueError(f"oracles without queries: {sorted(missing)}")
    return queries, oracles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _load()[0]


def oracle_sql() -> dict[str, str]:
    return _load()[1]
