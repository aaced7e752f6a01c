"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_REPEAT (default 1; the median is reported).
Each query runs to completion through the ``noop`` sink, so nothing is
collected to the driver and the whole plan is executed.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairgrid.plans import catalog  # noqa: E402
from pairgrid.session import local_session  # noqa: E402

HEADLINE = [
    "holdout_report",            # flagship: nested-CV grid → best α → holdout → pooled RMSE
    "grid_search",               # R12 for the closed-form family
    "predict_holdout",           # R11 per-row predictions
    "curate_table",              # A1–P10 + J1–J2 curation chain
    "group_kfold_greedy",        # V1 exact greedy folds
    "hashed_count_fingerprint_docs",  # F2 over whole document texts
    "rmse_by_density",           # G10 over predictions ⋈ density flags
    "join_predictions",          # J6
    "curve_argmin",              # G12–G14 on the penalty path
    "score_ffm",                 # R8 scoring without pair expansion
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), driver_memory="12g", app="pairgrid-bench")
    queries = catalog.queries()
    # JVM/JIT warm-up outside the timings: one untimed run of the flagship
    queries["holdout_report"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
