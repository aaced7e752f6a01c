"""The stored best row per key after restarts, replayed batches and merges, against W1."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from pairgrid.operators.reshape import best_per_group
from pairgrid.streaming import stream as X

SCHEMA = "key string, alpha double, rmse double"


def arrive(spark, src, rows, files):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(src)


def wanted(spark, rows):
    best = best_per_group(spark.createDataFrame(rows, SCHEMA), ["key"], [F.round("rmse", 9).asc(), F.col("alpha").asc()])
    return sorted(map(tuple, best.collect()), key=str)


def test_replayed_batches_and_merges(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice("abcdef"), float(rnd.randrange(5)), rnd.randrange(8) / 8) for _ in range(90)]
    rows += [(None, 1.0, .5), (None, 0.0, .5), ("a", 9.0, -1.0)]
    src, out, log = (str(tmp_path / x) for x in ("src", "out", "log"))
    arrive(spark, src, rows[:50], 5)

    def run():
        sdf = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        got = X.run_to_best(sdf, out, "best", ["key"], "rmse", ["alpha"], every=3, checkpoint=log)
        return sorted(map(tuple, got.collect()), key=str)

    assert run() == wanted(spark, rows[:50])
    # the last batch stored its rows but its commit was lost: it runs again
    last = max((p for p in Path(log, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    before = sorted(p.name for p in Path(out, "rows").iterdir())
    last.unlink()
    Path(log, "commits", f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == wanted(spark, rows[:50])
    assert sorted(p.name for p in Path(out, "rows").iterdir()) == before
    arrive(spark, src, rows[50:], 4)
    assert run() == wanted(spark, rows)
    assert {p.name for p in Path(out, "bases").iterdir()} >= {"-1", "2", "5"}


def test_an_unmarked_base_is_not_read(spark, tmp_path):
    src, out, log = (str(tmp_path / x) for x in ("src", "out", "log"))
    rows = [("a", 1.0, .5), ("b", 2.0, .25)]
    arrive(spark, src, rows, 1)
    sdf = spark.readStream.schema(SCHEMA).parquet(src)
    got = X.run_to_best(sdf, out, "best", ["key"], "rmse", ["alpha"], checkpoint=log)
    got.limit(0).write.parquet(f"{out}/rows/step=0/kind=base")  # a merge that did not end
    again = X.best_table(spark, out, got.schema, ["key"], "rmse", ["alpha"])
    assert sorted(map(tuple, again.collect())) == wanted(spark, rows)


def test_no_input(spark, tmp_path):
    src = str(tmp_path / "src")
    arrive(spark, src, [], 1)
    sdf = spark.readStream.schema(SCHEMA).parquet(src)
    assert X.run_to_best(sdf, str(tmp_path / "out"), "best", ["key"], "rmse", ["alpha"], checkpoint=str(tmp_path / "log")).collect() == []
