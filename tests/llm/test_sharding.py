"""Operator 7: the permutation, its inverse and the law on rows."""

import zlib
from collections import Counter

import numpy as np

from pairgrid.llm import sharding


def test_permutation():
    for n in (1, 2, 5, 24, 1000, 99_991):
        rows = np.arange(n)
        assert sorted(sharding.permute(rows, n, 7)) == list(range(n))
        s, t = sharding.place(rows, n, 24, 7)
        assert (sharding.row_at(s, t, n, 24, 7) == rows).all()


def test_rows_law(spark):
    rows = [(i, f"text {i % 5}", "x") for i in range(90)] + [(None, None, "y")] * 7 + [(3, "", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    for parts in (1, 7):
        got = sharding.shard_rows(df.repartition(parts), shards=6, key=5).collect()
        assert len(got) == len(rows) and sorted(r["row"] for r in got) == list(range(len(rows)))
        counts = Counter(r["shard"] for r in got)
        assert max(counts.values()) - min(counts.values()) <= 1
        for s in counts:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
            (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
        if parts == 1:
            before = sorted(map(str, got))
    assert before == sorted(map(str, got))  # the same whatever the partitions


def test_empty(spark):
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string")).collect() == []
