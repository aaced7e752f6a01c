"""Operator 12 against all pairs in double precision."""

import math

import numpy as np
import pytest

from pairgrid.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=.9):
    """Sorted (vec_id, n_links, component_id, kept), with None for null."""
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = {i: [] for i in range(len(rows))}
    for size in {len(rows[i][1]) for i in ok}:
        at = np.array([i for i in ok if len(rows[i][1]) == size])
        m = np.array([rows[i][1] for i in at], np.float32).astype(float)
        m /= np.sqrt((m * m).sum(1))[:, None]
        for i, hits in zip(at, m @ m.T >= threshold):
            near[i] = [j for j in at[hits] if j != i]
    root = {}
    for i in range(len(rows)):
        if i not in root:
            group, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            root |= dict.fromkeys(group, min(ids, default=None))
    return sorted(((rows[i][0], len(near[i]), root[i], rows[i][0] is not None and rows[i][0] == root[i]) for i in range(len(rows))), key=str)


def got(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r)[:4] for r in E.link(df).collect()), key=str)


def at_cosine(rng, x, c):
    z = rng.standard_normal(len(x))
    z -= (z @ x) * x / (x @ x)
    return c * x / np.linalg.norm(x) + math.sqrt(1 - c * c) * z / np.linalg.norm(z)


def plain(v):
    return [float(np.float32(x)) for x in v]


def test_groups_chains_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, plain(rng.standard_normal(64))) for i in range(300)]
    base = rng.standard_normal(64)
    rows += [(1000 + i, plain(base)) for i in range(40)] + [(1100 + i, plain(base * 3)) for i in range(5)]
    rows += [(2000 + i, plain(at_cosine(rng, base, c))) for i, c in enumerate(rng.uniform(.88, .999, 250))]
    x = rng.standard_normal(64)
    for i in range(30):  # a chain: neighbours alone are linked
        rows.append((3000 - i, plain(x)))
        x = at_cosine(rng, x, .93)
    nan, inf = float("nan"), float("inf")
    rows += [(None, plain(base)), (7, plain(base)), (7, plain(rng.standard_normal(64))), (4000, None), (4001, []), (4002, [0.0] * 64), (4003, [nan] + [1.0] * 63),
             (4004, [inf] * 64), (4005, [None] + [1.0] * 63), (4006, plain(base[:20])), (4007, plain(base[:20])), (4008, [1e-30] * 3), (4009, [1e30] * 3), (None, None), (4010, [-0.0, 1.0]), (4011, [0.0, 1.0])]
    want = brute(rows)
    assert max(w[1] for w in want) > 200
    assert got(spark, rows) == want


def test_recall_at_the_threshold(spark):
    """2,000 pairs between the cosines 0.9 and 0.92 and as many just below."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(2000):
        x = rng.standard_normal(64)
        rows += [(4 * i, plain(x)), (4 * i + 1, plain(at_cosine(rng, x, rng.uniform(.9, .92))))]
        x = rng.standard_normal(64)
        rows += [(4 * i + 2, plain(x)), (4 * i + 3, plain(at_cosine(rng, x, rng.uniform(.87, .8999))))]
    want, found = dict((w[0], w[1:]) for w in brute(rows)), dict((g[0], g[1:]) for g in got(spark, rows))
    missed = sum(found[k] != want[k] for k in want)
    assert sum(w[0] for w in want.values()) >= 3990 and missed <= 2 and all(found[k][0] <= want[k][0] for k in want)


def test_blocks(spark, monkeypatch):
    """Buckets and balls beyond a block give the same."""
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(6)
    bases = rng.standard_normal((3, 32))
    rows = [(i, plain(at_cosine(rng, bases[i % 3], c))) for i, c in enumerate(rng.uniform(.93, .99, 240))]
    assert got(spark, rows) == brute(rows)


def test_codes_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    for dims in (64, 100):
        x = rng.standard_normal((4000, dims))
        y = np.array([at_cosine(rng, v, c) for v, c in zip(x, rng.uniform(-.2, .99, len(x)))])
        both = np.concatenate([x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]])
        i, j = np.arange(4000), np.arange(4000, 8000)
        value, spread = E.estimate(E.codes(both), i, j)
        error = value - (both[i] * both[j]).sum(1)
        assert abs(error.mean()) < 4 * error.std() / math.sqrt(4000) + 2e-3
        assert (np.abs(error) <= E.EPS * spread).mean() > .9995 and error.std() < 1.2 * spread.mean()


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.link(none).collect() == []
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>").selectExpr("9 as key", "embedding", "'x' as ball", "vec_id", "0 as n_links")
    assert sorted(tuple(r)[:4] for r in E.link(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_sql_form(spark):
    duckdb = pytest.importorskip("duckdb")
    import pyarrow as pa

    rng = np.random.default_rng(9)
    base = rng.standard_normal(16)
    rows = [(i, plain(at_cosine(rng, base, c))) for i, c in enumerate(rng.uniform(.8, 1, 60))] + [(99, None), (98, [0.0] * 16), (97, [float("nan")] * 16)]
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows]), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}))
    assert sorted(con.execute(E.OP12_SQL).fetchall(), key=str) == brute(rows)
