"""Operator 6: the fit, out-of-fold training, held-out accuracy and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairgrid.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def test_logistic_gradient_is_zero():
    rng = np.random.default_rng(3)
    n, width = 400, 12
    m = rng.random((n, width)) < .3
    dense = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(m @ rng.normal(size=width) + dense[:, 0] - 1)))).astype(float)
    rows, cols = np.nonzero(m)
    w = X.logistic(rows, cols, dense, y, width, ridge=.7)
    p = 1 / (1 + np.exp(-(m @ w[:width] + dense @ w[width:-1] + w[-1])))
    grad = np.r_[m.T @ (p - y) + .7 * w[:width], dense.T @ (p - y) + 1e-3 * w[width:-1], (p - y).sum() + 1e-6 * w[-1]]
    assert np.abs(grad).max() < 1e-2


def test_logistic_converges_with_many_features():
    r = np.random.default_rng(1)
    n, width = 3000, 600
    often = 1 / np.arange(1, width + 1)
    own = [np.unique(r.choice(width, 30, p=often / often.sum())) for _ in range(n)]
    rows, cols = np.repeat(np.arange(n), [len(c) for c in own]), np.concatenate(own)
    z = np.bincount(rows, r.normal(0, 2, width)[cols], n)
    y = (z > np.quantile(z, .8)).astype(float)
    w = X.logistic(rows, cols, np.empty((n, 0)), y, width, ridge=.1)
    off = 1 / (1 + np.exp(-np.bincount(rows, w[cols], n) - w[-1])) - y
    assert np.abs(np.r_[np.bincount(cols, off[rows], width) + .1 * w[:width], off.sum() + 1e-6 * w[-1]]).max() < .02


def plain_chain(docs, labels):
    """The chain on dense numpy matrices: out-of-fold log-odds, then the fits on all rows."""
    ids = sorted(labels)
    own = {i: set(X._text_features(docs[i])) for i in ids}
    fold = np.array([zlib.crc32(str(i).encode()) % X.FOLDS for i in ids])
    y = np.array([[q, t, q * t] for t, q in (labels[i] for i in ids)], float)
    every = sorted(set().union(*own.values()))
    m = np.array([[f in own[i] for f in every] for i in ids], float)
    earlier, chain = np.empty((len(ids), 0)), []
    for k in range(3):
        judged = np.zeros(len(ids))
        for g in range(X.FOLDS + 1):
            some, yk = fold != g, y[:, k]
            n, yes, df, both = some.sum(), yk[some].sum(), m[some].sum(0), yk[some] @ m[some]
            with np.errstate(divide="ignore", invalid="ignore"):
                chi2 = np.nan_to_num(n * (both * n - df * yes) ** 2 / (df * (n - df) * yes * (n - yes)), posinf=0)
            keep = chi2 >= X.LEAST_CHI2
            x = np.c_[m[:, keep], earlier, np.ones(len(ids))]
            w = plain_logistic(x[some], yk[some], keep.sum(), min(X.ONES, max(1, (n - yes) / yes)))
            p = 1 / (1 + np.exp(-x @ w))
            judged[~some] = p[~some]
        chain.append(dict(zip(np.array(every)[keep].tolist(), w)) | {"earlier": w[keep.sum():-1], "intercept": w[-1]})
        earlier = np.c_[earlier, np.log(judged / (1 - judged))]
    return chain


def plain_logistic(x, y, width, ones):
    c, w = np.where(y > 0, ones, 1.0), np.zeros(x.shape[1])
    penalty = np.r_[np.full(width, X.RIDGE), np.full(x.shape[1] - width - 1, 1e-3), 1e-6]
    loss = lambda w: c @ (np.logaddexp(0, x @ w) - y * (x @ w)) + (penalty * w * w).sum() / 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (c * p * (1 - p))) @ x + np.diag(penalty), x.T @ (c * (p - y)) + penalty * w)
        size = 1.0
        while size > 1e-9 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return w


def some_documents():
    rng = np.random.default_rng(7)
    words = [f"word{chr(97 + i)}{i}" for i in range(25)]
    docs, labels = {}, {}
    for i in range(500):
        t, q = int(rng.random() < .3), int(rng.random() < .4)
        text = rng.choice(words, 6).tolist() + ["idiot"] * (rng.random() < (.8 if t else .05)) + ["spam"] * (rng.random() < (.7 if q else .1))
        docs[i], labels[i] = " ".join(text), (t, q)
    return docs, labels


def test_chain_against_plain_numpy(spark):
    docs, labels = some_documents()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = X.train(df, spark.createDataFrame([(i, 1 - q, t) for i, (t, q) in labels.items()], "doc_id long, quality int, toxic int"))
    for mine, want in zip(got, plain_chain(docs, labels)):
        np.testing.assert_allclose(mine["earlier"], want.pop("earlier"), atol=2e-2)
        assert abs(mine["intercept"] - want.pop("intercept")) < 2e-2 and mine["features"].keys() == want.keys()
        assert max((abs(mine["features"][f] - w) for f, w in want.items()), default=0) < 2e-2


def test_same_model_in_any_order(spark):
    """Rows that share an id, ids that are strings: the order of rows decides nothing."""
    docs, labels = some_documents()
    rows = [(f"d{i}", t) for i, t in docs.items()] + [(f"d{i}", "spam idiot") for i in range(0, 500, 3)] + [(None, "x")] * 3
    lab = spark.createDataFrame([(f"d{i}", 1 - q, t) for i, (t, q) in labels.items()], "doc_id string, quality int, toxic int")
    one = X.train(spark.createDataFrame(rows, "doc_id string, text string").repartition(2), lab)
    assert X.train(spark.createDataFrame(rows[::-1], "doc_id string, text string").repartition(5), lab) == one


def test_all_associated_features_are_kept(spark):
    told = " ".join(f"{i:04d}" for i in range(1500))
    docs = spark.createDataFrame([(i, told if i % 2 else f"other words {i}") for i in range(100)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert len(X.train(docs, labels)[1]["features"]) > 1500


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    chain = X.train(docs, labels.where(~test))
    got = {r["doc_id"]: r for r in X.score(docs, chain).collect()}
    held = labels.where(test).collect()
    assert len(got) == docs.count()
    hits = sum(r["toxic"] == 1 and got[r["doc_id"]]["toxic"] >= .5 for r in held)
    wrong = [r["doc_id"] for r in held if r["toxic"] == 0 and got[r["doc_id"]]["toxic"] >= .5]
    ones = sum(r["toxic"] for r in held)
    # a few labels there go with no word: repeated filler words, tables of ordinary ones
    assert hits >= .85 * ones and len(wrong) <= .005 * len(held), (hits, ones, wrong)
    assert len(chain[1]["earlier"]) == 1 and len(chain[2]["earlier"]) == 2
    some = docs.where(F.col("doc_id") < 500).withColumn("toxic", F.lit(7))
    kept = X.drop_toxic(some, chain)
    assert kept.columns == some.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d in range(500) if got[d]["toxic"] < .5}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot", "x"), (1, "you idiot", "x"), (None, None, "y"), (3, "", None), (4, "x " * 40_000, "z")],
                                 "doc_id long, text string, low_quality string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = X.score(docs, X.train(docs, none)).collect()
    assert len(rows) == 5 and all(r["toxic"] < 1e-5 for r in rows)
    labels = spark.createDataFrame([(1, 1, 1), (1, None, 0), (3, 0, 0), (None, 1, 1), (77, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = X.score(docs, X.train(docs, labels)).collect()
    assert len(rows) == 5 and len({(r["doc_id"], r["toxic"]) for r in rows}) == 4
    assert X.score(docs.limit(0), X.train(docs.limit(0), none)).collect() == []


def test_texts_are_taken_a_few_at_a_time():
    """A batch's texts and features become Python objects in pieces, in order and whole."""
    n = 3 * X.ROWS + 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([[0, 0, 0]] * n, pa.list_(pa.int32())), pa.array([0] * n, pa.int32()),
                                        pa.array([f"word{i} toxic" for i in range(n)])], names=["nth", "y", "fold", "text"])
    out = list(X._features(None)(iter([batch])))
    assert max(b.num_rows for b in out) <= X.ROWS
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(n))
    assert [f for b in out for f in b.column(3).to_pylist()] == [X._text_features(f"word{i} toxic") for i in range(n)]
    empty = list(X._features(None)(iter([batch.slice(0, 0)])))
    assert sum(b.num_rows for b in empty) == 0


def test_each_fold_is_fitted_in_a_task_of_its_own(spark, monkeypatch):
    """The folds' fits run side by side: no task gets the rows of two of them."""
    from pairgrid.llm import common

    taken = []

    def noting(df, name):
        out = common.materialize(df, name)
        if name == "fitted":
            taken.append(out.select(F.input_file_name().alias("file"), "kind").distinct().groupBy("kind").count().collect())
        return out

    monkeypatch.setattr(X, "materialize", noting)
    docs, labels = some_documents()
    X.train(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(i, 1 - q, t) for i, (t, q) in labels.items()], "doc_id long, quality int, toxic int"))
    assert [r[0]["count"] for r in taken if r[0]["kind"] == 0] == [X.FOLDS, X.FOLDS]


def test_far_from_the_end_steps_are_not_solved_exactly(monkeypatch):
    """The same minimum with fewer products by the matrix."""
    r = np.random.default_rng(1)
    n, width = 3000, 600
    often = 1 / np.arange(1, width + 1)
    own = [np.unique(r.choice(width, 30, p=often / often.sum())) for _ in range(n)]
    counts, cols = np.array([len(c) for c in own]), np.concatenate(own)
    z = np.bincount(np.repeat(np.arange(n), counts), r.normal(0, 2, width)[cols], n)
    y, passes, back = (z > np.quantile(z, .8)).astype(float), [0], X.Entries.back

    def counted(self, v):
        passes[0] += 1
        return back(self, v)

    monkeypatch.setattr(X.Entries, "back", counted)
    w, loose = X.newton(counts, cols, np.empty((n, 0)), y, width), passes[0]
    monkeypatch.setattr(X, "LOOSE", 0.0)
    exact = X.newton(counts, cols, np.empty((n, 0)), y, width)
    assert loose < .8 * (passes[0] - loose) and np.abs(w - exact).max() < .02
