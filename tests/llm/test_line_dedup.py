"""Operator 2 against a plain count of line windows."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairgrid.llm import line_dedup as L


def brute(docs, w=3, words=50):
    """docs: distinct (id, text) in order of id."""
    seen, out = set(), []
    for d, text in docs:
        lines = text.split("\n") if text else []
        units = [i for i, x in enumerate(lines) if x.strip(L.BLANKS)]
        gone = set()
        for j in range(len(units)):
            for size in range(1, min(w, len(units) - j) + 1):
                run = tuple(lines[u].strip(L.BLANKS) for u in units[j:j + size])
                if size < w and sum(len([x for x in re.split("[ \\t\\r\\x0b\\x0c]", line) if x]) for line in run) <= words:
                    continue
                gone |= {units[j + k] for k in range(size)} if run in seen else set()
                seen.add(run)
        kept = text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((d, kept, len(units), len(gone)))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    lines = [f"line {i}" for i in range(12)] + ["", "  ", "x"]
    docs = [(i, "\n".join(rnd.choices(lines, k=rnd.randrange(25)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "\n\n\n"), (203, "a\na\na\na\na\na"), (204, "one only"), (205, docs[0][1]), (206, "é\n" * 4000)]
    rows = [(None, "q1\nq2\nq3", "k", 1), *[(d, t, "k", 1) for d, t in docs], (207, "r1\nr2\nr3\nr4", "k", 1), (207, "r1\nr2\nr3\nr4", "k", 1),
            (208, " q1\nq2 \n\nq3\nr1", "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n_removed int").repartition(5)
    got = L.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed", "n_runs"]
    want = brute([(None, "q1\nq2\nq3"), *docs, (207, "r1\nr2\nr3\nr4"), (208, " q1\nq2 \n\nq3\nr1")])
    want.append(next(x for x in want if x[0] == 207))
    assert sorted([(r[0], r[1], r[4], r[5]) for r in got.collect()], key=str) == sorted(want, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.integers(1, 5))
def test_winnow_covers_every_window(hashes, w):
    owned = {j: best for best, first, last in L.winnow(hashes, w) for j in range(first, last + 1)}
    for j in range(len(hashes) - w + 1):
        assert owned[j] == min(range(j, j + w), key=hashes.__getitem__)


def test_empty(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_copies_are_spread_and_not_gathered(spark, monkeypatch):
    copy, n = "\n".join(f"c{i}" for i in range(6)), 400
    docs = [(i, copy if i % 2 else f"own {i}\nc1\nc2\nc3\nmore {i}") for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    shared = []
    keep = L.materialize
    monkeypatch.setattr(L, "materialize", lambda d, name: shared.append((keep(d, name), d)) or shared[-1][0])
    later = L.repeated_windows(df)
    plans = "".join(d._jdf.queryExecution().optimizedPlan().toString() for d in (later, *(d for _, d in shared)))
    assert "collect_list" not in plans and "collect_set(place" not in plans
    assert plans.count("collect_set(") == 1  # the starts of one document
    # exact copies of one fingerprint have many salts
    assert min(r["n"] for r in shared[0][0].where("id % 2 = 1").groupBy("print").agg(F.countDistinct("salt").alias("n")).collect()) > L.SALTS // 2
    assert sorted((r[0], r[1], r[2], r[3]) for r in L.dedup_lines(df).collect()) == brute(docs)


def test_short_runs_of_many_words(spark):
    """One or two lines repeat: they go by their words, whatever lines stand around them."""
    rnd = random.Random(9)
    line = lambda n: " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(900)) for _ in range(n))
    pool = [line(n) for n in (51, 50, 60, 120, 30, 21, 20, 26, 25, 1, 3)] + ["", " \t"]
    docs = [(i, "\n".join(rnd.choices(pool, k=rnd.randrange(1, 4)) + ([f"own {i}"] if i % 3 else []))) for i in range(150)]
    docs += [(300, pool[2]), (301, "x\t " + pool[0].replace(" ", "\xa0", 5)), (302, "new start\n" + pool[3] + "\nnew end"), (303, pool[0] + "\n" + pool[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted((r[0], r[1], r[2], r[3]) for r in L.dedup_lines(df).collect())
    assert got == brute(docs)
    assert (300, "", 1, 1) in got and (302, "new start\nnew end", 3, 1) in got
    few = sorted((r[0], r[1], r[2], r[3]) for r in L.dedup_lines(df, words=20).collect())
    assert few == brute(docs, words=20) != got


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=20), st.integers(1, 3))
def test_long_runs(sizes, w):
    assert L._long_runs(sizes, w, 50) == {j for j in range(len(sizes)) if j + w <= len(sizes) and sum(sizes[j:j + w]) > 50}


def test_lines_are_taken_a_few_rows_at_a_time():
    """Texts and lines of a batch become Python objects in pieces, in order and whole."""
    import pyarrow as pa

    n = 2 * L.ROWS + 7
    texts = [f"a {i}\nb {i}\nc {i}\nd" if i % 3 else None for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts)], names=["id", "key", "text"])
    out = list(L._fingerprints(3, 50)(iter([batch])))
    assert len(out) == 3 and sorted({i for b in out for i in b.column(0).to_pylist()}) == [i for i in range(n) if i % 3]
    cut = list(L._cut(3, 1)(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts), pa.array([[3] if t else None for t in texts], pa.list_(pa.int64()))], names=["c0", "c1", "starts"])])))
    assert max(b.num_rows for b in cut) <= L.ROWS and [t for b in cut for t in b.column(1).to_pylist()] == ["d" if i % 3 else None for i in range(n)]
