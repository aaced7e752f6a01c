"""Operator 11 against a plain count of all n-grams."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pairgrid.llm import collocations as C

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least=30, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) rows."""
    f, mass = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            mass[lang] += len(words)
            for n in range(1, 5):
                f.update((lang, tuple(words[i:i + n])) for i in range(len(words) - n + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = Counter()
    for (lang, g), a in found.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                held[lang, g[i:i + m]] = max(held[lang, g[i:i + m]], a)
    out = []
    for lang in mass:
        kept = []
        for (tongue, g), a in found.items():
            if tongue == lang and 100 * held[lang, g] < 80 * a:
                score, _, l, r = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, mass[lang], -score))
    return sorted(out)


def odd_rows(n=400):
    rng = random.Random(1)
    words = ["a", "B", "É", "é", "new", "York", "city", "of", "x\x00y", "'q", "ß", "naïve", " ", "日本"]
    gaps = [" ", " ", " ", "\t", "  \t", ". ", ",", "\n", "\x0b", "!"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "en", "fr", None, ""]), text + rng.choice(["", "New York City", " of new york city"])))
    rows += [("en", None), (None, None), ("en", ""), ("de", "   "), ("de", "one"), ("de", "a a a a " * 500)]
    return rows + rows[:50]


def got(df, **kind):
    out = C.collocations(df, **kind)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def test_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in df.select("lang", "text").collect()]
    assert got(df) == brute(rows) and len(brute(rows)) > 20


@pytest.mark.parametrize("least,top", [(30, 2000), (3, 25)])
def test_odd_rows(spark, least, top):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(5)
    want = brute(rows, least, top)
    assert want and got(df, least=least, top=top) == want
    clash = df.selectExpr("'z' as phrase", "text", "1 as n", "lang", "2 as size", "doc_id as score")
    assert got(clash, least=least, top=top) == want


def test_full_filter_and_small_blocks(spark, monkeypatch):
    """A filter that lets nearly all pass, and blocks of one text, change nothing."""
    rows = odd_rows(150)
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], SCHEMA)
    monkeypatch.setattr(C, "_filter", lambda s, found: (found.count(), s.sparkContext.broadcast(np.full(C.FILTER_BITS // 64, 2**64 - 1, np.uint64)))[1])
    assert got(df, least=5) == brute(rows, 5)


def test_summary_keeps_every_frequent_item():
    rng = np.random.default_rng(3)
    for seed in range(30):
        items = np.concatenate([rng.integers(0, 10**6, 4000), rng.zipf(1.4, 4000) % 5000]).astype(np.uint64)
        rng.shuffle(items)
        least = int(rng.integers(5, 60))
        s = C.Summary(len(items) // least + 1)
        for some in np.array_split(items, int(rng.integers(1, 40))):
            s.merge(*np.unique(some, return_counts=True))
            assert len(s.counts) <= s.capacity
        values, counts = np.unique(items, return_counts=True)
        assert s.error < least and set(values[counts >= least]) <= set(s.frequent(least))
        true = dict(zip(values, counts))
        assert all(c <= true[h] <= c + s.error for h, c in zip(s.hashes, s.counts))


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, None)], SCHEMA)) == []


def test_sql_form():
    duckdb = pytest.importorskip("duckdb")
    import pyarrow as pa

    rows, con = odd_rows(), duckdb.connect()
    con.register("documents", pa.table({"lang": pa.array([r[0] for r in rows], pa.string()), "text": pa.array([r[1] for r in rows], pa.string())}))
    assert sorted(con.execute(C.OP11_SQL).fetchall()) == brute(rows)
