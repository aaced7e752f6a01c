"""Operator 9 against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from pairgrid.llm import jaccard_join as J
from pairgrid.llm.graph import components


def words(t):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(J._LOWER))


def shingle_set(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, threshold=0.8):
    """docs: (id, text) -> sorted (id, class_id, n_links, n_copies)."""
    classes = {}
    for d, t in docs:
        classes.setdefault(tuple(words(t)), []).append((d, t))
    keys = [k for k in classes if k]
    sets = {k: shingle_set(classes[k][0][1]) for k in keys}
    near = {k: set() for k in keys}
    for a, b in combinations(keys, 2):
        inter = len(sets[a] & sets[b])
        if inter >= threshold * len(sets[a] | sets[b]) - 1e-9:
            near[a].add(b), near[b].add(a)
    group = {}
    for k in keys:
        if k not in group:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = k
                    todo += near[x]
    least = {}
    for k in keys:
        for d, _ in classes[k]:
            old = least.get(group[k])
            least[group[k]] = d if old is None else old if d is None else min(old, d)
    out = []
    for d, t in docs:
        k = tuple(words(t))
        out.append((d, least[group[k]], len(near[k]), len(classes[k])) if k else (d, d, 0, sum((x[0], x[1] or "") == (d, t or "") for x in docs)))
    return sorted(out, key=str)


def fixture():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(300)] + ["été", "ñ", "日本"]
    docs = []
    for g in range(25):
        base = rnd.choices(vocab, k=rnd.randrange(3, 120))
        for _ in range(rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            docs.append(" ".join(w) if rnd.random() < .8 else " ".join(base).upper().replace("É", "é").replace("Ñ", "ñ") + ".")
    docs = list(enumerate(docs))
    return docs + [(None, docs[3][1]), (900, None), (901, ""), (901, None), (902, "--- !!"), (903, docs[5][1]), (903, docs[5][1]), (904, "one"), (905, "One!"),
                   (906, "a b c d"), (907, "a b c d e"), (908, "x " * 3000), (909, "x " * 40), (None, "only here and only once it is")]


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(d, t, "n", 1, "k") for d, t in docs], "doc_id long, text string, node string, block int, key string").repartition(parts)


@pytest.mark.parametrize("block", [1024, 3])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "NEAR_BLOCK", block)
    docs = fixture()
    rows = J.join(frame(spark, docs)).collect()
    got = sorted([(r["id"], r["class_id"], r["n_links"], r["n_copies"]) for r in rows for _ in range(r["n_rows"])], key=str)
    assert got == brute(docs)


def test_keep_one(spark):
    docs = fixture()
    df = frame(spark, docs)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    want = {(d, t) for d, t in docs if not words(t)} | {(c, None) for _, c, _, _ in brute([x for x in docs if words(x[1])]) if c is not None}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, got)) == sorted([str(d) for d, t in docs if not words(t)]
                                           + [str(c) for c in {c for _, c, _, _ in brute([x for x in docs if words(x[1])])}])
    assert want


def test_words_and_shingles():
    texts = [t.encode() for t in ["A b, c d e f", "", "!!", "one", "é b c d e f", "a b c d e f"]]
    w, n = J.word_hashes(texts)
    assert n.tolist() == [6, 0, 0, 1, 6, 6] and (w[:6] == w[-6:]).all() and w[7] != w[0]
    h, k = J.shingles(w, n)
    assert k.tolist() == [2, 0, 0, 1, 2, 2] and (h[:2] == h[-2:]).all()
    keys = J._sequence_keys(w, n)
    assert (keys[0] == keys[5]).all() and (keys[0] != keys[4]).all()


def test_depth_meets_recall():
    d = J.matched_depth()
    assert 1 - (1 - .8**d) ** J.TREES >= J.RECALL and (d == J.DEPTH or 1 - (1 - .8**(d + 1)) ** J.TREES < J.RECALL)


def test_common_shingles():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 60, n).astype(np.uint64)) for n in (5, 20, 40, 1)]
    got = J.common_shingles(sets[:2], sets)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:2]]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60) if i % 20] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(a != b and x in (a, b) for a, b in edges)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(none).collect() == [] and J.keep_one(none).collect() == []
