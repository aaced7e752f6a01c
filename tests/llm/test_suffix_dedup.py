"""Operator 1 against a dictionary of all windows."""

import random

import numpy as np

from pairgrid.llm import suffix_dedup as S


def brute(docs, length):
    """docs: (id, text) in order."""
    seen, out = set(), []
    for d, text in docs:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                gone[p:p + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, kept))
    return sorted(out, key=str)


def fixture():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdé ", k=rnd.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(30) for _ in range(6)]
    docs = []
    for i in range(80):
        parts = [text(rnd.randrange(25))]
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            cut = rnd.randrange(len(p) // 2)
            parts += [p[cut:] if rnd.random() < .5 else p, text(rnd.randrange(6))]
        docs.append((i, " ".join(parts)))
    docs += [(100, docs[7][1]), (101, docs[7][1][:-1] + "!"), (102, None), (103, ""), (104, "z" * 900), (105, "z" * 99), (106, "ab" * 300),
             (107, "y" * 100), (108, passages[0]), (109, docs[9][1]), (109, docs[9][1]), (109, passages[1] * 3)]
    return [(None, passages[2]), *docs[:-3], *sorted(docs[-3:], key=lambda x: x[1])]


def test_against_brute_force(spark, monkeypatch):
    docs = fixture()
    rows = [(d, t, "x", 1) for d, t in docs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, gram int").repartition(3)
    for length in (100, 40, 64, 33):
        got = sorted([tuple(r[:4]) + (bytes(r[4]),) for r in S.dedup_substrings(df, length).collect()], key=str)
        assert got == brute(docs, length), length


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 300)
    rnd = random.Random(8)
    a = bytes(rnd.choices(b"abc", k=2000))
    texts = [a, a[500:1500], b"q" * 700]
    owned = {}
    for h, doc, start, n, place, joined in S._chunks(texts, 100):
        for k in range(len(h)):
            for j in range(n[k]):
                at = (int(doc[k]), int(start[k]) + j)
                assert at not in owned and joined[place[k] + j:place[k] + j + 100] == texts[at[0]][at[1]:at[1] + 100]
                owned[at] = (int(h[k]), texts[at[0]][at[1]:at[1] + 100])
    assert len(owned) == sum(len(t) - 99 for t in texts)
    assert len(set(owned.values())) == len({w for _, w in owned.values()})  # equal windows have equal grams


def test_refine():
    rnd = random.Random(2)
    data = np.frombuffer(bytes(rnd.choices(b"ab", k=3000)), np.uint8)
    starts = np.arange(0, 2890)
    for length in (33, 64, 100):
        b = S.refine(data, starts, length)
        text = data.tobytes()
        pairs = {(int(x), text[s:s + length]) for x, s in zip(b, starts)}
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_empty(spark):
    assert S.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_grams_are_split(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for length in (100, 40):
        assert sorted([tuple(r[:4]) + (bytes(r[4]),) for r in S.dedup_substrings(df, length).collect()], key=str) == brute(docs, length), length

    # a phrase of 60 bytes between ever different text
    rnd = random.Random(4)
    other = lambda: "".join(rnd.choices("abcdefghijklmnop", k=90))
    phrase = other()[:60]
    docs = [(i, f"{other()}{phrase}{other()}") for i in range(300)]
    whole = S._repeats

    def checked(length):
        run = whole(length)

        def bounded(batches):
            held = list(batches)
            distinct = {(g, x) for b in held for g, x in zip(b.column(0).to_pylist(), b.column(6).to_pylist()) if x}
            grams = [g for g, _ in distinct]
            assert all(grams.count(g) <= 3 for g in set(grams)), "surroundings of a hot gram in one bucket"
            return run(iter(held))
        return bounded
    monkeypatch.setattr(S, "_repeats", checked)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted([tuple(r[:4]) + (bytes(r[4]),) for r in S.dedup_substrings(df).collect()], key=str) == brute(docs, 100)
