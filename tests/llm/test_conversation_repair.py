"""Operator 13 against a plain dynamic program over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from pairgrid.llm import conversation_repair as R

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, damaged=True):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20 if damaged else 19
        kept = convs[conv]
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        kept += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return {conv: _one(kept) for conv, kept in convs.items()}


def _one(kept):
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:16], r[2][:16], hashlib.md5(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
    turns = [t for t, _, _ in kept if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in kept:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}  # forward: state -> (cost, audit, output)

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserts(table):
        for _ in range(4):
            for state, (c, a, out) in list(table.items()):
                for role in ("user", "assistant"):
                    if role[0] in step[state]:
                        better(table, step[state][role[0]], (c + 3, a + "I", (*out, (role, ""))))
        return table

    inserts(best)
    for (_, role, text), fault in zip(kept, faults):
        new = {}
        for state, (c, a, out) in best.items():
            better(new, state, (c + 4, a + "D", out))
            if fault not in "bd":
                extra = 3 if fault == "t" else 0
                if role[:1] and role[:1] in step[state]:
                    better(new, step[state][role[0]], (c + extra, a + "K", (*out, (role, text))))
                for to in ("user", "assistant"):
                    if to[0] in step[state]:
                        better(new, step[state][to[0]], (c + 3 + extra, a + "R", (*out, (to, text))))
        best = inserts(new)
    cost, audit, out = min(best[s] for s in ("", "a") if s in best)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha


def got(df, damaged=True):
    out = R.digests(R.repair(df, damaged)).collect()
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r["conv_id"]: tuple(r)[1:] for r in out}


def odd_rows(n, seed=3):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "unknown", "s"]
    texts = ["Yes.", "No", "", None, " \t\x0b", "Well!", "é?", "a\nb.", "..", "Yes. ", "\x00"]
    return [(rng.choice([None, 1, 2, 3, 4, 5, -7]) if rng.random() < .7 else rng.randrange(40), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got(df) == brute(rows)


@pytest.mark.parametrize("rows", [4, 512])
def test_odd_rows_in_parts_of_any_size(spark, monkeypatch, rows):
    """Nulls, ties, repeats and long conversations; parts of few rows join as whole ones do."""
    monkeypatch.setattr(R, "ROWS", rows)
    monkeypatch.setattr(R, "_cut", _with_rows(rows))
    data = odd_rows(500) + [(9, t, "user" if t % 2 else "assistant", f"line {t}.") for t in range(80)] * 2
    df = spark.createDataFrame(data, SCHEMA)
    want = brute(data)
    assert got(df) == want
    assert got(df, damaged=False) == brute(data, damaged=False)
    extra = df.selectExpr("1 as cost", "role", "'x' as conv", "text", "2 as part", "turn", "conv_id", "'y' as audit")
    assert got(extra.repartition(5)) == want


def _with_rows(rows):
    """The workers import the module anew, so the part size travels with the function."""
    cut = R._cut

    def run(batches):
        R.ROWS = rows
        return cut(batches)
    return run


def test_agenda_against_all_edit_strings():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(5)
        initials, faults = "".join(rng.choices("suat", k=n)), [rng.randrange(4) for _ in range(n)]
        best = None
        for length in range(n + 4):
            for audit in map("".join, itertools.product("DIKR", repeat=length)):
                value = _price(audit, initials, faults)
                if value is not None and (best is None or (value, audit) < best):
                    best = (value, audit)
        assert R.edits(initials, faults, R.ACCEPTING, [0])[0] == best
        for at in range(n + 1):
            assert R.whole(R.join_spans(R.spans(initials[:at], faults[:at]), R.spans(initials[at:], faults[at:]))) == best


def _price(audit, initials, faults):
    if sum(e != "I" for e in audit) != len(initials):
        return None
    row = cost = 0
    out = ""
    for e in audit:
        fault = faults[row] if e != "I" else 0
        if e != "D" and fault in (1, 2):
            return None
        need = "u" if not out or out[-1] in "sa" else "a"
        out += {"D": "", "K": initials[row] if e == "K" else ""}.get(e, need)
        cost += {"D": 4, "K": 0, "R": 3, "I": 3}[e] + (3 if fault == 3 and e in "KR" else 0)
        row += e != "I"
    return cost if re.fullmatch("(s?(ua)+)?", out) else None


def test_outputs_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Yes.")], SCHEMA)
    parts = sorted(R.repair(df, damaged=False).collect(), key=lambda r: r["part"])
    assert ("".join(r["edits"] for r in parts), sum((r["roles"] for r in parts), []), sum((r["texts"] for r in parts), [])) == ("KR", ["user", "assistant"], ["Hi.", "Yes."])
    assert [r["last"] for r in parts] == [False] * (len(parts) - 1) + [True] and {r["cost"] for r in parts} == {3}
    none = spark.createDataFrame([], SCHEMA)
    assert got(none) == {}
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert got(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
