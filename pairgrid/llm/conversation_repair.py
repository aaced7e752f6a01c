"""Operator 13: cheapest repair of conversations by Knuth's lightest derivations.

A conversation is legal when the initials of its roles form ``(s?(ua)+)?``. Repair
items are weighted deductions: item (row, state) stands for "the rows from here on can
be repaired from this grammar state", its value is (cost, audit), and each edit deduces
an item from the item behind it by putting its letter before the audit. The agenda pops
the least (cost, rows covered, audit): every edit raises the cost or the rows covered,
so the functions are superior, and putting a letter in front keeps the order of equal
covers, so they are monotone; the first pop of an item is its lightest derivation and
the search ends when the goal item is popped.

A conversation may hold a third of all rows, so no task needs a whole one. The damaged
rows are range-partitioned by (conversation, turn, ...) and cut into parts of at most
``ROWS`` rows or ``CHARS`` characters. A conversation of one part is solved at once. For
the others every part yields its 16 span items (state in, state out), and spans that
adjoin are joined by binary deductions in pairs of equal size, as a binary counter does;
repeats across parts are found by a grouped minimum of text digests. The repaired turns
come out part by part, in order; a digest folds over that stream. What one task must
hold of a long conversation is its audit (a byte a row, which the result holds as well).

Defined results: null conversation ids are one conversation; a null role or text is one
space; null turns come first; rows of one turn are ordered by the first 16 characters of
the role, of the text, then by the MD5 of both (equal rows are interchangeable); every
given conversation has a result, also if all its rows are dropped; an empty table gives
an empty result; other columns are ignored. Roles count by their first character.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, partitions, small_side, table

#: Largest part of a conversation: rows, and characters of text (one longer row is a part).
ROWS, CHARS = 512, 4_000_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FINE, BLANK, REPEATED, CUT = range(4)
#: Grammar of legal role initials: state, initial -> state; 0 start, 1 after s, 2 after u, 3 after a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ACCEPTING = 4, (0, 3)
#: The role that an edit (insert, rerole) can write in each state.
WRITES = {0: "user", 1: "user", 2: "assistant", 3: "user"}
LEGAL_PAIRS = ("su", "ua", "au")
_SOLID = re.compile(r"[^\x20\x09-\x0D]")


# --- the agenda ---------------------------------------------------------------------

def lightest(axioms: Iterable[tuple], deduce: Callable, goals: set) -> dict:
    """Knuth's algorithm: item -> (cost, covered, audit) of its lightest derivation, for
    the items popped until all ``goals`` are. ``axioms`` are (value, item); ``deduce(item,
    value, final)`` yields the (value, item) that superior functions derive from a
    finalised item, together with others in ``final`` where they need them."""
    agenda, final, open_goals = list(axioms), {}, set(goals)
    heapq.heapify(agenda)
    while agenda and open_goals:
        value, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        open_goals.discard(item)
        for derived in deduce(item, value, final):
            if derived[1] not in final:
                heapq.heappush(agenda, derived)
    return final


def _into(state: int) -> list[tuple[str, int]]:
    return [(x, q) for (q, x), to in STEPS.items() if to == state]


_INTO = [_into(q) for q in range(STATES)]


def edits(initials: str, faults: Iterable[int], exits: Iterable[int], goals: Iterable[int]) -> dict:
    """state -> (cost, audit): the lightest repair of these rows that begins in the
    state (one of ``goals``) and ends in one of ``exits``."""
    faults, n = list(faults), len(initials)

    def deduce(item, value, _):
        row, state = item
        cost, covered, audit = value
        for x, q in _INTO[state]:
            if x != "s":
                yield (cost + INSERT, covered, "I" + audit), (row, q)
        if row:
            yield (cost + DELETE, covered + 1, "D" + audit), (row - 1, state)
            fault = faults[row - 1]
            if fault not in (BLANK, REPEATED):
                extra = TRUNCATED if fault == CUT else 0
                for x, q in _INTO[state]:
                    if x == initials[row - 1]:
                        yield (cost + KEEP + extra, covered + 1, "K" + audit), (row - 1, q)
                    if x != "s":
                        yield (cost + REROLE + extra, covered + 1, "R" + audit), (row - 1, q)

    found = lightest([((0, 0, ""), (n, q)) for q in exits], deduce, {(0, q) for q in goals})
    return {q: (found[0, q][0], found[0, q][2]) for q in goals if (0, q) in found}


def spans(initials: str, faults: Iterable[int]) -> dict:
    """(state in, state out) -> (cost, audit) for one part of a conversation."""
    return {(q, out): v for out in range(STATES) for q, v in edits(initials, faults, [out], range(STATES)).items()}


def join_spans(left: dict, right: dict) -> dict:
    """Spans of two adjoining parts as one. Equal spans hold equally many row letters, so
    no audit of equal cost is a proper prefix of another and joining keeps their order."""
    out: dict = {}
    for (q, mid), (c1, a1) in left.items():
        for end in range(STATES):
            if (mid, end) in right:
                c2, a2 = right[mid, end]
                if (q, end) not in out or (c1 + c2, a1 + a2) < out[q, end]:
                    out[q, end] = (c1 + c2, a1 + a2)
    return out


def whole(span: dict) -> tuple[int, str]:
    return min(span[0, q] for q in ACCEPTING if (0, q) in span)


def repaired(audit: str, roles: list, texts: list, state: int = 0) -> tuple[list, list, int]:
    """Roles and texts after the edits, and the state behind them."""
    new_roles, new_texts, row = [], [], 0
    for edit in audit:
        if edit == "D":
            row += 1
            continue
        if edit == "I":
            role, text = WRITES[state], ""
        else:
            role, text = (roles[row] if edit == "K" else WRITES[state]), texts[row]
            row += 1
        new_roles.append(role)
        new_texts.append(text)
        state = STEPS[state, role[:1]]
    return new_roles, new_texts, state


# --- rows and parts -----------------------------------------------------------------

def _fault(text: str) -> int:
    if not _SOLID.search(text):
        return BLANK
    return FINE if text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else CUT


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _faults(roles: list, texts: list, again: Iterable[int] = ()) -> list[int]:
    """The first fault of each row; ``again``: rows seen in an earlier part."""
    seen, out, again = set(), [], set(again or ())
    for i, (role, text) in enumerate(zip(roles, texts)):
        fault = _fault(text)
        if fault != BLANK:
            key = _digest(role, text)
            if i in again or key in seen:
                fault = REPEATED
            seen.add(key)
        out.append(fault)
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the rows after damage by
    crc32(conv_id:turn) % 20 (0 drops, 1 empties, 2 takes out ``[.!?]``, 3 repeats, 4
    makes user); a dropped row stays as a marker, so that its conversation is known."""
    c = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    c = c.withColumn("kind", F.crc32(F.encode(name, "UTF-8")) % 20)
    c = c.withColumn("role", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")))
    c = c.withColumn("text", F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    c = c.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return c.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("dropped"))


_PARTS = "conv string, part long, roles array<string>, texts array<string>, turns array<long>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> parts. Parts are numbered by partition and place, so they are
    ordered within a conversation that runs over several partitions."""
    serial = TaskContext.get().partitionId() << 40
    now, rows, chars = None, [], 0
    done: list[tuple] = []

    def close():
        nonlocal rows, chars, serial
        roles, texts, turns = (list(x) for x in zip(*rows)) if rows else ([], [], [])
        done.append((now, serial, roles, texts, turns))
        rows, chars, serial = [], 0, serial + 1

    def batch():
        out = [pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())))]
        done.clear()
        return pa.RecordBatch.from_arrays(out, ["conv", "part", "roles", "texts", "turns"])

    held = 0
    for b in batches:
        for conv, turn, role, text, dropped in zip(*(c.to_pylist() for c in b.columns)):
            if now is not None and (conv != now or len(rows) >= ROWS or rows and chars + len(text) > CHARS):
                held += chars
                close()
                if held > CHARS or len(done) >= 2000:
                    yield batch()
                    held = 0
            now = conv
            if not dropped:
                rows.append((role, text, turn))
                chars += len(text)
    if now is not None:
        close()
    if done:
        yield batch()


def parts(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped) as one row per part of a conversation:
    conv ('n' or 'v' and the id), part (ascending), roles, texts, turns."""
    n = partitions(rows.sparkSession)
    conv = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    r = rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", "dropped")
    # Equal rows are told apart by a serial number, so that no conversation, turn or text is one partition.
    order = ["conv", "turn", "r16", "t16", "both", "serial"]
    r = r.withColumns({"r16": F.substring("role", 1, 16), "t16": F.substring("text", 1, 16), "both": F.md5(F.concat_ws("\x00", F.col("role"), F.col("text"))), "serial": F.monotonically_increasing_id()})
    r = r.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return r.select("conv", "turn", "role", "text", "dropped").mapInArrow(_cut, _PARTS)


# --- solving ------------------------------------------------------------------------

_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_OUT = f"conv string, part long, last boolean, {_STATS}, edits string, roles array<string>, texts array<string>"
_NAMES = [x.split()[0] for x in _OUT.replace(", ", ",").split(",")]
_ARROW = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]


def _out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], _NAMES)


def _counts(initials: str, faults: list[int], turns: list) -> dict:
    known = [t for t in turns if t is not None]
    return {"faults": [sum(f == k for f in faults) for k in (BLANK, REPEATED, CUT)],
            "illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:])),
            "least": known[0] if known else None, "most": known[-1] if known else None,
            "turns": sum(a != b for a, b in zip(known, known[1:])) + bool(known)}


def _initials(roles: list[str]) -> str:
    """First characters; an empty role is NUL, which no step has."""
    return "".join(r[:1] or "\x00" for r in roles)


def _gaps(c: dict) -> int:
    return 0 if c["least"] is None else c["most"] - c["least"] + 1 - c["turns"]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one part each."""
    for b in batches:
        done = []
        for conv, roles, texts, turns in zip(*(b.column(c).to_pylist() for c in ("conv", "roles", "texts", "turns"))):
            initials, faults = _initials(roles), _faults(roles, texts)
            cost, audit = edits(initials, faults, ACCEPTING, [0])[0]
            c = _counts(initials, faults, turns)
            done.append((conv, 0, True, _gaps(c), *c["faults"], c["illegal"], cost, audit, *repaired(audit, roles, texts)[:2]))
        if done:
            yield _out(done)


def _texts_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, part, row, digest) of each part's first non-blank (role, text)."""
    for b in batches:
        out = []
        for conv, part, roles, texts in zip(*(b.column(c).to_pylist() for c in ("conv", "part", "roles", "texts"))):
            out += [(conv, part, i, _digest(roles[i], texts[i])) for i, f in enumerate(_faults(roles, texts)) if f in (FINE, CUT)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.binary()))], ["conv", "part", "row", "digest"])


_SPAN = "array<struct<q:int,out:int,cost:long,audit:string>>"
_SUMMED = f"conv string, part long, kind int, counts array<long>, initials string, least long, most long, span {_SPAN}, roles array<string>, texts array<string>"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part as a summary (kind 0) and as its turns (kind 1)."""
    span_type = pa.list_(pa.struct([("q", pa.int32()), ("out", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    types = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int64(), span_type, pa.list_(pa.string()), pa.list_(pa.string())]
    names = ["conv", "part", "kind", "counts", "initials", "least", "most", "span", "roles", "texts"]
    for b in batches:
        out = []
        for conv, part, roles, texts, turns, again in zip(*(b.column(c).to_pylist() for c in ("conv", "part", "roles", "texts", "turns", "again"))):
            initials, faults = _initials(roles), _faults(roles, texts, again)
            c = _counts(initials, faults, turns)
            span = [{"q": q, "out": o, "cost": v[0], "audit": v[1]} for (q, o), v in spans(initials, faults).items()]
            out.append((conv, part, 0, [*c["faults"], c["illegal"], c["turns"]], initials[:1] + initials[-1:], c["least"], c["most"], span, None, None))
            out.append((conv, part, 1, None, None, None, None, None, roles, texts))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)


class _Long:
    """A conversation of several parts, while its summaries and then its parts stream by."""

    def __init__(self, conv: str):
        self.conv, self.stack, self.counts = conv, [], [0] * 5
        self.initial, self.least, self.most = "", None, None
        self.audit, self.at, self.state = None, 0, 0

    def add(self, counts, initials, least, most, span) -> None:
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        if initials and self.initial and self.initial + initials[0] not in LEGAL_PAIRS:
            self.counts[3] += 1
        self.initial = initials[-1:] or self.initial
        if least is not None:
            self.counts[4] -= least == self.most
            self.least, self.most = least if self.least is None else self.least, most
        self.stack.append((1, {(s["q"], s["out"]): (s["cost"], s["audit"]) for s in span}))
        while len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            self._join()

    def _join(self) -> None:
        (n2, right), (n1, left) = self.stack.pop(), self.stack.pop()
        self.stack.append((n1 + n2, join_spans(left, right)))

    def finish(self) -> None:
        self.parts = sum(n for n, _ in self.stack)
        while len(self.stack) > 1:
            self._join()
        self.cost, self.audit = whole(self.stack.pop()[1])
        c = {"least": self.least, "most": self.most, "turns": self.counts[4]}
        self.stats = (_gaps(c), *self.counts[:4], self.cost)

    def take(self, part: int, roles: list, texts: list) -> tuple:
        """The next part's share of the audit, with inserts before its rows (the last part
        takes those behind its rows as well)."""
        if self.audit is None:
            self.finish()
        self.parts -= 1
        end, rows = self.at, 0
        while end < len(self.audit) and rows < len(roles):
            rows += self.audit[end] != "I"
            end += 1
        end = end if self.parts else len(self.audit)
        share, self.at = self.audit[self.at:end], end
        new_roles, new_texts, self.state = repaired(share, roles, texts, self.state)
        return (self.conv, part, not self.parts, *self.stats, share, new_roles, new_texts)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries, then parts, of each conversation in order -> repaired parts."""
    now: _Long | None = None
    for b in batches:
        done = []
        for conv, part, kind, counts, initials, least, most, span, roles, texts in zip(*(c.to_pylist() for c in b.columns)):
            now = _Long(conv) if now is None or now.conv != conv else now
            if kind == 0:
                now.add(counts, initials, least, most, span)
            else:
                done.append(now.take(part, roles, texts))
        if done:
            yield _out(done)


def repair(conversations: DataFrame, damaged: bool = True) -> DataFrame:
    """The repaired conversations, one row per part: conv_id, part, last (its last part),
    gaps, blank, duplicate, truncated, illegal, cost (of the whole conversation, on each
    part), edits (letters D, I, K, R), roles, texts (of the repaired turns).

    The parts of a conversation follow one another in one partition, so a fold over the
    partition (``digests``) reads whole conversations. ``damaged=False`` repairs the rows
    as they are."""
    kind = conversations.schema["conv_id"].dataType
    if damaged:
        rows = damage(conversations)
    else:
        rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(False).alias("dropped"))
    p = materialize(parts(rows), "conversation-parts")
    several = materialize(p.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv", F.lit(True).alias("several")), "conversation-long")
    p = p.join(small_side(several), "conv", "left")
    single = p.where("several is null").select("conv", "roles", "texts", "turns").mapInArrow(_solve, _OUT)
    many = p.where("several").drop("several")
    seen = many.select("conv", "part", "roles", "texts").mapInArrow(_texts_seen, "conv string, part long, row int, digest binary")
    first = seen.groupBy("conv", "digest").agg(F.min("part").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = seen.join(first, ["conv", "digest"]).where("part > first").groupBy("part").agg(F.collect_list("row").alias("again"))
    summed = many.join(again, "part", "left").select("conv", "part", "roles", "texts", "turns", "again").mapInArrow(_summed, _SUMMED)
    long = summed.repartition(partitions(p.sparkSession), "conv").sortWithinPartitions("conv", "kind", "part").mapInArrow(_walk, _OUT)
    conv_id = F.when(F.col("conv") != "n", F.expr("substring(conv, 2)")).cast(kind).alias("conv_id")
    return single.union(long).select(conv_id, *_NAMES[1:])


def _fold(kind: pa.DataType) -> Callable:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, audit, begun = hashlib.sha256(), [], False
        for b in batches:
            done = []
            for conv, _, last, *stats, share, roles, texts in zip(*(c.to_pylist() for c in b.columns)):
                audit.append(share)
                for role, text in zip(roles, texts):
                    sha.update(("\n" * begun + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    begun = True
                if last:
                    done.append((conv, *stats, "".join(audit), sha.hexdigest()))
                    sha, audit, begun = hashlib.sha256(), [], False
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names)

    return fold


def digests(repaired_parts: DataFrame) -> DataFrame:
    """One row per conversation: its counts, the whole audit and the SHA-256 of its
    repaired ``role:text`` lines, folded over the parts as they stream by."""
    kind = repaired_parts.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, {_STATS}, audit string, repaired_sha256 string"
    return repaired_parts.mapInArrow(_fold(to_arrow_type(kind)), schema)


def op13_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule and repaired at the least cost."""
    return digests(repair(table(spark, sf_dir, "conversations")))
