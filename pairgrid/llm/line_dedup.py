"""Operator 2: line deduplication by winnowing.

The hashes of a document's non-blank lines are winnowed: of every ``window``
consecutive lines the smallest hash (the first one on ties) is a fingerprint, so two
runs of at least ``window`` equal lines share one. Fewer lines count by their words:
for every size below ``window`` the runs of that size with more than ``words`` words
in all are winnowed in the same way, so equal ones share a fingerprint of that size.
Positions are joined by fingerprint; where one occurs more than once, the match is
extended to both sides over the runs that the fingerprint stands for. A line goes when
it lies in a run (of ``window`` lines, or of fewer with more than ``words`` words) that
also starts earlier (smaller id, or earlier in the same document); runs are judged on
the input, so the first copy always stays whole.

Rows of one fingerprint (or one window) are never gathered: they are aggregated by a
salt of the document's id and text to a count or a least place, only that one small
row per salt meets the others, and it is joined back to the positions by salt.

Defined results: lines are compared without blanks around them, blank lines are
neither compared nor removed, words are what blanks separate; a null text stays null
and has no lines; short documents have the runs that they have room for; documents that share an id are ordered by
a hash of their text, and equal rows are one document (all keep or lose the same
lines); empty tables give empty results; other columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, materialize, table

WINDOW, WORDS, SALTS = 3, 50, 64
#: Rows of an Arrow batch whose texts and lines are Python objects at a time.
ROWS = 256
BLANKS = " \t\r\x0b\x0c"
WORD = re.compile(f"[^{BLANKS}]+")


def _units(text: str | None) -> tuple[list[str], list[int]]:
    """Lines of a text and the places of those that are not blank."""
    lines = text.split("\n") if text else []
    return lines, [i for i, line in enumerate(lines) if line.strip(BLANKS)]


def winnow(hashes: list[int], window: int) -> list[tuple[int, int, int]]:
    """(place of the fingerprint, first and last window it stands for), in order."""
    out: list[list[int]] = []
    best = -1
    for j in range(len(hashes) - window + 1):
        if best < j:
            best = min(range(j, j + window), key=hashes.__getitem__)
        elif hashes[j + window - 1] < hashes[best]:
            best = j + window - 1
        if out and out[-1][0] == best:
            out[-1][2] = j
        else:
            out.append([best, j, j])
    return [tuple(x) for x in out]


def _long_runs(sizes: list[int], w: int, words: int) -> set[int]:
    """Starts of the runs of ``w`` lines with more than ``words`` words; ``sizes``: words by line."""
    return {j for j in range(len(sizes) - w + 1) if sum(sizes[j:j + w]) > words}


def _fingerprints(window: int, words: int):
    kind = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, ROWS):
            take, prints, lengths, ats, nears, offsets = [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                lines, units = _units(text)
                own = [lines[u].strip(BLANKS) for u in units]
                signed = np.array([xxhash.xxh3_64_intdigest(line.encode()) for line in own], dtype=np.uint64).astype(np.int64).tolist()
                sizes = [len(WORD.findall(line)) for line in own]
                for w in range(1, window + 1):
                    some = None if w == window else _long_runs(sizes, w, words)
                    for best, first, last in winnow(signed, w) if some is None or some else ():
                        at = [j - first for j in range(first, last + 1) if some is None or j in some]
                        if at:
                            take.append(i)
                            prints.append(signed[best])
                            lengths.append(w)
                            ats.append(first)
                            nears.append(signed[first:last + w])
                            offsets.append(at)
            rows = pa.array(take, pa.int64())
            cols = [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x, t) for x, t in zip((prints, lengths, ats, nears, offsets), kind))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "key", "print", "w", "at", "near", "ks"])
    return run


def _key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def repeated_windows(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, key (hash of the text), starts: the runs that also begin earlier, each as
    (number of its first unit) * (window + 1) + its number of units; only documents
    that have some."""
    rows = df.select(F.col(id_col).alias("id"), _key(text_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    prints = rows.mapInArrow(_fingerprints(window, words), f"id {kind}, key long, print long, w int, at int, near array<long>, ks array<int>")
    # exact copies differ in their ids alone, so the salt is of both
    prints = prints.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int"))
    # join positions: fingerprints of one size that occur more than once
    counts = prints.groupBy("print", "w", "salt").agg(F.count(F.lit(1)).alias("n"))
    often = (counts.withColumn("n", F.sum("n").over(Window.partitionBy("print", "w"))).where("n > 1")
             .select(F.col("print").alias("_print"), F.col("w").alias("_w"), F.col("salt").alias("_salt")))
    same = (F.col("print") == F.col("_print")) & (F.col("w") == F.col("_w")) & (F.col("salt") == F.col("_salt"))
    shared = materialize(prints.join(often, same, "left_semi"), "line-prints")
    # extend: the runs on both sides that hold the fingerprint
    runs = (shared.select("id", "key", "salt", "w", "at", "near", F.explode("ks").alias("k"))
            .select(F.slice("near", F.col("k") + 1, F.col("w")).alias("run"), "salt",
                    F.struct("id", "key", ((F.col("at") + F.col("k")).cast("long") * (window + 1) + F.col("w")).alias("start")).alias("place")))
    least = runs.groupBy("run", "salt").agg(F.min("place").alias("least"))
    least = least.select(F.col("run").alias("_run"), F.col("salt").alias("_salt"), F.min("least").over(Window.partitionBy("run")).alias("first"))
    later = (runs.join(least, (F.col("run") == F.col("_run")) & (F.col("salt") == F.col("_salt")))
             .where("NOT place <=> first").select("place.*"))
    return later.groupBy("id", "key").agg(F.collect_set("start").alias("starts"))


def _cut(window: int, text_at: int):
    """Rows with the runs' starts and sizes as their last column -> the text without those runs, and counts in its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, ROWS):
            *cols, starts = batch.columns
            kept, counts = [], []
            for text, own in zip(cols[text_at].to_pylist(), starts.to_pylist()):
                lines, units = _units(text)
                gone = sorted({j // (window + 1) + k for j in own or () for k in range(j % (window + 1))})
                runs = sum(a + 1 != b for a, b in zip([-2, *gone], gone))
                if gone:
                    places = {units[u] for u in gone}
                    text = "\n".join([line for i, line in enumerate(lines) if i not in places])
                kept.append(text)
                counts.append((len(units), len(gone), runs))
            cols[text_at] = pa.array(kept, pa.string())
            cols += [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])
    return run


def dedup_lines(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The columns of ``df`` with the text without its repeated runs, and after them
    three counts: lines that are not blank, lines removed, runs removed. They are
    named ``n_lines``, ``n_removed`` and ``n_runs`` whatever ``df`` holds, so that a
    table with such columns has them twice; ``df.columns`` come first."""
    names, kinds = df.columns, [f.dataType.simpleString() for f in df.schema.fields]
    later = repeated_windows(df, window, id_col, text_col, words).select("id", "key", "starts")
    docs = df.toDF(*[f"c{i}" for i in range(len(names))])
    i, t = names.index(id_col), names.index(text_col)
    key = _key(f"c{t}")
    both = docs.join(later.hint("shuffle_hash"), docs[f"c{i}"].eqNullSafe(later["id"]) & (key == later["key"]), "left")
    out = both.select(*docs.columns, "starts").mapInArrow(
        _cut(window, t), ", ".join(f"c{k} {kind}" for k, kind in enumerate([*kinds, *["long"] * 3])))
    return out.toDF(*names, "n_lines", "n_removed", "n_runs")


def op2_winnow_lines(spark, sf_dir):
    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed", "n_runs", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"),
                    F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = """
WITH line AS (
  SELECT doc_id, l, i, trim(l, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS t
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
unit AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS u FROM line WHERE t <> ''),
sized AS (SELECT *, len(regexp_extract_all(t, '[^ \\t\\r\\v\\f]+')) AS n FROM unit),
near AS (SELECT doc_id, u, t, n, lead(t) OVER w AS t2, lead(n) OVER w AS n2, lead(t, 2) OVER w AS t3 FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY u)),
win AS (
  SELECT doc_id, u, 3 AS k, row_number() OVER (PARTITION BY t, t2, t3 ORDER BY doc_id, u) AS nth FROM near WHERE t3 IS NOT NULL
  UNION ALL
  SELECT doc_id, u, 2 AS k, row_number() OVER (PARTITION BY t, t2 ORDER BY doc_id, u) AS nth FROM near WHERE t2 IS NOT NULL AND n + n2 > 50
  UNION ALL
  SELECT doc_id, u, 1 AS k, row_number() OVER (PARTITION BY t ORDER BY doc_id, u) AS nth FROM near WHERE n > 50),
gone AS (SELECT DISTINCT doc_id, unnest(range(u, u + k)) AS u FROM win WHERE nth > 1),
cut AS (SELECT doc_id, i FROM gone JOIN unit USING (doc_id, u)),
kept AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS s FROM line ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id),
runs AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN before IS NULL OR before <> u - 1 THEN 1 ELSE 0 END) AS r
         FROM (SELECT doc_id, u, lag(u) OVER (PARTITION BY doc_id ORDER BY u) AS before FROM gone) GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n FROM unit GROUP BY doc_id)
SELECT d.doc_id, coalesce(total.n, 0)::BIGINT AS n_lines, coalesce(runs.n, 0)::BIGINT AS n_removed, coalesce(runs.r, 0)::BIGINT AS n_runs,
       length(coalesce(s, ''))::BIGINT AS kept_chars, sha256(coalesce(s, '')) AS kept_sha256
FROM documents d LEFT JOIN total USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
