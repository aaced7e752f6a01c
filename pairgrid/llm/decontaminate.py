"""Operator 4: benchmark decontamination (DataFrame functions only).

A window is 10 consecutive words of a benchmark item (a shorter, non-empty item is
one window). Every 10-word window covers an aligned block of 5 document words, so
only those blocks are looked up in a broadcast hash set of all 5-word grams of the
windows; the document windows around a hit are then compared as whole strings.
Windows of short items are looked up at every word offset.

Defined results: null or wordless texts have no words, no hits, and are clean;
null or wordless items have no windows; items that share an id count as one, items
without an id mark words but are not listed; repeated documents are judged row by
row; empty tables give empty or clean results; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side, table

WINDOW = 10
#: Fixed value: everything that is not a word character after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased, without empty first and last pieces."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.split(low, SEPARATORS)


def trimmed(pieces: Column) -> Column:
    head = (F.element_at(pieces, 1) == "").cast("int")
    tail = (F.element_at(pieces, -1) == "").cast("int")
    return F.slice(pieces, head + 1, F.greatest(F.size(pieces) - head - tail, F.lit(0)))


def _grams(arr: Column, length: int, n: Column, step: int = 1) -> Column:
    """Array of (k, hash) of ``length``-word grams that start at k·step, 0-based."""
    count = F.floor((n - length) / step).cast("int")
    gram = lambda k: F.struct(F.lit(length).alias("length"), k.cast("int").alias("k"),
                              F.xxhash64(*[arr[(k * step).cast("int") + i] for i in range(length)]).alias("gram"))
    empty = F.array().cast("array<struct<length:int,k:int,gram:bigint>>")
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), count), gram)).otherwise(empty)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW,
                      id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """length, window (words joined by one space), items (sorted ids)."""
    w = (benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w"))
         .withColumn("w", trimmed(F.col("w"))).withColumn("n", F.size("w")).where("n > 0")
         .withColumn("length", F.least("n", F.lit(window)))
         .select("item", "w", "length", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("length") + 1)).alias("at"))
         .select("item", "length", F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("window")))
    return w.groupBy("length", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, positions (sorted word positions inside occurring windows),
    items (sorted ids of items with an occurring window), one row per document."""
    spans = materialize(benchmark_windows(benchmark, window), "windows")
    short = [r[0] for r in spans.where(F.col("length") < window).select("length").distinct().collect()]
    block = (window + 1) // 2
    full = spans.where(F.col("length") == window).select(F.split("window", " ").alias("w"))
    looked = _grams(F.col("w"), block, F.lit(window)).alias("g")
    keys = full.select(F.explode(looked).alias("g")).select(F.lit(window).alias("length"), "g.gram")
    for n in sorted(short):
        part = spans.where(F.col("length") == n).select(F.split("window", " ").alias("w"))
        keys = keys.union(part.select(F.explode(_grams(F.col("w"), n, F.lit(n))).alias("g"))
                          .select(F.lit(n).alias("length"), "g.gram"))
    keys = materialize(keys.distinct().withColumn("hit", F.lit(True)), "grams")

    # the row number tells repeated documents apart; it is made from the scan order alone
    d = (docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), words(F.col(text_col)).alias("w"))
         .withColumn("w", trimmed(F.col("w"))).withColumn("n", F.size("w")))
    start = F.array(F.struct(F.lit(0).alias("length"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("gram")))
    blocks = F.transform(_grams(F.col("w"), block, F.col("n"), block),
                         lambda g: F.struct(F.lit(window).alias("length"), g["k"].alias("k"), g["gram"].alias("gram")))
    probes = F.concat(start, blocks, *[_grams(F.col("w"), n, F.col("n")) for n in sorted(short)])
    rows = (d.select("id", "row", "n", "w", probes.alias("probes"))
            .select("id", "row", "n", "w", F.explode_outer("probes").alias("p"))
            .select("id", "row", "n", "w", "p.length", "p.k", "p.gram")
            .join(small_side(keys), ["length", "gram"], "left")
            .where((F.col("length") == 0) | F.col("hit")))
    # windows around a block: their first words lie in [from, to]
    at = F.when(F.col("length") == window, F.col("k") * block).otherwise(F.col("k"))
    lo = F.when(F.col("length") == window, F.greatest(at + block - window, F.lit(0))).otherwise(at)
    hi = F.when(F.col("length") == window, F.least(at, F.col("n") - window)).otherwise(at)
    near = (rows.withColumn("lo", lo).withColumn("hi", hi)
            .where((F.col("length") == 0) | (F.col("lo") <= F.col("hi")))
            .withColumn("near", F.when(F.col("length") > 0, F.slice("w", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("length"))))
            .select("id", "row", "n", "length", "lo", "near", F.explode_outer(F.sequence("lo", "hi")).alias("at"))
            .withColumn("window", F.array_join(F.slice("near", F.col("at") - F.col("lo") + 1, F.col("length")), " ")))
    found = near.join(small_side(spans), ["length", "window"], "left").where((F.col("length") == 0) | F.col("items").isNotNull())
    per = found.groupBy("row", "id").agg(
        F.max("n").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("length") > 0, F.struct("at", "length"))).alias("spans"),
        F.collect_set("items").alias("items"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))
    return per.select(F.col("id").alias(id_col), "n_words", F.array_sort(F.array_distinct(covered)).alias("positions"),
                      F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any hit, with their columns; of the rows that share an id only those with a hit go."""
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    own = docs.select(F.struct(docs[id_col].alias("id"), key.alias("key")).alias("own"), docs[text_col].alias("text"))
    bad = hits(own, benchmark, id_col="own").where(F.size("positions") > 0).select(F.col("own.id").alias("_bad"), F.col("own.key").alias("_key")).distinct()
    bad = materialize(bad, "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]) & (key == bad["_key"]), "left_anti")


def op4_decontaminate(spark, sf_dir):
    h = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return h.select("doc_id", "n_words", F.size("positions").cast("long").alias("n_hit"),
                    F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
                    (F.size("positions") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM (SELECT item_id, w, least(len(w), 10) AS n FROM item WHERE len(w) > 0))),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
hit AS (
  SELECT d.doc_id, d.p, win.n, win.item_id
  FROM (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
              FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)) d
  JOIN win ON win.n = d.n AND win.s = d.s),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
