"""Operator 8: document fingerprints as invertible Bloom lookup tables (DataFrame
functions only).

A text's paragraphs (lines, long ones cut at sentence ends) are digested to 64 bits. Each distinct digest goes into one cell of each of three subtables; a cell
holds a count and the exclusive-or of its digests and of their check values. The
fingerprint is such a table of ``3 * CELLS`` cells. Two fingerprints subtract cell by
cell, and peeling cells that hold one digest recovers the digests of either side that
differ. Where that fails, the residual counts estimate the size of the difference,
and larger tables are tried: the digests are dealt by their bits into groups of one or
two differing ones, each with a table of its own that starts with one cell a subtable
and is doubled where it fails, up to ``MOST``. (Groups beyond that have chance below
1e-9; they are compared digest by digest.) Likeness is the Jaccard similarity of the two
digest sets, from their sizes and the size of the difference.

Neighbours in the order of ids are found in ranges of ids: each range also gets the
first document of the following one, so the texts are shuffled once and no window
spans the table.

Defined results: a null text is empty; two texts without paragraphs have likeness 1;
rows that share an id follow in the order of a hash of their text, null ids come
last; one document is its own neighbour; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table

#: Cells of each of the three subtables of a fingerprint, and of the largest group table.
CELLS, MOST = 4, 64
#: Pieces of text that are digested: within a line, 120 characters or more up to a sentence end, 300 at most.
PIECE = r"[^\n]{1,120}+[^.!?\n]{0,180}+[.!?\n ]*+|\n++"
#: Bits of a digest: 6 for the cell in each subtable from 0 on; for groups from 20 and from 40 on.
GROUP_BITS, MAJOR, MINOR = 20, 20, 40


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _bits(key: Column, at: int, mask) -> Column:
    return F.shiftrightunsigned(key, at).bitwiseAND(mask)


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1)).bitwiseAND(0xFFFFFFFF)


def _into(sign: int):
    def add(s, k):
        return F.struct((s["n"] + sign).alias("n"), s["k"].bitwiseXOR(k).alias("k"), s["c"].bitwiseXOR(_check(k)).alias("c"))
    return add


def sketch(keys: Column, cells: int, but: Column | None = None) -> Column:
    """Array of 3 * cells structs (n, k, c): ``keys`` put in, those of ``but`` taken out."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))

    def subtable(at: int) -> Column:
        def made(i):
            own = lambda k: _bits(k, at, cells - 1) == i
            full = F.aggregate(F.filter(keys, own), zero, _into(1))
            return full if but is None else F.aggregate(F.filter(but, own), full, _into(-1))
        return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), made)
    return F.concat(*[subtable(6 * j) for j in range(3)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"),
                                                  x["c"].bitwiseXOR(y["c"]).alias("c")))


def _pure(x: Column) -> Column:
    return F.when(F.abs(x["n"]) == 1, x["c"] == _check(x["k"])).otherwise(False)


def peel(table_: Column, cells: int, steps: Column) -> Column:
    """struct(t: what is left of a subtracted table, found: recovered structs (k, n), n
    being 1 for digests of the first text and -1 for those of the second)."""
    empty = F.array().cast("array<struct<k:bigint,n:int>>")
    start = F.struct(table_.alias("t"), empty.alias("found"))

    def step(s, _):
        def remove(one):
            """one: what to take out, or nulls."""
            kept = F.transform(s["t"], lambda x, i: F.when((i == one["x"]) | (i == one["y"]) | (i == one["z"]), _less(x, one)).otherwise(x))
            return F.when(one["k"].isNull(), s).otherwise(
                F.struct(kept.alias("t"), F.concat(s["found"], F.array(F.struct(one["k"].alias("k"), one["n"].alias("n")))).alias("found")))

        def placed(pure):
            at = [(_bits(pure["k"], 6 * j, cells - 1) + j * cells).alias("xyz"[j]) for j in range(3)]
            return _let(F.struct(pure["k"].alias("k"), pure["n"].alias("n"), _check(pure["k"]).alias("c"), *at), remove)
        return _let(F.get(F.filter(s["t"], _pure), F.lit(0)), placed)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, step)


def _less(x: Column, p: Column) -> Column:
    return F.struct((x["n"] - p["n"]).alias("n"), x["k"].bitwiseXOR(p["k"]).alias("k"), x["c"].bitwiseXOR(p["c"]).alias("c"))


def _done(peeled: Column) -> Column:
    return F.forall(peeled["t"], lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0))


def _listed(a: Column, b: Column) -> Column:
    one = lambda arr, n: F.transform(arr, lambda k: F.struct(k.alias("k"), F.lit(n).alias("n")))
    return F.concat(one(F.array_except(a, b), 1), one(F.array_except(b, a), -1))


def _groups(keys: Column, major: Column, minor: Column) -> Column:
    """Digests dealt into major * minor groups: first by some bits, then by others."""
    row = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    return F.flatten(F.transform(row(major), lambda g: _let(
        F.filter(keys, lambda k: _bits(k, MAJOR, major - 1) == g),
        lambda own: F.transform(row(minor), lambda h: F.filter(own, lambda k: _bits(k, MINOR, minor - 1) == h)))))


def with_differences(df: DataFrame, pairs: list[tuple[str, str, str, str]], out: str) -> DataFrame:
    """``df`` with ``out``, an array of (p, k, n): digests of only one text of pair p, n = 1
    for the first and -1 for the second. pairs: columns (digests, table, digests, table).

    The steps are columns of their own: each is computed once and for all pairs.
    """
    c = F.col
    found_type, todo_type = "array<struct<p:int,k:bigint,n:int>>", "array<struct<p:int,a:array<bigint>,b:array<bigint>>>"
    none, nothing = F.array().cast(found_type), F.array().cast(todo_type)
    tag = lambda p, arr: F.transform(arr, lambda f: F.struct(p.alias("p"), f["k"].alias("k"), f["n"].alias("n")))
    df = df.withColumns({f"_left{p}": subtract(c(at), c(bt)) for p, (_, at, _, bt) in enumerate(pairs)})
    # more than three digests in the mean cell: not worth a try
    df = df.withColumns({f"_peeled{p}": F.when(F.aggregate(f"_left{p}", F.lit(0), lambda s, x: s + F.abs(x["n"])) <= 9 * CELLS,
                                               peel(c(f"_left{p}"), CELLS, F.lit(3 * CELLS))) for p in range(len(pairs))})
    df = df.withColumns({f"_ok{p}": F.coalesce(_done(c(f"_peeled{p}")), F.lit(False)) for p in range(len(pairs))})

    def doublings(p: int) -> Column:
        """Groups, as a power of two, for one or two differing digests in each. The counts
        of a cell are sums of signs, so their squared distance from the mean adds up to
        about (1 - 1 / CELLS) times the size of the difference in each subtable."""
        a, _, b, _ = pairs[p]
        more = F.size(a) - F.size(b)
        squares = F.aggregate(f"_left{p}", F.lit(0), lambda s, x: s + x["n"] * x["n"]) / 3 - more * more / CELLS
        size = F.least(F.size(a) + F.size(b), F.greatest(squares * (CELLS / (CELLS - 1)), F.abs(more)))
        return F.least(F.ceil(F.log2(F.greatest(size / 2, F.lit(1.0)))), F.lit(2 * GROUP_BITS)).cast("double")

    power = lambda x: F.pow(F.lit(2.0), x).cast("long")
    df = df.withColumns({f"_by{p}": doublings(p) for p in range(len(pairs))})
    df = df.withColumns({f"_side{p}": F.struct(power(F.floor(c(f"_by{p}") / 2)).alias("x"), power(F.ceil(c(f"_by{p}") / 2)).alias("y"))
                         for p in range(len(pairs))})
    dealt = lambda p, side: _groups(c(pairs[p][side]), c(f"_side{p}.x"), c(f"_side{p}.y"))
    groups = lambda p: F.zip_with(dealt(p, 0), dealt(p, 2), lambda x, y: F.struct(F.lit(p).alias("p"), x.alias("a"), y.alias("b")))
    df = df.withColumns({
        "_found": F.concat(none, *[F.when(c(f"_ok{p}"), tag(F.lit(p), c(f"_peeled{p}.found"))).otherwise(none) for p in range(len(pairs))]),
        "_todo": F.concat(nothing, *[F.when(c(f"_ok{p}"), nothing).otherwise(groups(p)) for p in range(len(pairs))])})
    cells = 1
    while cells <= MOST:
        tried = F.transform("_todo", lambda g: F.struct(g["p"].alias("p"), g["a"].alias("a"), g["b"].alias("b"), peel(
            sketch(g["a"], cells, g["b"]), cells, F.least(F.size(g["a"]) + F.size(g["b"]), F.lit(3 * cells))).alias("peeled")))  # noqa: B023
        df = df.withColumn("_tried", tried)
        df = df.withColumns({
            "_found": F.concat("_found", F.flatten(F.transform(F.filter("_tried", lambda r: _done(r["peeled"])), lambda r: tag(r["p"], r["peeled"]["found"])))),
            "_todo": F.transform(F.filter("_tried", lambda r: ~_done(r["peeled"])), lambda r: F.struct(r["p"].alias("p"), r["a"].alias("a"), r["b"].alias("b")))})
        cells *= 2
    listed = F.flatten(F.transform("_todo", lambda g: tag(g["p"], _listed(g["a"], g["b"]))))
    scratch = ["_found", "_todo", "_tried", *[f"_{x}{p}" for x in ("left", "peeled", "ok", "by", "side") for p in range(len(pairs))]]
    return df.withColumn(out, F.concat("_found", listed)).drop(*scratch)


def likeness(a_keys: Column, b_keys: Column, differing: Column) -> Column:
    """Jaccard similarity from the sizes of two sets and of their difference."""
    both = F.size(a_keys) + F.size(b_keys)
    return F.when(both == 0, 1.0).otherwise((both - differing) / (both + differing)).cast("double")


def encoded(keys: Column, table_: Column) -> Column:
    """A fingerprint as text: number of digests, then the cells."""
    cells = F.transform(table_, lambda x: F.concat_ws(".", F.hex(x["n"]), F.hex(x["k"]), F.hex(x["c"])))
    return F.concat_ws(":", F.size(keys).cast("string"), F.array_join(cells, "-"))


def with_next(docs: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``docs`` (id, key and others) with ``name``: ``value`` of the next row by
    descending id (null ids last), then key; after the last row that of the first."""
    spark = docs.sparkSession
    n = max(2, 2 * partitions(spark))
    cuts = docs.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    k = len(set(cuts))
    # binary search for the number of cuts that are not over the id
    search = lambda s, _: _let(F.floor((s["lo"] + s["hi"]) / 2).cast("int"), lambda m: F.when(s["lo"] >= s["hi"], s).when(
        bounds[m] <= F.col("id"), F.struct((m + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"))))
    start = F.struct(F.lit(0).alias("lo"), F.lit(k).alias("hi"))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(k.bit_length() + 1)), start, search)["lo"]
    # null ids: 64 ranges of the key's top bits
    late = (F.shiftright("key", 58) + 32 + k + 1).cast("int")
    docs = docs.withColumn("_none", F.col("id").isNull()).withColumn("_down", F.coalesce(F.bitwise_not("id"), F.lit(0).cast("long")))
    docs = docs.withColumn("_range", F.when(F.col("_none"), late).otherwise(F.lit(k) - place))
    key = ["_none", "_down", "key"]
    heads = docs.groupBy("_range").agg(F.min(F.struct(*key)).alias("h")).select("_range", "h.*")
    by_range = Window.orderBy("_range")  # a row for each range
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("_none").alias("_n"), F.col("_down").alias("_d"), F.col("key").alias("_k"),
                         F.coalesce(F.lag("_range").over(by_range), F.max("_range").over(whole)).alias("_to"))
    # at most one row for each range
    both = docs.join(F.broadcast(heads), (docs["_none"] == heads["_n"]) & (docs["_down"] == heads["_d"]) & (docs["key"] == heads["_k"]), "left")
    copies = F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("g")))).otherwise(
        F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("g")), F.struct(F.col("_to").alias("r"), F.lit(True).alias("g"))))
    rows = both.withColumn("_c", F.explode(copies)).withColumn("_range", F.col("_c.r")).withColumn("_ghost", F.col("_c.g"))
    w = Window.partitionBy("_range").orderBy("_ghost", *key)
    return rows.withColumn(name, F.lead(value).over(w)).where("not _ghost").select(*order, name)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keys (digests), cells, fingerprint of every whole text."""
    d = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("keys", digests(F.col("_text")))
    d = d.withColumn("cells", sketch(F.col("keys"), CELLS))
    return d.select(id_col, "keys", "cells", encoded(F.col("keys"), F.col("cells")).alias("fingerprint"))


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against its edited form (the last half of its characters replaced by
    the first as many of the next document) and against the next document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    d = d.withColumn("keys", digests(F.col("text"))).withColumn("cells", sketch(F.col("keys"), CELLS))
    d = with_next(d, ["id", "text", "keys", "cells"], F.struct("text", "keys", "cells"), "next")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.left("text", n - half), F.left("next.text", half)))
    d = d.select("id", "n_chars", "edited", "keys", "cells", F.col("next.keys").alias("nkeys"), F.col("next.cells").alias("ncells"))
    d = d.withColumn("ekeys", digests(F.col("edited"))).withColumn("ecells", sketch(F.col("ekeys"), CELLS))
    d = with_differences(d, [("keys", "cells", "ekeys", "ecells"), ("keys", "cells", "nkeys", "ncells")], "differ")
    c = F.col
    count = lambda p: F.size(F.filter("differ", lambda x: x["p"] == p))
    return d.select(c("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), encoded(c("keys"), c("cells")).alias("fingerprint"),
                    encoded(c("ekeys"), c("ecells")).alias("edited_fingerprint"),
                    likeness(c("keys"), c("ekeys"), count(0)).alias("near_edited"), likeness(c("keys"), c("nkeys"), count(1)).alias("near_next"))


def op8_iblt_fingerprints(spark, sf_dir):
    return edited_likeness(table(spark, sf_dir, "documents"))
