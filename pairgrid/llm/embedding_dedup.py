"""Operator 12: near-duplicate embeddings by randomised-rotation binary codes.

Equal vectors are one class from the start. Classes gather in balls: a ball has a centre
and only members within half of the threshold angle of it, so all its members are linked
to one another and a large group of near copies costs no pairs. Vectors choose centres
in a few rounds of hash buckets, each time the centre that most vectors of the bucket
have. Two balls are compared when members of theirs meet in one of several tables of
cross-polytope hashes; the number of tables follows from ``MISS``, the chance that a
pair exactly at the threshold meets in none.

Each centre is stored as a code: the signs of its rotated unit vector, the factor
<code, vector> that makes the inner product with a code unbiased once divided by it, and
the rotated vector in four bits a dimension as the other side of a product. Counting the
common bits of code and bit planes estimates the cosine both ways, and ``EPS`` standard
deviations above the estimate is the bound: pairs whose bound stays below the cosine
that their balls' radii call for are dropped, all others are computed exactly in double
precision. If the centres' angle decides for all members (all linked, or none), it is
done; else each member is measured against the other centre, and only members that this
leaves open are compared with the other ball's members, in blocks.

Defined results: vectors that are null or empty, hold null or non-finite components, or
are all zero are linked to nothing; vectors of different lengths are not linked; equal
rows and rows that share an id are separate vectors; a null id is never a component's
smallest id unless there is no other, and its row is not kept; an empty table gives an
empty result; other columns are ignored. Links at the threshold exactly are missed with
a probability of about 1e-4 (``MISS`` and twice the tail beyond ``EPS``), closer ones
less; links that are reported are exact.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, small_side, table
from .graph import components

THRESHOLD = 0.9
MISS, EPS = 1e-4, 4.5
#: Random directions of a cross-polytope hash, vectors of one bucket that are to be expected by chance, rounds of choosing centres.
DIRECTIONS, LOAD, ROUNDS = 64, 64, 4
#: Members of a bucket or ball that are compared as one block; pairs that are held at a time.
BLOCK, PAIRS = 1024, 1 << 20
PLANES, SEED = 4, 5_417
#: Radians by which a ball must clear a bound: beyond the rounding of an arc cosine.
CLEAR = 1e-7


# --- vectors and codes --------------------------------------------------------------

def _unit(rows: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors as doubles) of the valid rows, by length."""
    lengths = np.asarray(rows.value_lengths().fill_null(0))
    flat, offsets = rows.values, np.asarray(rows.offsets)[:-1]
    null = np.asarray(flat.is_null())
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")))
    bad = np.concatenate([[0], np.cumsum(null | ~np.isfinite(values))])
    ok = (lengths > 0) & (bad[offsets + lengths] == bad[offsets])
    out = []
    for n in np.unique(lengths[ok]):
        at = np.flatnonzero(ok & (lengths == n))
        v = values[offsets[at][:, None] + np.arange(n)]
        top = np.abs(v).max(1)
        at, v, top = at[top > 0], v[top > 0], top[top > 0]
        if len(at):
            v = v / top[:, None]
            out.append((at, v / np.sqrt((v * v).sum(1))[:, None]))
    return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) of valid stored unit vectors, by length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths, offsets, values = np.asarray(column.value_lengths()), np.asarray(column.offsets)[:-1], np.asarray(column.values)
    return [(at := np.flatnonzero(lengths == n), values[offsets[at][:, None] + np.arange(n)]) for n in np.unique(lengths)]


def _lists(v: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.ListArray:
    rows: list = [None] * n
    for at, m in v:
        for i, x in zip(at, m):
            rows[i] = x
    return pa.array(rows, pa.list_(pa.float64()))


@functools.lru_cache(4)
def _rotation(dims: int) -> np.ndarray:
    """A random rotation of the vectors, padded with zeros to whole words of 64 bits."""
    size = -(-dims // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng([SEED, dims]).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dims]


def codes(unit: np.ndarray) -> dict[str, np.ndarray]:
    """What is stored of unit vectors: ``code`` (words of signs), ``factor`` <code, vector>,
    and the four-bit form: ``planes`` (bits by weight), ``low``, ``step``, ``total``."""
    turned = unit @ _rotation(unit.shape[1])
    n, size = turned.shape
    pack = lambda bits: np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / (2**PLANES - 1), 1e-12)
    dither = np.random.default_rng([SEED, size, 1]).random(size)
    levels = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, 2**PLANES - 1).astype(np.uint8)
    planes = np.stack([pack((levels >> j & 1).astype(np.uint8)) for j in range(PLANES)], 1)
    return {"code": pack((turned > 0).astype(np.uint8)), "factor": np.abs(turned).sum(1) / math.sqrt(size),
            "planes": planes, "low": low, "step": step, "total": levels.sum(1).astype(np.int64)}


def estimate(c: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of <x_i, x_j>, the code of i against the four-bit form of j,
    and their standard deviations."""
    size = c["code"].shape[1] * 64
    code, planes = c["code"][i], c["planes"][j]
    ones = np.bitwise_count(code).sum(1, dtype=np.int64)
    common = sum((np.bitwise_count(code & planes[:, p]).sum(1, dtype=np.int64) << p) for p in range(PLANES))
    signed = c["low"][j] * (2 * ones - size) + c["step"][j] * (2 * common - c["total"][j])
    factor = c["factor"][i]
    spread = np.sqrt((1 - np.minimum(factor, 1) ** 2) / (factor**2 * max(size - 1, 1)) + (c["step"][j] / (2 * factor)) ** 2)
    return signed / math.sqrt(size) / factor, spread


# --- hashes -------------------------------------------------------------------------

@functools.lru_cache(64)
def agreement(cosine: float) -> float:
    """The probability that vectors at this cosine have the same cross-polytope hash."""
    rng = np.random.default_rng([SEED, 2])
    x, z = rng.standard_normal((2, 40_000, DIRECTIONS))
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z
    a, b, r = np.abs(x).argmax(1), np.abs(y).argmax(1), np.arange(len(x))
    return float(((a == b) & (np.sign(x[r, a]) == np.sign(y[r, b]))).mean()) * 0.98


def tables_for(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(hashes a table, tables): buckets of about LOAD unrelated rows, and enough tables."""
    depth = max(1, math.ceil(math.log(max(rows / LOAD, 1), 2 * DIRECTIONS)))
    return depth, math.ceil(math.log(miss) / math.log1p(-agreement(threshold) ** depth))


@functools.lru_cache(256)
def _directions(dims: int, k: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims, 3, k]).standard_normal((dims, DIRECTIONS)).astype(np.float32)


def _bucket(unit: np.ndarray, serial: int, depth: int) -> np.ndarray:
    """The bucket of each vector in one table: ``depth`` cross-polytope hashes in a number
    that also holds the table and the length of the vectors."""
    v, r = unit.astype(np.float32), np.arange(len(unit))
    out = np.full(len(unit), serial * 65_536 + unit.shape[1] % 65_536, np.int64)
    for k in range(depth):
        p = v @ _directions(unit.shape[1], serial * depth + k)
        a = np.abs(p).argmax(1)
        out = out * (2 * DIRECTIONS) + 2 * a + (p[r, a] > 0)
    return out


# --- tasks --------------------------------------------------------------------------

def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, embedding -> vec_id, key (digest of the unit vector, null if invalid), vec."""
    for b in batches:
        n, keys = b.num_rows, [None] * b.num_rows
        units = _unit(b.column(1).cast(pa.list_(pa.float64())))
        for at, m in units:
            for i, x in zip(at, m):
                keys[i] = hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), _lists(units, n)], ["vec_id", "key", "vec"])


def _round(serial: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = np.zeros(b.num_rows, np.int64)
            for at, m in _matrix(b.column("vec")):
                bucket[at] = _bucket(m, serial, depth)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *b.columns], ["bucket", *b.schema.names])
    return run


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((a * b).sum(1), -1, 1))


def _angles(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Angles between the vectors of two columns, row by row; infinite where the right
    one is null or has another length."""
    out = np.full(len(left), np.inf)
    a, b = np.asarray(left.value_lengths()), np.asarray(right.value_lengths().fill_null(-1))
    for n in np.unique(a[a == b]):
        at = np.flatnonzero((a == n) & (b == n))
        x, y = (np.asarray(c.values)[np.asarray(c.offsets)[:-1][at][:, None] + np.arange(n)] for c in (left, right))
        out[at] = _angle(x, y)
    return out


def _choose(half: float):
    """A vector takes the offered centre if that lies within the half angle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = _angles(b.column("vec"), b.column("top_vec"))
            take = pa.array(far <= half)
            pick = lambda new, old: pa.compute.if_else(take, b.column(new), b.column(old))
            centre = pa.array([y if t else x for x, y, t in zip(b.column("centre").to_pylist(), b.column("top_vec").to_pylist(), far <= half)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("vec"), b.column("copies"), b.column("least"), pick("top", "ball"), centre,
                                              pa.compute.if_else(take, pa.array(far), b.column("far"))], ["key", "vec", "copies", "least", "ball", "centre", "far"])
    return run


def _entries(depth: int, tables: int):
    """vec, ball -> (bucket, ball) for every table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, m in _matrix(b.column("vec")):
                ball = b.column("ball").take(pa.array(at))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(_bucket(m, ROUNDS + t, depth)), ball], ["bucket", "ball"])
    return run


_CODE = ["code", "planes", "factor", "low", "step", "total"]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ball, radius, centre -> ball, radius and the stored code of the centre."""
    for b in batches:
        for at, m in _matrix(b.column("centre")):
            c, at = codes(m), pa.array(at)
            blob = [pa.array([x.tobytes() for x in np.ascontiguousarray(c[k])], pa.binary()) for k in _CODE[:2]]
            yield pa.RecordBatch.from_arrays([b.column("ball").take(at), b.column("radius").take(at), *blob, *(pa.array(c[k]) for k in _CODE[2:])], ["ball", "radius", *_CODE])


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by integer columns as tables of whole runs of equal keys, at least
    ``least`` rows where there are more, with the number of each row's run."""
    held: list[pa.RecordBatch] = []

    def numbered(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            v = np.asarray(t.column(k).combine_chunks())
            change[1:] |= v[1:] != v[:-1]
        return np.cumsum(change)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= least:
            t = pa.Table.from_batches(held)
            run = numbered(t)
            end = int(np.searchsorted(run, run[-1]))
            if end:
                yield t.slice(0, end), run[:end]
                held = t.slice(end).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            yield t, numbered(t)


def _pairs(run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j of equal run, PAIRS or few more at a time."""
    held, count, longest = [], 0, int(np.bincount(run).max())
    for d in range(1, longest):
        i = np.flatnonzero(run[d:] == run[:-d])
        held.append((i, i + d))
        count += len(i)
        if count >= PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, count = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _meet(threshold: float):
    """Entries sorted by cell -> pairs of balls (a < b) that the codes cannot rule out."""
    limit = math.acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cell in whole_runs(batches, ["bucket", "i", "j"]):
            t = t.combine_chunks()
            ball = t.column("ball").to_pylist()
            radius, i, j, part = (np.asarray(t.column(k)) for k in ("radius", "i", "j", "part"))
            words = np.array([len(x) for x in t.column("code").to_pylist()])
            for width in np.unique(words):  # a cell has vectors of one length
                rows = np.flatnonzero(words == width)
                some = pa.array(rows)
                c = {k: np.asarray(t.column(k).take(some)) for k in _CODE[2:]}
                c["code"] = np.frombuffer(b"".join(t.column("code").take(some).to_pylist()), np.uint64).reshape(len(rows), -1)
                c["planes"] = np.frombuffer(b"".join(t.column("planes").take(some).to_pylist()), np.uint64).reshape(len(rows), PLANES, -1)
                names, r, p, split = [ball[k] for k in rows], radius[rows], part[rows], (i != j)[rows]
                for x, y in _pairs(np.unique(cell[rows], return_inverse=True)[1]):
                    other = ~split[x] | (p[x] != p[y])  # pairs within a part meet in its own cell
                    x, y = x[other], y[other]
                    need = np.cos(np.minimum(limit + r[x] + r[y] + CLEAR, math.pi))
                    for turn in (False, True):  # the code of either side
                        value, spread = estimate(c, y, x) if turn else estimate(c, x, y)
                        keep = value + EPS * spread >= need
                        x, y, need = x[keep], y[keep], need[keep]
                    found = {(min(names[u], names[v]), max(names[u], names[v])) for u, v in zip(x, y)}
                    if found:
                        a, b = zip(*found)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
    return run


def _decide(threshold: float):
    """Pairs of balls with their centres -> a, b, verdict: 1 all linked, 0 open."""
    limit = math.acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ca, cb = b.column("a_centre"), b.column("b_centre")
            angle = _angles(ca, cb)
            reach = np.asarray(b.column("a_radius")) + np.asarray(b.column("b_radius"))
            single = np.asarray(b.column("a_radius")) + np.asarray(b.column("b_radius")) == 0
            cosine = np.full(b.num_rows, -2.0)
            for n in np.unique(np.asarray(ca.value_lengths())[single]):
                at = np.flatnonzero(single & (np.asarray(ca.value_lengths()) == n) & (np.asarray(cb.value_lengths()) == n))
                x, y = (np.asarray(c.values)[np.asarray(c.offsets)[:-1][at][:, None] + np.arange(n)] for c in (ca, cb))
                cosine[at] = (x * y).sum(1)
            every = np.where(single, cosine >= threshold, angle + reach <= limit - CLEAR)
            none = np.where(single, cosine < threshold, angle - reach > limit + CLEAR)
            at = pa.array(np.flatnonzero(~none))
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at), pa.array(every[~none].astype(np.int32))], ["a", "b", "verdict"])
    return run


def _measure(threshold: float):
    """Members against the centre of an open ball -> key, ball, other, linked (null: open), vec."""
    limit = math.acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angle, radius = _angles(b.column("vec"), b.column("centre")), np.asarray(b.column("radius"))
            every, none = angle + radius <= limit - CLEAR, angle - radius > limit + CLEAR
            at = pa.array(np.flatnonzero(~none))
            linked = pa.array(np.asarray(b.column("size")), mask=~every).take(at)
            yield pa.RecordBatch.from_arrays([b.column("key").take(at), b.column("ball").take(at), b.column("other").take(at), linked, b.column("vec").take(at)],
                                             ["key", "ball", "other", "linked", "vec"])
    return run


def _compare(threshold: float):
    """Cells of open members (side 0) and members of the other ball (side 1) -> key, ball,
    other, linked: the exact number of linked vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cell in whole_runs(batches, ["cell", "i", "j"], 2 * BLOCK):
            for k in np.unique(cell):
                c = t.filter(pa.array(cell == k)).combine_chunks()
                side, other = np.asarray(c.column("side")), np.array(c.column("other").to_pylist(), object)
                for name in set(other):  # cells are hashes of the ball
                    left, right = (np.flatnonzero((other == name) & (side == s)) for s in (0, 1))
                    if not len(left) or not len(right):
                        continue
                    y = np.stack(c.column("vec").take(pa.array(right)).to_pylist())
                    x = np.stack(c.column("vec").take(pa.array(left)).to_pylist())
                    linked = ((x @ y.T >= threshold) * np.asarray(c.column("copies"))[right]).sum(1)
                    some = pa.array(left[linked > 0])
                    yield pa.RecordBatch.from_arrays([c.column("key").combine_chunks().take(some), c.column("ball").combine_chunks().take(some), c.column("other").combine_chunks().take(some), pa.array(linked[linked > 0].astype(np.int64))],
                                                     ["key", "ball", "other", "linked"])
    return run


# --- plan ---------------------------------------------------------------------------

def _balls(classes: DataFrame, threshold: float, depth: int) -> DataFrame:
    """Each class (key, vec, copies, least) with its ball: ball, centre, far (angle)."""
    m = classes.select("key", "vec", "copies", "least", F.col("key").alias("ball"), F.col("vec").alias("centre"), F.lit(0.0).alias("far"))
    plain = "key binary, vec array<double>, copies long, least long, ball binary, centre array<double>, far double"
    plain = plain.replace("least long", f"least {classes.schema['least'].dataType.simpleString()}")
    for serial in range(ROUNDS):
        m = m.mapInArrow(_round(serial, depth), f"bucket long, {plain}")
        counts = m.groupBy("bucket", "ball").agg(F.count("*").alias("n"), F.max("centre").alias("centre"))
        top = counts.groupBy("bucket").agg(F.max(F.struct("n", "ball", "centre")).alias("t"), F.sum("n").alias("all"))
        top = top.where("all > 1").select("bucket", F.col("t.ball").alias("top"), F.col("t.centre").alias("top_vec"))
        m = m.join(top, "bucket", "left").withColumn("top_vec", F.when(F.col("top") != F.col("ball"), F.col("top_vec")))
        m = materialize(m.mapInArrow(_choose(math.acos(threshold) / 2 - CLEAR), plain), "embedding-balls")
    return m


def _in_blocks(rows: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """Rows of split buckets go to one cell for each pair of parts: columns part, i, j."""
    r = rows.join(small_side(sizes), keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    r = r.withColumn("part", F.pmod(F.xxhash64("ball"), F.col("parts")).cast("int"))
    r = r.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    return r.withColumns({"i": F.least("part", "with"), "j": F.greatest("part", "with")}).drop("parts", "with")


def link(embeddings: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, ball (a digest; members of one are linked to
    one another), for every row: see the head of the module."""
    spark = embeddings.sparkSession
    n = partitions(spark)
    kind = embeddings.schema[id_col].dataType.simpleString()
    source = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = source.mapInArrow(_prepare, f"vec_id {kind}, key binary, vec array<double>")
    rows = materialize(rows, "embedding-rows")
    classes = rows.where("key is not null").groupBy("key").agg(F.max("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = materialize(classes, "embedding-classes")
    depth, tables = tables_for(classes.count(), threshold)
    members = _balls(classes, threshold, depth)
    balls = members.groupBy("ball").agg(F.sum("copies").alias("size"), F.count("*").alias("classes"), F.max("far").alias("radius"), F.max("centre").alias("centre"), F.min("least").alias("least"))
    balls = materialize(balls, "embedding-centres")

    entries = materialize(members.select("vec", "ball").mapInArrow(_entries(depth, tables), "bucket long, ball binary").distinct(), "embedding-entries")
    full = entries.groupBy("bucket").agg(F.count("*").alias("n"))
    busy = materialize(full.where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "embedding-buckets")
    entries = entries.join(full.where("n > 1").select("bucket"), "bucket", "left_semi")
    coded = balls.select("ball", "radius", "centre").mapInArrow(_encode, "ball binary, radius double, code binary, planes binary, factor double, low double, step double, total long")
    cells = _in_blocks(entries, ["bucket"], busy).join(coded, "ball")
    cells = cells.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    cells = cells.select("bucket", "i", "j", "part", "ball", "radius", *_CODE)
    met = cells.mapInArrow(_meet(threshold), "a binary, b binary").distinct()

    for side in ("a", "b"):
        met = met.join(balls.select(F.col("ball").alias(side), F.col("centre").alias(f"{side}_centre"), F.col("radius").alias(f"{side}_radius")), side)
    decided = materialize(met.select("a", "b", "a_centre", "b_centre", "a_radius", "b_radius").mapInArrow(_decide(threshold), "a binary, b binary, verdict int"), "embedding-pairs")
    sure = decided.where("verdict = 1")
    two_ways = lambda d: d.select(F.col("a").alias("ball"), F.col("b").alias("other")).union(d.select(F.col("b").alias("ball"), F.col("a").alias("other")))
    by_ball = two_ways(sure).join(balls.select(F.col("ball").alias("other"), "size"), "other").groupBy("ball").agg(F.sum("size").alias("outside"))

    open_to = two_ways(decided.where("verdict = 0")).join(balls.select(F.col("ball").alias("other"), "centre", "radius", "size"), "other")
    measured = members.select("key", "vec", "ball").join(open_to, "ball").select("key", "ball", "other", "vec", "centre", "radius", "size")
    measured = materialize(measured.mapInArrow(_measure(threshold), "key binary, ball binary, other binary, linked long, vec array<double>"), "embedding-open")
    exact = _exact(measured.where("linked is null"), members, balls, threshold, n)
    by_class = materialize(measured.where("linked is not null").select("key", "ball", "other", "linked").union(exact), "embedding-exact")

    edges = sure.select("a", "b").union(by_class.select(F.least("ball", "other"), F.greatest("ball", "other"))).distinct()
    labels = components(edges, "embedding-component").withColumnRenamed("node", "ball")
    joined = balls.select("ball", "size", "least").join(labels, "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = joined.join(least, "component").join(by_ball, "ball", "left").select("ball", "component_id", (F.col("size") - 1 + F.coalesce("outside", F.lit(0))).alias("inside"))

    own = by_class.groupBy("key").agg(F.sum("linked").alias("linked"))
    per_class = members.select("key", "ball").join(joined, "ball").join(own, "key", "left")
    per_class = per_class.select("key", "ball", "component_id", (F.col("inside") + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "key").join(per_class, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"), F.hex("ball").alias("ball"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), "ball")


def _exact(left: DataFrame, members: DataFrame, balls: DataFrame, threshold: float, n: int) -> DataFrame:
    """Open members (key, ball, other, vec) against all members of the other ball, by
    blocks of both: key, ball, other, linked."""
    left = left.select("key", "ball", "other", "vec")
    wide = left.groupBy("other").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("lefts"))
    wide = wide.join(balls.select(F.col("ball").alias("other"), F.ceil(F.col("classes") / BLOCK).cast("int").alias("rights")), "other")
    at = lambda parts: F.pmod(F.xxhash64("key"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    x = left.join(wide, "other").withColumn("i", at("lefts")).withColumn("j", each("rights")).select("key", "ball", "other", "vec", F.lit(0).alias("copies"), F.lit(0).alias("side"), "i", "j")
    y = members.select("key", F.col("ball").alias("other"), "vec", "copies").join(wide, "other").withColumn("j", at("rights")).withColumn("i", each("lefts"))
    y = y.select("key", F.lit(None).cast("binary").alias("ball"), "other", "vec", "copies", F.lit(1).alias("side"), "i", "j")
    cells = x.union(y).withColumn("cell", F.xxhash64("other")).repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = cells.mapInArrow(_compare(threshold), "key binary, ball binary, other binary, linked long")
    return found.groupBy("key", "ball", "other").agg(F.sum("linked").alias("linked"))


def op12_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return link(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


OP12_SQL = f"""
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e,
           embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
    FROM embeddings),
linked AS (
    SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e)
    WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (
    SELECT r AS node, r AS other FROM v
    UNION
    SELECT reach.node, linked.b FROM reach JOIN linked ON reach.other = linked.a),
least AS (
    SELECT reach.node, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.other GROUP BY 1),
degree AS (
    SELECT a AS node, count(*) AS n FROM linked GROUP BY 1)
SELECT v.vec_id, coalesce(degree.n, 0)::BIGINT AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.node = v.r LEFT JOIN degree ON degree.node = v.r
"""
