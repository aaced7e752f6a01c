"""Operator 9: self join of documents on the Jaccard similarity of word shingles by a
MinHash LSH forest.

Texts with equal words are one class from the start. Each class has ``TREES`` tries;
its path in a trie is ``DEPTH`` minimum hashes. The matched prefix is shortened from
the full depth until a pair at the threshold meets in some trie with the target
recall. Sorted by prefix, the classes under one trie node stand together; those whose
whole signatures agree far enough (the threshold less about 4.5 standard deviations)
are linked in a spanning forest, so a node of n classes gives at most n - 1 rows.
Within a component of that forest all pairs are verified exactly on their shingle
sets, in blocks of at most ``BLOCK`` classes: the number of links of each class is
counted and again only a spanning forest of the links is kept.

Words are runs of ASCII letters, digits and non-ASCII bytes, with A-Z lower-cased; a
text of fewer than five words has one shingle of all its words.

Defined results: texts without words (null too) are linked to nothing and are
classes of their own; equal rows and rows that share an id are documents like others;
a class takes its smallest id (null only if it has no other); empty tables give empty
results; other columns are ignored by ``join`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, small_side, table
from .graph import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL, SLACK = 24, 6, 0.9999, 0.15
#: Classes that are compared as one block: exactly, and under a trie node; bytes of text that are hashed at a time.
BLOCK, NEAR_BLOCK, CHUNK = 1024, 8192, 1 << 19
_SIZE = TREES * DEPTH

_rng = np.random.Generator(np.random.PCG64(971))
_LETTER = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_XOR = _rng.integers(0, 2**32, _SIZE, dtype=np.uint32)
_MUL = _rng.integers(0, 2**32, _SIZE, dtype=np.uint32) | np.uint32(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def matched_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets often enough."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < recall:
        depth -= 1
    return depth


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    data = np.frombuffer(b"\n".join([t.translate(_LOWER) for t in texts]) + b"\n", np.uint8)
    inside = _WORD[data].astype(np.int8)
    step = np.diff(inside, prepend=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    total = np.r_[np.uint64(0), np.cumsum(_LETTER[data] * _powers(_BASE, len(data)))]
    words = _mix((total[end] - total[start]) * _powers(_BACK, len(data))[start] + (end - start).astype(np.uint64))
    border = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.r_[0, np.searchsorted(start, border)])


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts in order (repeats too), and how many each text has."""
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(counts.dtype))
    first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(np.minimum(counts, SHINGLE), n)
    padded = np.r_[words, np.zeros(SHINGLE, np.uint64)]
    h = width.astype(np.uint64)
    for k in range(SHINGLE):
        h = np.where(k < width, _mix(h * _BASE + padded[first + k]), h)
    return h, n


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _sequence_keys(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's word sequence."""
    place = (np.arange(len(words)) - np.repeat(_starts(counts), counts))
    most = int(counts.max(initial=1))
    full = np.flatnonzero(counts)
    out = np.zeros((len(counts), 2), np.uint64)
    for k, base in enumerate((np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))):
        terms = _mix(words + base) * _powers(base, most)[place]
        out[full, k] = _mix(np.add.reduceat(terms, _starts(counts)[full]) + counts[full].astype(np.uint64))
    return out


def _signatures(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Minimum hashes of texts that have shingles, one row each, folded to 16 bits."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    at = _starts(n)
    least = np.stack([np.minimum.reduceat((x ^ a) * b, at) for a, b in zip(_XOR, _MUL)], axis=1)
    return (least ^ (least >> np.uint32(16))).astype(np.uint16)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Binary values from the rows of a contiguous array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize if len(rows) else 0
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _unfixed(col: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1)


def _texts(batch: pa.RecordBatch, column: int):
    """Slices of a batch of about CHUNK bytes: (from, to, texts)."""
    texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= CHUNK or i == len(texts) - 1:
            yield at, i + 1, texts[at:i + 1]
            at, held = i + 1, 0


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text) -> (id, key, node, signature); no node for texts without words."""
    for batch in batches:
        for lo, hi, texts in _texts(batch, 2):
            words, counts = word_hashes(texts)
            full = np.flatnonzero(counts)
            node = np.full(hi - lo, -1)
            node[full] = np.arange(len(full))
            take = pa.array(node, mask=node < 0)
            if len(full):
                h, n = shingles(words, counts)
                nodes, sigs = _fixed(_sequence_keys(words, counts)[full]), _fixed(_signatures(h, n[full]))
            else:
                nodes = sigs = pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], nodes.take(take), sigs.take(take)],
                                             names=["id", "key", "node", "signature"])


def _paths(depth: int):
    """(node, signature) -> (bucket, node) for the trie node at that depth in each tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _unfixed(batch.column(1), np.uint16).reshape(-1, TREES, DEPTH).astype(np.uint64)
            bucket = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), sig.shape[:2])
            for k in range(depth):
                bucket = _mix(bucket * _BASE + sig[:, :, k])
            rows = np.repeat(np.arange(len(sig)), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.reshape(-1).view(np.int64)), batch.column(0).take(pa.array(rows))], names=["bucket", "node"])
    return run


def _forest(similar, n: int) -> list[tuple[int, int]]:
    """Spanning forest of 0..n-1; similar(i, others) tells which of the others are linked to i."""
    edges, rest = [], np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = similar(i, rest)
            edges += [(i, int(j)) for j in rest[hit]]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return edges


def _groups(values: list[np.ndarray]):
    """Ranges of equal values in sorted columns."""
    new = np.zeros(len(values[0]), bool)
    new[:1] = True
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    first = np.flatnonzero(new)
    return zip(first.tolist(), np.r_[first[1:], len(new)].tolist())


def _near(least: float):
    """All rows (bucket, i, j, node, signature) of some pairs of blocks of trie nodes ->
    forest of classes with like signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.sort_by([(c, "ascending") for c in ("bucket", "i", "j")])
        bucket, i, j = (rows.column(c).to_numpy() for c in ("bucket", "i", "j"))
        nodes, sigs = rows.column("node").to_pylist(), rows.column("signature")
        pairs = set()
        for lo, hi in _groups([bucket, i, j]):
            sig = _unfixed(sigs[lo:hi], np.uint16)
            for x, y in _forest(lambda k, rest: (sig[rest] == sig[k]).sum(1) >= least * _SIZE, hi - lo):
                pairs.add((nodes[lo + x], nodes[lo + y]))
        a, b = zip(*pairs) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, part, text) -> (node, part, set): sorted distinct shingle hashes."""
    for batch in batches:
        for lo, hi, texts in _texts(batch, 2):
            h, n = shingles(*word_hashes(texts))
            at = np.r_[_starts(n), len(h)]
            sets = [np.unique(h[at[i]:at[i + 1]]).tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(sets, pa.binary())], names=["node", "part", "set"])


def common_shingles(sets: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with all others, by products of 0/1
    matrices over the shingles that both sides have."""
    ids, place = np.unique(np.concatenate([*sets, *other]), return_inverse=True)
    rows = np.repeat(np.arange(len(sets) + len(other)), [len(s) for s in [*sets, *other]])
    n = len(sets)
    both = (np.bincount(place[rows < n], minlength=len(ids)) > 0) & (np.bincount(place[rows >= n], minlength=len(ids)) > 0)
    new = np.cumsum(both) - 1
    keep = both[place]
    rows, place = rows[keep], new[place[keep]]
    out = np.zeros((n, len(other)), np.float64)
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    width = max(64, 4_000_000 // (len(sets) + len(other)))
    for lo in range(0, int(both.sum()), width):
        a, b = np.searchsorted(place, [lo, lo + width])
        m = np.zeros((n + len(other), width), np.float32)
        m[rows[a:b], place[a:b] - lo] = 1
        out += m[:n] @ m[n:].T
    return np.rint(out).astype(np.int64)


def _verified(threshold: float):
    """All rows (component, i, j, side, node, set) of some pairs of blocks ->
    (a, b, links): links of a counted here (b null), and a forest of the links (links 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.sort_by([(c, "ascending") for c in ("component", "i", "j", "side", "node")])
        comp = rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        i, j, side = (rows.column(c).to_numpy() for c in ("i", "j", "side"))
        nodes, sets = rows.column("node").to_pylist(), rows.column("set")
        out: list[tuple[bytes, bytes | None, int]] = []
        for lo, hi in _groups([comp, i, j]):
            own = [np.frombuffer(x, np.uint64) for x in sets[lo:hi].to_pylist()]
            names, left = nodes[lo:hi], int((side[lo:hi] == 0).sum())
            same = i[lo] == j[lo]
            a, b = (own, own) if same else (own[:left], own[left:])
            size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
            if not len(a) or not len(b):
                continue
            inter = common_shingles(a, b)
            linked = inter >= threshold * (size_a[:, None] + size_b[None, :] - inter) - 1e-9
            if same:
                np.fill_diagonal(linked, False)
                graph = linked
            else:
                graph = np.zeros((len(own), len(own)), bool)
                graph[:left, left:], graph[left:, :left] = linked, linked.T
            links = graph.sum(1)
            out += [(names[k], None, int(links[k])) for k in np.flatnonzero(links)]
            out += [(names[x], names[y], 0) for x, y in _forest(lambda k, rest: graph[k, rest], len(own))]
        a, b, n = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "links"])
    return run


def _block_pairs(rows: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Rows with ``blocks``, the number of blocks of their group -> each pair of blocks
    (i, j) of a group gets the rows of both; side 1 are those of j where i < j."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(*group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                       (F.col("block") > F.col("other")).cast("int").alias("side"), *values)


def join(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every distinct (id, key), key being a hash of the text: class_id (smallest
    id of the linked group), head (whether it is the group's first), n_links (other texts
    at or over the threshold), n_copies (rows with equal words), n_rows (rows with this id
    and text), worded (whether it has words)."""
    spark = df.sparkSession
    p = partitions(spark)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sketched = materialize(docs.mapInArrow(_sketch, f"id {kind}, key long, node binary, signature binary"), "sketches")
    light = sketched.select("id", "key", "node")
    nodes = sketched.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"), F.count(F.lit(1)).alias("n_copies"), F.first("signature").alias("signature"))
    nodes = materialize(nodes, "classes")
    paths = nodes.select("node", "signature").mapInArrow(_paths(matched_depth(threshold, recall)), "bucket long, node binary")
    sizes = paths.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = (paths.join(sizes, "bucket").join(nodes.select("node", "signature"), "node")
              .withColumn("blocks", F.ceil(F.col("n") / NEAR_BLOCK).cast("int")))
    near = _block_pairs(shared, ["bucket"], ["node", "signature"]).drop("side")
    near = materialize(near.repartition(p, "bucket", "i", "j").mapInArrow(_near(threshold - SLACK), "a binary, b binary"), "near")
    groups = components(near, "near")
    # exact verification: blocks of classes within a component, each pair of blocks once
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    part = (groups.join(sizes, "component").join(nodes.select("node", "first"), "node")
            .select("node", F.struct("component", "blocks").alias("part"), F.col("first.id").alias("rid"), F.col("first.key").alias("rkey")))
    part = small_side(materialize(part, "parts"))
    texts = docs.join(part, docs["id"].eqNullSafe(part["rid"]) & (docs["key"] == part["rkey"]))
    sets = texts.select("node", "part", "text").mapInArrow(_sets, "node binary, part struct<component:binary,blocks:int>, set binary")
    rows = materialize(light.groupBy("id", "key", "node").agg(F.count(F.lit(1)).alias("n_rows")), "rows")
    if rows.where("n_rows > 1 and node is not null").limit(1).count():  # equal rows gave a set twice
        sets = sets.dropDuplicates(["node"])
    pairs = _block_pairs(sets.select("node", "part.*", "set"), ["component"], ["node", "set"])
    found = materialize(pairs.repartition(p, "component", "i", "j").mapInArrow(_verified(threshold), "a binary, b binary, links long"), "links")
    classes = components(found.where("b is not null").select("a", "b"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    known = (nodes.select("node", "first", "n_copies").join(classes, "node", "left").join(counts, "node", "left")
             .select("node", "first", "n_copies", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    heads = known.groupBy("component").agg(F.min("first").alias("head"))
    known = materialize(known.join(heads, "component").select("node", "head", "n_copies", "n_links"), "known")
    out = rows.join(known, "node", "left")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    return out.select("id", "key", F.coalesce("head", own)["id"].alias("class_id"), F.coalesce(F.col("head") == own, F.lit(True)).alias("head"),
                      F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", "n_rows").alias("n_copies"), "n_rows", F.col("node").isNotNull().alias("worded"))


def keep_one(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of each linked group, with all columns of ``df``."""
    names = df.columns
    docs = df.toDF(*[f"c{k}" for k in range(len(names))])
    i, t = names.index(id_col), names.index(text_col)
    heads = join(df, threshold, id_col=id_col, text_col=text_col).where("head")
    heads = materialize(heads.select("id", "key", F.when(F.col("worded"), F.col("n_rows")).otherwise(1).alias("n_rows")), "heads")
    text_key = F.xxhash64(F.coalesce(F.col(f"c{t}"), F.lit("")))
    both = docs.join(heads.hint("shuffle_hash"), docs[f"c{i}"].eqNullSafe(heads["id"]) & (text_key == heads["key"]))
    if heads.where("n_rows > 1").limit(1).count():  # of equal rows one stays
        nth = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(1)))
        both = both.withColumn("nth", nth).where("nth = 1 or n_rows = 1")
    return both.select(*docs.columns).toDF(*names)


def op9_lsh_forest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    j = join(docs).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return j.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies", "head")
