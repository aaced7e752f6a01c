"""Operator 1: exact substring deduplication by bucket-pointer refinement.

Every byte goes that is covered by a string of ``length`` bytes which also starts
earlier (smaller id, or earlier in the same document); all strings are judged on
the input.

A suffix array of the whole corpus would sort every byte position. Only suffixes
that can share ``length`` bytes with another one matter, so the positions are first
put into buckets by 32-byte grams: each window of ``length`` bytes belongs to the
smallest gram hash inside it (the first on ties), which depends on its bytes alone.
Buckets of one occurrence are final and are dropped; that takes one shuffle of
gram hashes. The other buckets are gathered with the bytes of their windows, equal
surroundings once, and refined as a bucket-pointer suffix sort does: positions are
bucketed by their first 8 bytes, then sorted by the pair (own bucket, bucket of a
later offset), and the new buckets are used for the next, twice as long, step until
they tell ``length`` bytes apart. The first window of a final bucket stays; the
others are repeats.

Documents are dealt to parts by a hash of their id. A part sends one row for each
distinct gram and each distinct surrounding, however often it holds them, so a
passage that fills a third of the corpus is a row for each part. The texts are
shuffled once; the three steps that read them share that exchange. A gram that
occurs over ``HOT`` times, a phrase between ever different text, is not one bucket:
its windows are bucketed by a digest of all their bytes, and a part sends each
distinct window once, so no gram's surroundings have to fit one task.

Defined results: a null text is empty; rows that share an id are documents in order
of their text, and of equal rows all but one count as later copies; texts shorter
than ``length`` lose nothing; a null id is the smallest; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, table

LENGTH, GRAM = 100, 32
#: Bytes that are hashed at a time, and bytes of surroundings that are refined at a time.
CHUNK, BLOCK = 1 << 18, 1 << 21
#: Occurrences beyond which a gram's windows are bucketed one by one, and bytes of their digests.
HOT, DIGEST = 10_000, 16
_PLACE = np.uint64((1 << 20) - 1)
_TABLE = np.random.Generator(np.random.PCG64(20_240_607)).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each position: hashes of two neighbours of
    half the width make one, five times over."""
    h, width = _TABLE[data], 1
    while width < GRAM:
        h = (h[:-width] ^ (h[:-width] >> np.uint64(29))) * _ODD + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    return np.minimum(keys[: len(keys) - (width - done)], keys[width - done:]) if done < width else keys


def _runs(segments: list[tuple[int, int, bytes]], length: int):
    """Runs of windows with one smallest gram, over the joined segments (document,
    place in it, bytes): gram hash, document, first window in it, number of windows,
    place of the first window in the joined bytes."""
    joined = b"".join([s[2] for s in segments])
    data = np.frombuffer(joined, np.uint8)
    hashes = gram_hashes(data)
    keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    owner = (_sliding_min(keys, length - GRAM + 1) & _PLACE).astype(np.int64)
    sizes = np.array([len(s[2]) for s in segments])
    ends = np.cumsum(sizes)
    valid = np.ones(len(owner), bool)
    for e in ends[:-1].tolist():
        valid[e - length + 1:e] = False
    at = np.flatnonzero(valid)
    own = owner[at]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    n = np.diff(np.r_[first, len(at)])
    place = at[first]
    seg = np.searchsorted(ends, place, side="right")
    doc = np.array([s[0] for s in segments])[seg]
    shift = np.array([s[1] for s in segments]) - (ends - sizes)
    return hashes[own[first]], doc, place + shift[seg], n, place, joined


def _documents(docs: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """The documents of a part in order of id and text, and their bytes."""
    docs = docs.take(pc.sort_indices(docs, [("id", "ascending"), ("text", "ascending")], null_placement="at_start"))
    return docs, [x or b"" for x in docs.column("text").cast(pa.binary()).to_pylist()]


def _chunks(texts: list[bytes], length: int):
    segments, held = [], 0
    for d, text in enumerate(texts):
        for s in range(0, len(text) - length + 1, CHUNK):
            segments.append((d, s, text[s:s + CHUNK + length - 1]))
            held += len(segments[-1][2])
            if held >= CHUNK:
                yield _runs(segments, length)
                segments, held = [], 0
    if segments:
        yield _runs(segments, length)


def _bucket(length: int):
    """A part -> its distinct grams, and how often it holds them."""
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        _, texts = _documents(docs)
        hashes = [c[0] for c in _chunks(texts, length)]
        grams, counts = np.unique(np.concatenate(hashes) if hashes else np.empty(0, np.uint64), return_counts=True)
        return pa.table({"gram": grams.view(np.int64), "part": pa.array(np.full(len(grams), key[0].as_py(), np.int32)), "times": counts})
    return run


def _occurring_twice(hot: int):
    """All rows of some grams -> (part, gram, hot) of those in more than one place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy() for c in range(3)] for b in batches]
        if held:
            gram, part, times = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(gram)
            gram, part, times = gram[order], part[order], times[order]
            start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.empty(0, int)
            n = np.diff(np.r_[start, len(gram)])
            total = np.repeat(np.add.reduceat(times, start), n) if len(gram) else times
            keep = total > 1
            yield pa.RecordBatch.from_arrays([pa.array(part[keep]), pa.array(gram[keep]), pa.array(total[keep] > hot)], names=["part", "gram", "hot"])
    return run


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of spans within each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    reach = int(end.max()) + 1
    furthest = np.maximum.accumulate(end + doc * reach) - doc * reach  # starts anew with each document
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > furthest[:-1])]
    first = np.flatnonzero(new)
    return doc[first], start[first], furthest[np.r_[first[1:], len(doc)] - 1]


def _surroundings(length: int, id_type: pa.DataType):
    """A part and its grams in question -> each distinct surrounding once (the bytes of
    a run of windows, n windows), or of a hot gram each distinct window (its digest, whose
    beginning is the gram), and the spans of their later copies (no bytes)."""
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, grams: pa.Table) -> pa.Table:
        part = key[0].as_py()
        docs, texts = _documents(docs)
        asked = grams.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(asked)
        asked, hot = asked[order], grams.column("hot").to_numpy()[order]
        seen: set[bytes] = set()
        rows: list[tuple[int, int, int, int, bytes]] = []
        spans: list[tuple[int, int, int]] = []
        for h, doc, start, n, place, joined in _chunks(texts, length) if len(asked) else ():
            at = np.searchsorted(asked, h)
            hit = np.flatnonzero(asked[np.minimum(at, len(asked) - 1)] == h)
            for g, x, d, s, k, p in zip(h[hit].view(np.int64).tolist(), hot[at[hit]].tolist(), doc[hit].tolist(), start[hit].tolist(),
                                        n[hit].tolist(), place[hit].tolist()):
                near = joined[p:p + k + length - 1]
                if x:
                    for i in range(k):
                        window = hashlib.blake2b(near[i:i + length], digest_size=DIGEST).digest()
                        if window in seen:
                            spans.append((d, s + i, s + i + length))
                        else:
                            seen.add(window)
                            rows.append((int.from_bytes(window[:8], "little", signed=True), d, s + i, 1, window))
                elif near in seen:
                    spans.append((d, s, s + len(near)))
                else:
                    seen.add(near)
                    rows.append((g, d, s, k, near))
        d, s, e = _merged(*np.array(spans, np.int64).reshape(-1, 3).T)
        spread = ((d + part).astype(np.uint64) * _ODD).view(np.int64)  # any value that spreads these rows
        own = [list(x) for x in zip(*rows)] or [[]] * 5
        doc = np.r_[np.array(own[1], np.int64), d]
        return pa.table({
            "gram": pa.array(np.r_[np.array(own[0], np.int64), spread]), "part": pa.array(np.full(len(doc), part, np.int32)),
            "id": docs.column("id").cast(id_type).take(pa.array(doc)), "doc": pa.array(doc),
            "start": pa.array(np.r_[np.array(own[2], np.int64), s]), "n": pa.array(np.r_[np.array(own[3], np.int64), e - s]),
            "near": pa.array([*own[4], *[None] * len(d)], pa.binary())})
    return run


def refine(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Bucket numbers of the ``length``-byte strings at ``starts``, equal for equal
    strings, by bucket-pointer refinement over all positions of ``data``."""
    padded = np.r_[data, np.zeros(length, np.uint8)]
    n = len(data)
    key = np.zeros(n, np.uint64)
    for k in range(8):  # the first buckets: 8-byte grams in byte order
        key = (key << np.uint64(8)) | padded[k:k + n]
    bucket = np.unique(key, return_inverse=True)[1].astype(np.int64)
    known = 8
    while known < length:
        step = min(known, length - known)
        later = bucket[np.minimum(np.arange(n) + step, n - 1)]
        if known + step >= length:  # the last step sorts the windows alone
            return np.unique(bucket[starts] * n + later[starts], return_inverse=True)[1]
        bucket = np.unique(bucket * n + later, return_inverse=True)[1].astype(np.int64)
        known += step
    return bucket[starts]


def _later_windows(near: list[bytes], n: np.ndarray, length: int):
    """Surroundings in order -> (which, first window, end of the last window) of runs of
    windows that stand earlier in the list too."""
    data = np.frombuffer(b"".join(near), np.uint8)
    sizes = n + length - 1
    base = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(n)), n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    buckets = refine(data, base[which] + window, length)
    first = np.unique(buckets, return_index=True)[1]
    later = np.ones(len(buckets), bool)
    later[first] = False
    at = np.flatnonzero(later)
    if not len(at):
        return at, at, at
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (which[at[1:]] != which[at[:-1]])]
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(at)] - 1
    return which[at[head]], window[at[head]], window[at[tail]] + length


def _repeats(length: int):
    """All rows of some grams -> spans of windows that are not the first of their bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        given = rows.filter(pc.is_null(rows.column("near")))
        out = [[given.column(c).to_numpy() for c in ("part", "doc", "start")] + [given.column("start").to_numpy() + given.column("n").to_numpy()]]
        rows = rows.filter(pc.is_valid(rows.column("near")))
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("gram", "id", "part", "doc", "start")], null_placement="at_start"))
        gram, part, doc, start, n = (rows.column(c).to_numpy() for c in ("gram", "part", "doc", "start", "n"))
        kind = rows.column("near").combine_chunks().dictionary_encode().indices.to_numpy()
        first = np.zeros(len(kind), bool)
        first[np.unique(kind, return_index=True)[1]] = True
        out.append([part[~first], doc[~first], start[~first], start[~first] + n[~first] + length - 1])
        # of equal surroundings the first is left; a bucket with one of them is done
        left = np.flatnonzero(first & (pc.binary_length(rows.column("near")).to_numpy() >= length))  # digests are whole windows
        begin = np.flatnonzero(np.r_[True, gram[left][1:] != gram[left][:-1]]) if len(left) else left
        size = np.diff(np.r_[begin, len(left)])
        left = left[np.repeat(size > 1, size)]
        block_of = np.cumsum(n[left] + length - 1) // BLOCK
        if len(left):  # a bucket stays in the block that it begins in
            head = np.flatnonzero(np.r_[True, gram[left][1:] != gram[left][:-1]])
            block_of = np.repeat(block_of[head], np.diff(np.r_[head, len(left)]))
        near = rows.column("near")
        for b in np.unique(block_of):
            own = left[block_of == b]
            which, a, e = _later_windows(near.take(pa.array(own)).to_pylist(), n[own], length)
            out.append([part[own[which]], doc[own[which]], start[own[which]] + a, start[own[which]] + e])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["part", "doc", "start", "end"])
    return run


def _removed(output: str):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, spans: pa.Table) -> pa.Table:
        docs, texts = _documents(docs)
        d, s, e = _merged(*(spans.column(c).to_numpy() for c in ("doc", "start", "end")))
        own = np.searchsorted(d, np.arange(len(texts) + 1)).tolist()
        s, e = s.tolist(), e.tolist()
        gone, count, kept = [], [], []
        for i, text in enumerate(texts):
            lo, hi = own[i], own[i + 1]
            if hi > lo:
                cuts = [0, *(x for k in range(lo, hi) for x in (s[k], e[k])), len(text)]
                text = b"".join([text[cuts[k]:cuts[k + 1]] for k in range(0, len(cuts), 2)])
            gone.append(len(texts[i]) - len(text))
            count.append(hi - lo)
            kept.append(hashlib.sha256(text).hexdigest() if output == "digest" else text)
        return pa.table([docs.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()),
                         pa.array(kept, pa.string() if output == "digest" else pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def dedup_substrings(df: DataFrame, length: int = LENGTH, output: str = "kept", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and ``kept``: the bytes that are left (a cut may
    split a character), or with output="digest" their SHA-256 in hex."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    p = partitions(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                     F.pmod(F.xxhash64(id_col), F.lit(4 * p)).cast("int").alias("part"))
    kind = docs.schema["id"].dataType.simpleString()
    arrow_id = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    docs = docs.repartition(p, "part")  # the one shuffle of the texts
    grams = docs.groupBy("part").applyInArrow(_bucket(length), "gram long, part int, times long")
    asked = grams.repartition(p, "gram").mapInArrow(_occurring_twice(HOT), "part int, gram long, hot boolean")
    near = (docs.groupBy("part").cogroup(asked.groupBy("part"))
            .applyInArrow(_surroundings(length, arrow_id), f"gram long, part int, id {kind}, doc long, start long, n long, near binary"))
    spans = near.repartition(p, "gram").mapInArrow(_repeats(length), "part int, doc long, start long, end long")
    done = (docs.groupBy("part").cogroup(spans.groupBy("part"))
            .applyInArrow(_removed(output), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if output == 'digest' else 'binary'}"))
    return done.toDF(id_col, "n_bytes", "n_removed", "n_spans", "kept")


def op1_suffix_dedup(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents"), output="digest").withColumnRenamed("kept", "kept_sha256")
