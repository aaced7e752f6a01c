"""Operator 11: phrase collocations by mergeable Misra-Gries summaries.

First pass. Each task counts the n-grams of its texts as 64-bit hashes and sends them out
by hash partition. A partition first learns its mass (the occurrences that fall into it)
and then merges what it gets in a Misra-Gries summary: counters are added, and when there
are more than the capacity, the next largest counter is taken off all of them. The
capacity exceeds mass / threshold, each unit taken off removes more than that many
occurrences, so no count is low by the threshold and every frequent n-gram survives.
Word pairs go first; an n-gram of three or four words is summarised only where all its
word pairs survived, as one that is frequent has frequent pairs alone.

Second pass. The survivors' hashes set bits of a filter of fixed size, which is broadcast;
n-grams that pass are counted exactly, by their words and not by hash. A false pass, by
the filter or by equal hashes, is a count under the threshold and goes. A filter that is
full costs shuffled rows, no result.

Hot phrases, words and languages are pre-aggregated in every task; the first rows of a
language are chosen in parts before they meet. No step holds a document's n-grams beyond
a block of ``CHUNK`` bytes (or one longer text).

Defined results: a null text is empty, a null lang is ``und``; words are split at spaces
and tabs, pieces at ``.,;:!?`` and line ends; only A-Z are lower-cased; equal rows and rows
that share an id count each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, small_batches, table

LEAST, LONGEST, TOP = 30, 4, 2000
#: Bytes of text that are cut into words at a time; n-grams that a task counts before it sends them; phrases that it counts exactly; bytes of text a hash partition.
CHUNK, HELD, KEPT, SHARE = 2 << 20, 1 << 20, 200_000, 1 << 30
#: Bits of the broadcast filter (16 MB, whatever the input) and bits that a survivor sets.
FILTER_BITS, PROBES = 1 << 27, 4

_CLASS = np.zeros(256, np.uint8)  # 0 word, 1 between words, 2 between pieces
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def _hash(strings: pa.LargeBinaryArray) -> np.ndarray:
    """Polynomial hashes of byte strings."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[:len(strings) + 1]
    sizes = np.diff(offsets)
    if not len(sizes) or not offsets[-1]:
        return np.zeros(len(sizes), np.uint64)
    data = np.frombuffer(strings.buffers()[2], np.uint8)[:offsets[-1]].astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.full(int(sizes.max()), _B))
    data *= powers[np.arange(len(data)) - np.repeat(offsets[:-1], sizes)]
    out, full = np.zeros(len(sizes), np.uint64), sizes > 0
    out[full] = np.add.reduceat(data, offsets[:-1][full])
    return _mix(out)


class Words:
    """The words of some texts: ``code`` into ``dictionary``, ``lang`` code, ``after`` (the
    word follows the one before it in a piece)."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        joined = pc.binary_join_element_wise(texts.cast(pa.large_binary()), pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1]
        data = _LOWER[np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]]
        kind = _CLASS[data]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        starts, ends = edge[::2], edge[1::2]
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        lengths = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lengths), pa.py_buffer(data[inside])])
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        self.code = np.asarray(coded.indices).astype(np.int64)
        tongue = langs.dictionary_encode()
        self.langs = tongue.dictionary.to_pylist()
        self.lang = np.asarray(tongue.indices)[np.searchsorted(offsets - offsets[0], starts, "right") - 1].astype(np.int64)
        self.after = np.zeros(len(starts), bool)
        self.after[1:] = piece[1:] == piece[:-1]

    def pairs(self) -> np.ndarray:
        """Whether a pair begins at each word."""
        return np.append(self.after[1:], False)[:len(self.after)]

    def hashes(self) -> np.ndarray:
        """A hash of each word and its language."""
        langs = pa.array([x.encode() for x in self.langs], pa.large_binary())
        return _mix(_hash(self.words)[self.code] + _B * _hash(langs)[self.lang])


def _longer(before: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of n-grams of ``size`` words at each place from those one word shorter (at
    the end of the texts they are of no use)."""
    return _mix(before * _B + np.roll(words, 1 - size))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Columns lang, text -> words of about CHUNK bytes of whole texts."""
    for b in batches:
        lang, text = b.column(0), b.column(1)
        size = np.cumsum(np.asarray(pc.binary_length(text)).astype(np.int64))
        at = 0
        while at < len(text):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
            yield Words(lang.slice(at, end - at), text.slice(at, end - at))
            at = end


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter has all bits of each hash."""
    out = np.ones(len(hashes), bool)
    for k in range(PROBES):
        at = _probe(hashes, k)
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _probe(hashes: np.ndarray, k: int) -> np.ndarray:
    return _mix(hashes + np.uint64(k * int(_B) % 2**64)) % np.uint64(FILTER_BITS)


# --- first pass ---------------------------------------------------------------------

_SENT = "p int, kind int, mass long, hashes binary, counts binary"


def _send(parts: int, known):
    """Texts -> counts of n-gram hashes by hash partition: word pairs, or with a broadcast
    filter ``known`` the n-grams of three and more words whose pairs all pass. Each
    partition gets a row with the mass (kind 0), which is sorted first, and the counts."""
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        edges = [-(-(i << 64) // parts) for i in range(1, parts)]
        cut = [0, *np.searchsorted(hashes, np.array(edges, np.uint64)).tolist(), len(hashes)]
        rows = []
        for p in range(parts):
            h, c = hashes[cut[p]:cut[p + 1]], counts[cut[p]:cut[p + 1]]
            if len(h):
                rows += [(p, 0, int(c.sum()), None, None), (p, 1, None, h.tobytes(), c.astype(np.uint32).tobytes())]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["p", "kind", "mass", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for w in _blocks(batches):
            begins, h1 = w.pairs(), w.hashes()
            h2 = _longer(h1, h1, 2)
            if known is None:
                found = [h2[begins]]
            else:
                begins[begins] = passes(known.value, h2[begins])
                found, h, run_on = [], h2, begins
                for size in range(3, LONGEST + 1):
                    h = _longer(h, h1, size)
                    run_on = run_on & np.append(begins[size - 2:], np.zeros(size - 2, bool))[:len(begins)]
                    found.append(h[run_on])
            held += found
            count += sum(map(len, found))
            if count >= HELD:
                yield from flush(held)
                held, count = [], 0
        if count:
            yield from flush(held)
    return run


class Summary:
    """A Misra-Gries summary of hashes with room for ``capacity`` counters; a count is low
    by ``error`` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, hashes: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        both, value = both[order], np.concatenate([self.counts, counts])[order]
        first = np.flatnonzero(np.diff(both, prepend=both[:1] - np.uint64(1))) if len(both) else np.zeros(0, np.int64)
        self.hashes, self.counts = both[first], np.add.reduceat(value, first) if len(first) else value
        self.error += error
        if len(self.counts) > self.capacity:
            over = np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1]
            keep = self.counts > over
            self.hashes, self.counts = self.hashes[keep], self.counts[keep] - over
            self.error += int(over)

    def frequent(self, least: int) -> np.ndarray:
        return self.hashes[self.counts + self.error >= least]


def _merge(least: int):
    """Rows of ``_send`` sorted by (p, kind) -> the filter's bits (word, bit) of the hashes
    that may have ``least`` occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, mass, summary = None, 0, None

        def done() -> pa.RecordBatch:
            at = np.concatenate([_probe(summary.frequent(least), k) for k in range(PROBES)])
            return pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bit"])

        for b in batches:
            for i in range(b.num_rows):
                at, kind = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if at != p:
                    if summary is not None:
                        yield done()
                    p, mass, summary = at, 0, None
                if kind == 0:
                    mass += b.column(2)[i].as_py()
                    continue
                summary = summary or Summary(mass // least + 1)
                summary.merge(np.frombuffer(b.column(3)[i].as_buffer(), np.uint64), np.frombuffer(b.column(4)[i].as_buffer(), np.uint32).astype(np.int64))
        if summary is not None:
            yield done()
    return run


def survivors(docs: DataFrame, least: int, parts: int, known=None) -> DataFrame:
    """(lang, text) -> word, bit: filter bits of all n-grams with ``least`` occurrences, and
    of some others."""
    sent = docs.mapInArrow(_send(parts, known), _SENT)
    return sent.repartition(parts, "p").sortWithinPartitions("p", "kind").mapInArrow(_merge(least), "word long, bit long")


def _filter(spark: SparkSession, found: DataFrame):
    """The broadcast filter of survivors. Its words are put together by aggregation; at most
    FILTER_BITS / 64 of them come to the driver."""
    words = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[np.asarray(words.column("word").combine_chunks())] = np.asarray(words.column("bits").combine_chunks()).view(np.uint64)
    return spark.sparkContext.broadcast(bits)


# --- second pass --------------------------------------------------------------------

def _count(pairs, longer):
    """Texts -> lang, size, phrase, f: counts of all words, and of the n-grams that pass
    the filters, by the words themselves. A task sends its counts when it has KEPT phrases."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], dict[bytes, int]] = {}
        for w in _blocks(batches):
            if not len(w.code):
                continue
            v, h1, begins = len(w.words), w.hashes(), w.pairs()
            _, first, count = np.unique(w.lang * v + w.code, return_index=True, return_counts=True)
            _add(held, w, 1, first, count)
            h = _longer(h1, h1, 2)
            begins[begins] = passes(pairs.value, h[begins])
            at, last = np.flatnonzero(begins), len(begins) - 1
            name = np.zeros(len(begins), np.int64)  # numbers equal n-grams alike
            _, first, name[at], count = np.unique((w.lang[at] * v + w.code[at]) * v + w.code[np.minimum(at + 1, last)], return_index=True, return_inverse=True, return_counts=True)
            _add(held, w, 2, at[first], count)
            run_on = begins
            for size in range(3, LONGEST + 1):
                h = _longer(h, h1, size)
                run_on = run_on & np.append(begins[size - 2:], np.zeros(size - 2, bool))[:len(begins)]
                at = np.flatnonzero(run_on)
                _, first, inverse, count = np.unique(name[at] * v + w.code[np.minimum(at + size - 1, last)], return_index=True, return_inverse=True, return_counts=True)
                name = np.zeros(len(begins), np.int64)
                name[at] = inverse
                keep = passes(longer.value, h[at[first]])
                _add(held, w, size, at[first][keep], count[keep])
            if sum(map(len, held.values())) >= KEPT:
                yield from _rows(held)
        yield from _rows(held)
    return run


def _add(held: dict, w: Words, size: int, at: np.ndarray, count: np.ndarray) -> None:
    """Add the n-grams that begin at ``at`` to the counts by (lang, size)."""
    if not len(at):
        return
    text = w.words.take(pa.array(w.code[at]))
    for k in range(1, size):
        text = pc.binary_join_element_wise(text, w.words.take(pa.array(w.code[at + k])), pa.scalar(b" ", pa.large_binary()))
    for code in np.unique(w.lang[at]):
        some = w.lang[at] == code
        counts = held.setdefault((w.langs[code], size), {})
        for phrase, f in zip(text.filter(pa.array(some)).to_pylist(), count[some].tolist()):
            counts[phrase] = counts.get(phrase, 0) + f


def _rows(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, size), counts in held.items():
        n = len(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, size, np.int32)), pa.array(counts.keys(), pa.binary()).cast(pa.string()),
                                          pa.array(counts.values(), pa.int64())], ["lang", "size", "phrase", "f"])
    held.clear()


def count_phrases(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, size, phrase, f: exact counts of all words (size 1) and of all phrases of 2 to
    LONGEST words with at least ``least`` occurrences in their language."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), -(-size // SHARE))
    with small_batches(spark, 2 * CHUNK):
        pairs = _filter(spark, survivors(docs, least, parts))
        longer = _filter(spark, survivors(docs, least, parts, pairs))
        counted = docs.mapInArrow(_count(pairs, longer), "lang string, size int, phrase string, f long").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
        return materialize(counted.where((F.col("size") == 1) | (F.col("f") >= least)), "phrase-counts")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language whose
    weakest cut scores highest, without those that a longer candidate nearly always holds."""
    counts = count_phrases(docs, least, lang_col, text_col)
    mass = counts.where("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    found = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a")).withColumn("words", F.split("phrase", " "))
    part = counts.select("lang", "phrase", "f")

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": F.array_join(F.slice("words", F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    cuts = cuts.select("lang", "phrase", "a", "k", "left", "right")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = found.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    inner = inner.groupBy("lang", F.array_join(F.slice("words", F.col("from"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("held"))
    decimal = lambda c: F.col(c).cast("decimal(19, 0)")
    kept = weakest.join(inner, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * decimal("held") < 80 * decimal("a")))

    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.join(mass, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_misra_gries_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language in all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH docs AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (
    SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
words AS (
    SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
    SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(generate_series(1, len(w) - k + 1), lambda i: list_slice(w, i, i + k - 1))))) AS g
    FROM words WHERE len(w) > 0),
counts AS (
    SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL),
mass AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(g) = 1 GROUP BY lang),
found AS (
    SELECT lang, g, f AS a FROM counts WHERE len(g) > 1 AND f >= {LEAST}),
cuts AS (
    SELECT lang, g, a, unnest(generate_series(1, len(g) - 1)) AS k FROM found),
scored AS (
    SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN counts y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]),
weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
spans AS (
    SELECT lang, g, a, unnest(flatten(list_transform(generate_series(2, len(g) - 1), lambda m: list_transform(generate_series(1, len(g) - m + 1), lambda i: list_slice(g, i, i + m - 1))))) AS part
    FROM found WHERE len(g) > 2),
kept AS (
    SELECT w.lang, array_to_string(w.g, ' ') AS phrase, w.a, w.l, w.r, w.score FROM weakest w
    WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.lang = w.lang AND s.part = w.g AND 100 * s.a >= 80 * w.a)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, ranked.rank, phrase, a, l, r, mass.n, score::BIGINT AS score
FROM ranked JOIN mass ON mass.lang = ranked.lang WHERE rank <= {TOP}
"""
