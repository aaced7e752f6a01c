"""Operator 6: toxicity by a chain of linear classifiers.

The categories form a chain: each one's logistic model sees the words of a document
(and the beginnings of words, for inflected forms) and the log-odds of the categories
before it. Those come out of fold while the chain is trained: every fold is judged by
a model of the other folds, so a later model meets earlier probabilities of the
quality that it will meet on new documents. The models are fitted by Spark tasks, one
for each fold and one for all rows (where the folds' fits start), on a sample of at most
``SAMPLE`` labelled documents (the smallest hashes of their ids); a model keeps at most
``FEATURES`` features, those whose presence goes with the category beyond chance, and a
task gets the numbers of those alone. All documents are then scored over their whole
text in one map without a shuffle.

Defined results: a null text is an empty one and gets the score of no words; labels
of one id are merged (toxic if any says so, low quality if any does), of documents that
share an id the text with the smallest hash is learnt from, null labels and labels
without a document are left out; without labels of both kinds a category's
probability is its share of ones, 0 without labels; repeated rows are scored alike;
empty tables give empty results; other columns are ignored, or kept by ``drop_toxic``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, materialize, table

#: The chain, and the category that decides.
CATEGORIES, DECIDES, CUT = ("low_quality", "toxic", "toxic_low_quality"), "toxic", 0.5
SAMPLE, FOLDS, FEATURES, LEAST_CHI2, RIDGE, ONES = 20_000, 5, 4096, 25.0, 0.1, 2.0
#: Words whose features a worker remembers.
KNOWN = 300_000
#: Entries of the design matrix that a fit works on at a time.
ENTRIES = 1 << 16
#: Least share of its first error that a Newton step's system is solved to, far from the end.
LOOSE = 0.01
#: Rows of an Arrow batch whose texts and features are Python objects at a time.
ROWS = 256
_WORDS = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """32-bit hashes of a word and of its beginnings of 3 to 6 letters."""
    return [zlib.crc32(f"{n}:{word[:n]}".encode()) for n in range(3, 7) if len(word) > n] + [zlib.crc32(f"w:{word}".encode())]


def _text_features(text: str | None) -> list[int]:
    return sorted({f for w in set(_WORDS.findall((text or "").lower())) for f in word_features(w)})


def _features(chosen: np.ndarray | None):
    """(nth, y, fold, text) -> (nth, y, fold, distinct features), or with ``chosen`` the
    places in it of those features that it has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None if chosen is None else {f: i for i, f in enumerate(chosen.tolist())}
        for batch in few(batches, ROWS):
            feats = [_text_features(t) for t in batch.column(3).to_pylist()]
            if place is not None:
                feats = [[place[f] for f in own if f in place] for own in feats]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(feats, pa.list_(pa.int64() if place is None else pa.int32()))], names=["nth", "y", "fold", "features"])
    return run


def _associated(n: np.ndarray, ones: np.ndarray):
    """Counts of features by fold -> (category, fold left out or FOLDS, feature, chi2) where
    presence and category go together beyond chance in the other folds. n: rows by
    fold, ones: by category and fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            counts = np.stack([np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(float)) for c in batch.columns[1:]])
            counts = counts.reshape(FOLDS, 1 + len(CATEGORIES), -1)
            out = []
            for g in range(FOLDS + 1):
                use = [f for f in range(FOLDS) if f != g]
                df, total = counts[use, 0].sum(0), n[use].sum()
                for k in range(len(CATEGORIES)):
                    both, yes = counts[use, 1 + k].sum(0), ones[k, use].sum()
                    with np.errstate(divide="ignore", invalid="ignore"):
                        chi2 = np.nan_to_num(total * (both * total - df * yes) ** 2 / (df * (total - df) * yes * (total - yes)), posinf=0)
                    hit = np.flatnonzero(chi2 >= LEAST_CHI2)
                    out.append((np.full(len(hit), k), np.full(len(hit), g), names[hit], chi2[hit]))
            k, g, f, x = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(g, pa.int32()), pa.array(f, pa.int64()), pa.array(x)],
                                             names=["k", "left_out", "feature", "chi2"])
    return run


def logistic(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int,
             ridge: float = RIDGE, ones_count: float = 1.0) -> np.ndarray:
    """Ridge logistic regression: weights of the ``width`` 0/1 features (entries rows, cols,
    by row), of the dense columns, and an intercept. A row of category 1 counts as
    ``ones_count`` rows."""
    return newton(np.bincount(rows, minlength=len(y)), cols, dense, y, width, ridge, ones_count)


class Entries:
    """A 0/1 matrix by rows: ``counts`` entries a row, their columns ``cols``; worked on
    some rows at a time, so that no copy of all entries is made."""

    def __init__(self, counts: np.ndarray, cols: np.ndarray, width: int):
        self.counts, self.cols, self.width = counts, cols, width
        ends = np.cumsum(counts)
        self.blocks, row, at = [], 0, 0
        while row < len(counts):
            last = max(row + 1, int(np.searchsorted(ends, at + ENTRIES, "right")))
            to = int(ends[last - 1])
            full = np.flatnonzero(counts[row:last])
            self.blocks.append((row, last, at, to, full, (ends - counts)[row:last][full] - at))
            row, at = last, to

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.counts))
        for row, last, at, to, full, starts in self.blocks:
            if len(full):
                out[row + full] = np.add.reduceat(w[self.cols[at:to]], starts)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for row, last, at, to, _, _ in self.blocks:
            out += np.bincount(self.cols[at:to], np.repeat(r[row:last], self.counts[row:last]), self.width)
        return out


def newton(counts: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, ridge: float = RIDGE,
           ones_count: float = 1.0, start: np.ndarray | None = None) -> np.ndarray:
    """``logistic`` by Newton steps with scaled conjugate gradients, from ``start`` if given."""
    n = len(y)
    c = np.where(y > 0, ones_count, 1.0)
    dense = np.c_[dense, np.ones(n)]
    k = dense.shape[1]
    x = Entries(counts, cols, width)

    def forward(w):
        return x.times(w) + dense @ w[width:]

    def back(r):
        return np.r_[x.back(r), dense.T @ r]

    penalty = np.r_[np.full(width, ridge), np.full(k - 1, 1e-3), 1e-6]
    w = np.zeros(width + k)
    share = min(max((c @ y) / c.sum(), 1e-6), 1 - 1e-6)
    w[-1] = np.log(share / (1 - share))
    w = w if start is None else start.copy()

    def loss(w):
        z = forward(w)
        return c @ (np.logaddexp(0, z) - y * z) + (penalty * w * w).sum() / 2

    now, first = loss(w), 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -40, 40)))
        grad = back(c * (p - y)) + penalty * w
        d = c * p * (1 - p) + 1e-9
        scale = 1 / (np.r_[x.back(d), d @ dense**2] + penalty)  # features differ widely in frequency
        step, r = np.zeros_like(w), -grad
        z = scale * r
        direction, rz = z.copy(), r @ z
        first = first or rz
        least = max(1e-8, LOOSE * min(1.0, rz / first) ** 0.5) * rz if first else 0.0  # a step far from the end need not be exact
        for _ in range(50):
            if rz <= least:
                break
            h = back(d * forward(direction)) + penalty * direction
            a = rz / (direction @ h)
            step += a * direction
            r -= a * h
            z = scale * r
            rz, old = r @ z, rz
            direction = z + rz / old * direction
        size = 1.0
        while size > 1e-4 and (after := loss(w + size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - after < 1e-7 * max(1.0, abs(now)):
            break
        w, now = w + size * step, after
    return w


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


_SENT = "left_out int, nth int, fold int, y int, earlier array<double>, features array<int>"


def _send(category: int, places: dict[int, np.ndarray]):
    """Rows (nth, y, fold, features, earlier) -> one for each group of ``places``, with the
    features that the group's model has. places: of each feature in the model, or -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("features")
            flat = lists.flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
            y = pa.array([own[category] for own in b.column("y").to_pylist()], pa.int32())
            for g, place in places.items():
                col = place[flat]
                keep = col >= 0
                offsets = np.r_[0, np.cumsum(np.bincount(row[keep], minlength=b.num_rows))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, g, np.int32)), b.column("nth"), b.column("fold"), y, b.column("earlier"),
                                                  pa.ListArray.from_arrays(pa.array(offsets), pa.array(col[keep]))], names=["left_out", "nth", "fold", "y", "earlier", "features"])
    return run


def _fit(category: int, names: dict[int, np.ndarray], start: dict[int, np.ndarray]):
    """Rows of ``_send`` sorted by (left_out, nth), left_out being a fold or FOLDS for none
    -> out-of-fold probabilities (kind 0: nth), or the model (kind 1: feature, 2: earlier
    category, 3: intercept). names: the features of each group's model."""
    def solve(left_out: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        nth, fold, y, counts = (np.concatenate(x) for x in list(zip(*held))[:4])
        y = y.astype(float)
        cols = np.concatenate([x[4] for x in held])
        earlier = _log_odds(np.concatenate([x[5] for x in held]))
        held.clear()
        width, test = len(names[left_out]), fold == left_out
        train = ~test
        n, ones = int(train.sum()), float(y[train].sum())
        if 0 < ones < n:
            w = newton(counts[train], cols[np.repeat(train, counts)] if test.any() else cols, earlier[train], y[train], width, RIDGE, min(ONES, max(1.0, (n - ones) / ones)), start.get(left_out))
        else:
            share = ones / n if n else 0.0
            w = np.r_[np.zeros(width + category), _log_odds(np.array([share]))]
        if left_out < FOLDS:
            z = Entries(counts[test], cols[np.repeat(test, counts)], width).times(w) + np.c_[earlier[test], np.ones(test.sum())] @ w[width:]
            out = [(0, int(i), float(v)) for i, v in zip(nth[test], 1 / (1 + np.exp(-np.clip(z, -40, 40))))]
        else:
            out = [(1, int(f), float(v)) for f, v in zip(names[left_out], w)]
            out += [(2, k, float(w[width + k])) for k in range(category)] + [(3, 0, float(w[-1]))]
        kind, name, value = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(name, pa.int64()), pa.array(value, pa.float64())], names=["kind", "name", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            groups = np.asarray(b.column("left_out"))
            for g in np.unique(groups):
                if now is not None and g != now:
                    yield solve(now, held)
                now = int(g)
                some = b.slice(int(np.searchsorted(groups, g)), int((groups == g).sum()))
                lists = some.column("features")
                earlier = np.array(some.column("earlier").to_pylist(), np.float64).reshape(some.num_rows, category)
                held.append((*(np.array(some.column(c)) for c in ("nth", "fold", "y")), np.asarray(lists.value_lengths()).astype(np.int32), np.array(lists.flatten()), earlier))
        if now is not None:
            yield solve(now, held)
    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """The chain: for each category its feature weights, weights of the earlier
    categories and intercept. Bounded by the sample and by FEATURES."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.max(F.col("toxic").cast("int")).alias("t"), F.max(1 - F.col("quality").cast("int")).alias("q")))
    y = F.array(*[c.cast("int") for c in (F.col("q"), F.col("t"), F.col("q") * F.col("t"))])
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    order = [F.xxhash64("id"), F.col("id")]
    known = known.orderBy(*order).limit(sample).select(F.row_number().over(Window.orderBy(*order)).alias("nth"), "id", y.alias("y"), fold.alias("fold"))  # at most sample rows
    texts = docs.select(F.col(id_col).alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), F.col("did") == F.col("id"))
    texts = texts.groupBy("nth", "y", "fold").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first")).select("nth", "y", "fold", "first.text")
    texts = materialize(texts, "labelled-texts")
    of_y = [F.sum(F.col("y")[k]).alias(f"y{k}") for k in range(len(CATEGORIES))]
    n, ones = np.zeros(FOLDS), np.zeros((len(CATEGORIES), FOLDS))
    for r in texts.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *of_y).collect():  # a row for each fold
        n[r["fold"]], ones[:, r["fold"]] = r["n"], r[2:]
    shape = "nth int, y array<int>, fold int, features array<long>"
    counts = (texts.mapInArrow(_features(None), shape).select("y", "fold", F.explode("features").alias("feature"))
              .groupBy("feature").pivot("fold", list(range(FOLDS))).agg(F.count(F.lit(1)).alias("n"), *of_y))
    found = counts.mapInArrow(_associated(n, ones), "k int, left_out int, feature long, chi2 double")
    best = F.row_number().over(Window.partitionBy("k", "left_out").orderBy(F.desc("chi2"), "feature"))
    chosen = {(k, g): np.empty(0, np.int64) for k in range(len(CATEGORIES)) for g in range(FOLDS + 1)}
    held = found.withColumn("nth", best).where(F.col("nth") <= FEATURES).groupBy("k", "left_out").agg(F.collect_list("feature").alias("f"))
    for r in held.collect():  # at most FEATURES for each category and fold
        chosen[r["k"], r["left_out"]] = np.sort(np.array(r["f"], np.int64))
    union = np.unique(np.concatenate(list(chosen.values())))
    rows = texts.mapInArrow(_features(union), shape.replace("long", "int"))
    rows = materialize(rows.withColumn("earlier", F.array().cast("array<double>")), "labelled")
    chain: list[dict] = []
    for k in range(len(CATEGORIES)):
        def fitted(groups: list[int], start: dict[int, np.ndarray]) -> DataFrame:
            names = {g: chosen[k, g] for g in groups}
            places = {g: np.full(len(union) + 1, -1, np.int32) for g in groups}
            for g in groups:
                places[g][np.searchsorted(union, names[g])] = np.arange(len(names[g]), dtype=np.int32)
            sent = rows.mapInArrow(_send(k, places), _SENT).repartitionById(len(groups), F.col("left_out") - groups[0]).sortWithinPartitions("left_out", "nth")
            return materialize(sent.mapInArrow(_fit(k, names, start), "kind int, name long, value double"), "fitted")

        found = fitted([FOLDS], {})
        model = {"features": {}, "earlier": [0.0] * k, "intercept": -20.0}
        for kind, name, value in found.where("kind > 0").collect():  # at most FEATURES + k + 1 numbers
            if kind == 1:
                model["features"][name] = value
            elif kind == 2:
                model["earlier"][name] = value
            else:
                model["intercept"] = value
        chain.append(model)
        if k + 1 < len(CATEGORIES):
            begin = {g: np.r_[[model["features"].get(f, 0.0) for f in chosen[k, g].tolist()], model["earlier"], model["intercept"]] for g in range(FOLDS)}
            judged = fitted(list(range(FOLDS)), begin).select(F.col("name").cast("int").alias("nth"), F.col("value").alias("p"))
            rows = rows.join(judged, "nth").withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p")
    return chain


def _scorer(chain: list[dict]):
    """texts -> probabilities, a column for each category."""
    names = sorted({f for m in chain for f in m["features"]})
    place = {f: i for i, f in enumerate(names)}
    weights = np.zeros((len(names), len(chain)))
    for k, m in enumerate(chain):
        for f, w in m["features"].items():
            weights[place[f], k] = w
    known: dict[str, tuple[int, ...]] = {}

    def score(texts: list[str | None]) -> np.ndarray:
        if len(known) > KNOWN:
            known.clear()
        z = np.tile([float(m["intercept"]) for m in chain], (len(texts), 1))
        for i, text in enumerate(texts):
            hit: set[int] = set()
            for word in set(_WORDS.findall((text or "").lower())):
                own = known.get(word)
                if own is None:
                    own = known[word] = tuple([place[f] for f in word_features(word) if f in place])
                if own:
                    hit.update(own)
            if hit:
                z[i] += weights[sorted(hit)].sum(0)
        p = np.zeros_like(z)
        for k, m in enumerate(chain):
            if k:
                z[:, k] += _log_odds(p[:, :k]) @ np.array(m["earlier"])
            p[:, k] = 1 / (1 + np.exp(-np.clip(z[:, k], -40, 40)))
        return p
    return score


def score(docs: DataFrame, chain: list[dict], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the probability of each category for every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _scorer(chain)
        for batch in few(batches, ROWS):
            p = judge(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(chain)))], names=["id", *CATEGORIES])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in CATEGORIES))
    return out.toDF(id_col, *CATEGORIES)


def drop_toxic(docs: DataFrame, chain: list[dict], cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The documents whose deciding category is below ``cut``, with all their columns."""
    at, k = docs.columns.index(text_col), CATEGORIES.index(DECIDES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _scorer(chain)
        for batch in few(batches, ROWS):
            yield batch.filter(pa.array(judge(batch.column(at).to_pylist())[:, k] < cut))

    names = [f"c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    return docs.toDF(*names).mapInArrow(run, kinds).toDF(*docs.columns)


def op6_toxicity_chain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    p = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return p.select("doc_id", *[F.col(c).alias(f"p_{c}") for c in CATEGORIES], (F.col(DECIDES) >= CUT).alias("toxic"))
