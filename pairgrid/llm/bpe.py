"""Operator 10: BPE encoding and decoding by prefix-sharing trie traversal.

Texts are cut into words; the distinct words of a batch that are not known yet are
sorted, which lists their trie depth first. Along it, the last token of the
encoding of every prefix is kept on a stack: of the tokens that end a prefix, the
one is taken that BPE would put after the last token of what stands before it. A
prefix that several words share is encoded once, and a word's tokens are read by
following the last tokens back. Known words stay in a bounded cache of the worker.

The work is a map over the documents: nothing is shuffled, and a lost executor
costs the batches it held.

Defined results: a null text is an empty one and has no tokens (digests of the
empty string); every row is encoded by itself, so repeated rows and ids repeat;
special tokens that stand in a text become their ids; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Texts that are encoded together and chunks that a worker keeps between batches.
TEXTS, CHUNKS = 256, 400_000
#: White space as the tokenizer's patterns see it, and its form of a tokenizer file.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
FORM = {"model": "BPE", "normalizers": ["NFC", "Replace", "Lowercase"], "pretokenizers": ["Split", "ByteLevel"]}


def _byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with word ends, read from the text of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, norm, pre = spec["model"], spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
        form = {"model": model["type"], "normalizers": [x["type"] for x in norm], "pretokenizers": [x["type"] for x in pre]}
        if form != FORM or not pre[0]["invert"] or pre[0]["behavior"] != "Removed" or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"another form of tokenizer: {form}")
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.name = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(self.end)}
        self.last = {t[: -len(self.end)]: i for t, i in vocab.items() if t.endswith(self.end)}
        self.longest = max(map(len, [*self.inner, *self.last]))
        self.width = {i: len(t) for kind in (self.inner, self.last) for t, i in kind.items()}
        # states: the beginnings of inner tokens; a text is in that of its longest end among them
        self.state = {"": 0}
        for t in self.inner:
            for i in range(1, len(t) + 1):
                self.state.setdefault(t[:i], len(self.state))
        self.beginning = list(self.state)
        self.moves: dict[int, int] = {}
        self.ending: list[tuple | None] = [None] * len(self.beginning)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            u, v, whole = vocab[a], vocab[b], vocab[a + b]
            if any(self.parts[x][2] > r for x in (u, v) if x in self.parts):
                raise ValueError("a merge stands before the merges that make its parts")
            self.rank.setdefault((u, v), r)
            self.parts.setdefault(whole, (u, v, r))
        self.words = regex.compile(pre[0]["pattern"]["Regex"].replace(r"\s", SPACE))
        self.space = regex.compile(f"[{SPACE}]+")
        self.odd = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the tokenizer does not
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes = _byte_characters()
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.pairs: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at the left (0) or right (1) edge of a token while it is
        merged, each with the rank at which it is merged away."""
        found = self.edges.get((token, side))
        if found is None:
            found, until, t = [], float("inf"), token
            while True:
                found.append((t, until))
                if t not in self.parts:
                    break
                until, t = self.parts[t][2], self.parts[t][side]
            self.edges[token, side] = found
        return found

    def follows(self, u: int, v: int) -> bool:
        """Whether BPE leaves u and v apart where they meet: no merge across the
        border comes before the merges that use up its sides (at equal rank the
        left-hand merge is first)."""
        rank = self.rank
        for a, a_until in self.edge(u, 1):
            for b, b_until in self.edge(v, 0):
                r = rank.get((a, b))
                if r is not None and r < a_until and r <= b_until:
                    return False
        return True

    def _own(self, token: int) -> bool:
        """Whether the token is the encoding of its own string."""
        return token not in self.parts or not self.follows(*self.parts[token][:2])

    def _move(self, state: int, char: str, key: int) -> int:
        text = self.beginning[state] + char
        while text not in self.state:
            text = text[1:]
        self.moves[key] = found = self.state[text]
        return found

    def _ending(self, state: int) -> tuple:
        """Tokens that end a state's text with their widths, the longest first."""
        text = self.beginning[state]
        self.ending[state] = found = tuple((self.inner[text[i:]], len(text) - i) for i in range(len(text)) if text[i:] in self.inner)
        return found

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple]:
        """Token ids of each distinct word, along the depth-first order of their trie."""
        chars, width, pairs, longest, last = self.bytes, self.width, self.pairs, self.longest, self.last
        moves, ending = self.moves, self.ending
        out: dict[str, tuple] = {}
        tokens, states, before, known = [0], [0], "", 0  # last token and state of each prefix of the word before
        for s, word in sorted([("".join([chars[b] for b in w.encode()]), w) for w in words]):
            n = len(s)
            depth, most = 0, min(n - 1, known)
            while depth < most and s[depth] == before[depth]:
                depth += 1
            del tokens[depth + 1:], states[depth + 1:]
            now = states[depth]
            for i in range(depth + 1, n + 1):
                if i < n:
                    key = now << 17 | ord(s[i - 1])
                    step = moves.get(key)
                    now = self._move(now, s[i - 1], key) if step is None else step
                    states.append(now)
                    ends = ending[now] or self._ending(now)
                else:
                    ends = [(t, i - j) for j in range(max(0, i - longest), i) if (t := last.get(s[j:i])) is not None]
                for t, w in ends:
                    key = tokens[i - w] << 20 | t if i > w else ~t
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = self.follows(tokens[i - w], t) if i > w else self._own(t)
                    if ok:
                        break
                else:
                    raise ValueError(f"no token ends {s[:i]!r}")
                tokens.append(t)
            known, before = n - 1, s
            ids, i = [], n
            while i > 0:
                ids.append(t := tokens[i])
                i -= width[t]
            out[word] = tuple(ids[::-1])
        return out

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that are encoded by themselves: runs without white space, which
        no normal form or word crosses, and special tokens."""
        if self.marks is None or not self.marks.search(text):
            return text.split() if not self.odd.search(text) else self.space.split(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*self.space.split(text[at:m.start()]), m[0]]
            at = m.end()
        return out + self.space.split(text[at:])

    def words_of(self, chunk: str) -> list[str]:
        """The words of a chunk after normalisation; a special token is one."""
        if chunk in self.special:
            return [chunk]
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # each character is lower-cased by itself
        return self.words.findall(chunk.lower())

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings with a space between them, as a file without a decoder has it."""
        return " ".join([self.name[i] for i in ids])


class Recent(dict):
    """A bounded cache of two generations: what was not asked for since the last but one change is dropped."""

    def __init__(self):
        self.before: dict = {}

    def missing(self, keys: Iterable) -> set:
        """Keys that neither generation has; those of the older one come over."""
        gone = {k for k in keys if k not in self}
        back = gone & self.before.keys()
        self.update({k: self.before[k] for k in back})
        return gone - back

    def age(self, most: int) -> None:
        if len(self) > most:
            self.before = dict(self)
            self.clear()


_LOADED: dict[str, tuple] = {}


def _loaded(text: str) -> tuple[WordBpe, Recent, Recent]:
    """The vocabulary and the caches of this worker, made once: word -> ids, and
    chunk -> (ids, decimal ids, token strings)."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordBpe(text), Recent(), Recent()
    return _LOADED[key]


def _encoded(loaded, texts: list[str | None]) -> list[list[tuple]]:
    """The cache entries of each text's chunks, in order."""
    bpe, words, known = loaded
    words.age(CHUNKS)
    known.age(CHUNKS)
    if len(bpe.pairs) > 4 * CHUNKS:
        bpe.pairs.clear()
    cut = [bpe.chunks(t) if t else [] for t in texts]
    new = {c: bpe.words_of(c) for c in known.missing({c for chunks in cut for c in chunks})}
    fresh = words.missing({w for own in new.values() for w in own})
    words.update({w: (bpe.special[w],) for w in fresh & bpe.special.keys()})
    words.update(bpe.encode_words(fresh - bpe.special.keys()))
    for c, own in new.items():
        ids = words[own[0]] if len(own) == 1 else tuple([i for w in own for i in words[w]])
        known[c] = ids, " ".join(map(str, ids)), bpe.decode(ids)
    return [[known[c] for c in chunks] for chunks in cut]


def _tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _map(df: DataFrame, path: str, id_col: str, text_col: str, columns, schema: str) -> DataFrame:
    """columns(cache entries of a text's chunks) -> values after the id."""
    sent = df.sparkSession.sparkContext.broadcast(_tokenizer_text(path))  # one vocabulary file
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    types = None

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _loaded(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                made = [columns(chunks) for chunks in _encoded(loaded, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(x), t) for x, t in zip(zip(*made), types))],
                                                 names=[id_col, *(f"c{i}" for i in range(len(types)))])

    types = [pa.int64() if x == "long" else pa.list_(pa.int32()) if x == "array<int>" else pa.string() for x in schema.split()[1::2]]
    names = schema.split()[::2]
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(encode, f"`{id_col}` {kind}, " + ", ".join(f"c{i} {t}" for i, t in enumerate(schema.split()[1::2])))
    return out.toDF(id_col, *names)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>): token ids of every whole text."""
    def columns(chunks):
        return ([i for c in chunks for i in c[0]],)
    return _map(df, path, id_col, text_col, columns, "ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded: the token strings of an id array with a space between them (null: empty)."""
    sent = df.sparkSession.sparkContext.broadcast(_tokenizer_text(path))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _loaded(sent.value)[0]
        for ids in batches:
            yield ids.map(lambda x: "" if x is None else bpe.decode(x))

    return df.select(F.col(id_col), text(F.col(ids_col)).alias("decoded"))


def digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every whole text, without moving the ids out of the worker."""
    def columns(chunks):
        chunks = [c for c in chunks if c[0]]  # the empty pieces beside a special token
        return (sum([len(c[0]) for c in chunks]),
                hashlib.sha256(" ".join([c[1] for c in chunks]).encode()).hexdigest(),
                hashlib.sha256(" ".join([c[2] for c in chunks]).encode()).hexdigest())
    return _map(df, path, id_col, text_col, columns, "n_tokens long ids_sha256 string decoded_sha256 string")


def word_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op10_trie_bpe(spark, sf_dir):
    return digest(table(spark, sf_dir, "documents"), word_bpe_path())
