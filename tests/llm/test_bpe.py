"""Operator 10 against the tokenizers library, which plays the brute force here."""

import hashlib

import pytest
from pyspark.sql import types as T

from pairgrid.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [
    "", "  ", None, "The the THE, that's 'small I'LL 'D", "a<|endoftext|>b <|startoftext|> c", "<|endoftext|>",
    "\x1c\x1f a\x85b　c d e", "ΑΣ Σ İstanbul ǅ ﬁ ½ ² Ⅻ 12 345 ١٢", "!!!???...---___ ((((( 😀😀👍🏽 é é",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaa hahahahahahahaha " + "x" * 5000, "日本語テキスト 한국어 ไทย हिन्दी", "tab\tnew\nline\r\n nul\x00",
    "und.34@mail7.example.com +1 (017) 555-7713 \"908038b7\"", "The the THE, that's 'small I'LL 'D",
]


def test_equals_library(spark):
    path = bpe.word_bpe_path()
    ref = tokenizers.Tokenizer.from_file(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, schema)
    want = [(i, ref.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows]
    enc = bpe.encode(df, path)
    assert sorted(enc.collect(), key=str) == sorted(want, key=str)
    back = {r[0]: r[1] for r in bpe.decode(enc, path).collect()}
    assert back == {i: ref.decode(ids, skip_special_tokens=False) for i, ids in want}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {tuple(r) for r in bpe.digest(df, path).collect()} == {
        (i, len(ids), sha(" ".join(map(str, ids))), sha(ref.decode(ids, skip_special_tokens=False))) for i, ids in want}


def test_whole_documents(spark):
    path = bpe.word_bpe_path()
    ref = tokenizers.Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, path).collect()}
    assert got == {r["doc_id"]: ref.encode(r["text"], add_special_tokens=False).ids for r in docs.collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digest(df, bpe.word_bpe_path()).collect() == []
