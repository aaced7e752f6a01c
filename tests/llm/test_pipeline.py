"""The pipeline against the plain versions of its stages, each on its own input."""

import hashlib

import pytest

import corpus_pipeline as P
from pairgrid.llm import bpe, toxicity
from tests.llm import test_decontaminate, test_jaccard_join, test_line_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    chain = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, chain).collect() if r["toxic"] >= toxicity.CUT}
    out = spark.createDataFrame(P.reject_toxic(spark, docs, SF).collect(), docs.schema)
    assert out.columns == columns and {r["doc_id"] for r in out.collect()} == rows.keys() - toxic

    before = sorted((r["doc_id"], r["text"]) for r in out.collect())
    out = spark.createDataFrame(P.drop_repeated_lines(spark, out, SF).collect(), docs.schema)
    want = {d: t for d, t, n, gone in test_line_dedup.brute(before) if gone < n or not gone}
    got = out.collect()
    assert out.columns == columns and {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)

    before = sorted(want.items())
    out = spark.createDataFrame(P.keep_one_of_near_copies(spark, out, SF).collect(), docs.schema)
    classes = {c for _, c, _, _ in test_jaccard_join.brute(before)}
    assert out.columns == columns and {r["doc_id"] for r in out.collect()} == classes

    before = sorted((r["doc_id"], r["text"]) for r in out.collect())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    out = spark.createDataFrame(P.drop_benchmark_text(spark, out, SF).collect(), docs.schema)
    clean = {d for d, _, hit, _ in test_decontaminate.brute(before, items) if not hit}
    assert out.columns == columns and {r["doc_id"] for r in out.collect()} == clean

    ref = tokenizers.Tokenizer.from_file(bpe.word_bpe_path())
    last = {tuple(r) for r in P.run(spark, SF).collect()}
    want = set()
    for r in out.collect():
        ids = ref.encode(r["text"], add_special_tokens=False).ids
        said = (" ".join(map(str, ids)), ref.decode(ids, skip_special_tokens=False))
        want.add((r["doc_id"], len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in said)))
    assert last == want
