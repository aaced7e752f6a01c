"""Pipeline over ``documents``: toxicity, line dedup, n-gram Jaccard join, benchmark
decontamination, BPE encoding and decoding.

Each stage reads all that the one before kept (written as Parquet in between) and all
but the last return the columns of documents. A document goes when the toxicity chain
rejects it, when nothing is left of it after its repeated lines are gone, when another
one of its near-duplicate group stays, or when it holds a benchmark window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrid.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from pairgrid.llm.common import materialize, table
from pairgrid.session import ship_package


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labels, does not reject."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines, n_chars counted anew; those of
    which no text is left are out, documents that were empty before stay."""
    ship_package(spark)
    cut = line_dedup.dedup_lines(docs)
    names = [f"c{i}" for i in range(len(docs.columns))]
    cut = cut.toDF(*names, "total", "removed", "runs")
    text, size = (names[docs.columns.index(c)] for c in ("text", "n_chars"))
    kept = cut.where((F.col("removed") == 0) | (F.col("removed") < F.col("total")))
    return kept.withColumn(size, F.when(F.col("removed") > 0, F.char_length(text).cast("long")).otherwise(F.col(size))).select(*names).toDF(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that is linked by a shingle similarity of 0.8 or more."""
    ship_package(spark)
    return jaccard_join.keep_one(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each remaining text."""
    ship_package(spark)
    return bpe.digest(docs, bpe.word_bpe_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_text),
    ("bpe", encode),
]

#: The trained classifier has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
