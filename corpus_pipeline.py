"""From raw documents to token files: the text operators, one after another.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. Its result is stored as Parquet and read again as the next stage's docs. All
stages but the last return the columns of ``documents``. Every stage takes what its
operator takes: null and empty texts, ties and repeated rows, empty tables and
further columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from termweave.llm import op2_decontamination, op4_simhash, op5_language, op7_mixing, op10_tokens
from termweave.llm.common import send_code, table
from termweave.storage import fresh_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the classifier learns from the labels of documents that are not held out."""
    send_code(spark)
    return op5_language.accepted(docs, op5_language.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    send_code(spark)
    return op4_simhash.without_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return op2_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document as often as it is taken."""
    return op7_mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per document (copies one by one) what the files say."""
    send_code(spark)
    return op10_tokens.token_files(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("tokens", tokens),
]

#: Classifiers, fingerprints and tokens cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents`` on; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
