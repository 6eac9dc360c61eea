"""A corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) with docs as the stage before left it, and is written as Parquet and read
again. All but the last return the columns of documents.

Nulls, empty and very long texts and ties are handled as the operators' modules say: a null or empty text is scored like
any other, is no near-duplicate, holds no benchmark item and is packed as its end id. Documents without doc_id go
through all stages; of a repeated row one goes on from near_duplicates. Extra columns are carried to packing,
whatever their names. Of empty tables nothing comes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomstead.llm import decontam, neardup, packing, quality
from loomstead.llm.common import read, settled, small_batches


def _bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with texts on their way to Python in small batches."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_bounded
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels", "doc_id", "quality"), threshold=0.3)


@_bounded
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return neardup.keep_first(docs)


@_bounded
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontam.without_leaks(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


@_bounded
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=1)


STAGES = [
    ("quality_classifier", good_documents),
    ("near_duplicates", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settled(partial(stage, spark, docs, sf_dir))
    return docs
