"""The corpus pipeline: quality, toxicity, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; all but the last
return the columns of ``documents``.

Defined cases, for all stages: other columns of ``docs`` pass through as they are, whatever their names; an empty table
gives an empty table; texts are used whole; repeated rows are treated alike. What a null or empty text, a null id, a tie
and a repeated row mean is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talus.llm import jaccard_join, mixing, packing, quality, toxicity
from talus.llm.common import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose lines are mostly boilerplate go.

    Null and empty texts have no words and go. Rows with a null id are judged by their text. Without labels of both kinds only
    the base rules reject. A content share of exactly the least one stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept_documents(docs, quality.train(docs, labels))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    Null and empty texts have no cue and stay, and so do all documents where labels of both kinds are missing. A score at
    the threshold goes. Null ids are judged by their text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_documents(docs, toxicity.train(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that with the smallest id (a null id only where a class has no other).

    Null texts and texts without words are no duplicates and all stay. Of rows that repeat an id and a text one stays.
    """
    return jaccard_join.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have size 0 and are never taken. A null source is a source of its own, last in order. Ties in
    the queue go by source, hash and id; repeated rows are separate documents.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents and their places in sequences.

    A null or empty text is one piece with the closing id alone; repeated rows and null ids are packed as any other, and
    pieces of one length are interchangeable.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Viterbi decoding, chosen paths and the configuration program have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k + 1}")
    return docs
