"""The corpus pipeline: each stage's output is written as Parquet, in the shared folder, and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalens.llm import bpe, mixing, near_dedup, pii, quality
from stratalens.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trusted target's n-grams speak against go."""
    return quality.drop_bad(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.drop_near_copies(docs)


def private_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kinds."""
    return pii.masked(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the order of the mixture's schedule; those of sources above their natural share come again."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of the text."""
    return bpe.encoded(docs)


STAGES = [("quality_rules", quality_rules), ("near_copies", near_copies), ("private_spans", private_spans), ("source_mixing", source_mixing), ("byte_bpe", byte_bpe)]

#: Near copies, spans and ids are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
