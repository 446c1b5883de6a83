"""Corpus pipeline: quality, near-duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it
returns is written as Parquet and read again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huescope.llm import decontaminate, neardup, packing, pii, quality
from huescope.llm.common import discard, discard_since, table, written, written_since
from huescope.llm.queries import vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; learned from all labels of the documents here."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.keep_good(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, one
    row of it if it is repeated."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact(docs, pii.learn(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' token ids, packed into sequences."""
    return packing.pack(docs, vocabulary_path())


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: A learned classifier, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = written_since()
        done = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # nothing reads a stage's own tables, or its input, once its output is written
        discard(docs)
        discard_since(spark, mark, done)
        docs = done
    return docs
