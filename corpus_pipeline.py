"""Corpus pipeline: documents -> good, distinct, uncontaminated, redacted documents -> the mix.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns what
it keeps. Each stage's result is written as Parquet and read again as the next one's input.

All stages take any further columns along (a column ``copy`` is replaced by the mix), whatever their
names, and give no rows for an empty table; texts of any length are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from synthscope.llm import decontam, mixing, neardup, pii, quality
from synthscope.llm.common import forget, shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (fitted on the labelled ones among them) does not reject.

    A null text is judged as an empty one; rows without an id are judged but not learnt from;
    repeated rows are judged alike; a score of exactly 0.5 (as without labels) keeps a row.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group, found by SimHash and by min-hashes and held against the texts.

    Null and blank texts are one group; rows without an id stay; different texts under one id
    are judged each by itself; of repeated rows one stays.
    """
    return neardup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and blank texts contain none; each row, with an id or without, is judged by its own text."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind. Null texts stay null; repeated rows stay."""
    return pii.redact_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for, numbered by ``copy``.

    A null source is a source of its own; null and blank texts have size 0 and come along as their
    source's other documents do; rows of one id go together, rows without one by their text.
    """
    return mixing.mix_sources(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("mixing", mixing_stage)]

#: The stages have no common SQL (min-hashes, a fitted classifier, a fitted field).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to the mix. A stage's folder goes when the next stage has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            forget(spark, before)
        before = path
    return docs
