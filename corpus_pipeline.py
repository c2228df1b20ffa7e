"""The training-text pipeline over `documents`: each stage's result is written as Parquet and reread for the next.

A stage's intermediate tables are deleted when the next stage starts, as its result has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from busloom.llm import decontamination, mixing, near_dedup, private_data, quality
from busloom.llm.store import collected, drop, read_table, settle

#: similarity of the stage's near duplicates, in percent
NEAR_PERCENT = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: tables of the last stage, by application
_left_over: dict[str, list[str]] = {}


def staged(stage: Stage) -> Stage:
    """The stage, after deleting what stages before it settled."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = _left_over.setdefault(spark.sparkContext.applicationId, [])
        drop(spark, before)
        with collected() as paths:
            out = stage(spark, docs, sf_dir)
        before.extend(paths)
        return out

    return run_stage


@staged
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


@staged
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more) stays."""
    return near_dedup.keep_one(docs, NEAR_PERCENT)


@staged
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    return decontamination.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


@staged
def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced in the texts; n_chars follows."""
    return private_data.sanitised(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat so that sources meet their target weights; `copy` numbers the repeats."""
    # the last stage's own few rows stay, as its result may be read at any time
    drop(spark, _left_over.get(spark.sparkContext.applicationId, []))
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("private_data", private_data_stage),
    ("source_mixing", mixing_stage),
]
#: the classifier and the sanitiser can't be expressed in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs
