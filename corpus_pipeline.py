"""A corpus pipeline of five stages: each takes what the one before it kept, as documents.

Quality rules and quality classifier drop what they reject, the n-gram join leaves one document of
each group, the mix repeats and cuts sources to their weights, and packing, the last, returns where
each piece of each text goes.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import classifier, mixing, outliers, packing, setjoin
from graphloom.llm.common import settle, table
from graphloom.storage import discard_unread, recorded

_LEFT: list[DataFrame] = []


def _stage(f):
    """What earlier stages settled on their way goes when the next one begins, unless its `docs` still reads it."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_unread(_LEFT, docs)
        _LEFT.clear()
        with recorded() as tables:
            out = f(spark, docs, sf_dir)
        _LEFT.extend(tables)
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose text statistics are outliers for their language and source, and without wordless ones."""
    return outliers.keep_documents(docs)


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that their own evidence and that of their site make out to be poor; fitted on the table `labels`."""
    return classifier.keep_documents(docs, table(spark, sf_dir, "labels"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, and all without any."""
    return setjoin.keep_documents(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated and cut to their weights."""
    return mixing.mix_documents(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each text goes: a row for each piece, not documents."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: Estimation, training and packing are iterative; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
