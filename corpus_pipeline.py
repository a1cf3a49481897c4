"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

language ID -> line dedup -> near-dedup -> mixing -> packing. All but the last return the columns of documents.

Defined results: a null text or one without letters goes with language ID; a null lang is not learned from; null sources are one
source; a null doc_id keeps its lines and is no near-duplicate; an empty text left by line dedup stays, and is one end id when packed;
rows that occur twice are one document for line dedup and near-dedup and two for mixing and packing; further columns, whatever
their names, are carried along; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import common, lang_id, line_dedup, mixing, near_dedup, packing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier can tell; those without letters or below its least probability go."""
    return lang_id.keep_known(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that five or more documents share, but for the largest doc_id's."""
    return line_dedup.dedup_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked at a similarity of 0.8 or more."""
    return near_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated, cut or left out so that sources come to their target weights."""
    return mixing.repeat_texts(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned weights and token ids are beyond SQL; tests compare with a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
