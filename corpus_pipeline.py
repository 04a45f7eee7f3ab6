"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard dedup, source mixing, packing.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes
as Parquet into shared storage and rereads as the next one's ``docs``; tables that a stage made on its way are dropped
when the next one begins. All but the last return the columns of
``documents``; the last returns one row for each piece of a text in its window.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quire.llm import _common, line_dedup, mixing, ngram_join, packing, repetition


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _common.drop_noted(docs)
        with _common.tables_noted():
            return f(spark, docs, sf_dir)

    return go


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.reject(docs)


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, alike or nearly so, in an earlier place; emptied documents go."""
    return line_dedup.apply(docs)


@_stage
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return ngram_join.apply(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the low-discrepancy schedule shows them, each at least once."""
    return mixing.apply(docs)


@_stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every text with its window, place and words."""
    return packing.pack(docs, with_text=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("source_mix", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is a table in shared storage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = _common.cut(stage(spark, docs, sf_dir))
    return docs


#: MinHash banding, union-find and least squares have no SQL twin; the stages are tested against brute force.
ORACLE_SQL: str | None = None
