"""Registered queries of the training-data operators, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chunk_dedup, hilbert, language_id, licenses, line_dedup, mixing, ngram_join, packing, repetition, transport


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_t(spark, sf_dir, "documents"))


def op2_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a transport stream, read back with its payload."""
    return transport.demux(transport.encode(_t(spark, sf_dir, "documents"), lossy=False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_t(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicates(_t(spark, sf_dir, "documents"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shards(_t(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_t(spark, sf_dir, "documents"))


def op7_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.coverage(_t(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_t(spark, sf_dir, "documents"))


def op9_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_t(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.spans(_t(spark, sf_dir, "documents"))


_ALL = (
    op1_source_mix,
    op2_transport_streams,
    op3_language_id,
    op4_line_dedup,
    op5_hilbert_shards,
    op6_ngram_join,
    op7_repetition_coverage,
    op8_license_scan,
    op9_window_packing,
    op10_substring_dedup,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mix": mixing.sql(),
        "op5_hilbert_shards": hilbert.sql(),
        "op7_repetition_coverage": repetition.sql(),
    }
