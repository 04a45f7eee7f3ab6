"""Readers of other extractors' output and of ground-truth files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("filename", "file", "path")
TEXTS = ("text", "content", "output")


def _stem(col):
    return F.regexp_extract(col, r"([^/]+?)(\.gt)?(\.[A-Za-z]+)?$", 1)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of a CSV or JSON file whose columns go by any of the usual names; the name is the file's own."""
    df = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.csv(path, header=True, multiLine=True, escape='"')
    by = {c.lower(): c for c in df.columns}
    name = next((by[c] for c in NAMES if c in by), None)
    text = next((by[c] for c in TEXTS if c in by), None)
    if name is None or text is None:
        raise ValueError(f"no name or text column among {df.columns}")
    return df.select(F.element_at(F.split(F.col(name), "/"), -1).alias("name"), F.col(text).alias("text"))


def ground_truth(spark: SparkSession, root: str) -> DataFrame:
    """(page_type, stem, truth) of every ``*.gt.md`` below ``root``; the folder names the type."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.gt.md").load(root)
    path = F.col("_metadata.file_path")
    return files.select(F.element_at(F.split(path, "/"), -2).alias("page_type"), _stem(path).alias("stem"), F.col("value").alias("truth"))
