"""The extractor contract as a Python data source: page rows from any reader that is registered, pages pushed down."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = "doc_id string, page_num int, text string, image_count int, extractor string, ocr_applied boolean, confidence double, cost_usd double, error string"
Reader = Callable[[str], Iterator[tuple[int, str, int]]]

#: name -> (priority, default confidence, cost of a page, whether it is OCR)
REGISTRY: dict[str, tuple[int, float, float, bool]] = {
    "fast": (10, 1.0, 0.0, False),
    "opendataloader": (15, 0.92, 0.0, False),
    "rapidocr": (20, 0.85, 0.0, True),
    "mistral_ocr": (25, 0.93, 0.002, True),
    "surya": (30, 0.80, 0.0, True),
    "marker": (35, 0.90, 0.0, False),
    "docling": (40, 0.95, 0.0, False),
    "llm": (50, 0.85, 0.01, True),
}


def text_pages(path: str) -> Iterator[tuple[int, str, int]]:
    """Plain text: form feeds part pages."""
    with open(path, encoding="utf-8", errors="replace") as f:
        for i, t in enumerate(f.read().split("\f")):
            yield i, t, 0


class Pages(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ExtractorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.name = options.get("extractor", "fast")
        self.pages = set(json.loads(options["pages"])) if options.get("pages") else None

    def partitions(self) -> list[InputPartition]:
        return [Pages(p) for p in self.paths]

    def read(self, partition: Pages) -> Iterator[tuple]:
        _, conf, cost, ocr = REGISTRY[self.name]
        name = partition.path.rsplit("/", 1)[-1]
        try:
            for i, text, images in text_pages(partition.path):
                if self.pages is None or i in self.pages:
                    yield name, i, text, images, self.name, ocr, conf if text.strip() else 0.0, cost, None
        except OSError as e:
            # one document's failure is a row of the batch, not the batch's
            yield name, 0, "", 0, self.name, ocr, 0.0, 0.0, f"PDF_NOT_FOUND: {e.strerror}"


class ExtractorSource(DataSource):
    """``spark.read.format("quire_pages").option("paths", json).option("pages", json).load()``; a task a document."""

    @classmethod
    def name(cls) -> str:
        return "quire_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return ExtractorReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExtractorSource)


def available(names: set[str] | None = None) -> list[str]:
    """Registered extractors by priority."""
    return sorted((n for n in REGISTRY if names is None or n in names), key=lambda n: REGISTRY[n][0])
