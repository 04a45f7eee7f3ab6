"""Structured Streaming: a watched folder of pages, page events as they come, telemetry by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.plans.dialect import SPARK
from quire.plans.registry import RELATIONS, run_sql, spark_query


def watch(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, oldest first; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", "false").parquet(path)


def page_events(pages: DataFrame) -> DataFrame:
    """One event a page of (doc_id, text, image_count): stateless, so it appends without a watermark."""
    chars = f"length({X.strip(SPARK, 'text')})"
    return pages.selectExpr(
        "doc_id", "'page' AS kind", f"{X.page_quality(chars, 'image_count')} AS quality", f"{X.score_page(SPARK, 'text', 'image_count')} AS score"
    )


def telemetry_stream(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and mean confidence by window, page type and extractor; windows close ``late`` after their end."""
    text = RELATIONS["telemetry"](SPARK)
    read = events.selectExpr(*_columns(text)).withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        read.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "page_type", "extractor")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.sum("cost_usd").alias("cost_usd"))
        .select(F.col("window.start").alias("hour"), "page_type", "extractor", "n", "confidence", "cost_usd")
    )


def _columns(select: str) -> list[str]:
    """The items of a flat SELECT list, at commas outside parentheses."""
    body = select[len("SELECT ") : select.rindex(" FROM ")]
    out, depth, start = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(body[start:i].strip())
            start = i + 1
    return [*out, body[start:].strip()]


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events once each, for as long as the watermark keeps their ids."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def write_batches(stream: DataFrame, out: str, checkpoint: str):
    """Each micro-batch to its own folder, so a repeated batch replaces itself: exactly once for readers."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@spark_query
def session_windows(spark, sf_dir):
    """Sessions of users: events at most 30 minutes apart (the batch form of the streaming session window)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return (
        events.groupBy(F.session_window("ts", "30 minutes"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "value")
    )


__all__ = ["deduplicated", "page_events", "run_sql", "session_windows", "telemetry_stream", "watch", "write_batches"]
