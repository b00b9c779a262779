"""Streams: audits of pages as they arrive, and windowed counts of events. The batch transformations are reused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import AuditConfig
from ..operators import report
from ..sources import html


def page_stream(spark: SparkSession, folder: str, schema: str = "page_id bigint, url string, html string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def audit_stream(pages: DataFrame, config: AuditConfig, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's issues to a folder of its own below `out`, by the batch's id, so that a batch that is
    run again after a failure replaces what it wrote. Reading `out` gives all issues and the column batch. A block's
    issues are found, de-duplicated and merged in its own row."""
    return html.configured_blocks(pages, config).writeStream.foreachBatch(batch_writer(config, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_writer(config: AuditConfig, out: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        report.audit(batch, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def event_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling or sliding windows; events later than `late` are left out."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events with no gap of that length between them."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
