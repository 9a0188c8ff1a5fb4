"""Streams over files: resumable scoring and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resume_files(spark: SparkSession, source: str, schema, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Apply ``step`` to files that no earlier run has finished, then stop; the checkpoint knows which those are."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = step(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def first_seen(events: DataFrame, key: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark: state is bounded by the delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, ts: str, kind: str, value: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window; runs on streams and on tables."""
    g = events.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), kind)
    return g.agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")
