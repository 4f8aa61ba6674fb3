"""Streaming forms: hourly volumes with late data, and first-writer-wins rows per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, ts: str = "ts", by: str = "event_type", late: str = "2 hours") -> DataFrame:
    """Rows and total value of each hour; works on streams (append) and tables alike."""
    hours = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), by)
    return hours.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), by, "n", "total")


def first_rows(events: DataFrame, key: list[str], ts: str = "ts", late: str = "8 days") -> DataFrame:
    """The first row of each key within the watermark."""
    if events.isStreaming:
        return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)
