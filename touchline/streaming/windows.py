"""Counts and sums of events in tumbling windows, for streams and tables alike (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sums(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, key, n, total); ``late`` sets the watermark of a stream."""
    df = events.withColumn(time, F.col(time).cast("timestamp"))
    df = df.withWatermark(time, late) if late and df.isStreaming else df
    out = df.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")
