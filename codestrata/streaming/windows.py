"""Counts over event time. An extra for pipelines that receive events; nothing here is needed by the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows per tumbling window and key; of a stream, windows close when the watermark has passed them by `late`.

    Works on batches too, where nothing is late. Rows with a null time are in no window.
    """
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), key, "events")
