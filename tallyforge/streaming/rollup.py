"""An extension beside the batch operators: the roll-up of weekly facts as a stream with event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Per window and event type: count and sum. The same for a batch and for a stream, where rows later than `late` are
    left out and state for closed windows is dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
