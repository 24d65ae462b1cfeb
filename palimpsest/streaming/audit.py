"""The tumbling audit on a stream of events, with a watermark; equal to its batch form once all data is in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events (batch or stream) counted per type and window; rows later than the watermark are left out of a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    out = e.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", "total")
