"""Streaming first-wins dedup: beyond the batch operators, for sources that never end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_lines(stream: DataFrame, text: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose normalized line has not come within the watermark's delay; state is bounded by it."""
    return stream.withColumn("_k", F.md5(F.lower(F.trim(F.col(text))))).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_k"]).drop("_k")
