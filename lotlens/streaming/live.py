"""Streaming versions (extensions): daily counts, first-wins deduplication and latest value per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, ts: str, key: str, late: str = "1 day") -> DataFrame:
    """Events per key and day; a day closes once the watermark has passed it."""
    at = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return at.groupBy(F.window(ts, "1 day"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), key, "n")


def first_wins(events: DataFrame, ts: str, keys: list[str], within: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark; state is dropped after it."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def latest_values(events: DataFrame, ts: str, key: str, value: str) -> DataFrame:
    """The last value per key so far (update mode)."""
    return events.groupBy(key).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))
