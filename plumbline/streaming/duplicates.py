"""Incremental counts of repeated contents over a stream: an addition, for batch tables need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of a key by time window; state older than the watermark is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.min(time).alias("first"))


def first_seen(records: DataFrame, time: str, digest: str, late: str = "1 day") -> DataFrame:
    """Records whose content hasn't been seen within the watermark."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark([digest])
