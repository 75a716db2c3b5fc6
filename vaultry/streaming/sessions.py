"""Activity sessions separated by silence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str | None = None) -> DataFrame:
    """One row per session of a key: start, end, events.

    Works on batch and streaming input; a stream needs ``late``, how long to wait for late rows.
    Speaker changes do not end a session, which is why transcripts use their own block rule.
    """
    timed = events.withWatermark(time, late) if late else events
    grouped = timed.groupBy(key, F.session_window(time, gap).alias("session"))
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.max(time).alias("last_event")).select(
        key, F.col("session.start").alias("start"), "last_event", "events"
    )
