"""A frequency table that follows a stream of rows: the same counts that statistics take from a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.statistics import frequencies


def windowed_counts(events: DataFrame, time: str, key: str, window: str, lateness: str) -> DataFrame:
    """(start, end, key, n): rows per window and key; rows later than lateness are left out, and their state goes."""
    parts = events.withWatermark(time, lateness).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))
    return parts.select("window.start", "window.end", key, "n")


def follow_frequencies(stream: DataFrame, columns: list[str], name: str, checkpoint: str) -> StreamingQuery:
    """Keep the frequency table of a stream's columns (of one type class) as an in-memory table until the input ends."""
    return frequencies(stream, columns).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
