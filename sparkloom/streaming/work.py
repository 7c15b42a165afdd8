"""Scheduled work, sessions and snapshots as streams. Each gives what its batch form gives on the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_work(stream: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Scheduled work ``(x, y, z, type, trigger_tick)`` without repetitions: state is kept for as long as repetitions may be ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["x", "y", "z", "type", "trigger_tick"])


def counts(stream: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Events and values by window of time."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def live_sessions(stream: DataFrame, key: str = "user_id", time: str = "ts", timeout: str = "30 seconds", late: str = "1 hour") -> DataFrame:
    """Sessions of clients, given out once no event can be added to them any more."""
    windows = stream.withWatermark(time, late).groupBy(F.session_window(time, timeout).alias("w"), key)
    return windows.agg(F.count(F.lit(1)).alias("events"), F.max(time).alias("last")).select(key, F.col("w.start").alias("start"), "last", "events")


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``apply`` (such as a write of snapshots, once for each batch number) over what is there now."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
