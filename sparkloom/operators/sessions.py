"""Sessions of clients: gaps, time-outs, ends; lists of who is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gaps(events: DataFrame, key: str = "user_id", time: str = "ts", ping_after: int = 15, drop_after: int = 30) -> DataFrame:
    """Seconds since each client's last sign of life, and what they mean: ``alive``, ``ping`` (over 15 s) or ``drop`` (over 30 s).
    A first event is ``join``; equal times are in no order and have gap 0. Rows without key or time are left out."""
    w = W.partitionBy(key).orderBy(time)
    micros = F.unix_micros(time)
    gap = (micros - F.lag(micros).over(w)) / F.lit(1e6)
    known = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, gap.alias("gap"))
    what = F.when(F.col("gap").isNull(), "join").when(F.col("gap") > drop_after, "drop").when(F.col("gap") > ping_after, "ping").otherwise("alive")
    return known.withColumn("what", what)


def deadlines(events: DataFrame, key: str = "user_id", time: str = "ts", ping_after: float = 15, drop_after: float = 30, until: int | None = None) -> DataFrame:
    """What a server does while clients are silent: ``send ping`` at ``ping_after`` seconds after each sign of life and ``send drop`` at ``drop_after``, if the
    next one hasn't come by then. ``until`` (microseconds; else the last time of all clients) ends what comes after a client's last sign.
    Rows without key or time are left out. Returns ``key, us, what``."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    known = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, us.alias("us"))
    after = F.lead("us").over(W.partitionBy(key).orderBy("us"))
    last = known.agg(F.max("us").alias("end")) if until is None else known.sparkSession.range(1).select(F.lit(until).cast("long").alias("end"))
    next_ = known.withColumn("next", after).join(F.broadcast(last)).withColumn("before", F.coalesce("next", F.col("end") + 1))
    whats = F.array(*[F.struct(F.lit(w).alias("what"), F.lit(round(s * 1e6)).cast("long").alias("after")) for w, s in (("send ping", ping_after), ("send drop", drop_after))])
    each = next_.select(key, "us", "before", F.inline(whats))
    return each.where(F.col("us") + F.col("after") < F.col("before")).select(key, (F.col("us") + F.col("after")).alias("us"), "what")


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", timeout: str = "30 seconds") -> DataFrame:
    """Runs of events of a client without a gap of ``timeout``: start, end (last event) and number of events."""
    return events.groupBy(key, F.session_window(time, timeout).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max(time).alias("last")).select(key, F.col("w.start").alias("start"), "last", "events")


def present(events: DataFrame, key: str, most: int = 10) -> DataFrame:
    """Number of clients and a sample of at most ``most`` of them, the smallest first."""
    ids = events.select(key).where(F.col(key).isNotNull()).distinct()
    some = ids.orderBy(key).limit(most).agg(F.sort_array(F.collect_list(key)).alias("sample"))
    return ids.agg(F.count(F.lit(1)).alias("clients")).join(some)


def recent(uses: DataFrame, key: str, order: str, most: int = 128) -> DataFrame:
    """The ``most`` values used last, latest first: what a bounded move-to-front list holds."""
    last = uses.groupBy(key).agg(F.max(order).alias("used")).orderBy(F.desc("used"), key).limit(most)
    return last.withColumn("place", F.row_number().over(W.orderBy(F.desc("used"), key)))
