"""Work that a timer releases: keep-alive of clients and scheduled work, as streams with state.

Time is that of the events. A stream's clock is its watermark; what a timer is set for happens when the watermark has passed it, so the result depends on
neither micro-batches nor restarts, and equals that of the batch form on all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """State with timers is kept in the embedded store; to be set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Released(StatefulProcessor):
    """Holds rows until the watermark has passed their time; then they are handled in their order, and so are the deadlines between them."""

    PENDING = "us long, n long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "us long", "n long")

    def close(self) -> None:
        pass

    def hold(self, times: Iterator[pd.Series]) -> None:
        for series in times:
            for us, n in series.value_counts().items():
                had = self.pending.getValue((us,))[0] if self.pending.containsKey((us,)) else 0
                self.pending.updateValue((us,), (had + int(n),))

    def passed(self, upto: int) -> list[tuple[int, int]]:
        """Held times up to ``upto`` and how often each is there, earliest first; they are no longer held."""
        out = sorted((us, n) for (us,), (n,) in self.pending.iterator() if us <= upto)
        for us, _ in out:
            self.pending.removeKey((us,))
        return out

    def wake_at(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))


class KeepAlive(_Released):
    """State of a client: when it was last heard, and which of its deadlines have been told of."""

    SCHEMA = "client string, us long, gap double, what string"

    def __init__(self, ping_after: float, drop_after: float, forget_after: int | None) -> None:
        self.ping, self.drop, self.ttl = round(ping_after * 1e6), round(drop_after * 1e6), forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "us long, pinged boolean, dropped boolean", *([self.ttl] if self.ttl else []))

    def _advance(self, client: str, upto: int) -> pd.DataFrame:
        out: list[tuple[str, int, float | None, str]] = []
        us, pinged, dropped = self.last.get() if self.last.exists() else (None, False, False)

        def deadlines(now: int) -> None:
            nonlocal pinged, dropped
            if us is not None:
                if not pinged and us + self.ping < now:
                    out.append((client, us + self.ping, self.ping / 1e6, "send ping"))
                    pinged = True
                if not dropped and us + self.drop < now:
                    out.append((client, us + self.drop, self.drop / 1e6, "send drop"))
                    dropped = True

        for at, n in self.passed(upto):
            deadlines(at)
            gap = None if us is None else at - us
            what = "join" if gap is None else "drop" if gap > self.drop else "ping" if gap > self.ping else "alive"
            out.append((client, at, None if gap is None else gap / 1e6, what))
            out += [(client, at, 0.0, "alive")] * (n - 1)
            us, pinged, dropped = at, False, False
        deadlines(upto + 1)
        if us is not None:
            self.last.update((us, pinged, dropped))
            if not pinged:
                self.wake_at(us + self.ping)
            if not dropped:
                self.wake_at(us + self.drop)
        return pd.DataFrame(out, columns=["client", "us", "gap", "what"]).astype({"us": "int64", "gap": "float64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = [r["us"] for r in rows]
        self.hold(iter(known))
        for us in {int(u) for s in known for u in s}:
            self.wake_at(us)
        yield self._advance(key[0], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key[0], timerValues.getCurrentWatermarkInMs() * 1000)


def keep_alive(stream: DataFrame, key: str = "user_id", time: str = "ts", ping_after: float = 15, drop_after: float = 30, late: str = "10 seconds", forget_after: int | None = None) -> DataFrame:
    """Signs of life of clients as ``sessions.gaps`` tells them (``join, alive, ping, drop``, with the gap before), and what a server does in between, when
    it is due: ``send ping`` at ``ping_after`` seconds after the last sign and ``send drop`` at ``drop_after``, which no later event is needed for.

    Rows may come in any order within ``late``. A client's state is its last sign and the signs that the clock hasn't reached yet. It stays for ever unless
    ``forget_after`` (milliseconds without a sign, by the clock of the machines) is given; a client that was forgotten joins again. Rows without key or time
    are left out. Returns ``client, us, gap, what``."""
    use_timers(stream.sparkSession)
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).cast("string").alias("client"), F.col(time).alias("_time"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    timed = rows.withWatermark("_time", late).groupBy("client")
    return timed.transformWithStateInPandas(KeepAlive(ping_after, drop_after, forget_after), KeepAlive.SCHEMA, "Append", "EventTime")


class DueWork(_Released):
    """State of a piece of work: the ticks that it waits for."""

    def __init__(self, names: list[str], tick_us: int) -> None:
        self.names, self.tick_us = names, tick_us

    def _release(self, key: tuple, upto: int) -> pd.DataFrame:
        ticks = [us // self.tick_us for us, _ in self.passed(upto)]
        return pd.DataFrame({**{c: [k] * len(ticks) for c, k in zip(self.names, key, strict=True)}, "trigger_tick": pd.Series(ticks, dtype="int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = [r["trigger_tick"] * self.tick_us for r in rows]
        self.hold(iter(known))
        for us in {int(u) for s in known for u in s}:
            self.wake_at(us)
        yield self._release(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._release(key, timerValues.getCurrentWatermarkInMs() * 1000)


def due_work(stream: DataFrame, time: str = "ts", tick_ms: int = 50, late: str = "0 seconds", names: tuple[str, ...] = ("x", "y", "z", "type")) -> DataFrame:
    """Scheduled work (``names, trigger_tick`` and the event time ``time`` of its entry; tick ``n`` is at ``n * tick_ms`` of that time) once the clock has reached
    its tick. Equal work for one tick is released once, as long as it waits. Work for a tick that has passed is released at once. Rows without a tick are left out.
    Returns ``names, trigger_tick``."""
    use_timers(stream.sparkSession)
    known = stream.where(F.col("trigger_tick").isNotNull()).select(*names, F.col("trigger_tick").cast("long").alias("trigger_tick"), time).withWatermark(time, late)
    schema = stream.select(*names).schema
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", trigger_tick long"
    return known.groupBy(*names).transformWithStateInPandas(DueWork(list(names), tick_ms * 1000), out, "Append", "EventTime")
