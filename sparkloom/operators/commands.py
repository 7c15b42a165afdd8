"""Commands that are scheduled for a tick, and cleared again before it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.asof import next_after


def parse_schedule(commands: DataFrame, known: Iterable[str]) -> DataFrame:
    """``sched T command args..`` and ``clear_sched`` of a table of commands (``command, args`` and whatever else, such as ``nth``) as the columns ``verb``
    (``sched``, ``clear``), ``due``, ``scheduled`` and ``scheduled_args``. Other commands, a ``sched`` without a tick and a command, with a tick that is no
    whole number from 0 on, or of a command that isn't ``known`` are left out."""
    rest = [c for c in commands.columns if c not in ("command", "args")]
    tick = F.when(F.try_element_at("args", F.lit(1)).rlike(r"^[0-9]{1,18}$"), F.try_element_at("args", F.lit(1)).try_cast("bigint"))
    what = F.try_element_at("args", F.lit(2))
    clear = F.col("command") == "clear_sched"
    rows = commands.where(clear | ((F.col("command") == "sched") & tick.isNotNull() & what.isin(*known)))
    others = F.slice("args", 3, F.greatest(F.size("args") - 2, F.lit(0)))
    return rows.select(
        *rest, F.when(clear, "clear").otherwise("sched").alias("verb"), F.when(~clear, tick).alias("due"), F.when(~clear, what).alias("scheduled"), F.when(~clear, others).alias("scheduled_args")
    )


def lifetimes(entries: DataFrame, by: list[str]) -> DataFrame:
    """Scheduled entries with ``cleared``: the tick of the first clear after them, null if none comes. ``entries`` has ``by`` (whose schedule it is), ``tick`` at
    which it was entered, ``nth`` (its place among all entries of ``by``), ``verb``, ``due``. An as-of join, each entry's life ends at the clear after it."""
    scheduled = entries.where("verb = 'sched'").drop("verb")
    clears = entries.where("verb = 'clear'").select(*by, "tick", "nth")
    return next_after(scheduled, clears, by, ["tick", "nth"]).withColumnRenamed("next_tick", "cleared").drop("next_nth")


def firings(entries: DataFrame, by: list[str]) -> DataFrame:
    """Entries that run, each once, with ``tick`` now the tick at which they do, ``nth`` their order within it and ``entered`` the tick they were entered at.

    A schedule is looked at once, at the beginning of a tick, and runs what is due at exactly that tick; what is entered at a tick comes after that. So an
    entry runs if it is due after the tick it was entered at, and not cleared at an earlier tick than it is due. Entries without due tick or place never run.
    Repeated entries run each."""
    alive = lifetimes(entries.where("tick is not null AND nth is not null"), by)
    run = alive.where("due > tick AND (cleared is null OR cleared >= due)")
    return run.withColumnRenamed("tick", "entered").withColumnRenamed("due", "tick").drop("cleared")
