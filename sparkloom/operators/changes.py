"""Snapshots and change sets: who wrote last, what changed, replay, sampling and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_writer(writes: DataFrame, cell: list[str], order: list[str]) -> DataFrame:
    """State of each cell from its last write in ``order``; state 0 and null write nothing. A maximum, reduced before it is shuffled."""
    kept = writes.where("state <> 0").groupBy(*cell).agg(F.max(F.struct(*order, "state")).alias("w"))
    return kept.select(*cell, F.col("w.state").alias("state"))


def diff(before: DataFrame, after: DataFrame, cell: list[str]) -> DataFrame:
    """``(op, cell, state)`` that leads from one snapshot to the next: ``clear`` what is gone, ``fill`` what is new or has another state."""
    both = before.select(*cell, F.col("state").alias("b"), F.lit(True).alias("was")).join(after.select(*cell, F.col("state").alias("a"), F.lit(True).alias("is")), cell, "full")
    op = F.when(F.col("is").isNull(), "clear").when(F.col("was").isNull() | ~F.col("a").eqNullSafe(F.col("b")), "fill")
    return both.select(op.alias("op"), *cell, F.coalesce("a", F.lit(0)).alias("state")).where("op is not null")


def series_diffs(series: DataFrame, cell: list[str], last: int) -> DataFrame:
    """Change sets ``(tick, op, cell, state)`` of a series of snapshots ``(tick, cell, state)`` up to tick ``last``, by one
    shuffle: each cell's row is met by its own at the tick before and the one after."""
    w = W.partitionBy(*cell).orderBy("tick")
    seen = series.withColumn("p", F.lag("tick").over(w)).withColumn("ps", F.lag("state").over(w)).withColumn("n", F.lead("tick").over(w))
    filled = seen.where((F.col("p").isNull() | (F.col("p") < F.col("tick") - 1) | ~F.col("ps").eqNullSafe(F.col("state"))))
    cleared = seen.where((F.col("tick") < last) & (F.col("n").isNull() | (F.col("n") > F.col("tick") + 1)))
    return filled.select("tick", F.lit("fill").alias("op"), *cell, "state").unionByName(cleared.select((F.col("tick") + 1).alias("tick"), F.lit("clear").alias("op"), *cell, F.lit(0).alias("state")))


def replay(snapshot: DataFrame, changes: DataFrame, cell: list[str]) -> DataFrame:
    """``snapshot`` after ``changes`` (``tick, op, cell, state``), the latest of each cell deciding, a fill after a clear of the same tick."""
    last = changes.groupBy(*cell).agg(F.max(F.struct("tick", (F.col("op") == "fill").alias("fill"), "state")).alias("c")).select(*cell, F.col("c.fill").alias("fill"), F.col("c.state").alias("new"))
    both = snapshot.join(last, cell, "full").where(F.col("fill").isNull() | F.col("fill"))
    return both.select(*cell, F.when(F.col("fill"), F.col("new")).otherwise(F.col("state")).alias("state"))


def cleared(placed: DataFrame, cell: list[str]) -> DataFrame:
    """Writes of state 0 to all cells that were ever placed."""
    return placed.select(*cell).distinct().withColumn("state", F.lit(0))


def sampled(series: DataFrame, every: int) -> DataFrame:
    """Snapshots of each ``every``-th tick."""
    return series.where(F.col("tick") % every == 0)


def differences(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Cells ``(key, side)`` that two series don't share: ``left``, ``right`` or ``both`` (with other values)."""
    x = a.select(*key, F.struct(*values).alias("va"))
    y = b.select(*key, F.struct(*values).alias("vb"))
    side = F.when(F.col("vb").isNull(), "left").when(F.col("va").isNull(), "right").when(~F.col("va").eqNullSafe(F.col("vb")), "both")
    return x.join(y, key, "full").select(*key, side.alias("side")).where("side is not null")


def first_difference(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """The first of them in the order of ``key``; no row if the series are equal."""
    return differences(a, b, key, values).orderBy(*key).limit(1)
