"""Summaries in levels: change sets merged by powers of two of ticks, and digests that find where two series differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import broadcast_if_small, cut

#: Ticks or parts of a request that are sent to every executor; more are joined by a shuffle.
FEW = 100_000


def merged_changes(changes: DataFrame, cell: list[str], last: int) -> DataFrame:
    """Change sets ``(tick, op, cell, state)`` of ticks 1 to ``last``, merged: ``level, block, cell, tick, fill, state``.

    Block ``b`` of level ``n`` has, for each cell that changes in ticks ``b * 2**n + 1`` to ``(b + 1) * 2**n``, its last change there (a fill after a clear of
    the same tick). Each level is made from the one below, so a change is read once a level until a later one of its cell takes its place; blocks that reach
    beyond ``last`` aren't kept. Written once, it answers for any tick."""
    latest = F.max(F.struct("tick", "fill", "state")).alias("c")
    level = changes.where(F.col("tick").between(1, last)).select((F.col("tick") - 1).alias("block"), *cell, F.col("tick").cast("long").alias("tick"), (F.col("op") == "fill").alias("fill"), "state")
    level = level.groupBy("block", *cell).agg(latest).select("block", *cell, "c.*")
    out, n = [], 0
    while True:
        level = cut(level.select(F.lit(n).alias("level"), F.col("block").cast("long").alias("block"), *cell, "tick", "fill", "state"), "merged-changes")
        out.append(level)
        n += 1
        if (1 << n) > last:
            return reduce(DataFrame.unionByName, out)
        whole = level.where((F.shiftright("block", 1) + 1) * (1 << n) <= last)
        level = whole.groupBy(F.shiftright("block", 1).alias("block"), *cell).agg(latest).select("block", *cell, "c.*")


def blocks_of(ticks: DataFrame, last: int) -> DataFrame:
    """For each of ``ticks`` (``at``, up to ``last``), the blocks whose changes lead from tick 0 to it: ``at, level, block``, one for each bit of it that is set."""
    levels = F.array(*[F.lit(n) for n in range(max(1, last.bit_length()))])
    each = ticks.where(F.col("at").between(0, last)).select("at", F.explode(levels).alias("level"))
    one = F.call_function("shiftright", F.col("at"), F.col("level"))
    return each.withColumn("bits", one).where(F.col("bits") % 2 == 1).select("at", "level", (F.col("bits") - 1).alias("block"))


def states_at(snapshot: DataFrame, merged: DataFrame, ticks: DataFrame, cell: list[str], last: int) -> DataFrame:
    """``at, cell, state`` of all of ``ticks`` (``at``, each once, 0 to ``last``) at once, from the ``snapshot`` at tick 0 and ``merged_changes``.

    A tick reads as many blocks as it has bits, not all change sets before it. Its state has the cells of the snapshot and those changed since."""
    asked = ticks.select(F.col("at").cast("long").alias("at"))
    want = broadcast_if_small(blocks_of(asked, last), FEW)
    latest = F.max(F.struct("tick", "fill", "state")).alias("c")
    changed = merged.join(want, ["level", "block"]).groupBy("at", *cell).agg(latest).select("at", *cell, F.col("c.fill").alias("fill"), F.col("c.state").alias("new"))
    start = snapshot.select(*cell, "state").join(broadcast_if_small(asked.where(F.col("at").between(0, last)), FEW))
    both = start.join(changed, ["at", *cell], "full").where("fill is null or fill")
    return both.select("at", *cell, F.when(F.col("fill"), F.col("new")).otherwise(F.col("state")).alias("state"))


# Digests


def digests(series: DataFrame, levels: list[str], values: list[str], key: list[str]) -> DataFrame:
    """One row for each finest part (``levels``: columns from the coarsest to the finest): ``rows`` and two sums of hashes of its rows, which don't depend on
    their order. To be written with the series: later comparisons read this and not the rows. ``key`` and ``values`` are what is compared."""
    row = F.struct(*[F.col(c) for c in (*key, *values)])
    return series.groupBy(*levels).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(1), row).cast("decimal(38,0)")).alias("h2"))


def _same(levels: list[str]):
    out = F.lit(True)
    for c in levels:
        out = out & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return out


def unequal_parts(a: DataFrame, b: DataFrame, levels: list[str]) -> DataFrame:
    """Finest parts whose digests differ, found from the top: sums of digests are compared level by level, and only below what is unequal."""
    open_: DataFrame | None = None
    for depth in range(1, len(levels) + 1):
        upper = levels[:depth]
        sides = []
        for df in (a, b):
            there = df if open_ is None else df.join(broadcast_if_small(open_, FEW), levels[: depth - 1], "left_semi")
            sides.append(there.groupBy(*upper).agg(*[F.sum(c).alias(c) for c in ("rows", "h1", "h2")]))
        x, y = sides[0].alias("a"), sides[1].alias("b")
        equal = F.lit(True)
        for c in ("rows", "h1", "h2"):
            equal = equal & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        unequal = x.join(y, _same(upper), "full").where(~equal).select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in upper])
        open_ = cut(unequal, "unequal-parts")
    return open_


def differences_by_digest(a: DataFrame, b: DataFrame, levels: list[str], key: list[str], values: list[str], a_digests: DataFrame | None = None, b_digests: DataFrame | None = None) -> DataFrame:
    """Cells ``(key, side)`` that two series don't share, as ``changes.differences`` gives them, from the rows of unequal parts alone.

    ``levels`` are columns of both series, not null, and each key lies in one part. Where a level is a folder of the tables, unequal parts are read and others
    not even opened. Digests are made here if they aren't given. Two parts with other rows have equal digests with a probability of about ``2**-128``."""
    from .changes import differences

    made = [digests(df, levels, values, key) if known is None else known for df, known in ((a, a_digests), (b, b_digests))]
    parts = broadcast_if_small(unequal_parts(*made, levels), FEW)
    return differences(a.join(parts, levels, "left_semi"), b.join(parts, levels, "left_semi"), key, values)
