"""Voxel worlds: rows ``(x, y, z, state)`` of what is not air, light, scheduled work, and fluids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.iterate import broadcast_if_small, cut, offsets

CELL = ["x", "y", "z"]
SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
SIDES = [(1, 0, 0), (-1, 0, 0), (0, 0, 1), (0, 0, -1)]
#: Block states of water and lava: source, then seven levels, then the same eight when falling. Fixed values.
WATER, LAVA = 86, 102
#: Solid states that give light, and how much. Fixed values.
LAMPS = {6032: 15, 11603: 15, 13351: 14, 19517: 15, 2398: 14, 5907: 7, 6027: 10}
FIRE = 2403


@dataclass(frozen=True)
class Bounds:
    """A world's extent, ends included. Cells outside are air and can't be set."""

    x0: int = -128
    x1: int = 511
    y0: int = -64
    y1: int = 319
    z0: int = -128
    z1: int = 511

    def inside(self) -> Column:
        return F.col("x").between(self.x0, self.x1) & F.col("y").between(self.y0, self.y1) & F.col("z").between(self.z0, self.z1)


def is_water(state: Column) -> Column:
    return state.between(WATER, WATER + 15)


def is_lava(state: Column) -> Column:
    return state.between(LAVA, LAVA + 15)


def emission(state: Column) -> Column:
    """Light that a block gives."""
    out = F.when(is_lava(state) | (state == FIRE), 15)
    for block, level in LAMPS.items():
        out = out.when(state == block, level)
    return out.otherwise(0)


def passes_light(state: Column) -> Column:
    """Air and water; all other blocks stop light, those that nobody knows too."""
    return (state == 0) | is_water(state)


def solid(state: Column) -> Column:
    """Whether fluids can't enter: all but air, water, lava and fire."""
    return ~((state == 0) | is_water(state) | is_lava(state) | (state == FIRE))


def block_info(states: DataFrame) -> DataFrame:
    """Properties of each ``state``."""
    s = F.col("state")
    stage = F.when(is_water(s) | is_lava(s), (s - WATER) % 8).otherwise(0)
    opacity = F.when(s == 0, 0).when(is_water(s), 2).otherwise(15)
    return states.select("state", stage.cast("int").alias("stage"), emission(s).cast("int").alias("emission"), opacity.alias("opacity"), solid(s).alias("solid"))


def get_blocks(world: DataFrame, cells: DataFrame) -> DataFrame:
    """State at each of ``cells``; 0 where there is nothing."""
    return cells.join(world, CELL, "left").withColumn("state", F.coalesce("state", F.lit(0)))


def set_blocks(world: DataFrame, changes: DataFrame, bounds: Bounds) -> DataFrame:
    """``world`` after ``changes`` (distinct ``x, y, z, state``); those outside ``bounds`` are ignored, and state 0 leaves no row."""
    new = changes.where(bounds.inside()).select(*CELL, F.col("state").alias("new"))
    both = world.join(new, CELL, "full")
    return both.select(*CELL, F.coalesce("new", "state").alias("state")).where("state <> 0")


def fill(spark: SparkSession, lo: tuple[int, int, int], hi: tuple[int, int, int], state: int) -> DataFrame:
    """All cells of a box, ends included."""
    nx, ny, nz = (b - a + 1 for a, b in zip(lo, hi, strict=True))
    at = F.col("id")
    return spark.range(nx * ny * nz).select(
        (at % nx + lo[0]).cast("int").alias("x"), (F.floor(at / nx) % ny + lo[1]).cast("int").alias("y"), (F.floor(at / (nx * ny)) + lo[2]).cast("int").alias("z"), F.lit(state).alias("state")
    )


def non_air(world: DataFrame) -> DataFrame:
    """Blocks in each section of 16 cells a side."""
    sections = [F.shiftright(c, 4).alias(f"s{c}") for c in CELL]
    return world.where("state <> 0").groupBy(*sections).agg(F.count(F.lit(1)).alias("blocks"))


def flood_light(world: DataFrame, bounds: Bounds, most: int = 15) -> DataFrame:
    """Light levels above 0 of all cells, by rounds from the brightest level down.

    A lamp has its own level and each step to one of six neighbours costs 1. An opaque cell takes light only from the cell
    above it and doesn't pass it on; lamps, which are opaque, pass on their own. The largest level counts, so the order of
    lamps doesn't matter. Round by round, the open cells next to those of one level get the next lower one, unless they are of the
    level before or of that before it (an open cell's neighbours differ by one level at most, so no other can be there). Each
    cell is therefore in one round's frontier only; what is opaque is laid out by cell once for all rounds, and only frontiers are shuffled.
    """
    state = F.col("state")
    lamps = cut(world.where(bounds.inside()).select(*CELL, emission(state).cast("int").alias("level")).where("level > 0"), "lamps")
    solid_cells = world.where(~passes_light(state)).select(*CELL, F.lit(True).alias("opaque"))
    parts = int(world.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    opaque = solid_cells.repartition(parts, *CELL).persist()
    lit = [lamps]
    bright = edge = None
    for level in range(most, 0, -1):
        own = lamps.where(F.col("level") == level).select(*CELL)
        if edge is None:
            frontier = own
        else:
            spread = offsets(edge, CELL, SIX, down=F.col("_m.y") == -1).where(bounds.inside())
            reached = spread.groupBy(*CELL).agg(F.max("down").alias("down")).join(opaque, CELL, "left")
            reached = cut(reached.where(F.col("opaque").isNull() | F.col("down")).select(*CELL, F.col("opaque").isNull().alias("open")), "light")
            lit.append(reached.select(*CELL, F.lit(level).alias("level")))
            known = edge if bright is None else edge.unionByName(bright)
            frontier = own.unionByName(reached.where("open").select(*CELL).join(known, CELL, "left_anti"))
        bright, edge = edge, cut(frontier, "light")
    opaque.unpersist()
    out = lit[0]
    for more in lit[1:]:
        out = out.unionByName(more)
    return out.groupBy(*CELL).agg(F.max("level").alias("level"))


# Scheduled work: rows (x, y, z, type, trigger_tick).


def schedule(present: DataFrame, added: DataFrame, now: int) -> DataFrame:
    """``present`` with ``added`` (``x, y, z, type, delay``), triggered after their delay, 0 at least; what is there stays once."""
    new = added.select(*CELL, "type", (F.lit(now) + F.greatest(F.lit(0), F.col("delay"))).cast("long").alias("trigger_tick"))
    return present.select(*new.columns).unionByName(new).dropDuplicates([*CELL, "type", "trigger_tick"])


def due(work: DataFrame, now: int) -> DataFrame:
    return work.where(F.col("trigger_tick") <= now)


def priority(kind: Column) -> Column:
    """Rank of scheduled work on one cell, the least first: edits, other blocks, lava that ends, lava that flows, water that ends,
    water that flows, air. Fluids rank by level."""
    # The ranks are fixed values.
    level = lambda base: ((kind - base) % 8) * 2 + F.floor((kind - base) / 8).cast("int") + 1
    return (
        F.when(kind == -1, -1)
        .when(kind.between(-LAVA - 15, -LAVA), 2)
        .when(is_lava(kind), level(LAVA) * 4)
        .when(kind.between(-WATER - 15, -WATER), 128)
        .when(is_water(kind), level(WATER) * 256)
        .when(kind == 0, 8192)
        .otherwise(0)
    )


def pick(work: DataFrame) -> DataFrame:
    """One of the ``work`` of each cell, by ``priority``, then the smaller type. A minimum, so it is reduced before it is shuffled."""
    first = F.min(F.struct(priority(F.col("type")).alias("rank"), F.col("type")))
    return work.groupBy(*CELL).agg(first.alias("first")).select(*CELL, F.col("first.type").alias("type"))


def becomes(kind: Column) -> Column:
    """State that picked work writes: a negative type ends a fluid; null for an edit, which is already written."""
    return F.when(kind == -1, F.lit(None)).when(kind.isin(-94, -110), 0).otherwise(F.abs(kind))


def wake(edits: DataFrame, world: DataFrame) -> DataFrame:
    """What edited cells (``x, y, z``) schedule: themselves and their six neighbours, with delays 0 and 1."""
    own = edits.select(*CELL, F.lit(-1).alias("type"))
    around = get_blocks(world, offsets(edits.select(*CELL), CELL, SIX).distinct()).select(*CELL, F.col("state").alias("type"))
    return own.unionByName(around).select(*CELL, "type", F.explode(F.array(F.lit(0), F.lit(1))).alias("delay"))


def slopes(world: DataFrame, cells: DataFrame, bounds: Bounds, most: int = 4) -> DataFrame:
    """Steps from each of ``cells`` (``x, y, z``), over cells that aren't solid, to the nearest one above a cell that isn't solid;
    999 if it takes more than ``most``. One join a step, on a frontier that never holds a cell twice."""
    hard = world.where(solid(F.col("state"))).select(*CELL)
    start = [F.col(c).alias(f"s{c}") for c in CELL]
    key = [f"s{c}" for c in CELL]
    frontier = cells.select(*CELL, *start).distinct().join(hard, CELL, "left_anti")
    seen, found = cut(frontier, "slope"), []
    frontier = seen
    for step in range(most + 1):
        below = frontier.select(*CELL, *key).withColumn("y", F.col("y") - 1)
        drops = below.join(hard, CELL, "left_anti")
        found.append(drops.select(*key, F.lit(step).alias("steps")))
        if step == most:
            break
        on = offsets(frontier, CELL, SIDES).where(bounds.inside()).distinct().join(hard, CELL, "left_anti")
        frontier = cut(on.join(seen, [*CELL, *key], "left_anti").select(*seen.columns), "slope")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    steps = found[0]
    for more in found[1:]:
        steps = steps.unionByName(more)
    best = steps.groupBy(*key).agg(F.min("steps").alias("steps")).select(*[F.col(f"s{c}").alias(c) for c in CELL], "steps")
    return cells.select(*CELL).distinct().join(best, CELL, "left").select(*CELL, F.coalesce("steps", F.lit(999)).alias("steps"))


def feeds(a: Column, b: Column) -> Column:
    """Whether fluid ``a`` is of the same kind as ``b`` and of a lower level."""
    same = (is_water(a) & is_water(b)) | (is_lava(a) & is_lava(b))
    return same & ((a - WATER) % 8 < (b - WATER) % 8)


def fluid_neighbours(world: DataFrame) -> DataFrame:
    """Each fluid cell with the states below, above and at its four sides (``e, w, s, n``), 0 for air: one row a cell, by one
    aggregation in which every block reports to its neighbours."""
    names = {(0, -1, 0): "above", (0, 1, 0): "below", (-1, 0, 0): "e", (1, 0, 0): "w", (0, 0, -1): "s", (0, 0, 1): "n", (0, 0, 0): "state"}
    which = F.lit(None).cast("string")
    for move, name in names.items():
        which = F.when((F.col("_m.x") == move[0]) & (F.col("_m.y") == move[1]) & (F.col("_m.z") == move[2]), name).otherwise(which)
    told = offsets(world.select(*CELL, "state"), CELL, list(names), side=which)
    sides = [F.coalesce(F.max(F.when(F.col("side") == n, F.col("state"))), F.lit(0)).alias(n) for n in names.values()]
    around = told.groupBy(*CELL).agg(*sides)
    return around.where(is_water(F.col("state")) | is_lava(F.col("state")))


def fluid_step(world: DataFrame, bounds: Bounds, active: DataFrame | None = None) -> DataFrame:
    """Work (``x, y, z, type``, for the next tick) that the fluids of ``world`` ask for, by the rules of one cell:

    water over a source or a solid block and between two sources becomes a source; over air or flowing fluid of its kind it
    falls; else it spreads to the sides from which the way down is shortest, one level lower; a fluid that nothing feeds ends. Lava
    by water (above or beside) turns to stone instead: 2397 for a source, else 14; lava over water makes 1 of it. With
    ``active`` only these cells (``x, y, z``) act."""
    s, below, above = F.col("state"), F.col("below"), F.col("above")
    around = fluid_neighbours(world)
    around = around if active is None else around.join(broadcast_if_small(active.select(*CELL).distinct(), 200_000), CELL, "left_semi")
    base = F.when(is_water(s), WATER).otherwise(LAVA)
    stage = (s - base) % 8
    source = s == base
    sides = ["e", "w", "s", "n"]
    kin = lambda c: c.between(base, base + 15)
    fed = kin(above)
    for n in sides:
        fed = fed | feeds(F.col(n), s)
    n_sources = sum((F.when(F.col(n) == WATER, 1).otherwise(0) for n in sides), F.lit(0))
    renew = is_water(s) & ~source & ((below == WATER) | solid(below)) & (n_sources >= 2)
    falls = ~renew & ((below == 0) | (kin(below) & (below != base)))
    wet = is_water(above)
    for n in sides:
        wet = wet | is_water(F.col(n))
    reacts = is_lava(s) & (wet | is_water(below))
    ends = ~renew & ~source & ~fed
    rest = cut(around.select(*CELL, *sides, "state", base.alias("base"), stage.alias("stage"), source.alias("source"), renew.alias("renew"), falls.alias("falls"), ends.alias("ends"), reacts.alias("reacts"), wet.alias("wet")), "fluid")
    renewed = rest.where("renew").select(*CELL, F.lit(WATER).alias("type"))
    fallen = rest.where("falls").select("x", (F.col("y") - 1).alias("y"), "z", (F.col("base") + 8).alias("type"))
    moves = {"e": (1, 0), "w": (-1, 0), "s": (0, 1), "n": (0, -1)}
    flat = rest.where(~F.col("renew") & ~F.col("falls"))
    to = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dz).alias("dz"), F.col(n).alias("there")) for n, (dx, dz) in moves.items()]))
    ways = flat.select(*[F.col(c).alias(f"o{c}") for c in CELL], "base", "stage", to.alias("w")).select("*", (F.col("ox") + F.col("w.dx")).alias("x"), F.col("oy").alias("y"), (F.col("oz") + F.col("w.dz")).alias("z"), F.col("w.there").alias("there")).drop("w")
    ways = cut(ways, "ways")
    blocked = solid(F.col("there")) | (F.col("there").between(F.col("base"), F.col("base") + 15) & ((F.col("there") - F.col("base")) % 8 <= F.col("stage") + 1))
    weighed = ways.join(slopes(world, ways, bounds), CELL).withColumn("weight", F.when(blocked, 1000).otherwise(F.col("steps")))
    origin = ["ox", "oy", "oz"]
    least = weighed.groupBy(*origin).agg(F.least(F.lit(999), F.min("weight")).alias("least"))
    foreign = (is_water(F.col("there")) | is_lava(F.col("there"))) & ~F.col("there").between(F.col("base"), F.col("base") + 15)
    spread = weighed.join(least, origin).where((F.col("stage") < 7) & (F.col("weight") == F.col("least")) & ~foreign)
    spread = spread.select(*CELL, (F.col("base") + 1 + F.col("stage")).alias("type"))
    over = F.when(F.col("state") >= F.col("base") + 7, -(F.col("base") + 8)).otherwise(-(F.col("state") + 1))
    ended = rest.where(F.col("ends") & ~F.col("reacts")).select(*CELL, over.alias("type"))
    turned = rest.where(F.col("reacts") & F.col("wet")).select(*CELL, F.when(F.col("source"), 2397).otherwise(14).alias("type"))
    capped = around.where(is_lava(s) & is_water(below)).select("x", (F.col("y") - 1).alias("y"), "z", F.when(below == WATER, 2397).otherwise(1).alias("type"))
    out = renewed
    for more in (fallen, spread, ended, turned, capped):
        out = out.unionByName(more)
    return out.where(bounds.inside()).distinct()


def tick(world: DataFrame, work: DataFrame, now: int, bounds: Bounds) -> tuple[DataFrame, DataFrame]:
    """World and scheduled work after tick ``now``: of the due work one is picked a cell; all states are written; then the picked
    cells' fluids and the fluids around them ask for new work one tick later."""
    picked = cut(pick(due(work, now)), "picked")
    writes = picked.select(*CELL, becomes(F.col("type")).cast("int").alias("state")).where("state is not null")
    after = cut(set_blocks(world, writes, bounds), "world")
    active = offsets(picked.select(*CELL), CELL, [(0, 0, 0), *SIX]).distinct()
    asked = fluid_step(after, bounds, active).withColumn("delay", F.lit(1))
    later = work.where(F.col("trigger_tick") > now)
    return after, cut(schedule(later, asked, now), "work")


def latest(changes: DataFrame) -> DataFrame:
    """Last change of each cell (``x, y, z, state``, by ``tick``, then the larger state)."""
    return changes.groupBy(*CELL).agg(F.max(F.struct("tick", "state")).alias("m")).select(*CELL, F.col("m.state").alias("state"))
