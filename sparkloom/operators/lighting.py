"""Light of a voxel world in tiles: one shuffle for the whole flood, and after edits only the tiles that they can reach."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import broadcast_if_small
from .voxel import CELL, Bounds, emission, passes_light

#: Steps that light goes at most: the brightest lamp has 15, and each step costs 1.
REACH = 14
TILE = ["tx", "ty", "tz"]
#: Tiles that are sent to every executor; more are joined by a shuffle.
BROADCAST_TILES = 100_000


def _limits(bounds: Bounds) -> list[tuple[int, int]]:
    return [(bounds.x0, bounds.x1), (bounds.y0, bounds.y1), (bounds.z0, bounds.z1)]


def _by_tile(rows: DataFrame, bounds: Bounds, size: int) -> DataFrame:
    """Each row once for each tile of the world that it is in or at most ``REACH`` away from: at most eight where ``size`` is at least ``2 * REACH``."""
    for name, tile, (lo, hi) in zip(CELL, TILE, _limits(bounds), strict=True):
        first, last = F.floor((F.col(name) - REACH) / size), F.floor((F.col(name) + REACH) / size)
        rows = rows.select("*", F.explode(F.sequence(F.greatest(first, F.lit(lo // size)), F.least(last, F.lit(hi // size)))).alias(tile))
    return rows


def _sent(rows: DataFrame, bounds: Bounds, size: int, edit: bool) -> DataFrame:
    """``tx, ty, tz, at, kind, edit``: place in the tile with its border, and 0 for what light passes or 16 and the block's own light."""
    state, wide = F.col("state"), size + 2 * REACH
    kind = F.when(passes_light(state), 0).otherwise(emission(state) + 16).cast("tinyint")
    blocks = rows.where(bounds.inside() & state.isNotNull()).select(*CELL, kind.alias("kind"))
    x, y, z = (F.col(c) - F.col(t) * size + REACH for c, t in zip(CELL, TILE, strict=True))
    at = ((x * wide + y) * wide + z).cast("int")
    return _by_tile(blocks if edit else blocks.where("kind > 0"), bounds, size).select(*TILE, at.alias("at"), "kind", F.lit(edit).alias("edit"))


def _flood(bounds: Bounds, size: int) -> Callable[[pa.Table], pa.Table]:
    """A tile's rows to its lit cells. Light that comes in from beyond the border would have faded before it got to the tile."""
    wide = size + 2 * REACH
    middle = (slice(1, -1),) * 3

    def flood(table: pa.Table) -> pa.Table:
        corner = [table[t][0].as_py() * size - REACH for t in TILE]
        order = np.argsort(table["edit"].to_numpy(), kind="stable")  # edits last
        kind = np.zeros(wide**3, dtype=np.int8)
        kind[table["at"].to_numpy()[order]] = table["kind"].to_numpy()[order]
        kind = kind.reshape(wide, wide, wide)
        outside = np.zeros(kind.shape, dtype=bool)
        for axis, (lo, hi) in enumerate(_limits(bounds)):
            along = corner[axis] + np.arange(wide)
            outside |= ((along < lo) | (along > hi)).reshape([-1 if a == axis else 1 for a in range(3)])
        opaque = (kind >= 16) | outside
        own = np.where(kind >= 16, kind - 16, 0).astype(np.int8)
        level = np.pad(own, 1)
        for _ in range(REACH if own.any() else 0):
            near = level[middle]
            for axis in range(3):
                for side in (slice(None, -2), slice(2, None)):
                    near = np.maximum(near, level[tuple(side if a == axis else slice(1, -1) for a in range(3))] - 1)
            near = np.where(opaque, own, near)
            if np.array_equal(near, level[middle]):
                break
            level[middle] = near
        shown = np.where(opaque, np.maximum(own, level[1:-1, 2:, 1:-1] - 1), level[middle])
        shown[outside] = 0
        core = shown[(slice(REACH, REACH + size),) * 3]
        found = np.nonzero(core > 0)
        cells = {c: pa.array((f + o + REACH).astype(np.int32)) for c, f, o in zip(CELL, found, corner, strict=True)}
        return pa.table({**cells, "level": pa.array(core[found].astype(np.int32))})

    return flood


_LIT = "x int, y int, z int, level int"


def light_in_tiles(world: DataFrame, bounds: Bounds, size: int = 64) -> DataFrame:
    """As ``voxel.flood_light``, with one shuffle instead of rounds.

    The world is cut in cubes of ``size`` cells a side. A tile is sent the opaque cells in it and up to ``REACH`` around it, as far as light can go, and is
    flooded by itself; of its border nothing is returned. A tile has at most ``(size + 2 * REACH) ** 3`` cells, however full the world is, and opaque cells that no
    lamp can reach aren't shuffled if the tiles with lamps are few. Rows without a place or a state are left out."""
    lamps = _by_tile(world.where(bounds.inside() & (emission(F.col("state")) > 0)).select(*CELL), bounds, size).select(*TILE).distinct()
    near = _sent(world, bounds, size, False).join(broadcast_if_small(lamps, BROADCAST_TILES), TILE, "left_semi")
    return near.groupBy(*TILE).applyInArrow(_flood(bounds, size), _LIT)


def relight(light: DataFrame, world: DataFrame, edits: DataFrame, bounds: Bounds, size: int = 64) -> DataFrame:
    """``light`` (that of ``world``) after ``edits`` (``x, y, z, state``, each cell once; 0 is air, those outside don't count).

    Darkness spreads from what is taken away or closed as far as light did, so an edit changes nothing more than ``REACH`` steps away. The tiles that it can
    reach are flooded again from the world with the edits laid over it; all others keep their light. The world and its light are read but not shuffled
    where they are out of reach, so the work follows the edited tiles."""
    touched = broadcast_if_small(_by_tile(edits.where(bounds.inside() & F.col("state").isNotNull()).select(*CELL), bounds, size).select(*TILE).distinct(), BROADCAST_TILES)
    sent = _sent(world, bounds, size, False).join(touched, TILE, "left_semi").unionByName(_sent(edits, bounds, size, True).join(touched, TILE, "left_semi"))
    new = sent.groupBy(*TILE).applyInArrow(_flood(bounds, size), _LIT)
    tiled = light.select(*CELL, "level", *[F.floor(F.col(c) / size).alias(t) for c, t in zip(CELL, TILE, strict=True)])
    return tiled.join(touched, TILE, "left_anti").select(*CELL, "level").unionByName(new)
