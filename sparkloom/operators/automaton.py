"""Game of life on an unbounded grid: live cells are rows ``(y, x)``, so the grid has no edge and dead space costs nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import digest, offsets, repeat

#: Cells of the grids that a task works on at the same time.
STACKED = 1 << 18

NINE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def life_step(cells: DataFrame) -> DataFrame:
    """Next generation of distinct live cells: born with 3 live neighbours, alive with 2 or 3. Each cell sends one row
    to itself and its neighbours; they are counted before and after one shuffle."""
    own = F.lit(1).alias("n"), (F.col("_m.y") == 0).__and__(F.col("_m.x") == 0).cast("int").alias("alive")
    sent = offsets(cells, ["y", "x"], NINE, n=own[0], alive=own[1])
    counted = sent.groupBy("y", "x").agg((F.sum("n") - F.max("alive")).alias("n"), F.max("alive").alias("alive"))
    return counted.where((F.col("n") == 3) | ((F.col("n") == 2) & (F.col("alive") == 1))).select("y", "x")


def life(cells: DataFrame, generations: int) -> DataFrame:
    """The grid after ``generations`` steps, fewer if it stands still. Repeated cells count once."""
    return repeat(cells.select("y", "x").distinct(), life_step, generations)


def life_in_tiles(cells: DataFrame, generations: int, size: int = 64, each: int = 8) -> DataFrame:
    """As ``life``, with one shuffle and one written table for ``each`` generations instead of one for every one.

    The plane is cut in tiles of ``size`` cells a side. A tile is sent its cells and those up to ``each`` outside it, a border that is as wide as anything can
    travel in so many generations, and goes on by itself; what it knows of its border is left out again. A cell goes to four tiles at most (``each`` is at most
    half of ``size``), most to one. A task takes its tiles in order and many at once, as a stack of grids, however few cells they have; it keeps one stack, and repeated cells
    only mark theirs again. Cells with a null place are left out."""
    if not 1 <= each <= size // 2:
        raise ValueError("a border is at least one cell wide and at most half a tile")
    wide = size + 2 * each
    stack = max(1, STACKED // (wide + 2) ** 2)

    def rounds(steps: int):
        def aged(grids: np.ndarray, corners: np.ndarray) -> pa.RecordBatch:
            for _ in range(steps):
                rows = grids[:, :, :-2] + grids[:, :, 1:-1] + grids[:, :, 2:]
                near = rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]  # with the cell itself
                grids[:, 1:-1, 1:-1] = (near == 3) | ((near == 4) & (grids[:, 1:-1, 1:-1] == 1))
            tile, y, x = np.nonzero(grids[:, 1 + each : -1 - each, 1 + each : -1 - each])
            return pa.RecordBatch.from_arrays([pa.array(y + corners[tile, 0] + each), pa.array(x + corners[tile, 1] + each)], names=["y", "x"])

        def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by tiles; the last tile of a batch may go on in the next one."""
            grids, corners, used = np.zeros((stack, wide + 2, wide + 2), dtype=np.uint8), np.zeros((stack, 2), dtype=np.int64), 0
            for batch in batches:
                y, x, ty, tx = (batch.column(c).to_numpy() for c in ("y", "x", "ty", "tx"))
                if not len(y):
                    continue
                at = np.stack([ty * size - each, tx * size - each], axis=1)
                starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)])
                ends = np.r_[starts[1:], len(y)]
                if used and (corners[used - 1] == at[0]).all():
                    used -= 1  # goes on: its cells stay marked
                first = 0
                while first < len(starts):
                    if used == stack:
                        yield aged(grids, corners)
                        grids[:], used = 0, 0
                    upto = min(len(starts), first + stack - used)
                    here = slice(starts[first], ends[upto - 1])
                    slot = used + np.repeat(np.arange(upto - first), (ends - starts)[first:upto])
                    corners[used : used + upto - first] = at[starts[first:upto]]
                    grids[slot, y[here] - at[here, 0] + 1, x[here] - at[here, 1] + 1] = 1
                    used, first = used + upto - first, upto
            if used:
                yield aged(grids[:used], corners[:used])

        def step(state: DataFrame) -> DataFrame:
            near = lambda c: F.sequence(F.floor((F.col(c) - each) / size), F.floor((F.col(c) + each) / size))
            sent = state.select("y", "x", F.explode(near("y")).alias("ty")).select("y", "x", "ty", F.explode(near("x")).alias("tx"))
            return sent.repartition("ty", "tx").sortWithinPartitions("ty", "tx").mapInArrow(tiles, "y long, x long")

        return step

    start = cells.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).dropna()
    if not generations:
        return start.distinct()
    whole, rest = divmod(generations, each)
    state = repeat(start, rounds(each), whole)  # ends early where ``each`` generations change nothing; so does any number of times ``each``
    return repeat(state, rounds(rest), 1) if rest else state


def bounds(cells: DataFrame) -> DataFrame:
    """Smallest box around the live cells; one row of nulls if there is none."""
    return cells.agg(F.min("y").alias("min_y"), F.min("x").alias("min_x"), F.max("y").alias("max_y"), F.max("x").alias("max_x"))


def trimmed(cells: DataFrame) -> DataFrame:
    """Cells moved so that the box around them begins at (0, 0)."""
    return cells.join(F.broadcast(bounds(cells))).select((F.col("y") - F.col("min_y")).alias("y"), (F.col("x") - F.col("min_x")).alias("x"))


def same_pattern(a: DataFrame, b: DataFrame) -> bool:
    """Whether two grids are equal but for a shift."""
    return digest(trimmed(a)) == digest(trimmed(b))


def same_patterns(a: DataFrame, b: DataFrame, key: str = "file") -> DataFrame:
    """``key, cells, same`` for the grids ``(key, y, x)`` of many keys: live cells of ``a`` and whether the grid of that key in ``b`` is equal but for a
    shift. A key of ``b`` alone has no cells and isn't the same; cells with a null don't count and repeated ones count once. No grid is gathered: equal grids have
    equal counts and equal order-free sums of the hashes of their moved cells."""

    def summed(cells: DataFrame, n: str, h: str) -> DataFrame:
        cells = cells.select(key, "y", "x").dropna().distinct()
        corner = cells.groupBy(key).agg(F.min("y").alias("y0"), F.min("x").alias("x0"))
        at = [F.col("y").cast("long") - F.col("y0"), F.col("x").cast("long") - F.col("x0")]
        sums = F.struct(F.bit_xor(F.xxhash64(*at)), F.sum(F.xxhash64(*at, F.lit(1)).cast("decimal(38,0)")))
        return cells.join(corner, key).groupBy(key).agg(F.count(F.lit(1)).alias(n), sums.alias(h))

    both = summed(a, "n_a", "h_a").join(summed(b, "n_b", "h_b"), key, "full")
    same = F.coalesce((F.col("n_a") == F.col("n_b")) & (F.col("h_a") == F.col("h_b")), F.lit(False))
    return both.select(key, F.coalesce("n_a", F.lit(0)).cast("long").alias("cells"), same.alias("same"))


def window(cells: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    """The part of a grid that a viewer sees."""
    return cells.where(F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1))


def random_cells(spark: SparkSession, height: int, width: int, seed: int, share: float = 0.5) -> DataFrame:
    """Each cell of a box live with probability ``share``."""
    at = spark.range(height * width).where(F.rand(seed) < share)
    return at.select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
