"""Boxes, spheres and distances. Joins go through grid cells, so they are equality joins that can be shuffled and split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AXES = ("x", "y", "z")

#: Rows of either side that a tile of a crowded cell takes, on average.
TOGETHER = 4096


def join_in_tiles(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` and ``right`` joined on equal ``keys`` (cells), by sorting, with crowded cells cut in two dimensions.

    A cell with more pairs than a tile (``TOGETHER`` rows of each side) is cut by hashes of the rows into tiles of about that size: a row of ``left`` goes to all tiles of its
    row of tiles, one of ``right`` to all of its column, so each pair meets in exactly one tile, and no task makes the pairs of a whole cell, however crowded it is. Only the crowded
    cells, at most one for ``TOGETHER`` rows, are broadcast."""
    rows = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    both = rows(left, "_l").join(rows(right, "_r"), keys).where(F.col("_l").cast("double") * F.col("_r") > float(TOGETHER) ** 2)
    cuts = both.select(*keys, *[F.ceil(F.col(n) / TOGETHER).cast("int").alias(m) for n, m in (("_l", "_high"), ("_r", "_broad"))])

    def dealt(df: DataFrame, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        (mine, parts), (theirs, copies) = own, other
        part = F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col(parts)).cast("int"), F.lit(0))
        cut_up = df.join(F.broadcast(cuts), keys, "left").withColumn(mine, part)
        return cut_up.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)) - 1))).drop(parts, copies)

    s, t = ("_s", "_high"), ("_t", "_broad")
    return dealt(left, s, t).hint("merge").join(dealt(right, t, s), [*keys, "_s", "_t"]).drop("_s", "_t")


def first_cells(df: DataFrame, cells: list[str], firsts: list[Column], own: str, looked_for: bool) -> DataFrame:
    """``df`` with ``own``, by which a pair of boxes that meets in several cells is joined in one of them: that in which one of both begins, along each axis. A row's bits say along which
    axes its box begins in this cell (``firsts``). With ``looked_for``, a row stands once for each number that has all bits which it lacks itself: the partners that it is to meet here."""
    bits = sum((F.when(F.col(c) == f, 1 << n).otherwise(0) for n, (c, f) in enumerate(zip(cells, firsts, strict=True))), F.lit(0))
    if not looked_for:
        return df.withColumn(own, bits)
    every = (1 << len(cells)) - 1
    return df.withColumn("_bits", bits).withColumn(own, F.explode(F.filter(F.sequence(F.lit(0), F.lit(every)), lambda m: m.bitwiseOR(F.col("_bits")) == every))).drop("_bits")


def in_box(dims: int = 3) -> Column:
    """Whether ``x, y, z`` lies inside ``lo_*, hi_*``, ends excluded; ``dims=2`` doesn't look at z."""
    out = F.lit(True)
    for c in AXES[:dims]:
        out = out & (F.col(c) > F.col(f"lo_{c}")) & (F.col(c) < F.col(f"hi_{c}"))
    return out


def _cells(lo: Column, hi: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))


def _laid(boxes: DataFrame, cell: float) -> DataFrame:
    return boxes.withColumn("gx", _cells(F.col("lo_x"), F.col("hi_x"), cell)).withColumn("gy", _cells(F.col("lo_y"), F.col("hi_y"), cell))


def _of_points(points: DataFrame, laid: DataFrame, cell: float) -> DataFrame:
    """Points (as ``point_id, x, y, z``) with what is laid on their cell."""
    at = points.select(F.col("id").alias("point_id"), *AXES).withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    return join_in_tiles(at, laid, ["gx", "gy"])


def boxes_of_points(points: DataFrame, boxes: DataFrame, cell: float, dims: int = 3) -> DataFrame:
    """Pairs ``(point_id, box_id)`` of points (``id, x, y, z``) inside boxes (``id, lo_x .. hi_z``). Boxes are laid on a grid of cells in
    x and y, which points look up: choose ``cell`` about as large as a box."""
    laid = _laid(boxes.withColumnRenamed("id", "box_id"), cell)
    return _of_points(points, laid, cell).where(in_box(dims)).select("point_id", "box_id")


def touching_boxes(a: DataFrame, b: DataFrame, cell: float, dims: int = 3) -> DataFrame:
    """Pairs ``(a_id, b_id)`` of boxes that overlap, mere contact excluded. Both lie on the grid, and a pair meets in the first cell that it shares, only there."""
    sides = []
    for df, p in ((a, "a"), (b, "b")):
        first = [F.floor(F.col(f"lo_{c}") / cell) for c in AXES[:2]]
        laid = first_cells(_laid(df, cell), ["gx", "gy"], first, "_first", p == "a")
        sides.append(laid.select(F.col("id").alias(f"{p}_id"), "gx", "gy", "_first", *[F.col(f"{e}_{c}").alias(f"{p}_{e}_{c}") for e in ("lo", "hi") for c in AXES]))
    meet = F.lit(True)
    for c in AXES[:dims]:
        meet = meet & (F.col(f"a_lo_{c}") < F.col(f"b_hi_{c}")) & (F.col(f"b_lo_{c}") < F.col(f"a_hi_{c}"))
    return join_in_tiles(*sides, ["gx", "gy", "_first"]).where(meet).select("a_id", "b_id")


def spheres_of_points(points: DataFrame, spheres: DataFrame, cell: float) -> DataFrame:
    """Pairs of points inside spheres (``id, x, y, z, r``), the surface excluded. The boxes that are laid on the grid are a little wider than the spheres, so that rounding loses none."""
    wide = F.col("r") + F.greatest(F.abs("x"), F.abs("y"), F.col("r")) * F.lit(1e-12)
    boxes = spheres.where("r > 0 AND NOT isnan(r)").select(F.col("id").alias("sphere_id"), *[F.col(c).alias(f"s{c}") for c in AXES], "r", *[e.alias(f"{n}_{c}") for c in AXES[:2] for e, n in ((F.col(c) - wide, "lo"), (F.col(c) + wide, "hi"))])
    laid = _laid(boxes, cell).select("sphere_id", "sx", "sy", "sz", "r", "gx", "gy")
    d = sum(((F.col(c) - F.col(f"s{c}")) * (F.col(c) - F.col(f"s{c}")) for c in AXES), F.lit(0.0))
    return _of_points(points, laid, cell).where(d < F.col("r") * F.col("r")).select("point_id", "sphere_id")


def union_box(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Smallest box around the boxes of each group, and half its surface's edge sum (``surface``: twice the sum of extents)."""
    grown = boxes.groupBy(*by).agg(*[F.min(f"lo_{c}").alias(f"lo_{c}") for c in AXES], *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in AXES])
    return grown.withColumn("surface", 2 * sum((F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in AXES), F.lit(0.0)))


def to_load(viewers: DataFrame, loaded: DataFrame, most_radius: int) -> DataFrame:
    """Chunks ``(viewer, cx, cz, nth)`` within each viewer's radius (``viewer, vx, vz, r``) that aren't ``loaded`` (``viewer, cx, cz``), nearest first."""
    reach = F.least(F.col("r"), F.lit(most_radius))
    span = F.sequence(-reach, reach)
    around = viewers.select("viewer", "vx", "vz", "r", F.explode(span).alias("dx"), reach.alias("reach")).select("*", F.explode(F.sequence(-F.col("reach"), F.col("reach"))).alias("dz"))
    d2 = F.col("dx") * F.col("dx") + F.col("dz") * F.col("dz")
    cells = around.where(d2 <= F.col("r") * F.col("r")).select("viewer", (F.col("vx") + F.col("dx")).alias("cx"), (F.col("vz") + F.col("dz")).alias("cz"), d2.alias("d2"))
    order = W.partitionBy("viewer").orderBy("d2", "cx", "cz")
    return cells.join(loaded.select("viewer", "cx", "cz"), ["viewer", "cx", "cz"], "left_anti").select("viewer", "cx", "cz", F.row_number().over(order).alias("nth"))


def to_unload(viewers: DataFrame, loaded: DataFrame) -> DataFrame:
    """Loaded chunks farther from their viewer than its radius in x or z."""
    far = F.greatest(F.abs(F.col("cx") - F.col("vx")), F.abs(F.col("cz") - F.col("vz"))) > F.col("r")
    return loaded.join(viewers, "viewer").where(far).select("viewer", "cx", "cz")


def movement(track: DataFrame, key: str, order: str) -> DataFrame:
    """Steps of tracked points (``x, y, z``) in 4096ths, and whether they are too long (over 8 in any direction) to be sent as steps;
    steps over 100 are ``rejected``. First points have none."""
    w = W.partitionBy(key).orderBy(order)
    steps = track.select(key, order, *[(F.col(c) - F.lag(c).over(w)).alias(f"d{c}") for c in AXES])
    far = F.greatest(*[F.abs(f"d{c}") for c in AXES])
    return steps.where("dx is not null").select(key, order, *[F.round(F.col(f"d{c}") * 4096).cast("long").alias(f"d{c}") for c in AXES], (far >= 8).alias("jump"), (far > 100).alias("rejected"))
