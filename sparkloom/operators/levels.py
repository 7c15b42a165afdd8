"""Joins of boxes and spheres of any size, through a grid that is finer for small ones: a hierarchy of levels.

The cells of level ``n`` are ``2**n`` wide. A box lies on the level whose cells are as wide as its longest side or wider, by less than twice, so it
meets at most two cells in each direction: eight rows at most, whatever its size. What is looked up goes through the levels that have boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import AXES, first_cells, join_in_tiles

#: Finest and coarsest level. Smaller boxes lie on the finest; places are cut at a width of the coarsest, so infinite boxes have a level too.
LEAST, MOST = -20, 60


def _sides(prefix: str = "") -> list[tuple[Column, Column]]:
    return [(F.col(f"{prefix}lo_{c}"), F.col(f"{prefix}hi_{c}")) for c in AXES]


def level_of(*lengths: Column) -> Column:
    """Level of a box with sides of these lengths."""
    longest = F.greatest(*lengths)
    # logarithms are rounded: a level too low would be three cells wide, so it is taken one up where the cells are too narrow
    near = F.ceil(F.log2(longest)).cast("int")
    fits = F.when(F.pow(F.lit(2.0), near) < longest, near + 1).otherwise(near)
    return F.when(longest <= F.lit(2.0**LEAST), LEAST).when(longest >= F.lit(2.0**MOST), MOST).otherwise(fits).cast("int")


def _cell(place: Column, level: Column) -> Column:
    return F.floor(F.least(F.greatest(place, F.lit(-(2.0**MOST))), F.lit(2.0 ** (MOST - 1))) / F.pow(F.lit(2.0), level)).cast("long")


def usable(boxes: DataFrame, dims: int = 3) -> DataFrame:
    """Boxes that can hold or touch something: all bounds are numbers and none lies above its other."""
    fine = F.lit(True)
    for lo, hi in _sides()[:dims]:
        fine = fine & lo.isNotNull() & hi.isNotNull() & ~F.isnan(lo) & ~F.isnan(hi) & (lo <= hi)
    return boxes.where(fine)


def _levels(laid: DataFrame) -> DataFrame:
    """The levels that have boxes, as one array; at most ``MOST - LEAST + 1`` of them."""
    return laid.agg(F.sort_array(F.collect_set("level")).alias("levels"))


def _with_level(boxes: DataFrame, dims: int) -> DataFrame:
    return boxes.withColumn("level", level_of(*[hi - lo for lo, hi in _sides()[:dims]]))


def on_grid(boxes: DataFrame, dims: int = 3) -> DataFrame:
    """``boxes`` (``lo_x .. hi_z``) once for each cell of their own level that they meet: ``level, gx, gy`` and, in three dimensions, ``gz`` are added."""
    out = boxes if "level" in boxes.columns else _with_level(boxes, dims)
    for c, (lo, hi) in list(zip(AXES, _sides(), strict=True))[:dims]:
        out = out.withColumn(f"g{c}", F.explode(F.sequence(_cell(lo, F.col("level")), _cell(hi, F.col("level")))))
    return out


def _of_points(points: DataFrame, laid: DataFrame, dims: int) -> DataFrame:
    """Points (as ``point_id, x, y, z``) with the rows of ``laid`` (boxes with ``level``) whose boxes meet one of their cells."""
    up = points.select(F.col("id").alias("point_id"), *[F.col(c).cast("double").alias(c) for c in AXES[:dims]]).dropna(subset=list(AXES[:dims]))
    up = up.join(F.broadcast(_levels(laid))).withColumn("level", F.explode("levels")).drop("levels")
    for c in AXES[:dims]:
        up = up.where(~F.isnan(c)).withColumn(f"g{c}", _cell(F.col(c), F.col("level")))
    return join_in_tiles(up, on_grid(laid, dims), ["level", *[f"g{c}" for c in AXES[:dims]]])


def boxes_of_points(points: DataFrame, boxes: DataFrame, dims: int = 3) -> DataFrame:
    """Pairs ``(point_id, box_id)`` of points (``id, x, y, z``) inside boxes (``id, lo_x .. hi_z``), ends excluded; ``dims=2`` doesn't look at z.

    Each point looks up one cell on every level that has boxes. Points with a null or undefined place lie in none. The join is one on equal cells, and
    crowded cells, as those of boxes that hold nearly all points, are cut in tiles (``join_in_tiles``)."""
    bounds = [f"{e}_{c}" for c in AXES[:dims] for e in ("lo", "hi")]
    laid = _with_level(usable(boxes, dims).select(F.col("id").alias("box_id"), *[F.col(b).cast("double").alias(b) for b in bounds]), dims)
    inside = F.lit(True)
    for c in AXES[:dims]:
        inside = inside & (F.col(c) > F.col(f"lo_{c}")) & (F.col(c) < F.col(f"hi_{c}"))
    return _of_points(points, laid, dims).where(inside).select("point_id", "box_id")


def _sharing(left: DataFrame, right: DataFrame, dims: int, a_columns: list[str], b_columns: list[str]) -> DataFrame:
    """Rows of ``left`` and ``right`` (boxes ``lo_x .. hi_z``) whose boxes share a cell of the larger one's level, each pair once, with ``a_columns`` and ``b_columns``.

    The larger box of a pair lies on its level, the smaller one looks that level up, with at most eight cells. Of the cells that both meet, they are joined only in
    the one with the pair's common lower corner."""
    left, right = _with_level(left, dims), _with_level(right, dims)
    cells = [f"g{c}" for c in AXES[:dims]]

    def looking_up(df: DataFrame, other: DataFrame, above: bool) -> DataFrame:
        """``df`` on the levels of ``other`` from its own up; ``above``: only those higher than its own."""
        least = F.col("own") + 1 if above else F.col("own")
        up = df.withColumnRenamed("level", "own").join(F.broadcast(_levels(other))).withColumn("level", F.explode(F.filter("levels", lambda n: n >= least)))
        return up.drop("levels", "own")

    def laid(df: DataFrame, columns: list[str], looked_for: bool) -> DataFrame:
        firsts = [_cell(F.col(f"lo_{c}"), F.col("level")) for c in AXES[:dims]]
        return first_cells(on_grid(df, dims), cells, firsts, "_first", looked_for).select("level", *cells, "_first", *columns)

    keys = ["level", *cells, "_first"]
    small_a = join_in_tiles(laid(looking_up(left, right, False), a_columns, True), laid(right, b_columns, False), keys)
    small_b = join_in_tiles(laid(left, a_columns, True), laid(looking_up(right, left, True), b_columns, False), keys)
    return small_a.select(*a_columns, *b_columns).unionByName(small_b.select(*a_columns, *b_columns))


def touching_boxes(a: DataFrame, b: DataFrame, dims: int = 3) -> DataFrame:
    """Pairs ``(a_id, b_id)`` of boxes that overlap, mere contact excluded: each pair meets in one cell (``_sharing``)."""
    bounds = [f"{e}_{c}" for c in AXES[:dims] for e in ("lo", "hi")]
    left, right = (usable(df, dims).select(F.col("id").alias(f"{p}_id"), *[F.col(n).cast("double").alias(n) for n in bounds], *[F.col(n).cast("double").alias(f"{p}_{n}") for n in bounds]) for df, p in ((a, "a"), (b, "b")))
    meet = F.lit(True)
    for c in AXES[:dims]:
        meet = meet & (F.col(f"a_lo_{c}") < F.col(f"b_hi_{c}")) & (F.col(f"b_lo_{c}") < F.col(f"a_hi_{c}"))
    return _sharing(left, right, dims, *[[f"{p}_{n}" for n in ("id", *bounds)] for p in "ab"]).where(meet).select("a_id", "b_id")


def _around(spheres: DataFrame, *columns: Column) -> DataFrame:
    """Boxes around spheres (``x, y, z, r``), a little wider than they are, so that rounding loses none, with further ``columns``; spheres without a size are left out."""
    wide = F.col("r") + F.greatest(F.abs("x"), F.abs("y"), F.abs("z"), F.col("r")) * F.lit(1e-12)
    return usable(spheres.where("r > 0").select(*columns, *[(F.col(c) - wide).alias(f"lo_{c}") for c in AXES], *[(F.col(c) + wide).alias(f"hi_{c}") for c in AXES]))


def _distance2(p: str, q: str) -> Column:
    return sum(((F.col(f"{p}{c}") - F.col(f"{q}{c}")) * (F.col(f"{p}{c}") - F.col(f"{q}{c}")) for c in AXES), F.lit(0.0))


def spheres_of_points(points: DataFrame, spheres: DataFrame) -> DataFrame:
    """Pairs ``(point_id, sphere_id)`` of points inside spheres, the surface excluded. Places and radii go through the join on cells, so pairs aren't joined again."""
    laid = _with_level(_around(spheres, F.col("id").alias("sphere_id"), *[F.col(c).cast("double").alias(f"s{c}") for c in AXES], F.col("r").cast("double").alias("r")), 3)
    return _of_points(points, laid, 3).where(_distance2("", "s") < F.col("r") * F.col("r")).select("point_id", "sphere_id")


def touching_spheres(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs ``(a_id, b_id)`` of spheres that overlap: their middles are nearer than the sum of their radii, with their places and radii (``a_x .. b_r``)."""
    left, right = (_around(df, F.col("id").alias(f"{p}_id"), *[F.col(c).cast("double").alias(f"{p}_{c}") for c in (*AXES, "r")]) for df, p in ((a, "a"), (b, "b")))
    near = _sharing(left, right, 3, *[[f"{p}_{n}" for n in ("id", *AXES, "r")] for p in "ab"])
    return near.where(_distance2("a_", "b_") < (F.col("a_r") + F.col("b_r")) * (F.col("a_r") + F.col("b_r")))


def union_sphere(p: str = "a_", q: str = "b_") -> list[Column]:
    """The smallest sphere around two, as ``x, y, z, r``: the larger one if it holds the other, else one that both touch from inside."""
    d = F.sqrt(_distance2(p, q))
    r, s = F.col(f"{p}r"), F.col(f"{q}r")
    grown = (d + r + s) / 2
    share = (grown - r) / d
    out = [F.when(d + s <= r, F.col(f"{p}{c}")).when(d + r <= s, F.col(f"{q}{c}")).otherwise(F.col(f"{p}{c}") + (F.col(f"{q}{c}") - F.col(f"{p}{c}")) * share).alias(c) for c in AXES]
    return [*out, F.when(d + s <= r, r).when(d + r <= s, s).otherwise(grown).alias("r")]


def joined_sphere(p: str = "a_", q: str = "b_") -> list[Column]:
    """The union that a bounding tree of spheres keeps, as ``x, y, z, r``: both middles, weighed by ``1 + (r - s) / d`` and ``1 - (r - s) / d``, added up,
    and a radius of ``d + r + s``. It is no smallest sphere (see ``union_sphere``); null for two with one middle."""
    d2 = _distance2(p, q)
    d = F.when(d2 > 0, F.sqrt(d2))
    r, s = F.col(f"{p}r"), F.col(f"{q}r")
    lean = (r - s) / d
    return [*[(F.col(f"{p}{c}") * (1 + lean) + F.col(f"{q}{c}") * (1 - lean)).alias(c) for c in AXES], (d + r + s).alias("r")]
