"""Moving shapes: their cells, where they are at a tick, and the changes from tick to tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import broadcast_if_small
from . import twister


def _cube(spark: SparkSession, reach: tuple[int, int, int]) -> DataFrame:
    """Offsets up to ``reach`` from the middle in each direction."""
    nx, ny, nz = (2 * r + 1 for r in reach)
    at = F.col("id")
    return spark.range(nx * ny * nz).select(
        (at % nx - reach[0]).cast("int").alias("x"), (F.floor(at / nx) % ny - reach[1]).cast("int").alias("y"), (F.floor(at / (nx * ny)) - reach[2]).cast("int").alias("z")
    )


def sphere(spark: SparkSession, radius: int, filled: bool = True) -> DataFrame:
    """Cells up to ``radius + 0.5`` from the middle; hollow ones from ``radius - 0.5`` on."""
    d = F.sqrt((F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).cast("double"))
    return _cube(spark, (radius,) * 3).where((d <= radius + 0.5) & (F.lit(filled) | (d >= radius - 0.5)))


def ring(spark: SparkSession, inner: int, outer: int) -> DataFrame:
    """Flat ring; none without an outer radius, and a disc where the inner one is below 0."""
    d = F.sqrt((F.col("x") * F.col("x") + F.col("z") * F.col("z")).cast("double"))
    return _cube(spark, (max(0, outer), 0, max(0, outer))).where((F.lit(outer) > 0) & (d <= outer + 0.5) & (d >= max(0, inner) - 0.5))


def rectangle(spark: SparkSession, width: int, height: int, filled: bool = True) -> DataFrame:
    """Flat rectangle around the middle; an even side has one cell less on its upper end. Hollow ones are a border."""
    x0, z0 = -(width // 2), -(height // 2)
    x1, z1 = width // 2 - (width % 2 == 0), height // 2 - (height % 2 == 0)
    inside = F.col("x").between(x0, x1) & F.col("z").between(z0, z1)
    border = F.col("x").isin(x0, x1) | F.col("z").isin(z0, z1)
    return _cube(spark, (width // 2, 0, height // 2)).where(inside & (F.lit(filled) | border))


def random_cells(spark: SparkSession, lo: tuple[int, int, int], hi: tuple[int, int, int], count: int, seed: int) -> DataFrame:
    """``count`` distinct cells of a box (ends included), as a 32-bit Mersenne twister draws them; at most the whole box. Tasks draw parts of its stream."""
    return twister.random_cells(spark, lo, hi, count, seed).select("x", "y", "z")


#: Schema of a table of shapes. ``cells`` are offsets; a shape is gone from ``destroy`` on (null: never).
SHAPES = (
    "name string, x double, y double, z double, state int, destroy long, cells array<struct<x int, y int, z int>>, "
    "moves array<struct<dx double, dy double, dz double, start long, stop long>>, "
    "spins array<struct<rx double, ry double, rz double, start long, stop long>>, "
    "orbits array<struct<plane string, radius double, speed double, start long, stop long, phase double>>"
)


def _steps(part: Column, tick: Column) -> Column:
    return F.greatest(F.least(part["stop"], tick) - part["start"], F.lit(0)).cast("double")


def _total(parts: str, value) -> Column:
    return F.aggregate(F.coalesce(F.col(parts), F.array()), F.lit(0.0), lambda a, p: a + value(p))


def trajectory(shapes: DataFrame, ticks: DataFrame) -> DataFrame:
    """Each shape at each of ``ticks`` (``tick``) at which it exists: position (start, moves, orbits) and rotation."""
    t = F.col("tick")
    there = shapes.join(broadcast_if_small(ticks, 100_000), F.col("destroy").isNull() | (t < F.col("destroy")))

    def orbit(axis: str):
        def value(o: Column) -> Column:
            turn = o["phase"] + _steps(o, t) * o["speed"]
            on = {"x": F.when(o["plane"].isin("xy", "xz"), F.cos(turn)), "y": F.when(o["plane"] == "xy", F.sin(turn)).when(o["plane"] == "yz", F.cos(turn)), "z": F.when(o["plane"].isin("xz", "yz"), F.sin(turn))}
            return F.when(t >= o["start"], F.coalesce(on[axis], F.lit(0.0)) * o["radius"]).otherwise(0.0)

        return value

    place = [(F.col(c) + _total("moves", lambda m, c=c: _steps(m, t) * m[f"d{c}"]) + _total("orbits", orbit(c))).alias(c) for c in "xyz"]
    turned = [_total("spins", lambda s, c=c: _steps(s, t) * s[f"r{c}"]).alias(f"r{c}") for c in "xyz"]
    return there.select("name", "tick", "state", "cells", *place, *turned)


def blocks_at(shapes: DataFrame, ticks: DataFrame) -> DataFrame:
    """Cells ``(tick, name, x, y, z, state)`` of the shapes: offsets turned about x, then y, then z, moved, and rounded half away from zero."""
    at = trajectory(shapes, ticks).select("*", F.explode("cells").alias("c"))
    fx, fy, fz = (F.col(f"c.{k}").cast("double") for k in "xyz")
    fy, fz = fy * F.cos("rx") - fz * F.sin("rx"), fy * F.sin("rx") + fz * F.cos("rx")
    fx, fz = fx * F.cos("ry") + fz * F.sin("ry"), fz * F.cos("ry") - fx * F.sin("ry")
    fx, fy = fx * F.cos("rz") - fy * F.sin("rz"), fx * F.sin("rz") + fy * F.cos("rz")
    return at.select("tick", "name", *[F.round(F.col(k) + f).cast("int").alias(k) for k, f in zip("xyz", (fx, fy, fz), strict=True)], "state").distinct()
