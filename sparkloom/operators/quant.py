"""Block-quantised rows and their products. Built-in functions only.

Blocks have 32 values. ``q8``: scale ``max|x| / 127``, values rounded to -127..127. ``q4``: scale ``max|x| / 7``, values
rounded and stored with an offset of 8 (1..15); value k of a block stands in the low half of byte k for k < 16 and in the
high half of byte k - 16 for the others. These two rules are this library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import broadcast_if_small

BLOCK = 32


def blocks(rows: DataFrame) -> DataFrame:
    """``(row, x array)`` as ``(row, block, x)`` of 32 values each; a remainder is left out. Null or short rows have none."""
    count = F.floor(F.coalesce(F.size("x"), F.lit(0)) / BLOCK).cast("int")
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.struct(b.alias("block"), F.slice("x", b * BLOCK + 1, F.lit(BLOCK)).alias("x")))
    return rows.where(count > 0).select("row", F.inline(each))


def _scaled(x: Column, levels: int) -> tuple[Column, Column]:
    top = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    d = top / F.lit(float(levels))
    return d, F.transform(x, lambda v: F.when(d > 0, F.round(v.cast("double") / d)).otherwise(F.lit(0.0)).cast("int"))


def quantise_q8(rows: DataFrame) -> DataFrame:
    """``(row, block, d, qs)`` with whole numbers ``qs``."""
    d, q = _scaled(F.col("x"), 127)
    return blocks(rows).select("row", "block", d.alias("d"), q.alias("qs"))


def quantise_q4(rows: DataFrame) -> DataFrame:
    """``(row, block, d, qs)`` with 16 bytes ``qs`` of two values each."""
    d, q = _scaled(F.col("x"), 7)
    low, high = F.slice(q, 1, 16), F.slice(q, 17, 16)
    packed = F.zip_with(low, high, lambda a, b: ((a + 8) + F.shiftleft(b + 8, 4)).cast("int"))
    return blocks(rows).select("row", "block", d.alias("d"), packed.alias("qs"))


def unpack_q4(qs: Column) -> Column:
    """The 32 values of a packed block, without their offset."""
    low = F.transform(qs, lambda b: b.bitwiseAND(F.lit(15)) - 8)
    return F.concat(low, F.transform(qs, lambda b: F.shiftright(b, 4).bitwiseAND(F.lit(15)) - 8))


def dequantise(d: Column, values: Column) -> Column:
    return F.transform(values, lambda q: q * d)


def block_dot(x: Column, y: Column) -> Column:
    """Integer dot product of two blocks."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a * b).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)


def matmul(weights: DataFrame, activations: DataFrame, packed: bool = True, few: int = 20_000, tiles: int = 16) -> DataFrame:
    """Product of each row of ``weights`` with each of ``activations`` (``row, block, d, qs``; q4 if ``packed``, q8), as ``(i, j, c)``.
    Blocks meet on their number only where both have one; the smaller side should be ``activations``. Up to ``few`` blocks of it are broadcast. Beyond that the
    product is cut in ``tiles`` by ``tiles`` tiles of rows, each side goes to those of its rows, and a tile is a join key besides the block."""
    left = weights.select(F.col("row").alias("i"), "block", F.col("d").alias("dx"), (unpack_q4(F.col("qs")) if packed else F.col("qs")).alias("x"))
    right = activations.select(F.col("row").alias("j"), "block", F.col("d").alias("dy"), F.col("qs").alias("y"))
    dot = block_dot(F.col("x"), F.col("y")) * F.col("dx") * F.col("dy")
    on = ["block"]
    if (sent := broadcast_if_small(right, few)) is right:
        tile = lambda c: F.pmod(F.xxhash64(c), F.lit(tiles)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
        left, right = left.select("*", tile("i").alias("ti"), each.alias("tj")), right.select("*", each.alias("ti"), tile("j").alias("tj"))
        on, sent = ["block", "ti", "tj"], right
    return left.join(sent, on).groupBy("i", "j").agg(F.sum(dot).alias("c"))


def broadcast_matmul(a: DataFrame, b: DataFrame, r2: int, r3: int) -> DataFrame:
    """Products of stacks of matrices: ``a`` (``i2, i3, i, k, v``) is shared by ``r2`` by ``r3`` matrices of ``b`` (``i2, i3, k, j, b``), whose
    indexes are divided, rounding down. Returns ``(i2, i3, i, j, c)`` with the indexes of ``b``."""
    right = b.withColumn("a2", F.floor(F.col("i2") / r2)).withColumn("a3", F.floor(F.col("i3") / r3))
    left = a.select(F.col("i2").alias("a2"), F.col("i3").alias("a3"), "i", "k", "v")
    return right.join(left, ["a2", "a3", "k"]).groupBy("i2", "i3", "i", "j").agg(F.sum(F.col("v") * F.col("b")).alias("c"))
