"""Joins of rows to the row of another table that comes next, or last before, in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .iterate import cut


def _asof(left: DataFrame, right: DataFrame, by: list[str], order: list[str], carry: list[str], forward: bool, name: str) -> DataFrame:
    """All rows of both sides are sorted by ``by, order`` in ranges, which may cut a key anywhere; ``right`` rows of a range are found by a window within
    it, and the one beyond its edge from a summary with one row for each range and key."""
    payload = F.struct(*order, *carry)
    there = [c for c in left.columns if c not in by and c not in order]
    sides = left.select(*by, *order, F.struct(*[F.col(c) for c in there] or [F.lit(1)]).alias("_row"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_hit"))
    hits = right.select(*by, *order, F.lit(None).cast(sides.schema["_row"].dataType).alias("_row"), payload.alias("_hit"))
    # of equal orders, a row of ``right`` is neither next nor last: it comes before the left ones going forward and after them going back
    tie = F.when(F.col("_hit").isNull() == F.lit(forward), 1).otherwise(0).alias("_tie")
    both = sides.unionByName(hits).select("*", tie)
    sorted_ = cut(both.orderBy(*by, *order, "_tie").withColumn("_range", F.spark_partition_id()), name)
    pick = F.min if forward else F.max
    # frames begin at the first row: one that ends at the last row would be summed up anew for each row, so what comes next is found in the reverse order
    turned = lambda c: F.col(c).desc() if forward else F.col(c).asc()
    near = pick("_hit").over(W.partitionBy("_range", *by).orderBy(*[turned(c) for c in (*order, "_tie")]).rowsBetween(W.unboundedPreceding, 0))
    summary = sorted_.groupBy("_range", *by).agg(pick("_hit").alias("_edge"))
    beyond = pick("_edge").over(W.partitionBy(*by).orderBy(turned("_range")).rowsBetween(W.unboundedPreceding, -1))
    edges = summary.select("_range", *[F.col(c).alias(f"_by_{c}") for c in by], beyond.alias("_beyond")).where("_beyond is not null")
    here = sorted_.withColumn("_near", near).where("_row is not null").withColumnRenamed("_range", "_at")
    same: Column = F.col("_at") == F.col("_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return here.join(edges, same, "left").select(*by, *order, *[F.col(f"_row.{c}").alias(c) for c in there], F.coalesce("_near", "_beyond").alias("_found"))


def next_after(left: DataFrame, right: DataFrame, by: list[str], order: list[str], carry: list[str] | None = None, prefix: str = "next_") -> DataFrame:
    """Each row of ``left`` with the first row of ``right`` of the same ``by`` that comes after it in ``order``: its ``order`` and ``carry`` columns, with
    ``prefix``, null if there is none. Of rows of ``right`` with equal order the one with the smallest ``carry`` counts.

    A sort in ranges and windows in them: no loop over pairs, and a key that holds most rows is spread over ranges. Null keys equal each other; null
    orders come first. Every row of ``left`` is returned once."""
    carry = carry or []
    found = _asof(left, right, by, order, carry, True, "next-after")
    return found.select(*left.columns, *[F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in (*order, *carry)])


def last_before(left: DataFrame, right: DataFrame, by: list[str], order: list[str], carry: list[str] | None = None, prefix: str = "last_") -> DataFrame:
    """As ``next_after``, the other way round: the last row of ``right`` before each row of ``left``, of equal ones that with the largest ``carry``."""
    carry = carry or []
    found = _asof(left, right, by, order, carry, False, "last-before")
    return found.select(*left.columns, *[F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in (*order, *carry)])
