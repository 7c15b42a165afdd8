"""Products of sparse matrices in which a few ``k`` hold most of the entries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import spmm

#: Keys that a sketch names at most, those that it follows at the same time, and those that a tile takes together.
MOST, FOLLOWED, TOGETHER = 1024, 8192, 64


def frequent(df: DataFrame, key: str, share: float, side: str) -> tuple[set, int]:
    """Values of ``key`` with more than ``share`` of the rows (``share`` of 1/1000 or more), and about how many values ``side`` has; one scan.

    Each task follows at most ``FOLLOWED`` values in a sketch of frequent items and the sketches are merged; their counts are off by a few ten-thousandths of the
    rows, so no such value is missed, and at most ``MOST`` values come to the driver, however many there are."""
    sketch = F.expr(f"approx_top_k(`{key}`, {MOST}, {FOLLOWED})")
    top, rows, sides = df.agg(sketch, F.count(F.lit(1)), F.approx_count_distinct(side)).first()
    return {item["item"] for item in top or [] if item["count"] > share * rows}, sides


def _tile(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over the keys of a tile: one accumulator for each of its cells, however many keys meet there."""
    (i, row), (j, column) = (np.unique(t[c].to_numpy(), return_inverse=True) for t, c in ((left, "i"), (right, "j")))
    left_k, right_k, v, b = left["k"].to_numpy(), right["k"].to_numpy(), left["v"].to_numpy(), right["b"].to_numpy()
    sums, met = np.zeros((len(i), len(j))), np.zeros((len(i), len(j)), dtype=bool)
    for k in np.intersect1d(left_k, right_k):
        l, r = left_k == k, right_k == k
        cells = np.ix_(row[l], column[r])
        sums[cells] += np.outer(v[l], b[r])
        met[cells] = True
    y, x = np.nonzero(met)
    return pa.table({"i": pa.array(i[y], left.schema.field("i").type), "j": pa.array(j[x], right.schema.field("j").type), "c": sums[y, x]})


def spmm_split(a: DataFrame, b: DataFrame, share: float = 1 / 64, area: int = 1 << 20) -> DataFrame:
    """As ``matrix.spmm``, for matrices in which single ``k`` have more than ``share`` of all entries of A or of B: ``(i, j, c)``.

    Light ``k`` are multiplied as in ``matrix.spmm``. Heavy ones are found by a sketch, their repeated coordinates are added up, and their products are cut in two dimensions: tiles of about ``area``
    cells by hashes of ``i`` and ``j``, each with up to ``TOGETHER`` keys. A tile takes few enough rows of both sides for one task, whatever share a ``k`` has,
    and returns one partial sum a cell; all partial sums are added once more by ``(i, j)``. Which ``k`` are heavy decides how a product is made, never whether. Entries
    without place or value are left out."""
    a = a.select("i", "k", F.col("v").cast("double").alias("v")).where("i IS NOT NULL AND k IS NOT NULL AND v IS NOT NULL")
    b = b.select("k", "j", F.col("b").cast("double").alias("b")).where("k IS NOT NULL AND j IS NOT NULL AND b IS NOT NULL")
    (heavy_a, rows), (heavy_b, columns) = frequent(a, "k", share, "i"), frequent(b, "k", share, "j")
    heavy = sorted(heavy_a | heavy_b)
    named = [(k, n // TOGETHER) for n, k in enumerate(heavy)]  # at most 2 * MOST rows
    parts = lambda: F.broadcast(a.sparkSession.createDataFrame(named, f"k {a.schema['k'].dataType.simpleString()}, part int"))
    light = spmm(a.join(parts(), "k", "left_anti"), b.join(parts(), "k", "left_anti"))

    across = max(1, min(columns, math.isqrt(area)))
    high, broad = max(1, math.ceil(rows * across / area)), max(1, math.ceil(columns / across))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.join(parts(), "k").groupBy("part", "k", "i").agg(F.sum("v").alias("v")).select("part", spread("i", high).alias("s"), copies(broad).alias("t"), "k", "i", "v")
    right = b.join(parts(), "k").groupBy("part", "k", "j").agg(F.sum("b").alias("b")).select("part", copies(high).alias("s"), spread("j", broad).alias("t"), "k", "j", "b")
    place = ["part", "s", "t"]
    types = f"i {a.schema['i'].dataType.simpleString()}, j {b.schema['j'].dataType.simpleString()}, c double"
    tiled = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(_tile, types)
    return light.unionByName(tiled).groupBy("i", "j").agg(F.sum("c").alias("c"))
