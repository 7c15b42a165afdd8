"""Sparse and dense matrices as rows of coordinates: products, norms, tiles."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import broadcast_if_small, prefix_sums

#: Rows of a right-hand matrix that is sent to every executor; a larger one is shuffled on ``k``.
BROADCAST_ROWS = 100_000

#: Columns of a right-hand matrix whose rows are multiplied whole.
WIDEST = 256


def from_dense(rows: DataFrame) -> DataFrame:
    """``(i, row array)`` as ``(i, k, v)`` without exact zeros. Null rows and null entries give nothing."""
    return rows.select("i", F.posexplode("row").alias("k", "v")).where("v <> 0")


def by_rows(a: DataFrame) -> DataFrame:
    """``a`` with the entries of a row in one task, so that its sums need neither a large table of partial ones nor another shuffle."""
    return a.repartition("i")


def _row_sums(a: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``(i, c0, c1, ...)`` of ``a`` and B as ``(k, row array)``: one joined row for each entry of ``a``, one accumulator for each column."""
    return a.join(rows, "k").groupBy("i").agg(*[F.sum(F.col("v").cast("double") * F.col("row")[n]).alias(f"c{n}") for n in range(width)])


def _columns(b: DataFrame) -> list | None:
    """The ``j`` of a small ``b`` (each cell once) in order, if it is dense: every ``k`` has every ``j``, without nulls, and there are few."""
    counts = [F.count(F.lit(1)), F.count("j"), F.count("b"), F.count_distinct("k"), F.count_distinct("j")]
    cells, named, filled, ks, js = b.agg(*counts).first()
    if not cells == named == filled == ks * js or not 0 < js <= WIDEST:
        return None
    return [r.j for r in b.select("j").distinct().orderBy("j").collect()]


def spmm(a: DataFrame, b: DataFrame) -> DataFrame:
    """``C[i, j] = sum of A[i, k] * B[k, j]``, as ``(i, j, c)``; repeated coordinates add up, those of ``b`` before the join, so they make no products of their own. Rows of A that meet no row of
    B have no result (see ``with_all_rows``). Products and sums are in double precision.

    A B that is small once added up goes to all tasks, and each sums whole rows of A; if it is dense, too, it goes by rows, with one accumulator for each column. For a larger one the join on ``k``
    is split where a ``k`` is frequent, and products are summed before they are shuffled on ``(i, j)``."""
    added = b.where("k IS NOT NULL").groupBy("k", "j").agg(F.sum(F.col("b").cast("double")).alias("b"))
    small = broadcast_if_small(added, BROADCAST_ROWS)
    if small is not added:
        a = by_rows(a)
        if columns := _columns(added):
            rows = added.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "b"))), lambda s: s["b"]).alias("row"))
            cells = F.array(*[F.struct(F.lit(j).cast(b.schema["j"].dataType).alias("j"), F.col(f"c{n}").alias("c")) for n, j in enumerate(columns)])
            return _row_sums(a, F.broadcast(rows), len(columns)).select("i", F.inline(cells))
    return a.join(small, "k").groupBy("i", "j").agg(F.sum(F.col("v").cast("double") * F.col("b")).alias("c"))


def spmm_rows(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """The same product from B as ``(k, row array)`` of ``width``, row by row: rows of B with one ``k`` are added up, and there is one joined row for each non-zero of A,
    and one accumulator for each column. Returns ``(i, row array)``."""
    added = b.groupBy("k").agg(F.array(*[F.sum(F.col("row")[j].cast("double")) for j in range(width)]).alias("row"))
    if (small := broadcast_if_small(added, BROADCAST_ROWS // max(1, width))) is not added:
        a = by_rows(a)
    return _row_sums(a, small, width).select("i", F.array(*[F.col(f"c{j}") for j in range(width)]).alias("row"))


def with_all_rows(c: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """``c`` filled with zeros for all of ``rows`` (``i``) and ``columns`` (``j``, few)."""
    grid = rows.select("i").join(broadcast_if_small(columns.select("j"), BROADCAST_ROWS))
    return grid.join(c, ["i", "j"], "left").select("i", "j", F.coalesce("c", F.lit(0.0)).alias("c"))


def row_pointers(a: DataFrame) -> DataFrame:
    """``(i, start, entries)`` of each row that has entries, in the layout of compressed sparse rows."""
    return prefix_sums(a.groupBy("i").agg(F.count(F.lit(1)).alias("entries")), "i", "entries").select("i", "start", "entries")


def sparsity(a: DataFrame, rows: int, columns: int) -> DataFrame:
    """Share of zero cells of a ``rows`` by ``columns`` matrix; ``entries`` counts non-zeros."""
    return a.agg(F.count_if(F.col("v") != 0).alias("entries")).select("entries", (1 - F.col("entries") / F.lit(float(rows) * columns)).alias("sparsity"))


def inf_norm(a: DataFrame, value: str = "v") -> DataFrame:
    """Largest sum of magnitudes of a row; 0 for an empty matrix."""
    return a.groupBy("i").agg(F.sum(F.abs(value)).alias("s")).agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("inf_norm"))


def scaled_residual(reference: DataFrame, other: DataFrame, a: DataFrame, b: DataFrame, epsilon: float = 2.0**-23) -> DataFrame:
    """``max |reference - other| / (norm(A) * norm(B) * epsilon)``; where that is below 1e-20, 0 for no difference and else infinite.
    ``b`` is ``(k, j, b)``; cells absent from one side count as 0."""
    both = reference.select("i", "j", F.col("c").alias("x")).join(other.select("i", "j", F.col("c").alias("y")), ["i", "j"], "full")
    gap = both.agg(F.coalesce(F.max(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))), F.lit(0.0)).alias("gap"))
    norms = inf_norm(a).withColumnRenamed("inf_norm", "na").join(inf_norm(b.select(F.col("k").alias("i"), F.col("b").alias("v"))).withColumnRenamed("inf_norm", "nb"))
    scale = F.col("na") * F.col("nb") * F.lit(epsilon)
    small = F.when(F.col("gap") == 0, 0.0).otherwise(F.lit(float("inf")))
    return gap.join(norms).select(F.when(scale < 1e-20, small).otherwise(F.col("gap") / F.when(scale >= 1e-20, scale)).alias("residual"))


def tiles(a: DataFrame, width: int) -> DataFrame:
    """First and last column and number of the entries of each row in each tile of ``width`` columns."""
    return a.groupBy("i", F.floor(F.col("k") / F.lit(width)).alias("tile")).agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.count(F.lit(1)).alias("entries"))


def shuffled(n: int, seed: int, rounds: int = 6) -> Callable[[np.ndarray], np.ndarray]:
    """A seeded permutation of ``range(n)``, number by number: a Feistel network over the smallest even number of bits that holds ``n``; what comes out
    at ``n`` or above goes through again until it falls below. At most four times ``n`` numbers are walked through."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(0, 1 << 63, rounds, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    def permute(x: np.ndarray) -> np.ndarray:
        out = once(x.astype(np.uint64))
        while len(out_of := np.flatnonzero(out >= np.uint64(n))):
            out[out_of] = once(out[out_of])
        return out.astype(np.int64)

    return permute


def random_sparse(spark: SparkSession, rows: int, columns: int, zeros: float, seed: int) -> DataFrame:
    """Exactly ``int(rows * columns * (1 - zeros))`` entries at seeded random places, each once, normally distributed.

    Places are the first so many of a seeded permutation of all cells, so nothing is sorted, shuffled or drawn twice, and cells that
    stay zero cost nothing."""
    wanted = int(rows * columns * (1 - zeros))
    if wanted == 0:
        return spark.createDataFrame([], "i long, k long, v double")

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(shuffled(rows * columns, seed)(ids.to_numpy()))

    u = [F.xxhash64("id", F.lit(seed), F.lit(part)).bitwiseAND(F.lit((1 << 52) - 1)) for part in (1, 2)]
    normal = F.sqrt(-2 * F.log((u[0] + 1) / F.lit(float(1 << 52)))) * F.cos(u[1] * F.lit(2 * math.pi / (1 << 52)))
    at = spark.range(wanted).select(place("id").alias("at"), normal.alias("v"))
    return at.select(F.floor(F.col("at") / columns).alias("i"), (F.col("at") % columns).alias("k"), "v")


def random_dense(spark: SparkSession, rows: int, columns: int, seed: int) -> DataFrame:
    """All cells of a matrix, normally distributed with a standard deviation of 2."""
    return spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("k"), (F.col("id") % columns).cast("int").alias("j"), (F.randn(seed) * 2).alias("b"))
