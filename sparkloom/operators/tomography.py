"""Filtered back-projection: rows of a sinogram are ``(slice, angle, row array)``, an image is ``(slice, y, x, value)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Images that a task sums up at most before it passes them on.
OPEN_IMAGES = 64


def ramp(n: int, spacing: float = 1.0) -> np.ndarray:
    """Ramp filter for rows of ``n`` detectors, at distances -K to K: odd length, centre ``1 / (4 d**2)``, 0 at even and ``-1 / (pi k d)**2`` at odd distances."""
    k = np.arange(-((n | 1) // 2), (n | 1) // 2 + 1)
    odd = np.where(k % 2 != 0, k, 1)
    return np.where(k == 0, 0.25, np.where(k % 2 != 0, -1.0 / (np.pi * odd) ** 2, 0.0)) / spacing**2


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.array([x if x is not None and len(x) == n else [0.0] * n for x in column.to_pylist()], dtype=np.float64).reshape(-1, n)


def filter_rows(sinogram: DataFrame, n: int, spacing: float = 1.0) -> DataFrame:
    """Each row convolved with the ramp, zero beyond its ends: one matrix product for a batch of rows. Rows that are null or of
    another length than ``n`` become zeros."""
    k = len(ramp(n)) // 2
    gap = np.arange(n)[:, None] - np.arange(n)[None, :]
    taps = np.where(np.abs(gap) <= k, ramp(n, spacing)[np.clip(gap + k, 0, 2 * k)], 0.0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _matrix(b.column("row"), n) @ taps
            yield pa.RecordBatch.from_arrays([b.column("slice"), b.column("angle"), pa.array(list(out), pa.list_(pa.float64()))], names=["slice", "angle", "row"])

    typed = sinogram.select(F.col("slice").cast("int").alias("slice"), F.col("angle").cast("int").alias("angle"), "row")
    return typed.mapInArrow(work, "slice int, angle int, row array<double>")


def back_project(filtered: DataFrame, n: int, angles: int) -> DataFrame:
    """Sum over the angles of each row smeared over an ``n`` by ``n`` image, times pi / angles. Row ``a`` was taken at
    ``180 a / angles`` degrees. Between detectors values are interpolated; the lower one is found by truncation towards zero,
    and each of the two counts only if it exists. A task sums its rows of a slice in one array before anything is shuffled, so what
    is shuffled are images and not rays."""
    half = (n - 1) / 2
    y, x = np.mgrid[0:n, 0:n] - half

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        images: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(images), pa.int32()), pa.array([v.ravel() for v in images.values()], pa.list_(pa.float64()))], names=["slice", "image"])
            images.clear()
            return batch

        for b in batches:
            rows = _matrix(b.column("row"), n)
            for s, a, row in zip(b.column("slice").to_pylist(), b.column("angle").to_pylist(), rows, strict=True):
                theta = np.pi * a / angles
                u = x * np.cos(theta) + y * np.sin(theta) + half
                low = np.trunc(u).astype(np.int64)
                part = u - low
                padded = np.concatenate((row, [0.0]))  # the last place stands for all that are missing
                at = np.where((low >= 0) & (low < n), low, n)
                after = np.where((low + 1 >= 0) & (low + 1 < n), low + 1, n)
                value = padded[at] * (1 - part) + padded[after] * part
                if s not in images and len(images) >= OPEN_IMAGES:
                    yield out()
                images[s] = images.get(s, 0.0) + value
        if images:
            yield out()

    rays = filtered.where("slice is not null AND angle is not null").mapInArrow(work, "slice int, image array<double>")
    pixels = rays.select("slice", F.posexplode("image").alias("at", "v")).groupBy("slice", "at").agg(F.sum("v").alias("v"))
    return pixels.select("slice", F.floor(F.col("at") / n).cast("int").alias("y"), (F.col("at") % n).alias("x"), (F.col("v") * F.lit(np.pi / angles)).alias("value"))


def reconstruct(sinogram: DataFrame, n: int, angles: int, spacing: float = 1.0) -> DataFrame:
    return back_project(filter_rows(sinogram, n, spacing), n, angles)


def grey_levels(volume: DataFrame, n: int) -> DataFrame:
    """Pixels as 0 to 255 between the least and largest value of their slice, upside down; an even image is 0."""
    ends = volume.groupBy("slice").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    level = F.greatest(F.lit(0), F.least(F.lit(255), F.round((F.col("value") - F.col("lo")) / span * 255).cast("int")))
    return volume.join(ends, "slice").select("slice", (F.lit(n - 1) - F.col("y")).alias("y"), "x", level.alias("level"))


def angles_of(n: DataFrame, angles: int) -> DataFrame:
    """Degrees of each ``angle``."""
    return n.select("angle", (F.col("angle") * 180.0 / F.lit(angles)).alias("degrees"))


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Angles as places in ``order`` within ``by``, for tables that don't number them; a slice is one group."""
    return rows.withColumn("angle", (F.row_number().over(W.partitionBy(by).orderBy(order)) - 1).cast("int"))
