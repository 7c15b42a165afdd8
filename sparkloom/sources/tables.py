"""Tables of snapshots, sinograms and lookups on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def record(series: DataFrame, path: str, every: int = 1) -> None:
    """Append each ``every``-th snapshot of ``(tick, ...)``, in a folder for each tick so that a reader prunes by it."""
    series.where(F.col("tick") % every == 0).write.mode("append").partitionBy("tick").parquet(path)


def recorded(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df if first is None else df.where(F.col("tick") >= first)
    return df if last is None else df.where(F.col("tick") <= last)


def lookup(rows: DataFrame, names: DataFrame, key: str, missing: int = -1) -> DataFrame:
    """Numbers of names from a table ``(key, id)`` of them; ``missing`` for those it lacks."""
    return rows.join(names.select(key, "id"), key, "left").withColumn("id", F.coalesce("id", F.lit(missing)))


def timing(ticks: int, seconds: float) -> dict[str, float]:
    return {"total_ticks": ticks, "total_time_seconds": seconds, "ticks_per_second": ticks / seconds if seconds > 0 else float("inf")}
