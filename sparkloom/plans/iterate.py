"""Loops over DataFrames: lineage is cut by tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. A folder of our own where that is unset and all run in one process (tests);
    an error on a cluster, whose executors would write where the driver can't read."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="sparkloom-")
    return _own[app]


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a table that is written once and read back, so a loop's plan stays as long as one round."""
    path = f"{shared_dir(df.sparkSession)}/sparkloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; counting stops there."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def digest(df: DataFrame) -> tuple:
    """Row count and two order-free hashes of all rows: equal sets of rows have equal digests."""
    row = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    h, g = F.xxhash64(row), F.xxhash64(row, F.lit(1))
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(g.cast("decimal(38,0)"))).first())


def repeat(state: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, until_still: bool = True) -> DataFrame:
    """``step`` applied up to ``rounds`` times; ends early when a round changes nothing. Nothing is compared after the last round."""
    before = digest(state) if until_still and rounds > 1 else None
    for n in range(rounds):
        state = cut(step(state))
        if until_still and n < rounds - 1:
            after = digest(state)
            if after == before:
                break
            before = after
    return state


def prefix_sums(counts: DataFrame, key: str, value: str, span: int = 65_536) -> DataFrame:
    """``counts`` with ``start``: the sum of ``value`` over all smaller keys (integers, each once). Two levels: sums within
    ranges of ``span`` keys, and a running sum over the ranges, so no task holds more than a range or one number of each."""
    from pyspark.sql import Window as W

    ranged = counts.withColumn("_range", F.floor(F.col(key) / F.lit(span)))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = totals.select("_range", F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_range").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_inside", inside).join(before, "_range").withColumn("start", (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_inside", "_before")


def offsets(df: DataFrame, names: list[str], moves: list[tuple[int, ...]], **extra: Column) -> DataFrame:
    """Each row once for each move, with ``names`` shifted by it; other columns stay."""
    moved = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for n, d in zip(names, m, strict=True)]) for m in moves]))
    rest = [c for c in df.columns if c not in names]
    return df.withColumn("_m", moved).select(*[(F.col(n) + F.col(f"_m.{n}")).cast(df.schema[n].dataType).alias(n) for n in names], *rest, *[c.alias(k) for k, c in extra.items()])
