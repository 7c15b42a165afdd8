"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_words, small, text_or_empty, written


def water_fill(sources: DataFrame, max_epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """Targets of sources with columns ``source, source_size, weight``.

    ``share`` of all sizes is dealt out in proportion to ``weight``; a source whose part exceeds
    ``max_epochs`` times its size is clamped there and the excess goes to the others by weight, until
    no source is above. Clamping one source only raises what the others get, so sources are clamped in
    the order of cap / weight: round k has clamped the first k. The level after each round comes from
    running sums over the sources (one row each), and the first feasible round is taken.
    Sources of size 0, and an empty table, get target 0 or no row.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    rounds = sources.withColumn("_cap", cap).withColumn("_level", level)
    feasible = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))
    final = F.min_by(F.col("_level"), F.when(feasible.isNotNull(), F.col("_cap") / F.col("weight"))).over(whole)
    return rounds.withColumn("_final", final).select(
        *sources.columns, F.coalesce(F.least(F.col("_cap"), F.col("_final") * F.col("weight")), F.col("_cap")).alias("target")
    )


def _placed(docs: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``docs`` with their place in the seeded order: bucket, then hash. Rows without a doc_id are placed by their text's hash, ``tie``."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("tie").cast("string")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return (
        docs.withColumn("hash", F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("long"))
        .withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
        .withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    )


#: Order inside a bucket: rows with one doc_id come by their texts, and equal rows one by one.
ORDER = ["hash", "tie", "rid"]


def _cuts(slim: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """One row for each source: target, whole repetitions, and where in the order the fractional one ends."""
    by_bucket = written(slim.groupBy("source_key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size")), "mix-buckets")
    sources = by_bucket.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    targets = (
        water_fill(sources.withColumn("weight", weight), max_epochs)
        .select("source_key", "source_size", "target")
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("ratio").cast("int"))
        .withColumn("wanted", (F.col("ratio") - F.col("whole")) * F.col("source_size"))
    )
    targets = written(targets, "mix-targets")
    before = W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = by_bucket.select("source_key", "bucket", "bucket_size", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("start"))
    edge = starts.join(targets.select("source_key", "wanted"), "source_key").where((F.col("start") < F.col("wanted")) & (F.col("start") + F.col("bucket_size") >= F.col("wanted")))
    edge = written(edge.select("source_key", F.col("bucket").alias("edge"), "start", "wanted"), "mix-edges")
    near = slim.join(F.broadcast(edge) if small(edge, 200_000) else edge, (slim["bucket"] == edge["edge"]) & (slim["source_key"] == edge["source_key"])).drop(edge["source_key"])
    run = F.sum("size").over(W.partitionBy("source_key").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0))
    inside = near.withColumn("run", run).where(F.col("start") + F.col("run") - F.col("size") / 2 < F.col("wanted"))
    last = inside.groupBy("source_key").agg(F.max(F.struct(*ORDER)).alias("last"))
    return written(targets.join(edge.select("source_key", "edge"), "source_key", "left").join(last, "source_key", "left"), "mix-cuts")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: float = 3.0,
    seed: int = 17,
    buckets: int = 4096,
    size: Column | None = None,
    payload: tuple[str, ...] = (),
    row: str | None = None,
) -> DataFrame:
    """How often a mix takes each document of ``docs`` (``doc_id, source, text``, and the columns of ``payload``).

    Sources in code-point order (null last) weigh ``weights``, repeated. Each document is taken
    ``floor(target / source_size)`` times whole; the fractional repetition goes to the first documents
    of a seeded hash order until the source's target is met, so a rerun takes the same ones and a
    source misses its target by at most half of one document. Sizes are summed by source and ``buckets`` hash ranges; only the
    range in which a source's target is met is looked at row by row, and its last row's place is the cut. So documents
    are decided where they stand: neither they nor their texts are shuffled. Sources (one row each) are ordered in one task, which is
    meant for up to some hundred thousand of them.

    Null text has size 0 and is taken 0 words; texts of any length are counted whole; an empty table gives an empty result; rows with equal or without
    doc_id are decided each, by their texts, and of wholly equal rows a rerun takes as many. Returns ``doc_id, source, size, source_size, target, repeats, taken``, or with ``payload``
    (names other than these) ``doc_id, source, payload, repeats``. With ``row``, a column that tells the rows apart in every job, payload is read again
    and not written.
    """
    size = in_words(text_or_empty()) if size is None else size
    named = F.monotonically_increasing_id() if row is None else F.col(row)
    counted = docs.select(named.alias("rid"), "doc_id", "source", size.alias("size"), F.xxhash64(text_or_empty()).alias("tie"), *payload)
    slim = ["rid", "doc_id", "source", "size", "tie", "hash", "bucket", "source_key"]
    placed = _placed(counted, buckets, seed)
    again = placed if payload and row else None
    rows = written(placed if again is None else placed.select(*slim), "mix")
    cuts = _cuts(rows.select(*slim), weights, max_epochs)
    rows = rows if again is None else again
    decided = rows.join(F.broadcast(cuts) if small(cuts, 200_000) else cuts, "source_key")
    extra = F.when((F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (F.struct(*ORDER) <= F.col("last"))), 1).otherwise(0)
    repeats = (F.col("whole") + extra).cast("int")
    if payload:
        return decided.select("doc_id", "source", *payload, repeats.alias("repeats"))
    return decided.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken"))
