"""Sharding by minimax contiguous partition. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_or_empty, written


def shards_needed(sizes: Column, capacity: Column) -> Column:
    """Shards that a greedy pass over ``sizes`` fills up to ``capacity`` each."""
    start = F.struct(F.lit(1).alias("n"), F.lit(0).cast("long").alias("fill"))

    def put(state: Column, size: Column) -> Column:
        fits = state["fill"] + size <= capacity
        return F.struct(
            F.when(fits, state["n"]).otherwise(state["n"] + 1).alias("n"),
            F.when(fits, state["fill"] + size).otherwise(size).alias("fill"),
        )

    return F.aggregate(sizes, start, put, lambda s: s["n"])


def smallest_capacity(sizes: Column, shards: int) -> Column:
    """Binary search for the smallest capacity at which a greedy pass needs at most ``shards``: between
    the largest of (largest group, mean) and the total."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    least = F.greatest(F.array_max(sizes), F.ceil(total / F.lit(shards)))
    start = F.struct(least.cast("long").alias("lo"), F.least(total, least + F.array_max(sizes)).cast("long").alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + F.shiftright(state["hi"] - state["lo"], 1)).cast("long")
        fits = F.when(state["lo"] < state["hi"], shards_needed(sizes, mid) <= shards)
        return F.struct(
            F.when(fits, state["lo"]).when(~fits, mid + 1).otherwise(state["lo"]).alias("lo"),
            F.when(fits, mid).otherwise(state["hi"]).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(62)), start, halve, lambda s: s["hi"])


def cut_points(sizes: Column, capacity: Column) -> Column:
    """Indexes of the groups that begin a new shard in the greedy pass."""
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).cast("long").alias("fill"), F.lit(0).alias("at"))

    def put(state: Column, size: Column) -> Column:
        fits = state["fill"] + size <= capacity
        return F.struct(
            F.when(fits, state["cuts"]).otherwise(F.array_append(state["cuts"], state["at"])).alias("cuts"),
            F.when(fits, state["fill"] + size).otherwise(size).alias("fill"),
            (state["at"] + 1).alias("at"),
        )

    return F.aggregate(sizes, start, put, lambda s: s["cuts"])


def shard(docs: DataFrame, shards: int = 24, cells: int = 65536, slices: int = 4096) -> DataFrame:
    """Put ``docs`` (``doc_id, text``) into ``shards`` shards of near equal bytes; law ``bytes``.

    Rows with equal text stay together. Groups of equal texts are laid out in the order of their
    hash, bundled into ``cells`` hash ranges, so the ordered sequence that is searched has a bounded
    length at any size of the table. The smallest feasible capacity over it is found by binary search
    with a greedy check, and the sequence is cut there. A group larger than a mean shard makes that
    shard larger: groups are atomic. Within a shard, rows get slots in the order of cell, slice, doc_id;
    a cell with many rows (a group of copies) is dealt into slices, about ``slices`` for the whole
    table, and each slice is numbered alone.

    Size is UTF-8 bytes plus 8; null text counts as none and is grouped with empty text. Texts of any length are read once, whole, and not
    shuffled; one larger than a mean shard is a group like any other. Other columns are not read. An empty table
    gives an empty result; rows with equal doc_id are rows of their own.
    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.
    """
    text = text_or_empty()
    slim = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.shiftrightunsigned(F.xxhash64(text), 24), F.lit(cells)).cast("int").alias("cell"),
        ),
        "shard",
    )
    by_cell = written(slim.groupBy("cell").agg(F.sum("size").alias("cell_size"), F.count(F.lit(1)).alias("cell_rows")), "shard-cells")
    line = by_cell.agg(F.sort_array(F.collect_list(F.struct("cell", "cell_size"))).alias("line")).where(F.size("line") > 0)
    sizes = F.transform("line", lambda x: x["cell_size"])
    cut = written(line.select("line", sizes.alias("sizes")).withColumn("capacity", smallest_capacity(F.col("sizes"), shards)), "shard-capacity")
    starts = cut.select(F.transform(cut_points(F.col("sizes"), F.col("capacity")), lambda i: F.element_at(F.col("line"), i + 1)["cell"]).alias("starts"))
    total = by_cell.agg(F.sum("cell_rows").alias("rows"))
    first_cells = next((r["starts"] for r in starts.collect()), [])  # one row of at most `shards` numbers
    all_rows = total.first()["rows"] or 1
    of_cell = F.size(F.filter(F.array(*[F.lit(c) for c in first_cells]).cast("array<int>"), lambda c: c <= F.col("cell")))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    laid = by_cell.withColumn("shard", of_cell).select(
        "cell",
        "shard",
        F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("cell_start"),
        F.ceil(F.col("cell_rows") * F.lit(slices) / F.lit(all_rows)).cast("int").alias("n_slices"),
    )
    # `laid` has at most `cells` rows of four numbers
    placed = slim.join(F.broadcast(laid), "cell").withColumn("slice", F.pmod(F.xxhash64("doc_id", "size"), F.col("n_slices")).cast("int"))
    counts = placed.groupBy("cell", "slice").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(
        "cell", "slice", F.coalesce(F.sum("n").over(W.partitionBy("cell").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("slice_start")
    )
    at = F.row_number().over(W.partitionBy("cell", "slice").orderBy("doc_id", "text_crc32")) - 1
    return (
        placed.withColumn("at", at)
        .join(offsets, ["cell", "slice"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("cell_start") + F.col("slice_start") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
