"""Coordinate files of sparse matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import broadcast_if_small, cut


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Entries ``(file, i, k, v)`` of coordinate files, from 0 on. ``%`` lines are comments; the first other line has the size and is left
    out. Entries without a value are 1; a file that isn't ``general`` has its entries off the diagonal mirrored, negated if it is
    ``skew-symmetric``. Files of other formats give nothing. Repeated entries are kept: they add up in products.

    A file's first lines tell its kind, found as minima over its lines; the entries themselves are never gathered."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("nth"), F.trim("value").alias("line")).where("line <> ''")
    lines = cut(lines, "matrix-lines")  # places are those of one scan, read twice
    kinds = lines.where("line like '%\\%\\%MatrixMarket%'").groupBy("file").agg(F.lower(F.first("line")).alias("kind"))
    body = lines.where("not startswith(line, '%')")
    size_line = body.groupBy("file").agg(F.min("nth").alias("size_nth"))
    part = F.split("line", r"\s+")
    entries = body.join(broadcast_if_small(size_line.join(kinds, "file"), 100_000), "file").where("nth > size_nth AND kind like '%coordinate%'")
    v = F.when(F.size(part) > 2, F.element_at(part, 3).cast("double")).otherwise(1.0)
    one = entries.select("file", "kind", (part[0].cast("long") - 1).alias("i"), (part[1].cast("long") - 1).alias("k"), v.alias("v"))
    sign = F.when(F.col("kind").like("%skew%"), -1.0).otherwise(1.0)
    mirrored = one.where("i <> k AND kind not like '%general%'").select("file", F.col("k").alias("i"), F.col("i").alias("k"), (F.col("v") * sign).alias("v"))
    return one.select("file", "i", "k", "v").unionByName(mirrored)


def write_matrix(a: DataFrame, path: str, rows: int, columns: int) -> None:
    """``(i, k, v)`` as one general coordinate file for each partition, each with its own head."""
    head = "%%MatrixMarket matrix coordinate real general"
    with_part = cut(a.withColumn("part", F.spark_partition_id()), "matrix-parts")  # heads and entries have to see the same partitions
    sizes = with_part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    heads = sizes.select("part", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit(head).alias("value")), F.struct(F.lit(1).alias("o"), F.concat_ws(" ", F.lit(rows), F.lit(columns), "n").alias("value")))).alias("h")).select("part", "h.o", "h.value")
    body = with_part.select("part", F.lit(2).alias("o"), F.concat_ws(" ", F.col("i") + 1, F.col("k") + 1, "v").alias("value"))
    heads.unionByName(body).repartition("part").sortWithinPartitions("part", "o").select("part", "value").write.partitionBy("part").text(path)
