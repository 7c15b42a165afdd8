"""Run-length patterns of live cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Live cells ``(file, y, x)`` of pattern files."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return parse_patterns(texts)


def parse_patterns(texts: DataFrame) -> DataFrame:
    """Live cells of ``(file, text)``. Blank lines and ``#`` lines are skipped; the first line with x and y is the head, whose width cuts rows off;
    then come runs up to ``!``: ``o`` live, ``b`` dead, ``$`` next row, with a number in front for a run. The rule in the head is not read.

    A run's row is the number of ``$`` before it and its column the length of the runs before it in the row: two running sums
    within a file."""
    lines = F.filter(F.split("text", "\r?\n"), lambda s: (F.trim(s) != "") & ~F.trim(s).startswith("#"))
    is_head = lambda s: s.contains("x") & s.contains("y") & s.contains("=")
    head = F.element_at(F.filter(lines, is_head), 1)
    body = F.substring_index(F.array_join(F.filter(lines, lambda s: ~is_head(s)), ""), "!", 1)
    width = F.regexp_extract(head, r"x\s*=\s*(\d+)", 1).cast("int")
    runs = texts.select("file", width.alias("width"), F.posexplode(F.regexp_extract_all(body, F.lit(r"(\d*[bo$])"), 1)).alias("nth", "run"))
    count = F.greatest(F.coalesce(F.try_to_number(F.regexp_extract("run", r"^(\d+)", 1), F.lit("999999")), F.lit(1)), F.lit(1)).cast("int")
    kinds = runs.select("file", "width", "nth", F.right("run", F.lit(1)).alias("kind"), count.alias("n"))
    before = W.partitionBy("file").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    rows = kinds.withColumn("y", F.coalesce(F.sum(F.when(F.col("kind") == "$", F.col("n"))).over(before), F.lit(0)))
    in_row = W.partitionBy("file", "y").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("x", F.coalesce(F.sum("n").over(in_row), F.lit(0)))
    live = placed.where("kind = 'o'").select("file", "width", F.col("y"), F.explode(F.sequence(F.col("x"), F.col("x") + F.col("n") - 1)).alias("x"))
    return live.where("x < width").select("file", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
