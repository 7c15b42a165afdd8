"""Scripts of commands as tables: one command a line, and the shapes that its animation commands make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.voxel import CELL


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """Commands ``(file, nth, command, args array)`` of script files; see ``parse_commands``."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return parse_commands(texts)


def parse_commands(texts: DataFrame) -> DataFrame:
    """Commands of ``(file, text)``: lines in their order without blank ones and ``#`` lines, split at white space. Whether a command is known
    is not looked at."""
    lines = F.transform(F.split("text", "\r?\n"), lambda s: F.trim(F.translate(s, "\t", " ")))
    kept = F.filter(lines, lambda s: (s != "") & ~s.startswith("#"))
    each = texts.select("file", F.posexplode(kept).alias("nth", "line")).withColumn("part", F.split("line", " +"))
    return each.select("file", "nth", F.element_at("part", 1).alias("command"), F.slice("part", 2, F.greatest(F.size("part") - 1, F.lit(0))).alias("args"))


def _number(at: int, kind: str = "double") -> Column:
    return F.try_element_at("args", F.lit(at)).try_cast(kind)


def block_edits(commands: DataFrame) -> DataFrame:
    """Cells ``(file, nth, x, y, z, state)`` that ``setblock x y z state`` and ``fill x1 y1 z1 x2 y2 z2 state`` write; the two corners are in any order."""
    corner = [F.least(_number(i + 1, "int"), F.when(F.col("command") == "fill", _number(i + 4, "int")).otherwise(_number(i + 1, "int"))).alias(f"lo{i}") for i in range(3)]
    other = [F.greatest(_number(i + 1, "int"), F.when(F.col("command") == "fill", _number(i + 4, "int")).otherwise(_number(i + 1, "int"))).alias(f"hi{i}") for i in range(3)]
    state = F.when(F.col("command") == "fill", _number(7, "int")).otherwise(_number(4, "int")).alias("state")
    boxes = commands.where("command in ('setblock', 'fill')").select("file", "nth", *corner, *other, state).dropna()
    for i, c in enumerate(CELL):
        boxes = boxes.withColumn(c, F.explode(F.sequence(f"lo{i}", f"hi{i}")))
    return boxes.select("file", "nth", *CELL, "state")


def shape_table(commands: DataFrame) -> DataFrame:
    """Shapes ``(file, name, kind, sizes, x, y, z, state, destroy, moves, spins, orbits)`` of ``animate`` commands: ``create N KIND x y z sizes.. state``,
    ``move N dx dy dz start end``, ``spin N rx ry rz start end``, ``orbit N plane radius speed start end [degrees]`` and ``destroy N tick``. What is said of a
    shape that no command creates, and commands with arguments missing, are left out."""
    a = commands.where("command = 'animate'").select("file", "nth", F.element_at("args", 1).alias("verb"), F.try_element_at("args", F.lit(2)).alias("name"), F.slice("args", 3, F.greatest(F.size("args") - 2, F.lit(0))).alias("args"))
    span = [_number(4, "bigint").alias("start"), _number(5, "bigint").alias("stop")]
    move = F.struct(_number(1).alias("dx"), _number(2).alias("dy"), _number(3).alias("dz"), *span)
    spin = F.struct(_number(1).alias("rx"), _number(2).alias("ry"), _number(3).alias("rz"), *span)
    orbit = F.struct(F.element_at("args", 1).alias("plane"), _number(2).alias("radius"), _number(3).alias("speed"), *span, F.coalesce(F.radians(_number(6)), F.lit(0.0)).alias("phase"))

    def of(verb: str, value: Column) -> Column:
        ordered = F.sort_array(F.collect_list(F.when((F.col("verb") == verb) & _number(5, "bigint").isNotNull(), F.struct("nth", value.alias("v")))))
        return F.transform(ordered, lambda s: s["v"])

    n = F.size("args")
    made = F.struct(F.element_at("args", 1).alias("kind"), F.slice("args", 5, F.greatest(n - 5, F.lit(0))).alias("sizes"), _number(2).alias("x"), _number(3).alias("y"), _number(4).alias("z"), F.element_at("args", -1).try_cast("int").alias("state"))
    created = F.max_by(F.when(F.col("verb") == "create", made), F.when(F.col("verb") == "create", F.col("nth")))
    gone = F.max_by(F.when(F.col("verb") == "destroy", _number(1, "bigint")), F.when(F.col("verb") == "destroy", F.col("nth")))
    out = a.groupBy("file", "name").agg(created.alias("c"), gone.alias("destroy"), of("move", move).alias("moves"), of("spin", spin).alias("spins"), of("orbit", orbit).alias("orbits"))
    return out.where("c is not null").select("file", "name", "c.*", "destroy", "moves", "spins", "orbits")
