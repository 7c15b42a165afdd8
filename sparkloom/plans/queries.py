"""One query for each operator over the standard tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import automaton, changes, commands, heavy, levels, lighting, matrix, nested, packed, quant, sections, sessions, shapes, spatial, tomography, trees, voxel
from ..sources import blocks_gzip, matrix_market, patterns, scripts
from ..sources.tables import lookup, table
from .iterate import cut, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Matrices: A from line items (supplier, part modulo 500, quantity), B from embeddings (vector modulo 500).

_A = "a AS (SELECT l_suppkey AS i, l_partkey % 500 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
_B = "b AS (SELECT vec_id % 500 AS k, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS b FROM embeddings)"
_C = f"WITH {_A}, {_B}, c AS (SELECT i, j, sum(v * b) AS c FROM a JOIN b USING (k) GROUP BY 1, 2)"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of A with repeated coordinates, which products add up themselves."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 500).alias("k"), F.col("l_quantity").alias("v"))


def _a(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).groupBy("i", "k").agg(F.sum("v").alias("v"))


def _b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select((F.col("vec_id") % 500).alias("k"), F.posexplode("embedding").alias("j", "b"))


@_query(_C + " SELECT i, CAST(j AS BIGINT) AS j, round(c, 6) AS c FROM c")
def spmm(spark, d):
    return matrix.spmm(_entries(spark, d), _b(spark, d)).select("i", F.col("j").cast("long").alias("j"), F.round("c", 6).alias("c"))


@_query(_C + " SELECT i, CAST(j AS BIGINT) AS j, round(c, 6) AS c FROM c")
def spmm_rows(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 500).alias("k"), F.col("embedding").alias("row"))
    out = matrix.spmm_rows(_entries(spark, d), rows, 64).select("i", F.posexplode("row").alias("j", "c"))
    return out.select("i", F.col("j").cast("long").alias("j"), F.round("c", 6).alias("c"))


_HOT = "a AS (SELECT l_suppkey AS i, CASE WHEN l_linenumber % 2 = 0 THEN 7 ELSE l_partkey % 500 END AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


@_query(f"WITH {_HOT}, {_B} SELECT i, CAST(j AS BIGINT) AS j, round(sum(v * b), 6) AS c FROM a JOIN b USING (k) GROUP BY 1, 2")
def spmm_split(spark, d):
    k = F.when(F.col("l_linenumber") % 2 == 0, 7).otherwise(F.col("l_partkey") % 500).cast("long")
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), k.alias("k"), F.col("l_quantity").alias("v"))
    return heavy.spmm_split(a, _b(spark, d)).select("i", F.col("j").cast("long").alias("j"), F.round("c", 6).alias("c"))


@_query(
    "SELECT i, CAST(coalesce(sum(entries) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, entries "
    "FROM (SELECT l_orderkey AS i, count(*) AS entries FROM lineitem GROUP BY 1)"
)
def row_pointers(spark, d):
    return matrix.row_pointers(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i")))


@_query(f"WITH {_A} SELECT count(*) FILTER (v <> 0) AS entries, round(1 - count(*) FILTER (v <> 0) / (10000.0 * 500), 9) AS sparsity FROM a")
def sparsity(spark, d):
    return matrix.sparsity(_a(spark, d), 10_000, 500).select("entries", F.round("sparsity", 9).alias("sparsity"))


@_query(f"WITH {_A} SELECT round(max(s), 6) AS inf_norm FROM (SELECT sum(abs(v)) AS s FROM a GROUP BY i)")
def inf_norm(spark, d):
    return matrix.inf_norm(_a(spark, d)).select(F.round("inf_norm", 6).alias("inf_norm"))


@_query(
    _C + ", n AS (SELECT (SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM a GROUP BY i)) AS na, (SELECT max(s) FROM (SELECT sum(abs(b)) AS s FROM b GROUP BY k)) AS nb) "
    "SELECT round((SELECT max(abs(c - round(c, 2))) FROM c) / (na * nb * pow(2.0, -23)), 3) AS residual FROM n"
)
def scaled_residual(spark, d):
    a, b = _a(spark, d), _b(spark, d)
    c = cut(matrix.spmm(_entries(spark, d), b), "product")  # read twice
    coarse = c.withColumn("c", F.round("c", 2))
    return matrix.scaled_residual(c, coarse, a, b).select(F.round("residual", 3).alias("residual"))


@_query(f"WITH {_A} SELECT i, k // 64 AS tile, min(k) AS first_k, max(k) AS last_k, count(*) AS entries FROM a GROUP BY 1, 2")
def matrix_tiles(spark, d):
    return matrix.tiles(_a(spark, d), 64)


@_query(
    "WITH e AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS k, unnest(embedding) AS v FROM embeddings) "
    "SELECT i, CAST(count(*) AS BIGINT) AS entries, CAST(sum(k) AS BIGINT) AS k_sum, round(sum(CAST(v AS DOUBLE)), 5) AS v_sum FROM e WHERE v <> 0 GROUP BY i"
)
def dense_to_sparse(spark, d):
    coo = matrix.from_dense(table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("row")))
    return coo.groupBy("i").agg(F.count(F.lit(1)).alias("entries"), F.sum("k").alias("k_sum"), F.round(F.sum(F.col("v").cast("double")), 5).alias("v_sum"))


# Quantised rows

_Q = """
p AS (SELECT {row} AS row, unnest(range(len(x) // 32)) AS block, x FROM ({source})),
s AS (SELECT row, block, x[block * 32 + 1 : block * 32 + 32] AS x FROM p),
q AS (SELECT row, block, list_max(list_transform(x, lambda v: abs(CAST(v AS DOUBLE)))) / {levels} AS d, x FROM s),
{name} AS (SELECT row, block, d, list_transform(x, lambda v: CAST(CASE WHEN d > 0 THEN round(CAST(v AS DOUBLE) / d) ELSE 0 END AS INT)) AS qs FROM q)"""
_EMB = "SELECT vec_id, embedding AS x FROM embeddings"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("x"))


@_query("WITH" + _Q.format(row="vec_id", source=_EMB, levels="127.0", name="r") + " SELECT row, CAST(block AS BIGINT) AS block, round(d, 9) AS d, array_to_string(qs, ',') AS qs FROM r")
def q8_blocks(spark, d):
    return quant.quantise_q8(_rows(spark, d)).select("row", F.col("block").cast("long").alias("block"), F.round("d", 9).alias("d"), F.array_join("qs", ",").alias("qs"))


@_query(
    "WITH" + _Q.format(row="vec_id", source=_EMB, levels="7.0", name="r")
    + " SELECT row, CAST(block AS BIGINT) AS block, round(d, 9) AS d, array_to_string(list_transform(range(1, 17), lambda k: qs[k] + 8 + (qs[k + 16] + 8) * 16), ',') AS qs FROM r"
)
def q4_blocks(spark, d):
    return quant.quantise_q4(_rows(spark, d)).select("row", F.col("block").cast("long").alias("block"), F.round("d", 9).alias("d"), F.array_join("qs", ",").alias("qs"))


_TOPS = "SELECT label, list(m ORDER BY j) AS x FROM (SELECT label, j, max(e) AS m FROM (SELECT label, unnest(range(len(embedding))) AS j, unnest(embedding) AS e FROM embeddings) GROUP BY 1, 2) GROUP BY 1"


def _tops(spark: SparkSession, d: str) -> DataFrame:
    """Largest value of each dimension, for each label."""
    each = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("j", "e")).groupBy("label", "j").agg(F.max("e").alias("m"))
    return each.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("j", "m"))).alias("l")).select(F.col("label").cast("long").alias("row"), F.transform("l", lambda s: s["m"]).alias("x"))


def _matmul_sql(levels: str) -> str:
    w = _Q.format(row="vec_id", source=_EMB, levels=levels, name="w")
    a = _Q.format(row="label", source=_TOPS, levels="127.0", name="t").replace("p AS", "p2 AS").replace("FROM p)", "FROM p2)").replace("s AS", "s2 AS").replace("FROM s)", "FROM s2)").replace("q AS", "q2 AS").replace("FROM q)", "FROM q2)")
    return f"WITH{w},{a} SELECT w.row AS i, CAST(t.row AS BIGINT) AS j, round(sum(list_sum(list_transform(range(1, 33), lambda k: w.qs[k] * t.qs[k])) * w.d * t.d), 5) AS c FROM w JOIN t USING (block) GROUP BY 1, 2"


@_query(_matmul_sql("7.0"))
def q4_matmul(spark, d):
    out = quant.matmul(quant.quantise_q4(_rows(spark, d)), quant.quantise_q8(_tops(spark, d)))
    return out.select("i", "j", F.round("c", 5).alias("c"))


@_query(_matmul_sql("127.0"))
def q8_matmul(spark, d):
    out = quant.matmul(quant.quantise_q8(_rows(spark, d)), quant.quantise_q8(_tops(spark, d)), packed=False)
    return out.select("i", "j", F.round("c", 5).alias("c"))


@_query("""
WITH a AS (SELECT l_suppkey % 2 AS i2, l_linenumber % 3 AS i3, l_orderkey % 5 AS i, l_partkey % 16 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
b AS (SELECT l_suppkey % 4 AS i2, l_linenumber % 6 AS i3, l_partkey % 16 AS k, l_orderkey % 8 AS j, sum(l_quantity) AS b FROM lineitem GROUP BY ALL)
SELECT b.i2, CAST(b.i3 AS BIGINT) AS i3, a.i, b.j, sum(v * b) AS c FROM b JOIN a ON a.i2 = b.i2 // 2 AND a.i3 = b.i3 // 2 AND a.k = b.k GROUP BY ALL""")
def broadcast_matmul(spark, d):
    items = table(spark, d, "lineitem")
    key = lambda c, n: F.col(c) % n
    a = items.groupBy(key("l_suppkey", 2).alias("i2"), key("l_linenumber", 3).alias("i3"), key("l_orderkey", 5).alias("i"), key("l_partkey", 16).alias("k")).agg(F.sum("l_quantity").alias("v"))
    b = items.groupBy(key("l_suppkey", 4).alias("i2"), key("l_linenumber", 6).alias("i3"), key("l_partkey", 16).alias("k"), key("l_orderkey", 8).alias("j")).agg(F.sum("l_quantity").alias("b"))
    return quant.broadcast_matmul(a, b, 2, 2).withColumn("i3", F.col("i3").cast("long"))


# Life on cells (order // 8, supplier)

_LIFE = "SELECT DISTINCT l_orderkey // 8 AS y, l_suppkey AS x FROM lineitem"


def _generations(n: int) -> str:
    out = [f"g0 AS ({_LIFE})", "o AS (SELECT a.d AS dy, b.d AS dx FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d))"]
    for k in range(1, n + 1):
        sent = f"SELECT y + dy AS y, x + dx AS x, CASE WHEN dy = 0 AND dx = 0 THEN 1 ELSE 0 END AS own FROM g{k - 1}, o"
        out.append(f"g{k} AS (SELECT y, x FROM ({sent}) GROUP BY y, x HAVING count(*) - max(own) = 3 OR (count(*) - max(own) = 2 AND max(own) = 1))")
    return f"WITH {', '.join(out)} SELECT y, x FROM g{n}"


def _live(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("y"), F.col("l_suppkey").alias("x"))


@_query(_generations(1))
def life_1(spark, d):
    return automaton.life_step(_live(spark, d).distinct())


@_query(_generations(5))
def life_5(spark, d):
    return automaton.life(_live(spark, d), 5)


@_query(_generations(5))
def life_tiles_5(spark, d):
    return automaton.life_in_tiles(_live(spark, d), 5, size=64, each=5)


@_query(f"SELECT min(y) AS min_y, min(x) AS min_x, max(y) AS max_y, max(x) AS max_x FROM ({_LIFE})")
def life_bounds(spark, d):
    return automaton.bounds(_live(spark, d))


@_query(f"SELECT y - min(y) OVER () AS y, x - min(x) OVER () AS x FROM ({_LIFE})")
def life_trimmed(spark, d):
    return automaton.trimmed(_live(spark, d).distinct())


_ORDER_GRID = "SELECT DISTINCT l_orderkey AS file, l_partkey {0} AS y, l_suppkey {1} AS x FROM lineitem {2}"


@_query(f"""
WITH a AS ({_ORDER_GRID.format("", "", "")}), b AS ({_ORDER_GRID.format("+ 7", "- 2", "WHERE l_linenumber < 5 OR l_quantity < 25")}),
s AS (SELECT file, y - min(y) OVER (PARTITION BY file) AS y, x - min(x) OVER (PARTITION BY file) AS x FROM a),
t AS (SELECT file, y - min(y) OVER (PARTITION BY file) AS y, x - min(x) OVER (PARTITION BY file) AS x FROM b),
u AS ((FROM s EXCEPT FROM t) UNION ALL (FROM t EXCEPT FROM s))
SELECT file, count(*) AS cells, file NOT IN (SELECT file FROM u) AS same FROM s GROUP BY file""")
def patterns_compared(spark, d):
    items = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "file")
    moved = items.where("l_linenumber < 5 OR l_quantity < 25").select("file", (F.col("l_partkey") + 7).alias("y"), (F.col("l_suppkey") - 2).alias("x"))
    return automaton.same_patterns(items.select("file", F.col("l_partkey").alias("y"), F.col("l_suppkey").alias("x")), moved)


# Tomography: embeddings as rows of 64 detectors, one slice a label

_RAYS = "e AS (SELECT label AS slice, vec_id AS angle, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings)"
_FILTERED = f"""{_RAYS}, u AS (SELECT unnest(range(64)) AS u),
f AS (SELECT slice, angle, u, sum(v * CASE WHEN u = k THEN 0.25 WHEN abs(u - k) % 2 = 1 AND abs(u - k) <= 32 THEN -1 / (pi() * pi() * (u - k) * (u - k)) ELSE 0 END) AS v FROM e, u GROUP BY 1, 2, 3)"""
_IMAGE = f"""{_FILTERED}, a AS (SELECT DISTINCT slice, angle FROM e),
g AS (SELECT slice, angle, x, y, (x - 31.5) * cos(pi() * angle / n) + (y - 31.5) * sin(pi() * angle / n) + 31.5 AS u FROM a, n, (SELECT u AS x FROM u), (SELECT u AS y FROM u)),
h AS (SELECT *, CAST(trunc(u) AS BIGINT) AS u0 FROM g),
i AS (SELECT h.slice, h.y, h.x, sum(coalesce(p.v, 0) * (1 - (h.u - u0)) + coalesce(q.v, 0) * (h.u - u0)) * pi() / (SELECT n FROM n) AS value
  FROM h LEFT JOIN f p ON p.slice = h.slice AND p.angle = h.angle AND p.u = h.u0 LEFT JOIN f q ON q.slice = h.slice AND q.angle = h.angle AND q.u = h.u0 + 1 GROUP BY 1, 2, 3)"""


def _sinogram(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    rows = table(spark, d, "embeddings").select(F.col("label").alias("slice"), F.col("vec_id").alias("angle"), F.col("embedding").alias("row"))
    return rows, rows.count()


@_query(f"WITH {_FILTERED} SELECT CAST(slice AS BIGINT) AS slice, CAST(angle AS BIGINT) AS angle, CAST(u AS BIGINT) AS u, round(v, 6) AS v FROM f")
def ramp_filter(spark, d):
    out = tomography.filter_rows(_sinogram(spark, d)[0], 64).select("slice", "angle", F.posexplode("row").alias("u", "v"))
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("slice", "angle", "u")], F.round("v", 6).alias("v"))


@_query(f"WITH {_IMAGE} SELECT CAST(slice AS BIGINT) AS slice, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(value, 5) AS value FROM i")
def back_projection(spark, d):
    rows, n = _sinogram(spark, d)
    image = tomography.reconstruct(rows, 64, n)
    return image.select(*[F.col(c).cast("long").alias(c) for c in ("slice", "y", "x")], F.round("value", 5).alias("value"))


@_query(
    f"WITH {_IMAGE}, m AS (SELECT slice, min(value) AS lo, max(value) AS hi FROM i GROUP BY 1) SELECT CAST(slice AS BIGINT) AS slice, CAST(63 - y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, "
    "CAST(greatest(0, least(255, round((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 255))) AS BIGINT) AS level FROM i JOIN m USING (slice)"
)
def grey_levels(spark, d):
    rows, n = _sinogram(spark, d)
    out = tomography.grey_levels(tomography.reconstruct(rows, 64, n), 64)
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("slice", "y", "x", "level")])


@_query("SELECT DISTINCT vec_id % 90 AS angle, (vec_id % 90) * 180.0 / 90 AS degrees FROM embeddings")
def sinogram_angles(spark, d):
    return tomography.angles_of(table(spark, d, "embeddings").select((F.col("vec_id") % 90).alias("angle")).distinct(), 90)


# Numbers

@_query(
    "WITH h AS (SELECT l_orderkey, l_linenumber, l_discount * l_quantity AS x FROM lineitem), "
    "e AS (SELECT *, pow(2, CASE WHEN x > 0 THEN floor(log2(x)) ELSE 0 END - 10) AS unit FROM h) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN x < pow(2, -14) THEN 0.0 ELSE trunc(x / unit) * unit END AS half FROM e"
)
def half_precision(spark, d):
    x = F.col("l_discount") * F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.half_to_double(numbers.double_to_half(x)).alias("half"))


@_query("SELECT l_orderkey, l_linenumber, ((l_partkey & 15) << 4) | (l_suppkey & 15) AS place FROM lineitem")
def packed_places(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.pack_xz(F.col("l_partkey"), F.col("l_suppkey")).alias("place"))


# Voxels: line items in a cube of 64 cells a side

_WORLD = (
    "w AS (SELECT CAST(l_orderkey % 64 AS INT) AS x, CAST(l_partkey % 64 AS INT) AS y, CAST(l_suppkey % 64 AS INT) AS z, "
    "max(CASE WHEN l_quantity >= 50 THEN 6027 WHEN l_quantity >= 40 THEN 86 WHEN l_quantity >= 38 THEN 103 ELSE 1 END) AS state FROM lineitem GROUP BY 1, 2, 3)"
)
_SIDE = voxel.Bounds(0, 63, 0, 63, 0, 63)


def _world(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    state = F.when(q >= 50, 6027).when(q >= 40, 86).when(q >= 38, 103).otherwise(1)
    cell = [(F.col(c) % 64).cast("int").alias(n) for c, n in (("l_orderkey", "x"), ("l_partkey", "y"), ("l_suppkey", "z"))]
    return table(spark, d, "lineitem").groupBy(*cell).agg(F.max(state).alias("state"))


def _flooded(worlds: str, last: str) -> str:
    """SQL of the light of the table ``last`` of ``worlds``."""
    return f"""
WITH RECURSIVE {worlds},
m(dx, dy, dz) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
l AS (
  SELECT x, y, z, CASE WHEN state = 6027 THEN 10 ELSE 15 END AS level, true AS passes FROM {last} WHERE state IN (6027, 103)
  UNION
  SELECT l.x + dx, l.y + dy, l.z + dz, l.level - 1, coalesce(w.state = 86, true) FROM l CROSS JOIN m LEFT JOIN {last} w ON w.x = l.x + dx AND w.y = l.y + dy AND w.z = l.z + dz
  WHERE l.passes AND l.level > 1 AND l.x + dx BETWEEN 0 AND 63 AND l.y + dy BETWEEN 0 AND 63 AND l.z + dz BETWEEN 0 AND 63 AND (w.state IS NULL OR w.state = 86 OR dy = -1))
SELECT x, y, z, max(level) AS level FROM l GROUP BY 1, 2, 3"""


@_query(_flooded(_WORLD, "w"))
def light_flood(spark, d):
    return voxel.flood_light(_world(spark, d), _SIDE)


@_query(_flooded(_WORLD, "w"))
def light_tiles(spark, d):
    return lighting.light_in_tiles(_world(spark, d), _SIDE, 32)


#: Edits from orders: the largest state that an order puts in a cell (air, stone, glowing, lava).
_EDITS = (
    "e AS (SELECT CAST(o_orderkey % 64 AS INT) AS x, CAST(o_custkey % 64 AS INT) AS y, CAST(o_orderkey // 64 % 64 AS INT) AS z, "
    "max(CASE o_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 6027 WHEN 2 THEN 103 ELSE 0 END) AS state FROM orders GROUP BY 1, 2, 3), "
    "n AS (SELECT x, y, z, coalesce(e.state, w.state) AS state FROM w FULL JOIN e USING (x, y, z) WHERE coalesce(e.state, w.state) <> 0)"
)


@_query(_flooded(f"{_WORLD}, {_EDITS}", "n"))
def light_after_edits(spark, d):
    key, c = F.col("o_orderkey"), F.col("o_custkey") % 4
    cell = [v.cast("int").alias(n) for n, v in (("x", key % 64), ("y", F.col("o_custkey") % 64), ("z", F.floor(key / 64) % 64))]
    edits = table(spark, d, "orders").groupBy(*cell).agg(F.max(F.when(c == 0, 1).when(c == 1, 6027).when(c == 2, 103).otherwise(0)).alias("state"))
    world = _world(spark, d)
    return lighting.relight(lighting.light_in_tiles(world, _SIDE, 32), world, edits, _SIDE, 32)


@_query(f"WITH {_WORLD} SELECT x // 16 AS sx, y // 16 AS sy, z // 16 AS sz, count(*) AS blocks FROM w GROUP BY 1, 2, 3")
def non_air(spark, d):
    return voxel.non_air(_world(spark, d))


@_query(f"""
WITH {_WORLD}, c AS (SELECT CAST(o_orderkey % 80 AS INT) AS x, CAST(o_custkey % 80 AS INT) AS y, CAST(o_orderkey // 80 % 80 AS INT) AS z, max(CAST(o_custkey % 3 AS INT)) AS new FROM orders GROUP BY 1, 2, 3),
v AS (SELECT * FROM c WHERE x < 64 AND y < 64 AND z < 64)
SELECT x, y, z, coalesce(new, state) AS state FROM w FULL JOIN v USING (x, y, z) WHERE coalesce(new, state) <> 0""")
def set_blocks(spark, d):
    o = F.col("o_orderkey")
    cell = [(o % 80).cast("int").alias("x"), (F.col("o_custkey") % 80).cast("int").alias("y"), (F.floor(o / 80) % 80).cast("int").alias("z")]
    new = table(spark, d, "orders").groupBy(*cell).agg(F.max((F.col("o_custkey") % 3).cast("int")).alias("state"))
    return voxel.set_blocks(_world(spark, d), new, _SIDE)


@_query("""
WITH s AS (SELECT DISTINCT CAST(l_partkey % 140 AS INT) AS state FROM lineitem)
SELECT state, CASE WHEN state BETWEEN 86 AND 117 THEN (state - 86) % 8 ELSE 0 END AS stage, CASE WHEN state BETWEEN 102 AND 117 THEN 15 ELSE 0 END AS emission,
  CASE WHEN state = 0 THEN 0 WHEN state BETWEEN 86 AND 101 THEN 2 ELSE 15 END AS opacity, NOT (state = 0 OR state BETWEEN 86 AND 117) AS solid FROM s""")
def block_info(spark, d):
    return voxel.block_info(table(spark, d, "lineitem").select((F.col("l_partkey") % 140).cast("int").alias("state")).distinct())


_WORK = (
    "k AS (SELECT CAST(user_id % 40 AS INT) AS x, CAST(event_id % 7 AS INT) AS y, 0 AS z, CASE event_type WHEN 'view' THEN CAST(86 + event_id % 16 AS INT) WHEN 'click' THEN -1 WHEN 'purchase' THEN CAST(102 + event_id % 16 AS INT) "
    "WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN -94 ELSE -103 END ELSE CAST(event_id % 3 AS INT) END AS type, CAST(floor(value) AS BIGINT) % 50 AS trigger_tick FROM events)"
)


def _work(spark: SparkSession, d: str) -> DataFrame:
    e, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "view", 86 + e % 16).when(t == "click", -1).when(t == "purchase", 102 + e % 16).when(t == "signup", F.when(e % 2 == 0, -94).otherwise(-103)).otherwise(e % 3)
    return table(spark, d, "events").select((F.col("user_id") % 40).cast("int").alias("x"), (e % 7).cast("int").alias("y"), F.lit(0).alias("z"), kind.cast("int").alias("type"), (F.floor("value") % 50).cast("long").alias("trigger_tick"))


@_query(f"WITH {_WORK} SELECT DISTINCT x, y, z, type, trigger_tick FROM k UNION SELECT DISTINCT x, y, z, type, CAST(7 + greatest(0, trigger_tick - 20) AS BIGINT) FROM k")
def tick_dedup(spark, d):
    work = _work(spark, d)
    return voxel.schedule(work, work.withColumn("delay", F.col("trigger_tick") - 20), 7)


@_query(f"WITH {_WORK} SELECT * FROM k WHERE trigger_tick <= 10")
def due_ticks(spark, d):
    return voxel.due(_work(spark, d), 10)


_PRIORITY = (
    "CASE WHEN type = -1 THEN -1 WHEN type BETWEEN -117 AND -102 THEN 2 WHEN type BETWEEN 102 AND 117 THEN (((type - 102) % 8) * 2 + (type - 102) // 8 + 1) * 4 WHEN type BETWEEN -101 AND -86 THEN 128 "
    "WHEN type BETWEEN 86 AND 101 THEN (((type - 86) % 8) * 2 + (type - 86) // 8 + 1) * 256 WHEN type = 0 THEN 8192 ELSE 0 END"
)


@_query(
    f"WITH {_WORK}, r AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY {_PRIORITY}, type) AS n FROM k) "
    "SELECT x, y, z, type, CASE WHEN type = -1 THEN NULL WHEN type IN (-94, -110) THEN 0 ELSE abs(type) END AS state FROM r WHERE n = 1"
)
def priority_pick(spark, d):
    return voxel.pick(_work(spark, d)).withColumn("state", voxel.becomes(F.col("type")).cast("int"))


@_query(f"""
WITH {_WORLD}, e AS (SELECT DISTINCT CAST(o_orderkey % 64 AS INT) AS x, CAST(o_custkey % 64 AS INT) AS y, 5 AS z FROM orders),
m(dx, dy, dz) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
a AS (SELECT x, y, z, -1 AS type FROM e UNION ALL SELECT n.x, n.y, n.z, coalesce(w.state, 0) FROM (SELECT DISTINCT x + dx AS x, y + dy AS y, z + dz AS z FROM e, m) n LEFT JOIN w USING (x, y, z))
SELECT x, y, z, type, unnest([0, 1]) AS delay FROM a""")
def wake_neighbours(spark, d):
    edits = table(spark, d, "orders").select((F.col("o_orderkey") % 64).cast("int").alias("x"), (F.col("o_custkey") % 64).cast("int").alias("y"), F.lit(5).alias("z")).distinct()
    return voxel.wake(edits, _world(spark, d))


@_query()
def slope_search(spark, d):
    world = _world(spark, d)
    return voxel.slopes(world, world.where(voxel.is_water(F.col("state"))), _SIDE)


@_query()
def fluid_step(spark, d):
    return voxel.fluid_step(_world(spark, d), _SIDE)


# Scheduled commands: events enter them, a sign-up clears all of its world

_COMMANDS = (
    "c AS (SELECT user_id % 20 AS world, event_id // 10 AS entered, event_id AS nth, CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'clear' ELSE 'sched' END AS verb, event_id // 10 + CAST(floor(value) AS BIGINT) % 40 - 2 AS due FROM events), "
    "n AS (SELECT *, min(CASE WHEN verb = 'clear' THEN entered END) OVER (PARTITION BY world ORDER BY nth ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cleared FROM c)"
)


def _commands(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    at = F.floor(e / 10)
    verb = F.when((F.col("event_type") == "signup") & (e % 3 == 0), "clear").otherwise("sched")
    return table(spark, d, "events").select((F.col("user_id") % 20).alias("world"), at.alias("tick"), e.alias("nth"), verb.alias("verb"), (at + F.floor("value") % 40 - 2).alias("due"))


@_query(f"WITH {_COMMANDS} SELECT world, nth, entered, due AS tick FROM n WHERE verb = 'sched' AND due > entered AND (cleared IS NULL OR cleared >= due)")
def scheduled_commands(spark, d):
    return commands.firings(_commands(spark, d), ["world"]).select("world", "nth", "entered", "tick")


@_query(f"WITH {_COMMANDS} SELECT world, nth, entered AS tick, cleared FROM n WHERE verb = 'sched'")
def schedule_lifetimes(spark, d):
    return commands.lifetimes(_commands(spark, d), ["world"]).select("world", "nth", "tick", "cleared")


# Snapshots: events as writes of users at ticks

_SERIES = "s AS (SELECT event_id % 30 AS tick, user_id AS cell, max(CAST(floor(value) AS BIGINT) % 5) AS state FROM events GROUP BY 1, 2)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy((F.col("event_id") % 30).alias("tick"), F.col("user_id").alias("cell")).agg(F.max(F.floor("value") % 5).alias("state"))


@_query(f"WITH {_SERIES} SELECT cell, arg_max(state, tick) AS state FROM s WHERE state <> 0 GROUP BY 1")
def last_writer_state(spark, d):
    return changes.last_writer(_series(spark, d), ["cell"], ["tick"])


@_query(f"""
WITH {_SERIES}, p AS (SELECT cell, state FROM s WHERE tick = 10), n AS (SELECT cell, state FROM s WHERE tick = 11)
SELECT CASE WHEN n.cell IS NULL THEN 'clear' ELSE 'fill' END AS op, coalesce(n.cell, p.cell) AS cell, coalesce(n.state, 0) AS state
FROM p FULL JOIN n ON p.cell = n.cell WHERE n.cell IS NULL OR p.cell IS NULL OR p.state <> n.state""")
def state_diff(spark, d):
    s = _series(spark, d)
    return changes.diff(s.where("tick = 10"), s.where("tick = 11"), ["cell"])


_DIFFS = f"""{_SERIES},
r AS (SELECT *, lag(tick) OVER w AS p, lag(state) OVER w AS ps, lead(tick) OVER w AS n FROM s WINDOW w AS (PARTITION BY cell ORDER BY tick)),
c AS (SELECT tick, 'fill' AS op, cell, state FROM r WHERE p IS NULL OR p < tick - 1 OR ps <> state
UNION ALL SELECT tick + 1, 'clear', cell, 0 FROM r WHERE tick < 29 AND (n IS NULL OR n > tick + 1))"""


@_query(f"WITH {_DIFFS} SELECT * FROM c")
def precompute_diffs(spark, d):
    return changes.series_diffs(_series(spark, d), ["cell"], 29)


@_query(f"WITH {_SERIES} SELECT cell, state FROM s WHERE tick = 20")
def replay_diffs(spark, d):
    s = _series(spark, d)
    upto = changes.series_diffs(s, ["cell"], 29).where("tick between 6 and 20")
    return changes.replay(s.where("tick = 5").select("cell", "state"), upto, ["cell"])


@_query(f"WITH {_SERIES} SELECT DISTINCT cell, CAST(0 AS INT) AS state FROM s")
def clear_placed(spark, d):
    return changes.cleared(_series(spark, d), ["cell"])


@_query(f"WITH {_SERIES} SELECT * FROM s WHERE tick % 4 = 0")
def sample_every_k(spark, d):
    return changes.sampled(_series(spark, d), 4)


_TWO = f"{_SERIES}, t AS (SELECT tick, cell, CASE WHEN cell % 9 = 0 THEN state + 1 ELSE state END AS state FROM s WHERE cell % 7 <> 0 OR tick <> 3), a AS (SELECT * FROM s WHERE cell % 11 <> 0 OR tick <> 4)"
_DIFFER = "SELECT coalesce(a.tick, t.tick) AS tick, coalesce(a.cell, t.cell) AS cell, CASE WHEN t.cell IS NULL THEN 'left' WHEN a.cell IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN t ON a.tick = t.tick AND a.cell = t.cell WHERE t.cell IS NULL OR a.cell IS NULL OR a.state <> t.state"


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _series(spark, d)
    other = s.where("cell % 7 <> 0 OR tick <> 3").withColumn("state", F.when(F.col("cell") % 9 == 0, F.col("state") + 1).otherwise(F.col("state")))
    return s.where("cell % 11 <> 0 OR tick <> 4"), other


@_query(f"WITH {_TWO} {_DIFFER}")
def snapshot_compare(spark, d):
    return changes.differences(*_two(spark, d), ["tick", "cell"], ["state"])


@_query(f"WITH {_TWO} SELECT * FROM ({_DIFFER}) ORDER BY tick, cell LIMIT 1")
def first_difference(spark, d):
    return changes.first_difference(*_two(spark, d), ["tick", "cell"], ["state"])


@_query(f"WITH {_TWO} {_DIFFER}")
def digest_compare(spark, d):
    a, b = (x.withColumn("part", F.floor(F.col("cell") / 16)) for x in _two(spark, d))
    return trees.differences_by_digest(a, b, ["tick", "part"], ["tick", "cell"], ["state"])


@_query(f"WITH {_SERIES} SELECT tick AS at, cell, state FROM s WHERE tick IN (0, 1, 7, 16, 21, 29)")
def states_at_ticks(spark, d):
    s = _series(spark, d)
    merged = trees.merged_changes(changes.series_diffs(s, ["cell"], 29), ["cell"], 29)
    ticks = spark.createDataFrame([(t,) for t in (0, 1, 7, 16, 21, 29)], "at long")
    return trees.states_at(s.where("tick = 0").select("cell", "state"), merged, ticks, ["cell"], 29)


# Space: customers as points, suppliers as boxes

_POINTS = "p AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_custkey % 997 AS DOUBLE) * 10 AS y, CAST(c_nationkey AS DOUBLE) AS z FROM customer)"
_BOXES = "b AS (SELECT s_suppkey AS id, s_acctbal - 400 AS lo_x, s_acctbal + 400 AS hi_x, CAST(s_suppkey % 97 AS DOUBLE) * 100 - 700 AS lo_y, CAST(s_suppkey % 97 AS DOUBLE) * 100 + 700 AS hi_y, CAST(s_nationkey - 9 AS DOUBLE) AS lo_z, CAST(s_nationkey + 9 AS DOUBLE) AS hi_z FROM supplier)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), ((F.col("c_custkey") % 997).cast("double") * 10).alias("y"), F.col("c_nationkey").cast("double").alias("z"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    y, x, z = (F.col("s_suppkey") % 97).cast("double") * 100, F.col("s_acctbal"), F.col("s_nationkey").cast("double")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (x - 400).alias("lo_x"), (x + 400).alias("hi_x"), (y - 700).alias("lo_y"), (y + 700).alias("hi_y"), (z - 9).alias("lo_z"), (z + 9).alias("hi_z"))


_INSIDE = "x > lo_x AND x < hi_x AND y > lo_y AND y < hi_y"


@_query(f"WITH {_POINTS}, {_BOXES} SELECT p.id AS point_id, b.id AS box_id FROM p, b WHERE {_INSIDE} AND z > lo_z AND z < hi_z")
def box_contains_join(spark, d):
    return spatial.boxes_of_points(_points(spark, d), _boxes(spark, d), 1000.0)


@_query(f"WITH {_POINTS}, {_BOXES} SELECT p.id AS point_id, b.id AS box_id FROM p, b WHERE {_INSIDE}")
def box_contains_flat(spark, d):
    return spatial.boxes_of_points(_points(spark, d), _boxes(spark, d), 1000.0, dims=2)


@_query(f"WITH {_BOXES} SELECT a.id AS a_id, b.id AS b_id FROM b a, b WHERE a.lo_x < b.hi_x AND b.lo_x < a.hi_x AND a.lo_y < b.hi_y AND b.lo_y < a.hi_y AND a.lo_z < b.hi_z AND b.lo_z < a.hi_z")
def box_touch_join(spark, d):
    boxes = _boxes(spark, d)
    return spatial.touching_boxes(boxes, boxes, 1500.0)


@_query(f"WITH {_POINTS}, s AS (SELECT s_suppkey AS id, s_acctbal AS sx, CAST(s_suppkey % 97 AS DOUBLE) * 100 AS sy FROM supplier) SELECT p.id AS point_id, s.id AS sphere_id FROM p, s WHERE (x - sx) * (x - sx) + (y - sy) * (y - sy) + z * z < 250000.0")
def sphere_join(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), ((F.col("s_suppkey") % 97).cast("double") * 100).alias("y"), F.lit(0.0).alias("z"), F.lit(500.0).alias("r"))
    return spatial.spheres_of_points(_points(spark, d), s, 1000.0)


@_query(
    f"WITH {_BOXES} SELECT id % 5 AS part, min(lo_x) AS lo_x, min(lo_y) AS lo_y, min(lo_z) AS lo_z, max(hi_x) AS hi_x, max(hi_y) AS hi_y, max(hi_z) AS hi_z, "
    "round(2 * (max(hi_x) - min(lo_x) + max(hi_y) - min(lo_y) + max(hi_z) - min(lo_z)), 6) AS surface FROM b GROUP BY 1"
)
def box_union(spark, d):
    return spatial.union_box(_boxes(spark, d).withColumn("part", F.col("id") % 5), ["part"]).withColumn("surface", F.round("surface", 6))


# Boxes and spheres from 1 to a million wide

_ANY_SIZE = """
h AS (SELECT s_suppkey AS id, pow(10.0, s_suppkey % 7) / 2 AS h, s_acctbal AS x, CAST(s_suppkey % 997 AS DOUBLE) * 10 AS y, CAST(s_nationkey AS DOUBLE) AS z FROM supplier),
w AS (SELECT id, x - h AS lo_x, x + h AS hi_x, y - h AS lo_y, y + h AS hi_y, z - h AS lo_z, z + h AS hi_z FROM h)"""
_TOUCHING = "a.lo_x < b.hi_x AND b.lo_x < a.hi_x AND a.lo_y < b.hi_y AND b.lo_y < a.hi_y AND a.lo_z < b.hi_z AND b.lo_z < a.hi_z"


def _any_size(spark: SparkSession, d: str) -> DataFrame:
    """Middles and half widths."""
    k = F.col("s_suppkey")
    half = (F.pow(F.lit(10.0), k % 7) / 2).alias("h")
    return table(spark, d, "supplier").select(k.alias("id"), half, F.col("s_acctbal").alias("x"), ((k % 997).cast("double") * 10).alias("y"), F.col("s_nationkey").cast("double").alias("z"))


def _wide_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _any_size(spark, d).select("id", *[e.alias(n) for c in "xyz" for e, n in ((F.col(c) - F.col("h"), f"lo_{c}"), (F.col(c) + F.col("h"), f"hi_{c}"))])


@_query(f"WITH {_POINTS}, {_ANY_SIZE} SELECT p.id AS point_id, w.id AS box_id FROM p, w WHERE {_INSIDE} AND z > lo_z AND z < hi_z")
def boxes_of_any_size(spark, d):
    return levels.boxes_of_points(_points(spark, d), _wide_boxes(spark, d))


@_query(f"WITH {_ANY_SIZE} SELECT a.id AS a_id, b.id AS b_id FROM w a, w b WHERE {_TOUCHING}")
def touching_of_any_size(spark, d):
    boxes = _wide_boxes(spark, d)
    return levels.touching_boxes(boxes, boxes)


@_query(f"WITH {_POINTS}, {_ANY_SIZE} SELECT p.id AS point_id, h.id AS sphere_id FROM p, h WHERE (p.x - h.x) * (p.x - h.x) + (p.y - h.y) * (p.y - h.y) + (p.z - h.z) * (p.z - h.z) < h * h")
def spheres_of_any_size(spark, d):
    return levels.spheres_of_points(_points(spark, d), _any_size(spark, d).withColumnRenamed("h", "r"))


_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_BOTH = f"WITH {_ANY_SIZE}, t AS (SELECT a.id AS a_id, b.id AS b_id, a.x AS ax, a.y AS ay, a.z AS az, a.h AS r, b.x AS bx, b.y AS by_, b.z AS bz, b.h AS s, sqrt({_D2}) AS d FROM h a, h b WHERE a.id < b.id AND {_D2} < (a.h + b.h) * (a.h + b.h))"


def _touching_spheres(spark: SparkSession, d: str) -> DataFrame:
    spheres = _any_size(spark, d).withColumnRenamed("h", "r")
    return levels.touching_spheres(spheres, spheres).where("a_id < b_id")


@_query(f"{_BOTH}, g AS (SELECT *, (d + r + s) / 2 AS g FROM t) SELECT a_id, b_id, " + ", ".join(f"round(CASE WHEN d + s <= r THEN a{c} WHEN d + r <= s THEN b{q} ELSE a{c} + (b{q} - a{c}) * ((g - r) / d) END, 6) AS {c}" for c, q in (("x", "x"), ("y", "y_"), ("z", "z"))) + ", round(CASE WHEN d + s <= r THEN r WHEN d + r <= s THEN s ELSE g END, 6) AS r FROM g")
def sphere_union(spark, d):
    return _touching_spheres(spark, d).select("a_id", "b_id", *[numbers.rounded(c, 6).alias(n) for c, n in zip(levels.union_sphere(), "xyzr", strict=True)])


@_query(f"{_BOTH} SELECT a_id, b_id, " + ", ".join(f"round(CASE WHEN d > 0 THEN a{c} * (1 + (r - s) / d) + b{q} * (1 - (r - s) / d) END, 3) AS {c}" for c, q in (("x", "x"), ("y", "y_"), ("z", "z"))) + ", CASE WHEN d > 0 THEN round(d + r + s, 6) END AS r FROM t")
def sphere_joined(spark, d):
    x, y, z, r = levels.joined_sphere()
    return _touching_spheres(spark, d).select("a_id", "b_id", *[numbers.rounded(c, 3).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))], numbers.rounded(r, 6).alias("r"))


_VIEWERS = "v AS (SELECT s_suppkey AS viewer, CAST(s_suppkey % 50 AS INT) AS vx, s_nationkey AS vz, CAST(2 + s_suppkey % 5 AS INT) AS r FROM supplier), l AS (SELECT DISTINCT c_custkey % 100 + 1 AS viewer, CAST(c_custkey % 61 AS INT) AS cx, c_nationkey AS cz FROM customer)"


def _viewers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    v = table(spark, d, "supplier").select(k.alias("viewer"), (k % 50).cast("int").alias("vx"), F.col("s_nationkey").alias("vz"), (2 + k % 5).cast("int").alias("r"))
    c = F.col("c_custkey")
    return v, table(spark, d, "customer").select((c % 100 + 1).alias("viewer"), (c % 61).cast("int").alias("cx"), F.col("c_nationkey").alias("cz")).distinct()


@_query(f"""
WITH {_VIEWERS}, o AS (SELECT CAST(a.d AS INT) AS dx, CAST(b.d AS INT) AS dz FROM range(-6, 7) a(d), range(-6, 7) b(d)),
c AS (SELECT viewer, vx + dx AS cx, vz + dz AS cz, dx * dx + dz * dz AS d2 FROM v, o WHERE dx * dx + dz * dz <= r * r)
SELECT viewer, cx, cz, row_number() OVER (PARTITION BY viewer ORDER BY d2, cx, cz) AS nth FROM c ANTI JOIN l USING (viewer, cx, cz)""")
def radius_order(spark, d):
    v, loaded = _viewers(spark, d)
    return spatial.to_load(v, loaded, 6).withColumn("nth", F.col("nth").cast("long"))


@_query(f"WITH {_VIEWERS} SELECT viewer, cx, cz FROM l JOIN v USING (viewer) WHERE greatest(abs(cx - vx), abs(cz - vz)) > r")
def chebyshev_unload(spark, d):
    return spatial.to_unload(*_viewers(spark, d))


@_query("""
WITH t AS (SELECT user_id, event_id, value AS x, CAST(event_id % 13 AS DOUBLE) / 4 AS y, 0.5 AS z FROM events),
s AS (SELECT user_id, event_id, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CAST(round(dx * 4096) AS BIGINT) AS dx, CAST(round(dy * 4096) AS BIGINT) AS dy, CAST(round(dz * 4096) AS BIGINT) AS dz,
  greatest(abs(dx), abs(dy), abs(dz)) >= 8 AS jump, greatest(abs(dx), abs(dy), abs(dz)) > 100 AS rejected FROM s WHERE dx IS NOT NULL""")
def movement_delta(spark, d):
    track = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("x"), ((F.col("event_id") % 13).cast("double") / 4).alias("y"), F.lit(0.5).alias("z"))
    return spatial.movement(track, "user_id", "event_id")


# Packed columns


@_query("SELECT l_orderkey AS k, CAST((l_linenumber - 1) // 10 AS BIGINT) AS word, CAST(bit_or(CAST(l_quantity AS BIGINT) << (6 * ((l_linenumber - 1) % 10))) AS BIGINT) AS packed FROM lineitem GROUP BY 1, 2")
def bit_pack(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("at"), F.col("l_quantity").cast("long").alias("v"))
    return packed.pack_rows(rows, "k", "at", "v", 6)


@_query("SELECT o_orderkey AS k, CAST(unnest(range(6)) AS BIGINT) AS i, (o_custkey >> CAST(unnest(range(6)) * 5 AS INT)) & 31 AS v FROM orders")
def bit_unpack(spark, d):
    words = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.array("o_custkey").alias("w"))
    return words.select("k", F.posexplode(packed.unpack(F.col("w"), 5, 6)).alias("i", "v")).withColumn("i", F.col("i").cast("long"))


@_query("SELECT vec_id, array_to_string(list_transform(range(1, 33), lambda k: least(15, CAST(trunc(abs(embedding[2 * k - 1] * 20)) AS INT)) + 16 * least(15, CAST(trunc(abs(embedding[2 * k] * 20)) AS INT))), ',') AS packed FROM embeddings")
def nibble_pack(spark, d):
    whole = F.transform("embedding", lambda v: F.abs(v * F.lit(20)).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(packed.nibbles(whole), ",").alias("packed"))


@_query("SELECT l_suppkey, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 AS code FROM lineitem")
def dictionary_encode(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return packed.encode(rows, "l_suppkey", "q").withColumn("code", F.col("code").cast("long"))


@_query("""
WITH p AS (SELECT l_suppkey, count(*) AS rows, count(DISTINCT l_partkey) AS distinct_values FROM lineitem GROUP BY 1),
b AS (SELECT *, CAST(CASE WHEN distinct_values <= 1 THEN 0 WHEN distinct_values <= 16 THEN 4 WHEN distinct_values <= 256 THEN ceil(log2(distinct_values)) ELSE 15 END AS INT) AS bits FROM p)
SELECT *, CAST(CASE WHEN bits = 0 THEN 0 ELSE ceil(rows / (64 // bits)) END AS INT) AS words FROM b""")
def palette_sizes(spark, d):
    return packed.palettes(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@_query(f"""
WITH {_WORLD},
c AS (
  SELECT x, y, z, state, NULL AS level FROM w
  UNION ALL SELECT l_orderkey % 64, l_partkey % 64, l_suppkey % 64, NULL, max(l_linenumber) FROM lineitem GROUP BY 1, 2, 3),
i AS (SELECT x // 16 AS sx, y // 16 AS sy, z // 16 AS sz, (y % 16 * 16 + z % 16) * 16 + x % 16 AS spot, state, level FROM c),
a AS (
  SELECT sx, sy, sz, count(*) FILTER (state <= 5000) AS blocks, count(*) FILTER (state > 5000) AS invalid, list(DISTINCT state) FILTER (state <= 5000) AS states FROM i GROUP BY 1, 2, 3),
p AS (SELECT *, list_sort(CASE WHEN blocks < 4096 THEN list_prepend(0, coalesce(states, [])) ELSE states END) AS palette FROM a),
g AS (SELECT sx, sy, sz, spot // 16 AS word, coalesce(bit_or(CAST(level AS BIGINT) << CAST(spot % 16 * 4 AS BIGINT)), 0) AS packed FROM i GROUP BY 1, 2, 3, 4),
f AS (SELECT p.sx, p.sy, p.sz, string_agg(coalesce(packed, 0), ',' ORDER BY n.word) AS light FROM p CROSS JOIN range(256) n(word) LEFT JOIN g ON g.sx = p.sx AND g.sy = p.sy AND g.sz = p.sz AND g.word = n.word GROUP BY 1, 2, 3)
SELECT CAST(sx AS INT) AS sx, CAST(sy AS INT) AS sy, CAST(sz AS INT) AS sz, blocks, invalid, array_to_string(palette, ',') AS palette,
       CASE WHEN len(palette) <= 1 THEN 0 ELSE 4 END AS bits, CASE WHEN len(palette) <= 1 THEN 0 ELSE 256 END AS words, light FROM p JOIN f USING (sx, sy, sz)""")
def world_sections(spark, d):
    cell = [(F.col(c) % 64).cast("int").alias(n) for c, n in (("l_orderkey", "x"), ("l_partkey", "y"), ("l_suppkey", "z"))]
    light = table(spark, d, "lineitem").groupBy(*cell).agg(F.max("l_linenumber").alias("level"))
    texts = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("palette", "light")]
    return sections.sections(_world(spark, d), light, 5000).select("sx", "sy", "sz", "blocks", "invalid", "bits", "words", *texts)


# Numbers, names, nested data


@_query("SELECT l_orderkey, l_linenumber, CAST(1 + (p >= 128 OR p < 0)::INT + (p >= 16384 OR p < 0)::INT + (p >= 2097152 OR p < 0)::INT + (p >= 268435456 OR p < 0)::INT AS INT) AS bytes FROM (SELECT *, (l_partkey - 50) * l_suppkey * 37 AS p FROM lineitem)")
def varint_length(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.varint_length((F.col("l_partkey") - 50) * F.col("l_suppkey") * 37).alias("bytes"))


@_query("SELECT o_orderkey, x * 274877906944 + (z & 67108863) * 4096 + (y & 4095) AS packed, x, y, z FROM (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey - 700 AS BIGINT) AS x, CAST(o_custkey % 300 - 64 AS BIGINT) AS y, CAST(o_orderkey - 9000 AS BIGINT) AS z FROM orders)")
def position_pack(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    p = table(spark, d, "orders").select("o_orderkey", numbers.pack_position(c - 700, c % 300 - 64, o - 9000).alias("packed"))
    return p.select("o_orderkey", "packed", *[v.alias(n) for v, n in zip(numbers.unpack_position(F.col("packed")), "xyz", strict=True)])


@_query("SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT c_custkey, md5('OfflinePlayer:' || c_name) AS h FROM customer)")
def offline_uuid(spark, d):
    return table(spark, d, "customer").select("c_custkey", numbers.offline_uuid(F.col("c_name")).alias("uuid"))


@_query("SELECT event_id, CAST(CASE WHEN s > 127 THEN s - 256 ELSE s END AS INT) AS step FROM (SELECT event_id, CAST(floor(value * 256 / 360) AS BIGINT) % 256 AS s FROM events)")
def turn_to_byte(spark, d):
    return table(spark, d, "events").select("event_id", numbers.turn_to_byte(F.col("value")).alias("step"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), 0) AS missing FROM events")
def nested_get(spark, d):
    v = nested.parsed(F.col("props"))
    return table(spark, d, "events").select("event_id", nested.get(v, "$.k", "bigint").alias("k"), nested.get_or_zero(v, "$.missing", "bigint").alias("missing"))


@_query("SELECT p_partkey, CASE WHEN regexp_full_match(p_name, '[A-Za-z0-9._+\\-]+') THEN p_name ELSE '\"' || p_name || '\"' END AS quoted FROM part")
def quoted_names(spark, d):
    return table(spark, d, "part").select("p_partkey", nested.quoted(F.col("p_name")).alias("quoted"))


@_query("SELECT event_id, CASE event_type WHEN 'view' THEN event_id ELSE NULL END AS viewed, CASE event_type WHEN 'click' THEN -1 ELSE event_id END AS own, CAST(CASE event_type WHEN 'click' THEN 2 ELSE 3 END AS INT) AS n FROM events")
def fields_any_case(spark, d):
    fields = F.create_map(F.initcap("event_type"), F.col("event_id"), F.lit("User"), F.col("user_id"))
    changed = nested.put(fields, "Click", F.lit(-1).cast("long"))
    events = table(spark, d, "events").select("event_id", "event_type", fields.alias("f"), changed.alias("g"))
    own = F.element_at("g", F.initcap("event_type"))
    return events.select("event_id", nested.get_any_case(F.col("f"), "vIEW").alias("viewed"), own.alias("own"), F.size("g").alias("n"))


@_query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE (l_linenumber + l_partkey) % 8 WHEN 0 THEN 'byte' WHEN 1 THEN 'short' WHEN 2 THEN 'long' WHEN 3 THEN 'int' WHEN 4 THEN 'float' WHEN 7 THEN 'string' ELSE 'double' END AS kind FROM lineitem""")
def literal_kinds(spark, d):
    number, n = (F.col("l_partkey") - 50).cast("string"), (F.col("l_linenumber") + F.col("l_partkey")) % 8 + 1
    ends = F.element_at(F.array(*map(F.lit, ["b", "S", "L", "", ".5f", "e3", ".25D", "x"])), n.cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", nested.literal_kind(F.concat(number, ends)).alias("kind"))


@_query("SELECT event_id, coalesce(n.id, -1) AS id FROM (SELECT event_id, event_type AS key FROM events) e LEFT JOIN (VALUES ('view', 0), ('click', 1), ('purchase', 2)) n(key, id) USING (key)")
def registry_lookup(spark, d):
    names = spark.createDataFrame([("view", 0), ("click", 1), ("purchase", 2)], "key string, id int")
    return lookup(table(spark, d, "events").select("event_id", F.col("event_type").alias("key")), names, "key").select("event_id", "id")


# Sessions



def _timed(spark: SparkSession, d: str) -> DataFrame:
    """Events with times that have a zone: stored ones have none and are taken as UTC where the session is."""
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_GAP = "g AS (SELECT user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 AS gap FROM events)"


@_query(f"WITH {_GAP} SELECT user_id, epoch_us(ts) AS us, round(gap, 6) AS gap, CASE WHEN gap IS NULL THEN 'join' WHEN gap > 30000 THEN 'drop' WHEN gap > 15000 THEN 'ping' ELSE 'alive' END AS what FROM g")
def keep_alive(spark, d):
    out = sessions.gaps(_timed(spark, d), ping_after=15_000, drop_after=30_000)
    return out.select("user_id", F.unix_micros("ts").alias("us"), F.round("gap", 6).alias("gap"), "what")


@_query(
    "WITH g AS (SELECT user_id, epoch_us(ts) AS us, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts), (SELECT max(epoch_us(ts)) FROM events) + 1) AS before FROM events), "
    "w(what, after) AS (VALUES ('send ping', 15000000000), ('send drop', 30000000000)) SELECT user_id, us + after AS us, what FROM g, w WHERE us + after < before"
)
def keep_alive_deadlines(spark, d):
    return sessions.deadlines(_timed(spark, d), ping_after=15_000, drop_after=30_000)


@_query(
    f"WITH {_GAP}, n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) "
    "SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM n GROUP BY user_id, s"
)
def client_sessions(spark, d):
    s = sessions.sessions(_timed(spark, d), timeout="2 hours")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "events")


@_query("SELECT count(*) AS clients, (SELECT string_agg(user_id, ',' ORDER BY user_id) FROM (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 10)) AS sample FROM (SELECT DISTINCT user_id FROM events)")
def present_clients(spark, d):
    return sessions.present(table(spark, d, "events"), "user_id").select("clients", F.array_join(F.col("sample").cast("array<string>"), ",").alias("sample"))


@_query("SELECT user_id, row_number() OVER (ORDER BY max(event_id) DESC) AS place FROM events GROUP BY 1 QUALIFY place <= 128")
def recent_keys(spark, d):
    return sessions.recent(table(spark, d, "events"), "user_id", "event_id").select("user_id", F.col("place").cast("long").alias("place"))


# Shapes

_GRID = "r AS (SELECT CAST(unnest(range(-9, 10)) AS INT) AS v), g AS (SELECT a.v AS x, b.v AS y, c.v AS z FROM r a, r b, r c)"


@_query(f"""
WITH {_GRID}
SELECT 'ball' AS shape, x, y, z FROM g WHERE sqrt(x * x + y * y + z * z) <= 6.5
UNION ALL SELECT 'shell', x, y, z FROM g WHERE sqrt(x * x + y * y + z * z) BETWEEN 7.5 AND 8.5
UNION ALL SELECT 'ring', x, y, z FROM g WHERE y = 0 AND sqrt(x * x + z * z) BETWEEN 3.5 AND 9.5
UNION ALL SELECT 'frame', x, y, z FROM g WHERE y = 0 AND x BETWEEN -4 AND 3 AND z BETWEEN -3 AND 3 AND (x IN (-4, 3) OR z IN (-3, 3))""")
def shape_cells(spark, d):
    made = {"ball": shapes.sphere(spark, 6), "shell": shapes.sphere(spark, 8, filled=False), "ring": shapes.ring(spark, 4, 9), "frame": shapes.rectangle(spark, 8, 7, filled=False)}
    out = [df.select(F.lit(name).alias("shape"), "x", "y", "z") for name, df in made.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


_MOVING = """
s AS (SELECT 's' || s_suppkey AS name, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y, CAST(s_suppkey AS DOUBLE) AS z, CAST(1 + s_suppkey % 7 AS INT) AS state, CASE WHEN s_suppkey % 4 = 0 THEN 6 END AS gone, s_suppkey % 5 AS start FROM supplier),
t AS (SELECT unnest(range(0, 12)) AS tick),
st AS (SELECT *, CAST(greatest(least(9, tick) - start, 0) AS DOUBLE) AS n FROM s, t WHERE gone IS NULL OR tick < gone),
p AS (SELECT name, tick, state, x + n * 0.75 + CASE WHEN tick >= start THEN 3.3 * cos(0.2 + n * 0.3) ELSE 0 END AS px, y AS py, z - n * 1.25 + CASE WHEN tick >= start THEN 3.3 * sin(0.2 + n * 0.3) ELSE 0 END AS pz, n * 0.1 AS ry FROM st)"""


def _moving(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    start, stop = (k % 5).cast("long").alias("start"), F.lit(9).cast("long").alias("stop")
    cell = lambda x, z: F.struct(F.lit(x).alias("x"), F.lit(0).alias("y"), F.lit(z).alias("z"))
    return table(spark, d, "supplier").select(
        F.concat(F.lit("s"), k).alias("name"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"), k.cast("double").alias("z"), (1 + k % 7).cast("int").alias("state"),
        F.when(k % 4 == 0, 6).cast("long").alias("destroy"), F.array(cell(0, 0), cell(2, 0), cell(0, -3)).alias("cells"),
        F.array(F.struct(F.lit(0.75).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-1.25).alias("dz"), start, stop)).alias("moves"),
        F.array(F.struct(F.lit(0.0).alias("rx"), F.lit(0.1).alias("ry"), F.lit(0.0).alias("rz"), start, stop)).alias("spins"),
        F.array(F.struct(F.lit("xz").alias("plane"), F.lit(3.3).alias("radius"), F.lit(0.3).alias("speed"), start, stop, F.lit(0.2).alias("phase"))).alias("orbits"),
    )


@_query(f"WITH {_MOVING} SELECT name, tick, round(px, 6) AS x, round(py, 6) AS y, round(pz, 6) AS z, round(ry, 6) AS ry FROM p")
def trajectories(spark, d):
    at = shapes.trajectory(_moving(spark, d), spark.range(12).withColumnRenamed("id", "tick"))
    return at.select("name", "tick", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "ry")])


@_query(f"""
WITH {_MOVING}, c(cx, cz) AS (VALUES (0, 0), (2, 0), (0, -3))
SELECT DISTINCT tick, name, CAST(round(px + cx * cos(ry) + cz * sin(ry)) AS INT) AS x, CAST(round(py) AS INT) AS y, CAST(round(pz - cx * sin(ry) + cz * cos(ry)) AS INT) AS z, state FROM p, c""")
def shape_blocks(spark, d):
    return shapes.blocks_at(_moving(spark, d), spark.range(12).withColumnRenamed("id", "tick"))


# Patterns and scripts: an order is a file, its items are the lines


def _files(spark: SparkSession, d: str, head: str, line) -> DataFrame:
    """``file, text``: lines of an order in the order of its items."""
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", line.alias("line"))))
    texts = F.concat(F.lit(head), F.array_join(F.transform(lines, lambda s: s["line"]), "\n"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("file")).agg(texts.alias("text"))


@_query("""
WITH r AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS y FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS file, CAST(sum(n) AS BIGINT) AS cells, CAST(sum(n * y) AS BIGINT) AS y_sum, CAST(sum(n * (n + 1) // 2) AS BIGINT) AS x_sum FROM r GROUP BY 1""")
def pattern_cells(spark, d):
    files = _files(spark, d, "# an order\nx = 60, y = 99, rule = B3/S23\n", F.concat(F.lit("b"), F.col("l_quantity").cast("int"), F.lit("o$")))
    live = patterns.parse_patterns(files)
    return live.groupBy("file").agg(F.count(F.lit(1)).alias("cells"), F.sum("y").alias("y_sum"), F.sum("x").alias("x_sum"))


@_query("""
WITH e AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 3 * (l_linenumber + 1) END AS cells, l_partkey % 50 AS x, l_linenumber AS n FROM lineitem)
SELECT file, CAST(sum(cells) AS BIGINT) AS cells, CAST(sum(CASE WHEN n % 2 = 1 THEN x ELSE 3 * (x + 1) * (n + 1) END) AS BIGINT) AS x_sum, CAST(sum(cells * CASE WHEN n % 2 = 1 THEN n ELSE 5 END) AS BIGINT) AS states FROM e GROUP BY 1""")
def script_blocks(spark, d):
    n, x = F.col("l_linenumber"), F.col("l_partkey") % 50
    one = F.concat_ws(" ", F.lit("setblock"), x, F.lit("-4 3"), n)
    box = F.concat_ws("\t", F.lit("fill"), x + 2, n + 1, F.lit("2"), x, F.lit("1 2 5"))
    edits = scripts.block_edits(scripts.parse_commands(_files(spark, d, "# an order\n\n", F.when(n % 2 == 1, one).otherwise(box))))
    return edits.groupBy("file").agg(F.count(F.lit(1)).alias("cells"), F.sum("x").alias("x_sum"), F.sum("state").alias("states"))


# Matrices as coordinate files, one a partition, written and read


@_query(f"WITH {_A} SELECT i, k, CAST(v AS DOUBLE) AS v FROM a")
def matrix_files(spark, d):
    a, path = _a(spark, d), f"{shared_dir(spark)}/sparkloom/matrix-{uuid.uuid4().hex}"
    size = a.agg(F.max("i"), F.max("k")).first()
    matrix_market.write_matrix(a, path, (size[0] or 0) + 1, (size[1] or 0) + 1)
    return matrix_market.read_matrix(spark, f"{path}/*/*.txt").select("i", "k", "v")


# Compressed files: a document is a file


@_query("SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 ELSE ceil(n / 65280) END AS BIGINT) AS blocks, CAST(n AS BIGINT) AS n_bytes FROM (SELECT doc_id, coalesce(strlen(text), 0) AS n FROM documents)")
def blocked_gzip(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    back = blocks_gzip.decompress(blocks_gzip.compress(files))
    sizes = back.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("data")).cast("long").alias("n_bytes"))
    return docs.select("doc_id").join(sizes, "doc_id", "left").select("doc_id", F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"), F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"))
