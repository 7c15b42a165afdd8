"""Operators against slow models, golden values and round trips."""

import gzip
import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import numbers
from sparkloom.operators import automaton, changes, matrix, nested, packed, quant, sessions, shapes, spatial, tomography, voxel
from sparkloom.plans.iterate import digest, prefix_sums
from sparkloom.sources import blocks_gzip, matrix_market, patterns, scripts, tables
from sparkloom.streaming import work as streams

BOX = voxel.Bounds(0, 8, 0, 8, 0, 8)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# numbers


def test_half_precision(spark):
    bits = [0, 0x8000, 1, 0x3FF, 0x400, 0x3C00, 0xBC00, 0x7BFF, 0x7C00, 0xFC00, 0x3555]
    got = spark.createDataFrame([(b,) for b in bits], "b int").select(numbers.half_to_double(F.col("b")).alias("v")).collect()
    import numpy as np

    want = np.array(bits, dtype=np.uint16).view(np.float16).astype(float)
    assert [r.v for r in got] == want.tolist()


def test_to_half_truncates(spark):
    cases = [(0.0, 0), (1.0, 0x3C00), (-2.0, 0xC000), (1.9999, 0x3FFF), (65504.0, 0x7BFF), (65535.0, 0x7BFF), (70000.0, 0x7C00), (6e-5, 0), (2.0**-14, 0x400), (0.1, 0x2E66), (float("nan"), 0x7C00), (float("inf"), 0x7C00)]
    got = spark.createDataFrame([(x,) for x, _ in cases], "x double").select(numbers.double_to_half(F.col("x")).alias("b")).collect()
    assert [r.b for r in got] == [b for _, b in cases]


def test_varint_golden(spark):
    # Fixed values of the variable-length form.
    golden = [(0, "00"), (1, "01"), (2, "02"), (127, "7f"), (128, "8001"), (255, "ff01"), (25565, "ddc701"), (2097151, "ffff7f"), (2147483647, "ffffffff07"), (-1, "ffffffff0f"), (-2147483648, "8080808008")]
    df = spark.createDataFrame([(x,) for x, _ in golden], "x long")
    got = df.select(numbers.varint_hex(F.col("x")).alias("h"), numbers.varint_length(F.col("x")).alias("n")).collect()
    assert [(r.h, r.n) for r in got] == [(h, len(h) // 2) for _, h in golden]


def test_position_round_trip(spark):
    r = random.Random(1)
    cells = [(r.randint(-(1 << 25), (1 << 25) - 1), r.randint(-2048, 2047), r.randint(-(1 << 25), (1 << 25) - 1)) for _ in range(200)]
    df = spark.createDataFrame(cells, "x long, y long, z long").withColumn("p", numbers.pack_position(F.col("x"), F.col("y"), F.col("z")))
    back = df.select(*[c.alias(n) for c, n in zip(numbers.unpack_position(F.col("p")), "xyz", strict=True)])
    assert [tuple(x) for x in back.collect()] == cells


# packed columns


def test_unpack_golden(spark):
    # Fixed values of the packed form.
    words = [0x0020863148418841, 0x01018A7260F68C87]
    got = spark.range(1).select(packed.unpack(F.array(*[F.lit(w) for w in words]), 5, 24).alias("v")).first().v
    assert got == [1, 2, 2, 3, 4, 4, 5, 6, 6, 4, 8, 0, 7, 4, 3, 13, 15, 16, 9, 14, 10, 12, 0, 2]


@pytest.mark.parametrize("bits", [1, 4, 5, 9, 15, 31, 32])
def test_pack_round_trip(spark, bits):
    r = random.Random(bits)
    data = [(k, [r.randrange(1 << bits) for _ in range(n)]) for k, n in enumerate([0, 1, 12, 64, 100])]
    df = spark.createDataFrame(data, "k int, v array<long>").withColumn("w", packed.pack(F.col("v"), bits))
    assert [(x.k, x.b, len(x.w)) for x in df.select("k", packed.unpack(F.col("w"), bits, F.size("v")).alias("b"), "w").collect()] == [(k, v, -(-len(v) // (64 // bits))) for k, v in data]
    flat = df.select("k", F.posexplode("v").alias("i", "x"))
    back = packed.unpack_rows(packed.pack_rows(flat, "k", "i", "x", bits), "k", bits)
    assert not flat.select("k", F.col("i").cast("long"), "x").exceptAll(back.select("k", "index", "value")).count()


def test_pack_out_of_range(spark):
    df = spark.createDataFrame([([1, 16],), ([-1],), ([None],)], "v array<long>")
    assert [x.w for x in df.select(packed.pack(F.col("v"), 4).alias("w")).collect()] == [None, None, None]


def test_nibbles(spark):
    df = spark.createDataFrame([([1, 99, -3],)], "v array<int>").withColumn("b", packed.nibbles(F.col("v")))
    assert df.first().b == [0xF1, 0]
    assert df.select(packed.nibble(F.col("b"), F.lit(1)).alias("n")).first().n == 15


# matrices and quantised rows


def test_spmm_model(spark):
    r = random.Random(2)
    a = [(r.randrange(6), r.randrange(8), r.random()) for _ in range(20)]
    b = [(k, j, r.random()) for k in range(8) for j in range(4)]
    c = {}
    for i, k, v in a:
        for kk, j, w in b:
            if k == kk:
                c[i, j] = c.get((i, j), 0) + v * w
    left, right = spark.createDataFrame(a, "i int, k int, v double"), spark.createDataFrame(b, "k int, j int, b double")
    got = {(x.i, x.j): x.c for x in matrix.spmm(left, right).collect()}
    assert got.keys() == c.keys() and all(abs(got[k] - c[k]) < 1e-12 for k in c)
    full = matrix.with_all_rows(matrix.spmm(left, right), spark.range(9).withColumnRenamed("id", "i"), spark.range(4).withColumnRenamed("id", "j"))
    assert full.count() == 36


def test_residual_of_nothing(spark):
    empty = spark.createDataFrame([], "i int, j int, c double")
    a, b = spark.createDataFrame([], "i int, k int, v double"), spark.createDataFrame([], "k int, j int, b double")
    assert matrix.scaled_residual(empty, empty, a, b).first().residual == 0
    one = spark.createDataFrame([(0, 0, 1.0)], "i int, j int, c double")
    assert matrix.scaled_residual(one, empty, a, b).first().residual == float("inf")


def test_random_matrices(spark):
    a = matrix.random_sparse(spark, 20, 30, 0.75, 5)
    assert a.count() == 150 == a.select("i", "k").distinct().count()
    assert digest(a) == digest(matrix.random_sparse(spark, 20, 30, 0.75, 5))
    assert matrix.random_dense(spark, 3, 4, 1).count() == 12


def test_prefix_sums_over_ranges(spark):
    df = spark.createDataFrame([(k, k % 5) for k in range(0, 300, 3)], "k long, n long")
    total, want = 0, []
    for k in range(0, 300, 3):
        want.append((k, total))
        total += k % 5
    assert rows(prefix_sums(df, "k", "n", span=16), "k", "start") == want


def test_quantised_rows_come_back(spark):
    r = random.Random(3)
    x = [[r.uniform(-2, 2) for _ in range(70)], [0.0] * 32, [1.0] * 31, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "row long, x array<double>")
    q8 = quant.quantise_q8(df).select("row", "block", quant.dequantise(F.col("d"), F.col("qs")).alias("v")).collect()
    assert sorted((q.row, q.block) for q in q8) == [(0, 0), (0, 1), (1, 0)]
    for q in q8:
        assert all(abs(a - b) <= 2 / 127 / 2 + 1e-9 for a, b in zip(q.v, x[q.row][q.block * 32 :], strict=False))
    q4 = quant.quantise_q4(df).select("row", "block", quant.dequantise(F.col("d"), quant.unpack_q4(F.col("qs"))).alias("v")).collect()
    for q in q4:
        assert all(abs(a - b) <= 2 / 7 / 2 + 1e-9 for a, b in zip(q.v, x[q.row][q.block * 32 :], strict=False))


# life


def life_model(cells):
    n = {}
    for y, x in cells:
        for dy, dx in itertools.product((-1, 0, 1), repeat=2):
            if (dy, dx) != (0, 0):
                n[y + dy, x + dx] = n.get((y + dy, x + dx), 0) + 1
    return {c for c, k in n.items() if k == 3 or (k == 2 and c in cells)}


def test_life_model(spark):
    r = random.Random(4)
    cells = {(r.randrange(12), r.randrange(12)) for _ in range(50)}
    want = cells
    for _ in range(6):
        want = life_model(want)
    df = spark.createDataFrame(sorted(cells), "y long, x long")
    assert rows(automaton.life(df, 6)) == sorted(want)


def test_glider_moves(spark):
    glider = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 1), (2, 2)], "y long, x long")
    after = automaton.life(glider, 4)
    assert rows(after) == [(1, 2), (2, 3), (3, 1), (3, 2), (3, 3)]
    assert automaton.same_pattern(glider, after)


def test_many_patterns_compared(spark):
    r = random.Random(6)
    grids = {k: {(r.randrange(9), r.randrange(9)) for _ in range(r.randrange(1, 20))} for k in range(30)}
    shifted = {k: {(y - 5 * k, x + 3) for y, x in g} for k, g in grids.items()}
    for k in range(0, 30, 4):
        shifted[k].add((max(shifted[k])[0] + 1, 0))  # one cell more, below all others
    for k in range(1, 30, 4):
        shifted[k] = {(x, y) for y, x in shifted[k]}
    del shifted[2], grids[3]
    a, b = ([(k, y, x) for k, g in side.items() for y, x in sorted(g)] for side in (grids, shifted))

    def moved(g):
        y0, x0 = (min(c[i] for c in g) for i in (0, 1))
        return {(y - y0, x - x0) for y, x in g}

    want = [(k, len(grids.get(k, ())), k in grids and k in shifted and moved(grids[k]) == moved(shifted[k])) for k in range(30)]
    one, other = (spark.createDataFrame(c + c[:5] + [(2, None, 1), (40, 1, None)], "file int, y int, x int") for c in (a, b))
    assert rows(automaton.same_patterns(one, other)) == want
    assert sum(w[2] for w in want) > 10
    assert rows(automaton.same_patterns(one, other.limit(0))) == [(k, len(g), False) for k, g in sorted(grids.items())]


def test_life_ends(spark):
    block = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "y long, x long")
    assert rows(automaton.life(block, 50)) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert rows(automaton.life(block.where("y = 0"), 5)) == []
    assert automaton.bounds(block.where("y > 5")).first().min_y is None


def test_patterns(spark):
    text = "#C a glider\nx = 3, y = 3, rule = B3/S23\nbob$2bo$\n3o!ignored"
    assert rows(patterns.parse_patterns(spark.createDataFrame([("g", text), ("e", "x = 1, y = 1\n!")], "file string, text string")), "y", "x") == [(0, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    wide = spark.createDataFrame([("w", "x = 2, y = 3\n4o3$o!"), ("n", None)], "file string, text string")
    assert rows(patterns.parse_patterns(wide), "y", "x") == [(0, 0), (0, 1), (3, 0)]


# tomography


def test_reconstruction_of_a_disc(spark):
    import numpy as np

    n, angles = 32, 40
    t = np.arange(n) - (n - 1) / 2
    ray = 2 * np.sqrt(np.maximum(0, 64 - t**2))
    df = spark.createDataFrame([(0, a, ray.tolist()) for a in range(angles)], "slice int, angle int, row array<double>")
    image = np.zeros((n, n))
    for r in tomography.reconstruct(df, n, angles).collect():
        image[r.y, r.x] = r.value
    assert abs(image[12:20, 12:20].mean() - 1) < 0.1
    assert abs(image[14, :3].mean()) < 0.1
    grey = tomography.grey_levels(tomography.reconstruct(df, n, angles), n)
    assert grey.agg(F.min("level"), F.max("level")).first()[:] == (0, 255)
    flat = spark.createDataFrame([(0, 0, [0.0] * n), (0, 1, None)], "slice int, angle int, row array<double>")
    assert tomography.grey_levels(tomography.reconstruct(flat, n, 2), n).agg(F.max("level")).first()[0] == 0


# voxels


def light_model(world, b):
    level, queue = {}, []
    passes = lambda s: s == 0 or 86 <= s <= 101
    lamp = lambda s: 15 if 102 <= s <= 117 or s == 2403 else voxel.LAMPS.get(s, 0)
    for c, s in world.items():
        if lamp(s):
            queue.append((c, lamp(s), True))
    best = {}
    while queue:
        c, v, on = queue.pop()
        level[c] = max(level.get(c, 0), v)
        if not on or best.get(c, 0) >= v or v <= 1:
            continue
        best[c] = v
        for m in voxel.SIX:
            t = tuple(a + d for a, d in zip(c, m, strict=True))
            if not all(lo <= a <= hi for a, lo, hi in zip(t, (b.x0, b.y0, b.z0), (b.x1, b.y1, b.z1), strict=True)):
                continue
            clear = passes(world.get(t, 0))
            if clear or m == (0, -1, 0):
                queue.append((t, v - 1, clear))
    return level


@pytest.mark.parametrize("seed", [1, 2])
def test_light_model(spark, seed):
    r = random.Random(seed)
    world = {c: r.choice([1, 1, 86, 90]) for c in itertools.product(range(9), repeat=3) if r.random() < 0.35}
    for _ in range(4):
        world[tuple(r.randrange(9) for _ in range(3))] = r.choice([6032, 5907, 2403, 102])
    df = spark.createDataFrame([(*c, s) for c, s in world.items()], "x int, y int, z int, state int")
    got = {(q.x, q.y, q.z): q.level for q in voxel.flood_light(df, BOX).collect()}
    assert got == light_model(world, BOX)


def test_slopes_model(spark):
    r = random.Random(6)
    world = {c: 1 for c in itertools.product(range(9), repeat=3) if r.random() < 0.6}
    hard = set(world)
    starts = [(r.randrange(9), r.randrange(1, 9), r.randrange(9)) for _ in range(12)]

    def steps(c):
        seen, edge = {c}, [c] if c not in hard else []
        for k in range(5):
            if any((x, y - 1, z) not in hard for x, y, z in edge):
                return k
            new = []
            for x, y, z in edge:
                for dx, _, dz in voxel.SIDES:
                    t = (x + dx, y, z + dz)
                    if t not in seen and t not in hard and 0 <= t[0] <= 8 and 0 <= t[2] <= 8:
                        seen.add(t)
                        new.append(t)
            edge = new
        return 999

    df = spark.createDataFrame([(*c, 1) for c in hard], "x int, y int, z int, state int")
    got = {(q.x, q.y, q.z): q.steps for q in voxel.slopes(df, spark.createDataFrame(starts, "x int, y int, z int"), BOX).collect()}
    assert got == {c: steps(c) for c in set(starts)}


def test_water_rules(spark):
    schema = "x int, y int, z int, state int"
    floor = [(x, 0, z, 1) for x in range(9) for z in range(9)]
    step = lambda cells: {(q.x, q.y, q.z): q.type for q in voxel.fluid_step(spark.createDataFrame(floor + cells, schema), BOX).collect()}
    assert step([(4, 5, 4, 86)]) == {(4, 4, 4): 94}  # falls
    assert step([(4, 1, 4, 86)]) == {(5, 1, 4): 87, (3, 1, 4): 87, (4, 1, 5): 87, (4, 1, 3): 87}  # spreads
    assert step([(4, 1, 4, 92)])[4, 1, 4] == -93  # nothing feeds it
    assert step([(4, 1, 4, 93)]) == {(4, 1, 4): -94}
    two = step([(3, 1, 4, 86), (5, 1, 4, 86), (4, 1, 4, 87)])
    assert two[4, 1, 4] == 86  # between two sources
    assert step([(4, 1, 4, 102), (4, 2, 4, 86)])[4, 1, 4] == 2397  # lava under water
    hole = [c for c in floor if c[:3] != (6, 0, 4)]
    df = spark.createDataFrame([*hole, (4, 1, 4, 86)], schema)
    assert rows(voxel.fluid_step(df, BOX), "x", "y", "z", "type") == [(5, 1, 4, 87)]  # towards the hole


def test_tick_lets_water_run(spark):
    schema = "x int, y int, z int, state int"
    world = spark.createDataFrame([(x, 0, z, 1) for x in range(9) for z in range(9)] + [(4, 2, 4, 86)], schema)
    work = spark.createDataFrame([(4, 2, 4, -1, 1)], "x int, y int, z int, type int, trigger_tick long")
    for now in (1, 2, 3):
        world, work = voxel.tick(world, work, now, BOX)
    states = {(q.x, q.y, q.z): q.state for q in world.where("state <> 1").collect()}
    assert states[4, 2, 4] == 86 and states[4, 1, 4] == 94
    assert {c for c, s in states.items() if s == 87} == {(3, 1, 4), (5, 1, 4), (4, 1, 3), (4, 1, 5)}


def test_world_edges(spark):
    world = spark.createDataFrame([(0, 0, 0, 5)], "x int, y int, z int, state int")
    new = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 7), (99, 0, 0, 7)], "x int, y int, z int, state int")
    assert rows(voxel.set_blocks(world, new, BOX)) == [(1, 0, 0, 7)]
    asked = spark.createDataFrame([(0, 0, 0), (5, 5, 5)], "x int, y int, z int")
    assert rows(voxel.get_blocks(world, asked)) == [(0, 0, 0, 5), (5, 5, 5, 0)]
    assert rows(voxel.flood_light(world.where("x > 3"), BOX)) == []
    assert voxel.fill(spark, (0, 0, 0), (1, 2, 3), 4).distinct().count() == 24


# change sets


def test_diffs_replay(spark):
    r = random.Random(8)
    series = [(t, c, r.randint(1, 3)) for t in range(6) for c in range(10) if r.random() < 0.6]
    df = spark.createDataFrame(series, "tick long, cell long, state int")
    found = changes.series_diffs(df, ["cell"], 5)
    for t in range(1, 6):
        one = changes.diff(df.where(f"tick = {t - 1}"), df.where(f"tick = {t}"), ["cell"])
        assert rows(one, "op", "cell", "state") == rows(found.where(f"tick = {t}"), "op", "cell", "state")
    empty = df.where("tick < 0").select("cell", "state")
    for t in range(6):
        assert rows(changes.replay(empty, found.where(f"tick <= {t}"), ["cell"]), "cell", "state") == rows(df.where(f"tick = {t}"), "cell", "state")
    assert changes.first_difference(df, df, ["tick", "cell"], ["state"]).count() == 0


# space


def test_box_joins_model(spark):
    r = random.Random(9)
    box = lambda i: (i, *[x for _ in range(3) for a in [r.uniform(-50, 50)] for x in (a, a + r.uniform(0, 20))])
    schema = "id int, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double"
    a, b = [box(i) for i in range(60)], [box(i) for i in range(60)]
    points = [(i, *[r.uniform(-50, 50) for _ in range(3)]) for i in range(200)]
    A, B, P = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), spark.createDataFrame(points, "id int, x double, y double, z double")
    meet = lambda u, v: all(u[k] < v[k + 1] and v[k] < u[k + 1] for k in (1, 3, 5))
    inside = lambda p, u: all(u[2 * k + 1] < p[k + 1] < u[2 * k + 2] for k in range(3))
    for cell in (3.0, 25.0):
        assert rows(spatial.touching_boxes(A, B, cell)) == sorted((u[0], v[0]) for u in a for v in b if meet(u, v))
        assert rows(spatial.boxes_of_points(P, A, cell)) == sorted((p[0], u[0]) for p in points for u in a if inside(p, u))


# nested data, sessions


def test_nested(spark):
    df = spark.createDataFrame([('{"a": {"B": [1, 2]}, "s": "x"}',), ("no json",)], "t string").select(nested.parsed(F.col("t")).alias("v"))
    got = df.select(nested.get(F.col("v"), "$.a.B[1]", "int").alias("x"), nested.get_or_zero(F.col("v"), "$.s", "int").alias("z")).collect()
    assert [tuple(r) for r in got] == [(2, 0), (None, 0)]
    m = spark.range(1).select(F.create_map(F.lit("Ab"), F.lit(1), F.lit("c"), F.lit(2)).alias("m"))
    assert m.select(nested.get_any_case(F.col("m"), "aB").alias("x")).first().x == 1
    assert m.select(nested.put(F.col("m"), "d", F.lit(3)).alias("m")).first().m == {"Ab": 1, "c": 2, "d": 3}
    kinds = [("1b", "byte"), ("-2S", "short"), ("7L", "long"), ("12", "int"), ("1.5f", "float"), (".5", "double"), ("1e3d", "double"), ("abc", "string"), ("1x", "string")]
    df = spark.createDataFrame([(t,) for t, _ in kinds], "t string")
    assert [r.k for r in df.select(nested.literal_kind(F.col("t")).alias("k")).collect()] == [k for _, k in kinds]


def test_gaps_edges(spark):
    df = spark.createDataFrame([(1, 0), (1, 15), (1, 31), (1, 62), (None, 5)], "user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.what for r in sessions.gaps(df).orderBy("ts").collect()] == ["join", "alive", "ping", "drop"]


# shapes


def test_shapes(spark):
    assert shapes.sphere(spark, 0).count() == 1
    assert shapes.ring(spark, 0, 0).count() == 0
    assert shapes.rectangle(spark, 4, 3).count() == 12
    cells = shapes.random_cells(spark, (0, 0, 0), (2, 2, 2), 99, 100)
    assert cells.count() == 27 == cells.distinct().count()


# files


def test_blocked_gzip_is_gzip(spark):
    data = random.Random(1).randbytes(150_000)
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray()), ("c", None)], "path string, content binary")
    out = blocks_gzip.compress(df, level=6).orderBy("nth").collect()
    assert gzip.decompress(b"".join(bytes(r.block) for r in out) + blocks_gzip.END) == data
    assert len(out) == 3


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 3\n1 1 2.5\n3 1 -1\n3 1 4\n")
    (tmp_path / "p.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n2 2 1\n2 1\n")
    got = matrix_market.read_matrix(spark, str(tmp_path))
    assert rows(got.where("file like '%m.mtx'"), "i", "k", "v") == [(0, 0, 2.5), (0, 2, -1.0), (0, 2, 4.0), (2, 0, -1.0), (2, 0, 4.0)]
    assert rows(got.where("file like '%p.mtx'"), "i", "k", "v") == [(1, 0, 1.0)]
    matrix_market.write_matrix(got.where("file like '%m.mtx'"), str(tmp_path / "out"), 3, 3)
    back = matrix_market.read_matrix(spark, str(tmp_path / "out/*/*.txt"))
    assert rows(back, "i", "k", "v") == rows(got.where("file like '%m.mtx'"), "i", "k", "v")


def test_scripts(spark):
    text = "# a script\n\nsetblock 1 2 3 86\n fill 0 0 0 1 -1 0 5\nfill 1 2\nanimate create s sphere 1 2 3 4 true 7\nanimate move s 1 0 0 2 9\nanimate move s 0 1 0 3 9\nanimate orbit s xz 3 0.5 0 9 90\nanimate destroy s 12\nanimate spin lost 1 2 3 4 5\ntick"
    commands = scripts.parse_commands(spark.createDataFrame([("f", text), ("g", None)], "file string, text string"))
    assert [r.command for r in commands.orderBy("nth").collect()] == ["setblock", "fill", "fill", *["animate"] * 6, "tick"]
    assert rows(scripts.block_edits(commands), "x", "y", "z", "state") == [(0, -1, 0, 5), (0, 0, 0, 5), (1, -1, 0, 5), (1, 0, 0, 5), (1, 2, 3, 86)]
    (s,) = scripts.shape_table(commands).collect()
    assert (s["name"], s.kind, s.sizes, s.x, s.y, s.z, s.state, s.destroy) == ("s", "sphere", ["4", "true"], 1.0, 2.0, 3.0, 7, 12)
    assert [tuple(m) for m in s.moves] == [(1.0, 0.0, 0.0, 2, 9), (0.0, 1.0, 0.0, 3, 9)] and s.spins == [] and abs(s.orbits[0].phase - 1.5707963) < 1e-6


def test_random_grid(spark):
    cells = automaton.random_cells(spark, 40, 50, 3)
    assert 800 < cells.count() < 1200 and cells.where("y >= 40 OR x >= 50").count() == 0


def test_recorded_series(spark, tmp_path):
    series = spark.createDataFrame([(t, c) for t in range(6) for c in range(3)], "tick long, cell int")
    tables.record(series, str(tmp_path / "s"), every=2)
    assert rows(tables.recorded(spark, str(tmp_path / "s"), first=2).select(F.col("tick").cast("int"), "cell")) == [(t, c) for t in (2, 4) for c in range(3)]


# streams


def test_streams_equal_batches(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def put(df, n):
        df.write.mode("append").parquet(out)

    work = lambda df: df.select("ts", (F.col("user_id") % 4).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), F.length("event_type").alias("type"), F.lit(1).alias("trigger_tick"))
    streams.each_batch(streams.new_work(work(stream), late="60 days"), put, str(tmp_path / "c1"))
    key = ["x", "y", "z", "type", "trigger_tick"]
    assert rows(spark.read.parquet(out), *key) == rows(work(events).dropDuplicates(key), *key)

    query = streams.live_sessions(stream, timeout="2 hours", late="1 second").writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {tuple(r) for r in sessions.sessions(events, timeout="2 hours").select("user_id", "start", "last", "events").collect()}
    got = {tuple(r) for r in spark.table("live").select("user_id", "start", "last", "events").collect()}
    assert got and got <= want
    query = streams.counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()


def test_product_in_tiles(spark):
    draw = random.Random(5)
    w, a = (spark.createDataFrame([(i, [draw.gauss(0, 1) for _ in range(64)]) for i in range(n)], "row long, x array<double>") for n in (23, 9))
    product = lambda **kw: {(r.i, r.j): r.c for r in quant.matmul(quant.quantise_q8(w), quant.quantise_q8(a), packed=False, **kw).collect()}
    whole, tiled = product(), product(few=0, tiles=3)
    assert len(whole) == 23 * 9 and whole.keys() == tiled.keys() and all(abs(whole[k] - tiled[k]) < 1e-9 for k in whole)
