"""Split products against plain ones, and light in tiles against light cell by cell."""

import itertools
import random

import pytest

from sparkloom.operators import heavy, lighting, matrix, voxel

from .test_operators import light_model


def triples(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("area", [1 << 20, 64])
def test_split_product(spark, area):
    """One k has half of all entries of A, another of B; whole numbers, so sums are exact."""
    r = random.Random(area)
    a = [(r.randrange(200), 7 if r.random() < 0.5 else r.randrange(300), r.randint(-9, 9)) for _ in range(3000)]
    b = [(11 if r.random() < 0.4 else r.randrange(300), r.randrange(40), r.randint(-9, 9)) for _ in range(1500)]
    da = spark.createDataFrame([*a, (None, 7, 1), (1, None, 1), (1, 7, None)], "i long, k long, v int")
    db = spark.createDataFrame([*b, (None, 1, 1), (7, None, 1), (7, 1, None)], "k long, j int, b int")
    assert heavy.frequent(da.dropna(), "k", 1 / 64, "i")[0] == {7} and heavy.frequent(db.dropna(), "k", 1 / 64, "j")[0] == {11}
    plain = {}
    by_k = {}
    for k, j, w in b:
        by_k.setdefault(k, []).append((j, w))
    for i, k, v in a:
        for j, w in by_k.get(k, []):
            plain[i, j] = plain.get((i, j), 0) + v * w
    got = triples(heavy.spmm_split(da, db, area=area))
    assert got == sorted((i, j, float(c)) for (i, j), c in plain.items())
    assert got == triples(matrix.spmm(da.dropna(), db.dropna()))


def test_split_without_and_with_only_heavy(spark):
    even = spark.createDataFrame([(n % 50, n, 1.0) for n in range(1000)], "i long, k long, v double")
    right = spark.createDataFrame([(n, n % 3, 2.0) for n in range(1000)], "k long, j long, b double")
    assert triples(heavy.spmm_split(even, right)) == triples(matrix.spmm(even, right))
    one = spark.createDataFrame([(n, 0, float("nan") if n == 3 else 1.0) for n in range(500)], "i long, k long, v double")
    got = triples(heavy.spmm_split(one, right.where("k < 5"), area=128))
    assert len(got) == 500 and {c for i, _, c in got if i != 3} == {2.0} and next(c for i, _, c in got if i == 3) != 2.0
    assert triples(heavy.spmm_split(even.limit(0), right)) == triples(heavy.spmm_split(even, right.limit(0))) == []


BOX = voxel.Bounds(-3, 25, 0, 19, -20, 5)
SCHEMA = "x int, y int, z int, state int"
PLACES = list(itertools.product(range(BOX.x0, BOX.x1 + 1), range(BOX.y0, BOX.y1 + 1), range(BOX.z0, BOX.z1 + 1)))


def random_world(r, full):
    world = {c: r.choice([1, 1, 86, 90]) for c in r.sample(PLACES, int(full * len(PLACES)))}
    for c in r.sample(PLACES, 6):
        world[c] = r.choice([6032, 5907, 2403, 102])
    world[(BOX.x0 - 1, 3, 0)] = 6032  # outside: gives no light
    return world


def lit(df):
    return {(q.x, q.y, q.z): q.level for q in df.collect()}


@pytest.mark.parametrize("size,full", [(8, 0.1), (16, 0.5), (64, 0.3)])
def test_light_in_tiles(spark, size, full):
    world = random_world(random.Random(size), full)
    model = light_model({c: s for c, s in world.items() if c[0] >= BOX.x0}, BOX)
    df = spark.createDataFrame([*((*c, s) for c, s in world.items()), (None, 1, 1, 6032), (1, 1, 1, None) if (1, 1, 1) not in world else (None,) * 4], SCHEMA)
    assert lit(lighting.light_in_tiles(df, BOX, size)) == model


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_relight(spark, seed):
    """Lamps and walls come and go; a second series of edits goes on from the result of the first."""
    r = random.Random(seed)
    world = {c: s for c, s in random_world(r, 0.3).items() if c[0] >= BOX.x0}
    light = lighting.light_in_tiles(spark.createDataFrame([(*c, s) for c, s in world.items()], SCHEMA), BOX, 8)
    for _ in range(2):
        lamps = [c for c, s in world.items() if s in (6032, 5907, 2403, 102)]
        edits = {**{c: r.choice([0, 1, 86, 6032]) for c in r.sample(PLACES, 12)}, lamps[0]: 0, (BOX.x1 + 1, 2, 2): 6032}
        before = spark.createDataFrame([(*c, s) for c, s in world.items()], SCHEMA)
        light = lighting.relight(light, before, spark.createDataFrame([(*c, s) for c, s in edits.items()], SCHEMA), BOX, 8)
        world = {c: s for c, s in {**world, **edits}.items() if s and c[0] <= BOX.x1}
        assert lit(light) == light_model(world, BOX)


def test_relight_near_edits_only(spark):
    """Tiles out of an edit's reach keep what they had, wrong levels too: nobody looks at them."""
    world = spark.createDataFrame([(0, 5, 0, 6032), (200, 5, 0, 6032)], SCHEMA)
    far = voxel.Bounds(-20, 250, 0, 20, -20, 20)
    old = lighting.light_in_tiles(world, far, 32)
    marked = old.selectExpr("x", "y", "z", "IF(x > 150, 99, level) AS level")
    edit = spark.createDataFrame([(0, 5, 0, 0)], SCHEMA)
    got = lit(lighting.relight(marked, world, edit, far, 32))
    assert set(got.values()) == {99} and len(got) == old.where("x > 150").count() > 1000
    assert lit(lighting.relight(old, world, edit.limit(0), far, 32)) == lit(old)
    assert lighting.light_in_tiles(world.limit(0), far).count() == 0
