"""Joins of boxes and spheres in which a cell holds nearly everything: pairs are spread over tasks, each is met once, and repeated ids stay rows of their own."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.numbers import rounded
from sparkloom.operators import levels, spatial

POINT, BOX, SPHERE = "id int, x double, y double, z double", "id int, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double", "id int, x double, y double, z double, r double"


@pytest.fixture
def small_tiles(spark, monkeypatch):
    """Tiles of a few rows, and as many tasks as there are partitions."""
    monkeypatch.setattr(spatial, "TOGETHER", 16, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def spread(df):
    """Whether no task makes more than half of the pairs."""
    made = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(made) <= sum(made) / 2


def points(n, seed):
    r = random.Random(seed)
    return [(i // 2, *[r.uniform(1, 99) for _ in range(3)]) for i in range(n)]  # each id twice


def boxes(n, seed):
    r = random.Random(seed)
    wide = [(i // 2, *[v for m in [r.uniform(1, 99) for _ in range(3)] for v in (m - 90, m + 90)]) for i in range(n)]
    return wide + [(n + i, *[v for m in [r.uniform(1, 99) for _ in range(3)] for v in (m - 3, m + 3)]) for i in range(n // 4)]


def spheres(n, seed):
    r = random.Random(seed)
    return [(i // 2, *[r.uniform(1, 99) for _ in range(3)], r.choice([4.0, 70.0, 75.0, 80.0])) for i in range(n)]


def inside(p, b):
    return all(b[k] < v < b[k + 1] for v, k in zip(p[1:], (1, 3, 5), strict=True))


def meet(a, b):
    return all(a[k] < b[k + 1] and b[k] < a[k + 1] for k in (1, 3, 5))


def d2(p, s):
    return sum((v - w) ** 2 for v, w in zip(p[1:4], s[1:4], strict=True))


@pytest.mark.parametrize("join", [levels.boxes_of_points, lambda p, b: spatial.boxes_of_points(p, b, 200.0), lambda p, b: spatial.boxes_of_points(p, b, 40.0)])
def test_points_in_boxes(spark, small_tiles, join):
    ps, bs = points(300, 1), boxes(60, 2)
    got = join(spark.createDataFrame(ps, POINT), spark.createDataFrame(bs, BOX))
    assert Counter(tuple(r) for r in got.collect()) == Counter((p[0], b[0]) for p in ps for b in bs if inside(p, b))
    assert spread(got)


@pytest.mark.parametrize("join", [levels.spheres_of_points, lambda p, s: spatial.spheres_of_points(p, s, 200.0), lambda p, s: spatial.spheres_of_points(p, s, 40.0)])
def test_points_in_spheres(spark, small_tiles, join):
    ps, ss = points(300, 3), spheres(60, 4) + [(90, 5.0, 5.0, 5.0, -80.0), (91, 5.0, 5.0, 5.0, float("nan")), (92, 5.0, 5.0, 5.0, None)]
    got = join(spark.createDataFrame(ps, POINT), spark.createDataFrame(ss, SPHERE))
    assert Counter(tuple(r) for r in got.collect()) == Counter((p[0], s[0]) for p in ps for s in ss if s[0] < 90 and d2(p, s) < s[4] * s[4])
    assert spread(got)


@pytest.mark.parametrize("join", [levels.touching_boxes, lambda a, b: spatial.touching_boxes(a, b, 200.0), lambda a, b: spatial.touching_boxes(a, b, 40.0)])
def test_touching_boxes(spark, small_tiles, join):
    a, b = boxes(120, 5), boxes(90, 6)
    got = join(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX))
    assert Counter(tuple(r) for r in got.collect()) == Counter((p[0], q[0]) for p in a for q in b if meet(p, q))
    assert spread(got)


def test_touching_spheres(spark, small_tiles):
    a, b = spheres(120, 7), spheres(90, 8)
    got = levels.touching_spheres(spark.createDataFrame(a, SPHERE), spark.createDataFrame(b, SPHERE))
    assert Counter((r.a_id, r.a_x, r.b_id, r.b_r) for r in got.collect()) == Counter((p[0], p[1], q[0], q[4]) for p in a for q in b if d2(p, q) < (p[4] + q[4]) ** 2)
    assert spread(got)


def test_rounded(spark):
    r = random.Random(9)
    values = [r.uniform(-1, 1) * 10.0 ** r.randrange(-9, 12) for _ in range(3000)] + [round(r.uniform(-9, 9), 6) + 5e-7 for _ in range(500)] + [n / 16 for n in range(-40, 40)]
    values += [0.0, -0.0, -1e-9, 1e300, 2.0**53 + 1, 2.0**44 / 1e6, float("inf"), -float("inf"), float("nan"), None, 2.5e-7, 5e-7, 1.0000005, 2.0000015, -1.0000005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (3, 6):
        assert [repr(x.a) for x in df.select(rounded(F.col("v"), digits).alias("a")).collect()] == [repr(x.a) for x in df.select(F.round("v", digits).alias("a")).collect()]
