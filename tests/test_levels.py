"""Boxes and spheres of any size against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import levels
from sparkloom.operators.matrix import random_sparse, shuffled

BOX = "id int, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double"


def boxes(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        h = [10 ** r.uniform(0, 6) / 2 if r.random() < 0.7 else r.choice([0, 0.5, 1, 2, 4, 8]) for _ in range(3)]
        m = [r.choice([r.uniform(-2000, 2000), float(r.randrange(-16, 16))]) for _ in range(3)]
        out.append((i, *[v for a, b in zip(m, h, strict=True) for v in (a - b, a + b)]))
    inf = float("inf")
    return out + [(n, -inf, inf, -inf, inf, -inf, inf), (n + 1, 5.0, 4.0, 0.0, 1.0, 0.0, 1.0), (n + 2, None, 1.0, 0.0, 1.0, 0.0, 1.0), (n + 3, float("nan"), 1.0, 0.0, 1.0, 0.0, 1.0), (n + 4, 1.0, 1.0 + 1e-9, 1.0, 1.0 + 1e-9, 1.0, 1.0 + 1e-9)]


def sound(b):
    return all(v is not None and v == v for v in b[1:]) and all(b[k] <= b[k + 1] for k in (1, 3, 5))


@pytest.mark.parametrize("dims", [2, 3])
def test_boxes(spark, dims):
    a, b = boxes(60, 1), boxes(50, 2)
    left, right = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)
    touch = {(p[0], q[0]) for p in a for q in b if sound(p) and sound(q) and all(p[k] < q[k + 1] and q[k] < p[k + 1] for k in (1, 3, 5)[:dims])}
    got = [tuple(r) for r in levels.touching_boxes(left, right, dims).collect()]
    assert len(got) == len(set(got)) and set(got) == touch
    r = random.Random(3)
    points = [(i, *[r.choice([r.uniform(-3000, 3000), float(r.randrange(-16, 16))]) for _ in range(3)]) for i in range(200)] + [(200, None, 1.0, 1.0), (201, float("nan"), 1.0, 1.0), (202, 1e300, -1e300, 0.0)]
    frame = spark.createDataFrame(points, "id int, x double, y double, z double")
    inside = {(p[0], q[0]) for p in points for q in b if sound(q) and all(v is not None and q[k] < v < q[k + 1] for v, k in list(zip(p[1:], (1, 3, 5), strict=True))[:dims])}
    got = [tuple(r) for r in levels.boxes_of_points(frame, right, dims).collect()]
    assert len(got) == len(set(got)) and set(got) == inside


def test_few_rows_a_box(spark):
    laid = levels.on_grid(levels.usable(spark.createDataFrame(boxes(300, 4), BOX))).groupBy("id").count()
    assert laid.agg(F.max("count")).first()[0] <= 8
    exact = [(i, 0.0, 2.0**i, 0.0, 2.0**i, 0.0, 2.0**i) for i in range(-20, 40)]
    assert levels.on_grid(spark.createDataFrame(exact, BOX)).groupBy("id").count().agg(F.max("count")).first()[0] <= 8


def test_spheres(spark):
    r = random.Random(6)
    made = [(i, *[r.uniform(-500, 500) for _ in range(3)], 10 ** r.uniform(-1, 3.5)) for i in range(60)] + [(60, 0.0, 0.0, 0.0, 1.0), (61, 2.0, 0.0, 0.0, 1.0), (62, 0.0, 0.0, 0.0, 0.5), (63, 1.0, 1.0, 1.0, 0.0)]
    frame = spark.createDataFrame(made, "id int, x double, y double, z double, r double")
    d = lambda p, q: sum((a - b) ** 2 for a, b in zip(p[1:4], q[1:4], strict=True)) ** 0.5
    got = levels.touching_spheres(frame, frame).select("a_id", "b_id", *levels.union_sphere()).collect()
    assert {(g.a_id, g.b_id) for g in got} == {(p[0], q[0]) for p in made for q in made if p[4] > 0 and q[4] > 0 and d(p, q) < p[4] + q[4]}
    by_id = {p[0]: p for p in made}
    for g in got:
        around = (0, g.x, g.y, g.z)
        for p in (by_id[g.a_id], by_id[g.b_id]):
            assert d(around, p) + p[4] <= g.r * (1 + 1e-9)
        a, b = by_id[g.a_id], by_id[g.b_id]
        assert g.r == pytest.approx(max(a[4], b[4], (d(a, b) + a[4] + b[4]) / 2))
    points = [(i, *[r.uniform(-800, 800) for _ in range(3)]) for i in range(150)]
    inside = levels.spheres_of_points(spark.createDataFrame(points, "id int, x double, y double, z double"), frame)
    assert {tuple(x) for x in inside.collect()} == {(p[0], s[0]) for p in points for s in made if d(p, s) < s[4]}


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097, 65_536])
def test_permutation(n):
    out = shuffled(n, 7)(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))
    assert n < 1000 or (out != shuffled(n, 8)(np.arange(n))).any()


def test_random_places_without_a_shuffle(spark):
    df = random_sparse(spark, 300, 200, 0.9, 5)
    assert "Exchange" not in df._jdf.queryExecution().toString()
    cells = [(r.i, r.k) for r in df.collect()]
    assert len(cells) == len(set(cells)) == int(300 * 200 * (1 - 0.9)) and all(0 <= i < 300 and 0 <= k < 200 for i, k in cells)
    assert sorted(cells) == sorted((r.i, r.k) for r in random_sparse(spark, 300, 200, 0.9, 5).repartition(3).collect())
    v = np.array([r.v for r in df.collect()])
    assert abs(v.mean()) < 0.05 and abs(v.std() - 1) < 0.05
    per_row = np.bincount([i for i, _ in cells], minlength=300)
    assert per_row.min() > 2 and per_row.max() < 45
    assert random_sparse(spark, 5, 5, 1.0, 1).count() == 0 and random_sparse(spark, 5, 5, 0.0, 1).select("i", "k").distinct().count() == 25
