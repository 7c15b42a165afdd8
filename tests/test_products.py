"""Products with repeated coordinates: those of B are added up before the join, and dense rows are multiplied whole."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import heavy, matrix


def model(a, b):
    """Sums of products, null where all products are; a cell is there if any entries meet."""
    out = {}
    for (i, k, v), (l, j, w) in itertools.product(a, b):
        if k is not None and k == l:
            out.setdefault((i, j), []).append(None if v is None or w is None else float(v) * w)
    return {c: (sum(x for x in p if x is not None) if any(x is not None for x in p) else None) for c, p in out.items()}


def cells(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len({r[:2] for r in got})
    return {r[:2]: r[2] for r in got}


def joined_rows(df):
    """Rows that come out of joins."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        if "Join" in name and p.metrics().contains("numOutputRows"):
            found.append(p.metrics().apply("numOutputRows").value())
        for n in range(p.children().size()):
            walk(p.children().apply(n))

    walk(plan)
    return max(found)


def entries(seed):
    r = random.Random(seed)
    a = [(r.randrange(20), r.randrange(12), r.randint(-9, 9)) for _ in range(300)]
    dense = [(k, j, r.randint(-9, 9)) for k in range(10) for j in range(5) for _ in range(4)]
    return a, dense


KINDS = {
    "dense": lambda b: b,
    "sparse": lambda b: [c for c in b if (c[0] + c[1]) % 3],
    "null places": lambda b: b + [(None, 1, 3), (1, None, 4)],
    "as many cells as a dense one": lambda b: [(1, 1, 2), (2, 2, 3), (1, None, 4), (2, None, 5)],
    "null values": lambda b: [(k, j, None if (k, j) == (3, 2) else w) for k, j, w in b],
    "nothing": lambda b: [],
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("small", [True, False])
def test_products(spark, monkeypatch, kind, small):
    if not small:
        monkeypatch.setattr(matrix, "BROADCAST_ROWS", 0)
    a, b = entries(1)
    a, b = [*a, (21, 3, None), (22, None, 1), (None, 3, 2)], KINDS[kind](b)
    left, right = spark.createDataFrame(a, "i long, k long, v int"), spark.createDataFrame(b, "k long, j int, b int")
    df = matrix.spmm(left, right)
    assert df.columns == ["i", "j", "c"] and dict(df.dtypes)["j"] == "int" and cells(df) == model(a, b)
    plain = [[x for x in side if None not in x] for side in (a, b)]
    assert cells(heavy.spmm_split(left, right)) == cells(heavy.spmm_split(left, right, share=1.0)) == model(*plain)


def test_rows(spark):
    a, b = entries(2)
    rows = [(k, [float(w) for (l, _, w) in b[20 * k : 20 * k + 20] if l == k][n::4]) for k in range(10) for n in range(4)]
    right = spark.createDataFrame([*rows, (1, None)], "k long, row array<double>")
    got = {(r.i, j): c for r in matrix.spmm_rows(spark.createDataFrame(a, "i long, k long, v int"), right, 5).collect() for j, c in enumerate(r.row)}
    assert got == model(a, [(k, j, w) for k, row in rows for j, w in enumerate(row)])


@pytest.mark.parametrize("product", [matrix.spmm, heavy.spmm_split])
def test_one_joined_row_an_entry(spark, product):
    """Four entries a cell of B make no products of their own, nor does each of its columns."""
    a, b = entries(3)
    assert joined_rows(product(spark.createDataFrame(a, "i long, k long, v int"), spark.createDataFrame(b, "k long, j int, b int"), **({} if product is matrix.spmm else {"share": 1.0}))) <= len(a)


def test_rows_of_one_key_are_one(spark):
    a, _ = entries(4)
    rows = [(k, [1.0, 2.0]) for k in range(12) for _ in range(6)]
    assert joined_rows(matrix.spmm_rows(spark.createDataFrame(a, "i long, k long, v int"), spark.createDataFrame(rows, "k long, row array<double>"), 2)) <= len(a)


def test_residual_of_a_table_written_once(spark, sf_dir):
    from sparkloom.plans.queries import QUERIES

    plan = QUERIES["scaled_residual"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "product-" in str(QUERIES["scaled_residual"](spark, sf_dir).inputFiles()) and "posexplode" in plan
