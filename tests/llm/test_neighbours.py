"""Neighbours against brute force where products are large, near each other or equal."""

import tracemalloc

import numpy as np
import pytest

from sparkloom.llm.neighbours import Forest, neighbours

SCHEMA = "vec_id long, embedding array<double>"


def brute(x, k=20, every=20):
    out = {}
    for q in range(0, len(x), every):
        s = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
        out[q] = [(i, s[i]) for i in order]
    return out


def found(spark, x, **how):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    out = {}
    for r in neighbours(df, df.vec_id % 20 == 0, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def data(kind):
    r = np.random.default_rng(1)
    if kind == "large":
        return r.standard_normal((600, 16)) * 1e25
    if kind == "huge":
        return r.standard_normal((300, 8)) * 1e160  # products overflow
    if kind == "near":
        return 1 + 1e-9 * r.standard_normal((600, 16))
    if kind == "whole":
        return r.integers(0, 3, (1200, 8)).astype(float)
    return r.choice([-1.0, 1.0], (1200, 16))


@pytest.mark.parametrize("kind", ["large", "near", "whole", "signs"])
def test_all_leaves_open(spark, kind):
    """With every leaf open, ids and scores are those of brute force; so ties go to the smaller vec_id."""
    x = data(kind)
    x = x[np.abs(x).sum(axis=1) > 0]
    assert found(spark, x, least_visits=10**9) == brute(x)


@pytest.mark.parametrize("kind", ["large", "near", "whole", "signs"])
def test_recall(spark, kind):
    x = data(kind)
    x = x[np.abs(x).sum(axis=1) > 0]
    assert recall(found(spark, x), brute(x)) >= 0.9


def test_overflow(spark):
    got = found(spark, data("huge"), k=5)
    assert all(len(v) == 5 for v in got.values())


def test_regions_blocks_and_slices(spark):
    """Vectors in many regions and slices and queries in many blocks, repeated vectors and ids, other columns."""
    r = np.random.default_rng(2)
    x = np.repeat(r.standard_normal((250, 8)), 2, axis=0)
    want = brute(x, 7)
    got = found(spark, x, k=7, region=40, query_block=3, least_visits=10**9, leaf=8)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    got = found(spark, x, k=7, region=40, query_block=3, least_visits=10**9, most_depth=0)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    twice = spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in enumerate(x)] * 2, SCHEMA + ", region int, uid string")
    again = neighbours(twice, twice.vec_id % 20 == 0, k=7, least_visits=10**9).collect()
    assert {(a.query_id, a.rank, a.vec_id) for a in again} == {(q, n + 1, i) for q, v in want.items() for n, (i, _) in enumerate(v)} and len(again) == 7 * 25


def test_memory_of_the_measured_sample():
    """Leaves of a sample take memory for a block of vectors, not for all of them times all nodes; and they are those of a walk by single products."""
    r = np.random.default_rng(3)
    x = r.standard_normal((8192, 16))
    forest = Forest.fit(x, 2, 11, 5)
    tracemalloc.start()
    leaves = forest.leaves(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16e6  # all at once: 8192 * 2047 products, 134 MB
    for i in range(0, len(x), 97):
        for t in range(2):
            node = 0
            for _ in range(11):
                node = 2 * node + 1 + int(x[i] @ forest.directions[t, node].astype(np.float64) >= forest.thresholds[t, node])
            assert leaves[i, t] == node - forest.nodes
