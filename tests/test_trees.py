"""Jumps of the twister, merged change sets and digest trees against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import changes, trees, twister


@pytest.mark.parametrize("first", [0, 1, 5, 623, 624, 625, 19_936, 19_937, 100_003])
def test_jump(first):
    for seed in (1, 5489, 0, (1 << 40) + 3):
        state = twister.seeded(seed)
        mixed = (seed ^ (seed >> 32)) & 0xFFFFFFFF
        want = np.random.RandomState(mixed or 5489).randint(0, 1 << 32, first + 50, dtype=np.uint32)[first:]
        assert (twister.draws(state, first, 50) == want).all()


def test_far_jumps_agree():
    """A jump of any length is the same in one and in two."""
    state = twister.seeded(7)
    a, b = 10**12 + 7, 10**11 + 1
    one, two = twister.jumped(state, a + b), twister.jumped(twister.jumped(state, a), b)
    assert (twister.following(one, 700)[624:] == twister.following(two, 700)[624:]).all()
    assert twister.polynomial().bit_length() == twister.DEGREE + 1


def sequential(lo, hi, count, seed):
    """Cells as one loop draws them, the first draw of each."""
    size = [b - a + 1 for a, b in zip(lo, hi, strict=True)]
    raw = np.random.RandomState(seed)
    seen, n = {}, 0
    while len(seen) < min(count, size[0] * size[1] * size[2]):
        w = [int(x) for x in raw.randint(0, 1 << 32, 6, dtype=np.uint32)]
        seen.setdefault(tuple(a + ((w[2 * k] << 32) | w[2 * k + 1]) % s for k, (a, s) in enumerate(zip(lo, size, strict=True))), n)
        n += 1
    return {(d, *c) for c, d in seen.items()}


@pytest.mark.parametrize("lo,hi,count,each", [((-3, 0, 5), (3, 4, 9), 60, 10), ((0, 0, 0), (3, 3, 3), 64, 37), ((0, 0, 0), (3, 3, 3), 1000, 1 << 20), ((-1000, -64, -1000), (1000, 319, 1000), 400, 97), ((2, 2, 2), (2, 2, 2), 1, 5)])
def test_random_cells(spark, lo, hi, count, each):
    got = {tuple(r) for r in twister.random_cells(spark, lo, hi, count, 11, each).collect()}
    assert got == sequential(lo, hi, count, 11)


def test_no_random_cells(spark):
    assert twister.random_cells(spark, (0, 0, 0), (5, 5, 5), 0, 1).count() == 0


def test_states_at_any_tick(spark):
    r = random.Random(8)
    for last in (1, 2, 13, 16):
        rows = [(t, c, r.randrange(1, 4)) for t in range(last + 1) for c in range(12) if r.random() < 0.6]
        series = spark.createDataFrame(rows, "tick long, cell int, state int")
        merged = trees.merged_changes(changes.series_diffs(series, ["cell"], last), ["cell"], last)
        assert merged.agg(F.max("level")).first()[0] in (None, last.bit_length() - 1)
        ticks = spark.createDataFrame([(t,) for t in (*range(last + 1), last + 9, -1)], "at long")
        got = trees.states_at(series.where("tick = 0").select("cell", "state"), merged, ticks, ["cell"], last)
        assert sorted(map(tuple, got.collect())) == sorted(rows)
        assert all(x["count"] == x.at.bit_count() for x in trees.blocks_of(ticks, last).groupBy("at").count().collect())


def test_digests(spark, tmp_path):
    r = random.Random(9)
    base = {(t, c): r.randrange(5) for t in range(6) for c in range(64)}
    other = dict(base)
    other[(2, 17)] = 9
    del other[(4, 3)], other[(4, 4)]
    other[(5, 64)] = 1
    made = []
    for i, rows in enumerate((base, other)):
        df = spark.createDataFrame([(t, c // 8, c, s) for (t, c), s in rows.items()], "tick int, part int, cell int, state int")
        df.write.partitionBy("tick", "part").parquet(f"{tmp_path}/{i}")
        made.append(spark.read.parquet(f"{tmp_path}/{i}"))
    levels, key = ["tick", "part"], ["tick", "cell"]
    sums = [trees.digests(x, levels, ["state"], key) for x in made]
    assert {tuple(x) for x in trees.unequal_parts(*sums, levels).collect()} == {(2, 2), (4, 0), (5, 8)}
    got = sorted(map(tuple, trees.differences_by_digest(*made, levels, key, ["state"], *sums).collect()))
    assert got == sorted(map(tuple, changes.differences(*made, key, ["state"]).collect())) == [(2, 17, "both"), (4, 3, "left"), (4, 4, "left"), (5, 64, "right")]
    assert trees.differences_by_digest(made[0], made[0], levels, key, ["state"]).count() == 0
    none = made[0].limit(0)
    assert trees.differences_by_digest(none, none, levels, key, ["state"]).count() == 0
    assert trees.differences_by_digest(made[0], none, levels, key, ["state"]).count() == len(base)
