"""Life in tiles against life cell by cell."""

import random

import pytest

from sparkloom.operators import automaton


def slow(cells, n):
    for _ in range(n):
        near = {}
        for y, x in cells:
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if dy or dx:
                        near[(y + dy, x + dx)] = near.get((y + dy, x + dx), 0) + 1
        cells = {c for c, k in near.items() if k == 3 or (k == 2 and c in cells)}
    return cells


@pytest.mark.parametrize("generations,size,each", [(0, 8, 2), (1, 8, 4), (5, 8, 2), (7, 6, 3), (9, 64, 8)])
def test_random_grid(spark, generations, size, each):
    r = random.Random(generations)
    cells = {(r.randrange(-20, 21), r.randrange(-15, 16)) for _ in range(300)} | {(10**9 + dy, -(10**9) + dx) for dy, dx in ((0, 1), (1, 2), (2, 0), (2, 1), (2, 2))}
    df = spark.createDataFrame([*cells, *list(cells)[:5], (None, 1), (1, None)], "y long, x long")
    assert {tuple(c) for c in automaton.life_in_tiles(df, generations, size, each).collect()} == slow(cells, generations)


def test_periods_and_nothing(spark):
    """A blinker looks still after an even number of generations; the rest is done all the same."""
    bar = {(0, -1), (0, 0), (0, 1)}
    df = spark.createDataFrame(list(bar), "y long, x long")
    for n in (20, 21, 24, 25):
        assert {tuple(c) for c in automaton.life_in_tiles(df, n, 8, 4).collect()} == slow(bar, n)
    assert automaton.life_in_tiles(df.limit(0), 3, 8, 2).count() == 0
    with pytest.raises(ValueError):
        automaton.life_in_tiles(df, 3, 8, 5)
