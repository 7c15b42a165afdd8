"""Life in tiles that are taken many at once: tiles that go on over batches, full stacks, repeated cells, and no more jobs than rounds need."""

import random

import pytest

from sparkloom.operators import automaton
from sparkloom.plans import iterate

from .test_life_tiles import slow


@pytest.mark.parametrize("stacked,batch", [(1, 1), (1, 7), (3000, 3), (1 << 21, 10_000)])
def test_stacks(spark, monkeypatch, stacked, batch):
    monkeypatch.setattr(automaton, "STACKED", stacked, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    r = random.Random(stacked + batch)
    cells = {(r.randrange(-40, 41), r.randrange(-30, 31)) for _ in range(1500)} | {(10**9 + dy, -(10**9) + dx) for dy, dx in ((0, 1), (1, 2), (2, 0), (2, 1), (2, 2))}
    df = spark.createDataFrame([*cells, *list(cells)[:300], (None, 1), (1, None)], "y long, x long")
    for generations in (0, 3, 7):
        got = [tuple(c) for c in automaton.life_in_tiles(df, generations, 8, 3).collect()]
        assert len(got) == len(set(got)) and set(got) == slow(cells, generations)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_one_round_compares_nothing(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(iterate, "digest", lambda df: seen.append(df) or (len(seen),))
    bar = spark.createDataFrame([(0, -1), (0, 0), (0, 1)], "y long, x long")
    assert automaton.life_in_tiles(bar, 4, 64, 4).count() == 3 and not seen
    assert automaton.life_in_tiles(bar, 6, 64, 2).count() == 3 and len(seen) == 3


def test_tiles_are_no_groups(spark):
    """A call of Python for each tile costs more than a tile of few cells."""
    bar = spark.createDataFrame([(0, -1), (0, 0), (0, 1)], "y long, x long")
    plans = []
    original = iterate.cut
    try:
        iterate.cut = lambda df, name="step": plans.append(df._jdf.queryExecution().toString()) or original(df, name)
        automaton.life_in_tiles(bar, 2, 8, 2)
    finally:
        iterate.cut = original
    assert plans and not any("FlatMapGroups" in p for p in plans)
