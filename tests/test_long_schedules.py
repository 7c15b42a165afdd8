"""Commands of a long schedule: each is looked at once, not once for each that comes after it."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.commands import firings, lifetimes


@pytest.mark.parametrize("run", [lifetimes, firings])
def test_no_frame_is_summed_up_anew(spark, run):
    """A window up to the last row takes as many steps a row as rows follow."""
    n = F.col("id")
    entries = spark.range(3000).select(F.lit("w").alias("world"), F.floor(n / 4).alias("tick"), n.alias("nth"), F.when(n % 100 == 99, "clear").otherwise("sched").alias("verb"), (F.floor(n / 4) + 1 + n % 40).alias("due"))
    df = run(entries, ["world"])
    assert "unboundedfollowing" not in df._jdf.queryExecution().toString()
    want = {k: (k // 100 * 100 + 99) // 4 for k in range(3000) if k % 100 != 99}
    if run is lifetimes:
        assert {r.nth: r.cleared for r in df.collect()} == want
    else:
        assert sorted((r.nth, r.tick) for r in df.collect()) == [(k, k // 4 + 1 + k % 40) for k in want if want[k] >= k // 4 + 1 + k % 40]
