"""Sections against a slow model."""

import itertools
import math
import random

from sparkloom.operators.sections import sections


def test_model(spark):
    r = random.Random(6)
    places = [(r.randrange(-20, 20), r.randrange(-20, 40), r.randrange(-3, 20)) for _ in range(3000)]
    world = {c: r.choice([1, 2, 3, 0, 86, 500, -4, None]) for c in places[:2000]}
    world |= dict.fromkeys(itertools.product(range(32, 48), range(16), range(16)), 7)  # a section of one state
    light = {c: r.choice([0, 1, 8, 15, 20]) for c in places[1000:]}
    want = {}
    for c in {*world, *light}:
        s = want.setdefault(tuple(a >> 4 for a in c), [0, 0, set(), [0] * 256])
        at = ((c[1] % 16) * 16 + c[2] % 16) * 16 + c[0] % 16
        if c in world:
            ok = world[c] is not None and 0 <= world[c] <= 100
            s[1] += not ok
            if ok and world[c]:
                s[0] += 1
                s[2].add(world[c])
        s[3][at // 16] |= min(15, light.get(c, 0)) << (4 * (at % 16))
    df = spark.createDataFrame([(*c, s) for c, s in world.items()] + [(None, 1, 1, 1)], "x int, y int, z int, state int")
    dl = spark.createDataFrame([(*c, v) for c, v in light.items()], "x int, y int, z int, level int")
    got = sections(df, dl, 100).collect()
    assert len(got) == len(want)
    for q in got:
        blocks, invalid, states, words = want[q.sx, q.sy, q.sz]
        palette = sorted(states | ({0} if blocks < 4096 else set()))
        bits = 0 if len(palette) == 1 else max(4, math.ceil(math.log2(len(palette))))
        assert (q.blocks, q.invalid, q.palette, q.bits) == (blocks, invalid, palette, bits)
        assert q.words == (-(-4096 // (64 // bits)) if bits else 0)
        assert [w % 2**64 for w in q.light] == words
    assert any(q.palette == [7] for q in got)
    assert sections(df.limit(0), dl.limit(0), 100).count() == 0 and sections(df.limit(0), dl, 100).where("size(palette) <> 1").count() == 0
