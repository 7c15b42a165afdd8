"""One stream of a 32-bit Mersenne twister, drawn in parts by many tasks: each jumps ahead to where its part begins."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import cut

#: Words of the state, distance of the recurrence, its matrix, degree of its polynomial, and the seed that stands for 0. Fixed values.
WORDS, DISTANCE, MATRIX, DEGREE, NO_SEED = 624, 397, 0x9908B0DF, 19937, 5489


def seeded(seed: int) -> np.ndarray:
    """State after seeding, before the first draw; the halves of a seed of 64 bits are joined by exclusive-or."""
    seed &= (1 << 64) - 1
    seed = (seed ^ (seed >> 32)) & 0xFFFFFFFF
    return np.random.RandomState(seed or NO_SEED).get_state()[1].astype(np.uint32)


def following(state: np.ndarray, n: int) -> np.ndarray:
    """The state and the ``n`` words that follow it, as they stand before they are tempered."""
    out = np.empty(WORDS + n, dtype=np.uint32)
    out[:WORDS] = state
    step = WORDS - DISTANCE  # so many words depend on none of each other
    for at in range(WORDS, WORDS + n, step):
        to = min(at + step, WORDS + n)
        y = (out[at - WORDS : to - WORDS] & np.uint32(0x80000000)) | (out[at - WORDS + 1 : to - WORDS + 1] & np.uint32(0x7FFFFFFF))
        out[at:to] = out[at - step : to - step] ^ (y >> 1) ^ np.where(y & 1, np.uint32(MATRIX), np.uint32(0))
    return out


@lru_cache(maxsize=1)
def polynomial() -> int:
    """Characteristic polynomial of one step, bit ``i`` the coefficient of ``x**i``: the shortest recurrence of one bit of the words (Berlekamp and Massey)."""
    bits = (following(seeded(1), 2 * DEGREE)[WORDS:] & 1).tolist()
    c, b, length, since, seen = 1, 1, 0, 1, 0  # connection polynomials, bit i for the word i before
    for n, bit in enumerate(bits):
        seen = (seen << 1) | bit  # the last word is bit 0
        if not (c & seen).bit_count() & 1:
            since += 1
        elif 2 * length <= n:
            c, b, length, since = c ^ (b << since), c, n + 1 - length, 1
        else:
            c ^= b << since
            since += 1
    return int(format(c, f"0{length + 1}b")[::-1], 2)


_SPREAD = [sum((b >> i & 1) << 2 * i for i in range(8)).to_bytes(2, "little") for b in range(256)]


def power_of_x(steps: int) -> int:
    """``x**steps`` modulo the characteristic polynomial, by squaring."""
    p, r = polynomial(), 1
    for bit in bin(steps)[2:]:
        r = int.from_bytes(b"".join([_SPREAD[b] for b in r.to_bytes((r.bit_length() + 7) // 8, "little")]), "little") << int(bit)
        while (over := r.bit_length() - DEGREE - 1) >= 0:
            r ^= p << over
    return r


def jumped(state: np.ndarray, steps: int) -> np.ndarray:
    """The state ``steps`` words further on, at a cost that hardly depends on ``steps``: a sum of shifted windows of the words that follow."""
    words = following(state, DEGREE)
    out = np.zeros(WORDS, dtype=np.uint32)
    for i, bit in enumerate(format(power_of_x(steps), "b")[::-1]):
        if bit == "1":
            out ^= words[i : i + WORDS]
    return out


def draws(state: np.ndarray, first: int, n: int) -> np.ndarray:
    """Tempered words ``first`` to ``first + n - 1`` of the stream."""
    raw = np.random.RandomState()
    raw.set_state(("MT19937", jumped(state, first) if first else state, WORDS))
    return raw.randint(0, 1 << 32, n, dtype=np.uint32)


def drawn_cells(spark: SparkSession, lo: tuple[int, int, int], hi: tuple[int, int, int], first: int, n: int, seed: int, each: int) -> DataFrame:
    """Draws ``first`` to ``first + n - 1`` of cells of a box: ``draw, x, y, z``. A coordinate is the remainder of two words, the first of which is the
    high half. ``each`` draws are a task's."""
    state = seeded(seed)
    size = [b - a + 1 for a, b in zip(lo, hi, strict=True)]

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (k for pdf in parts for k in pdf["id"].tolist()):
            begin, end = first + part * each, min(first + n, first + (part + 1) * each)
            words = draws(state, 6 * begin, 6 * (end - begin)).reshape(-1, 3, 2).astype(np.uint64)
            whole = (words[:, :, 0] << np.uint64(32)) | words[:, :, 1]
            cells = [(whole[:, k] % np.uint64(s)).astype(np.int64) + a for k, (a, s) in enumerate(zip(lo, size, strict=True))]
            yield pd.DataFrame({"draw": np.arange(begin, end), **{c: v.astype(np.int32) for c, v in zip("xyz", cells, strict=True)}})

    parts = -(-n // each)
    return spark.range(0, parts, 1, parts).mapInPandas(draw, "draw long, x int, y int, z int")


def random_cells(spark: SparkSession, lo: tuple[int, int, int], hi: tuple[int, int, int], count: int, seed: int, each: int = 1 << 20) -> DataFrame:
    """The first ``count`` distinct cells of a box (ends included) that one seeded stream draws, at most the whole box: ``draw`` (number of the draw), ``x, y, z``.

    Tasks draw disjoint parts of the stream; of each cell the first draw stays, a minimum that is reduced before it is shuffled. As long as the draws so far
    have too few cells, a round adds more, as many as are expected to be missing. What lies beyond the last cell wanted is left out by its draw number,
    which is found from counts of ranges of draws. Nothing is drawn on the driver."""
    space = math.prod(b - a + 1 for a, b in zip(lo, hi, strict=True))
    count = max(0, min(count, space))
    if count == 0:
        return spark.createDataFrame([], "draw long, x int, y int, z int")
    cells, have, n = None, 0, 0
    while have < count:
        # expected draws until so many of all cells have been drawn, and some more
        expected = -space * math.log1p(-count / space) if count < space else space * (math.log(space) + 1)
        missing = -space * math.log1p(-(count - have) / (space - have)) if count < space else space
        more = int(expected * 1.02) + 64 if n == 0 else int(max(missing * 1.1, n * 0.05)) + 64
        new = drawn_cells(spark, lo, hi, n, more, seed, each)
        first = (new if cells is None else cells.unionByName(new)).groupBy("x", "y", "z").agg(F.min("draw").alias("draw"))
        cells = cut(first.select("draw", "x", "y", "z"), "drawn-cells")
        have, n = cells.count(), n + more
    width = max(1, -(-n // 65_536))
    upto, left = 0, count
    for r in cells.groupBy(F.floor(F.col("draw") / width).alias("r")).count().orderBy("r").collect():  # at most 65,536 counts
        if r["count"] >= left:
            inside = cells.where(F.floor(F.col("draw") / width) == r["r"]).select("draw").orderBy("draw").limit(left)  # of one range
            upto = inside.agg(F.max("draw")).first()[0]
            break
        left -= r["count"]
    return cells.where(F.col("draw") <= upto)
