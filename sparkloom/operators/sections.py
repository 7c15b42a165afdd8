"""Worlds as rows of whole sections: 16 cells a side, with a palette and packed light."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import bits_for, words_needed
from .voxel import CELL

#: Cells of a section, and those whose light (4 bits) fits a word.
CELLS, LIGHTS = 4096, 16


def sections(world: DataFrame, light: DataFrame, last_state: int) -> DataFrame:
    """One row for each section in which ``world`` (``x, y, z, state``) or ``light`` (``x, y, z, level``) has a cell, each cell once on either side.

    Cells are in the order y, z, x. A state that is null, below 0 or above ``last_state`` is ``invalid`` and becomes air. ``palette`` has the section's distinct
    states in their order, air where a cell has nothing, and ``bits`` and ``words`` say what indexes into it take. ``light`` has 256 words of 16 levels, lowest first, held to
    0..15. World and light needn't be joined: their cells meet in sums over words of 16 cells, which are reduced before they are shuffled, and a section is put together from 256 of
    them at most. Returns ``sx, sy, sz, blocks, invalid, palette, bits, words, light``."""
    state, level = F.col("state"), F.col("level")
    index = (F.col("y").bitwiseAND(F.lit(15)) * 16 + F.col("z").bitwiseAND(F.lit(15))) * 16 + F.col("x").bitwiseAND(F.lit(15))
    both = world.select(*CELL, F.coalesce(state.cast("int"), F.lit(-1)).alias("state"), F.lit(None).cast("int").alias("level"))
    both = both.unionByName(light.select(*CELL, F.lit(None).cast("int").alias("state"), F.greatest(F.lit(0), F.least(F.lit(15), level)).cast("int").alias("level")))
    placed = both.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select(*[F.shiftright(c, 4).alias(f"s{c}") for c in CELL], index.alias("index"), "state", "level")
    key, valid = ["sx", "sy", "sz"], state.between(0, last_state)
    shifted = F.call_function("shiftleft", level.cast("bigint"), (F.col("index") % LIGHTS * 4).cast("int"))
    words = placed.groupBy(*key, F.floor(F.col("index") / LIGHTS).cast("int").alias("word")).agg(
        F.collect_set(F.when(valid & (state != 0), state)).alias("states"), F.count_if(valid & (state != 0)).alias("blocks"), F.count_if(~valid).alias("invalid"), F.bit_or(shifted).alias("packed"),
    )
    lit = F.map_from_entries(F.collect_list(F.when(F.col("packed").isNotNull(), F.struct("word", "packed"))))
    whole = words.groupBy(*key).agg(F.sum("blocks").alias("blocks"), F.sum("invalid").alias("invalid"), F.flatten(F.collect_list("states")).alias("states"), lit.alias("lit"))
    air = F.when(F.col("blocks") < CELLS, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    full = whole.withColumn("palette", F.sort_array(F.array_distinct(F.concat(air, "states"))))
    bits = bits_for(F.size("palette"))
    at_word = F.transform(F.sequence(F.lit(0), F.lit(CELLS // LIGHTS - 1)), lambda i: F.coalesce(F.try_element_at("lit", i), F.lit(0).cast("bigint")))
    return full.select(*key, "blocks", "invalid", "palette", bits.alias("bits"), words_needed(F.lit(CELLS), bits).alias("words"), at_word.alias("light"))
