"""Bit-packed and dictionary-encoded columns. A 64-bit word holds ``64 // bits`` values, lowest first; none spans two words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words_needed(count: Column, bits: Column | int) -> Column:
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.when(bits == 0, 0).otherwise(F.ceil(count / F.floor(F.lit(64) / bits))).cast("int")


def get_bits(words: Column, index: Column, bits: int) -> Column:
    """Value at ``index`` (from 0) of packed words; null beyond them."""
    per = 64 // bits
    word = F.try_element_at(words, (F.floor(index / per) + 1).cast("int"))
    return _shift(word, (index % per) * bits).bitwiseAND(F.lit((1 << bits) - 1))


def _shift(word: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, by.cast("int"))


def unpack(words: Column, bits: int, count: Column | int) -> Column:
    """The first ``count`` values of packed words."""
    count = F.lit(count) if isinstance(count, int) else count
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: get_bits(words, i, bits))).otherwise(F.array().cast("array<bigint>"))


def pack(values: Column, bits: int) -> Column:
    """Packed words of an array of whole numbers, which must be 0 to ``2**bits - 1``: others make the result null."""
    per = 64 // bits
    size = F.size(values)
    n = F.ceil(size / per).cast("int")

    def word(w: Column) -> Column:
        part = F.slice(values, w * per + 1, F.lit(per))
        shifted = F.transform(part, lambda v, i: F.call_function("shiftleft", v.cast("bigint"), (i * bits).cast("int")))
        return F.aggregate(shifted, F.lit(0).cast("bigint"), lambda a, v: a.bitwiseOR(v))

    fit = F.forall(values, lambda v: v.isNotNull() & (v >= 0) & (v < F.lit(1 << bits) if bits < 63 else F.lit(True)))
    return F.when(fit, F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).otherwise(F.array().cast("array<bigint>")))


def pack_rows(rows: DataFrame, key: str, index: str, value: str, bits: int) -> DataFrame:
    """Packed words ``(key, word, packed)`` of rows: each row is shifted to its place and words are sums, reduced before they are shuffled. No
    array of a whole group is built."""
    per = 64 // bits
    shifted = F.call_function("shiftleft", F.col(value).cast("bigint"), ((F.col(index) % per) * bits).cast("int"))
    return rows.groupBy(key, F.floor(F.col(index) / per).alias("word")).agg(F.bit_or(shifted).alias("packed"))


def unpack_rows(packed: DataFrame, key: str, bits: int) -> DataFrame:
    """The reverse; ``(key, index, value)`` with the places that were never written as 0."""
    per = 64 // bits
    at = F.explode(F.sequence(F.lit(0), F.lit(per - 1)))
    return packed.select(key, "word", "packed", at.alias("i")).select(key, (F.col("word") * per + F.col("i")).alias("index"), _shift(F.col("packed"), F.col("i") * bits).bitwiseAND(F.lit((1 << bits) - 1)).alias("value"))


def nibble(data: Column, index: Column) -> Column:
    """Four-bit value at ``index`` of an array of bytes (whole numbers): even places are low halves."""
    byte = F.try_element_at(data, (F.floor(index / 2) + 1).cast("int")).cast("int")
    return F.when(index % 2 == 0, byte.bitwiseAND(F.lit(15))).otherwise(F.shiftright(byte, 4).bitwiseAND(F.lit(15)))


def nibbles(values: Column) -> Column:
    """Bytes (0 to 255) of values, which are held to 0..15; an odd last one has a high half of 0."""
    held = F.transform(values, lambda v: F.greatest(F.lit(0), F.least(F.lit(15), v)))
    n = F.ceil(F.size(values) / 2).cast("int")
    at = lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda b: at(2 * b + 1) + F.shiftleft(at(2 * b + 2), 4))).otherwise(F.array().cast("array<int>"))


def bits_for(distinct: Column, least: int = 4, most_indexed: int = 8, direct: int = 15) -> Column:
    """Bits of an index into a dictionary of ``distinct`` values: 0 for one value, ``least`` at least, and ``direct`` without dictionary
    where more than ``most_indexed`` would be needed."""
    need = F.ceil(F.log2(F.greatest(distinct, F.lit(1)).cast("double"))).cast("int")
    return F.when(distinct <= 1, 0).when(need <= least, least).when(need <= most_indexed, need).otherwise(direct)


def dictionary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Codes ``(key, value, code)`` of the distinct values of each group, numbered in order from 0."""
    from pyspark.sql import Window as W

    return rows.select(key, value).distinct().withColumn("code", (F.row_number().over(W.partitionBy(key).orderBy(value)) - 1).cast("int"))


def encode(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with the ``code`` of their value in their group's dictionary."""
    codes = dictionary(rows, key, value)
    return rows.join(codes, [key, value])


def palettes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Size of each group's dictionary, and the bits and words that its rows take."""
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_values"))
    bits = bits_for(F.col("distinct_values"))
    return counted.select(key, "rows", "distinct_values", bits.alias("bits"), words_needed(F.col("rows"), bits).alias("words"))
