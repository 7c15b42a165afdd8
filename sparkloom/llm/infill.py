"""Fill-in-the-middle: texts cut at lines and put together in another order."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_worker, text_or_empty

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Units between two checkpoints, and bytes that are looked at together.
EVERY = 64
BLOCK = 1 << 20


def _chars(data: bytes | memoryview) -> int:
    """Code points of UTF-8 bytes: all bytes but those that continue one."""
    whole = np.frombuffer(data, dtype=np.uint8)
    return sum(int(np.count_nonzero((whole[at : at + BLOCK] & 0xC0) != 0x80)) for at in range(0, len(whole), BLOCK))


@dataclass
class Checkpoints:
    """Where every ``EVERY``-th unit of a text begins, in bytes and in code points. A unit is a line with its end; the last one may have none."""

    data: bytes
    n: int
    chars: int
    units: list[int]
    byte_at: list[int]
    char_at: list[int]

    @classmethod
    def count(cls, data: bytes, every: int = EVERY, block: int = BLOCK) -> Checkpoints:
        """One pass over the bytes, ``block`` at a time, that counts units and notes a checkpoint whenever ``every`` of them are complete."""
        units, byte_at, char_at = [0], [0], [0]
        lines = chars = 0
        whole = np.frombuffer(data, dtype=np.uint8)
        for at in range(0, len(whole), block):
            part = whole[at : at + block]
            begins = (part & 0xC0) != 0x80
            ends = np.flatnonzero(part == 10) + 1
            noted = ends[every - 1 - lines % every :: every]
            before = 0
            for k, end in enumerate(noted.tolist()):
                chars += int(np.count_nonzero(begins[before:end]))
                before = end
                units.append((lines // every + k + 1) * every)
                byte_at.append(at + end)
                char_at.append(chars)
            chars += int(np.count_nonzero(begins[before:]))
            lines += len(ends)
        return cls(data, lines + (len(data) > 0 and data[-1] != 10), chars, units, byte_at, char_at)

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code point at which ``unit`` begins (``n``: the end): the last checkpoint before it is found by binary search, the rest is read again."""
        if unit >= self.n:
            return len(self.data), self.chars
        j = bisect_right(self.units, unit) - 1
        at = self.byte_at[j]
        for _ in range(unit - self.units[j]):
            at = self.data.index(b"\n", at) + 1
        return at, self.char_at[j] + _chars(memoryview(self.data)[self.byte_at[j] : at])


CUTS = "n long, prefix_chars long, middle_chars long"


def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    free_worker()
    for texts, h1, h2 in batches:
        rows = []
        for text, a, b in zip(texts, h1.to_pylist(), h2.to_pylist(), strict=True):
            index = Checkpoints.count(text.as_buffer().to_pybytes())
            first, second = sorted((a % (index.n + 1), b % (index.n + 1)))
            prefix = index.cut(first)[1]
            rows.append((index.n, prefix, index.cut(second)[1] - prefix))
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["n", "prefix_chars", "middle_chars"])


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that was made into ``output``: its parts, which hold no mark, in their first order."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(MARKS), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """Each text of ``docs`` (``doc_id, text``) cut into prefix, middle and suffix between lines, written as ``psm`` (``<P>prefix<S>suffix<M>middle``) or
    ``spm`` (``<S>suffix<P>prefix<M>middle``), or left ``plain``. Cuts and form come from the SHA-256 of seed and doc_id: reruns agree.

    ``rate`` percent are transformed, of these ``spm`` percent as spm. Empty texts and texts that hold a mark stay plain. Cuts are found in a sparse index
    of a text's lines (``Checkpoints``), in which only every 64th is noted, so a text of any length costs one pass and short rescans.

    Null text counts as empty, a null doc_id as an empty one in the hash. Rows are transformed each: repeated rows give equal rows. Long texts are whole
    in a task, as in any row of Spark. An empty table gives an empty result; further columns are not read.
    Returns ``doc_id, n`` (lines), ``form, prefix_chars, middle_chars`` (code points; null if plain), ``output``.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select("doc_id", text_or_empty().alias("text"), digest.alias("digest")).select("doc_id", "text", *h)
    cuts = F.arrow_udf(_cuts, CUTS)
    cut = rows.select("*", cuts(F.col("text").cast("binary"), "h1", "h2").alias("c")).select("doc_id", "text", "h3", "h4", "c.*")
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= rate)
    formed = cut.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm"))
    prefix = F.substring("text", F.lit(1), F.col("prefix_chars").cast("int"))
    middle = F.substring("text", (F.col("prefix_chars") + 1).cast("int"), F.col("middle_chars").cast("int"))
    suffix = F.substring("text", (F.col("prefix_chars") + F.col("middle_chars") + 1).cast("int"), F.lit(2**31 - 1))
    p, s, m = (F.lit(x) for x in MARKS)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    counted = [F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix_chars", "middle_chars")]
    return formed.select("doc_id", "n", "form", *counted, output.alias("output"))
