"""Blocked gzip: each block is a gzip member of its own that names its size, so readers can start at any block."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Uncompressed bytes of a block, below the 64 KiB that a block may have once its head is added. Fixed by the format.
BLOCK = 0xFF00
#: The empty block that ends a file. Fixed value.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def member(data: bytes, level: int = 0) -> bytes:
    """One block: gzip with an extra field that holds its size less 1."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def compress(files: DataFrame, level: int = 0, block: int = BLOCK) -> DataFrame:
    """Blocks ``(path, nth, block)`` of files ``(path, content)``: joined in order, and followed by ``END``, they are the compressed file.
    A file is cut first, so that its blocks can be compressed anywhere. Null and empty content has no blocks."""
    n = F.octet_length("content")
    starts = F.sequence(F.lit(0), n - 1, F.lit(block))
    pieces = files.where(n > 0).select("path", F.posexplode(F.transform(starts, lambda s: F.substring(F.col("content"), s + 1, F.lit(block)))).alias("nth", "data"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [member(x, level) for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("nth"), pa.array(out, pa.binary())], names=["path", "nth", "block"])

    return pieces.mapInArrow(work, "path string, nth int, block binary")


def decompress(blocks: DataFrame) -> DataFrame:
    """``(path, nth, data)`` of compressed blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [zlib.decompress(x, 31) for x in b.column("block").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("nth"), pa.array(out, pa.binary())], names=["path", "nth", "data"])

    return blocks.mapInArrow(work, "path string, nth int, data binary")
