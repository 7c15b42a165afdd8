"""Removal of repeated byte strings, by suffix arrays over shards of candidate text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import bundles, cover, runs
from .common import dropped, numbered, semi, short_batches, text_or_empty, written
from .suffixes import repeated

#: Distinct bundles of one anchor that may meet in a shard; a larger group is divided first.
GROUP = 1024
#: Text of a shard.
SHARD_BYTES = 1_500_000
#: Windows of a block when a large group is divided.
BLOCK = 64

BUNDLES = "rid long, lo int, hi int, at int, anchor long, content long"


def _buffers(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in column]


def _bundle_rows(length: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bundles([np.frombuffer(x, dtype=np.uint8) for x in _buffers(batch.column("data"))], length, k)
            rid = batch.column("rid").to_numpy(zero_copy_only=False)[found["doc"]] if len(found["doc"]) else np.zeros(0, dtype=np.int64)
            cols = [pa.array(rid, pa.int64()), *(pa.array(found[c].astype(np.int32)) for c in ("lo", "hi", "at")), pa.array(found["anchor"]), pa.array(found["content"])]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "lo", "hi", "at", "anchor", "content"])

    return rows


def _key(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


PARTS = "key long, rid long, copies long, start int, part binary"


def _cut_parts(length: int):
    """The text of bundles, from the documents that they were first found in. Bundles of a large group
    are cut into blocks of windows; the key of a block is the text that all its windows hold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, data, asked in zip(batch.column("rid").to_pylist(), _buffers(batch.column("data")), batch.column("asked").to_pylist(), strict=True):
                for x in asked:
                    lo, hi, at = x["lo"], x["hi"], x["at"]
                    if not x["large"]:
                        out.append((x["anchor"], rid, x["copies"], lo, data[lo : hi + length]))
                        continue
                    name = x["anchor"].to_bytes(8, "little", signed=True)
                    for b in range((at - hi) // BLOCK, (at - lo) // BLOCK + 1):
                        first, last = max(lo, at - BLOCK * b - BLOCK + 1), min(hi, at - BLOCK * b)
                        core = data[at - BLOCK * b : at - BLOCK * b - BLOCK + 1 + length]
                        out.append((_key(name, b.to_bytes(4, "little"), core), rid, x["copies"], first, data[first : last + length]))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "rid", "copies", "start", "part"])

    return cut


SPANS = "rid long, begin int, end int"


def _search_shard(length: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rid, start, flags in zip(pdf["rid"], pdf["start"], repeated(list(pdf["part"]), length), strict=True):
            for a, b in zip(*runs(flags), strict=True):
                out.append((rid, start + a, start + b - 1 + length))
        return pd.DataFrame(out, columns=["rid", "begin", "end"])

    return search


def _windows(length: int):
    """Single windows of parts whose group is still too large: the whole window is the key."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rid, start, part in zip(pdf["rid"], pdf["start"], pdf["part"], strict=True):
                for s in range(len(part) - length + 1):
                    d = hashlib.blake2b(part[s : s + length], digest_size=16).digest()
                    out.append((d, rid, start + s))
            yield pd.DataFrame(out, columns=["window", "rid", "start"])

    return windows


def repeated_spans(base: DataFrame, length: int, k: int) -> DataFrame:
    """Spans (``rid, begin, end`` in bytes, overlapping) of ``base`` (``rid, data``) that are covered by
    ``length``-byte strings which also start elsewhere."""
    found = written(base.mapInArrow(_bundle_rows(length, k), BUNDLES), "suffix-bundles")
    met = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("c0"), F.max("content").alias("c1")).where("n > 1")
    met = written(met.select("anchor", (F.col("c0") != F.col("c1")).alias("branching")), "suffix-met")
    shared = written(found.join(met, "anchor"), "suffix-shared")
    dropped(found, met)
    # anchors with one content: each window of each bundle stands in all of them
    spans = shared.where("NOT branching").select("rid", F.col("lo").alias("begin"), (F.col("hi") + length).alias("end"))
    branching = shared.where("branching").drop("branching")
    src = F.min(F.struct("rid", "lo", "hi", "at")).alias("src")
    distinct = written(branching.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), src), "suffix-distinct")
    copied = distinct.where("copies > 1").select("anchor", "content")
    # written by itself: where the join shuffles, adaptive execution can then split the copies of one bundle
    whole = semi(branching, copied, ["anchor", "content"]).select("rid", F.col("lo").alias("begin"), (F.col("hi") + length).alias("end"))
    whole = written(whole, "suffix-whole")
    variants = written(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("anchor"), "suffix-large")
    marked = distinct.join(variants.withColumn("l", F.lit(True)), "anchor", "left").select(
        F.col("src.rid").alias("rid"), F.struct("anchor", "copies", "src.lo", "src.hi", "src.at", F.coalesce("l", F.lit(False)).alias("large")).alias("x")
    )
    asked = written(marked.groupBy("rid").agg(F.collect_list("x").alias("asked")), "suffix-asked")
    texts = base.join(asked, "rid")
    parts = written(texts.mapInArrow(_cut_parts(length), PARTS), "suffix-parts")
    keys = written(parts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("part")).alias("bytes")).where("n > 1"), "suffix-keys")
    shards = max(1, -(-(keys.where(F.col("n") <= GROUP).agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))
    searched = (
        parts.join(keys.where(F.col("n") <= GROUP).select("key"), "key")
        .withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
        .select("shard", "rid", "start", "part")
        .groupBy("shard")
        .applyInPandas(_search_shard(length), SPANS)
    )
    out = spans.union(whole).union(written(searched, "suffix-searched"))
    if not keys.where(F.col("n") > GROUP).isEmpty():
        hot = parts.join(keys.where(F.col("n") > GROUP).select("key"), "key").select("rid", "start", "part")
        single = written(hot.mapInPandas(_windows(length), "window binary, rid long, start int"), "suffix-windows")
        again = single.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
        out = out.union(single.join(written(again, "suffix-again"), "window").select("rid", F.col("start").alias("begin"), (F.col("start") + length).alias("end")))
    return written(out.select(F.col("rid"), F.col("begin").cast("int"), F.col("end").cast("int")), "suffix-spans")


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, data, spans in zip(batch.column("doc_id").to_pylist(), _buffers(batch.column("data")), batch.column("spans").to_pylist(), strict=True):
            removed = n_spans = 0
            kept = data
            if spans:
                at = cover(len(data), np.array([s["begin"] for s in spans]), np.array([s["end"] for s in spans]))
                removed, n_spans = int(at.sum()), len(runs(at)[0])
                kept = np.frombuffer(data, dtype=np.uint8)[~at].tobytes()
            out.append((doc, len(data), removed, n_spans, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, length: int = 400, k: int = 32) -> DataFrame:
    """Remove each byte of ``docs`` (``doc_id, text``) covered by a ``length``-byte string that also starts
    anywhere else, in the same document too; strings are judged on the input.

    1. Windows are bundled by anchor (see ``anchors``), and bundles meet by the anchor's hash. Windows of
       an anchor that is met once are unique. Where all bundles of an anchor are equal, and where a bundle
       has an equal copy, all its windows are repeated. 2. What is left are bundles that agree in part.
       One of each is cut from its text and dealt into shards, whole anchors together; each shard's suffix
       array is built by induced sorting, and windows whose common prefix with a neighbour in it has
       ``length`` bytes are repeated. 3. The spans go back to their documents.

    An anchor in more than GROUP different bundles (a common line) is divided by the text that
    blocks of its windows share before it comes to a shard, and where that is not enough by whole
    windows, so no shard grows with a common string. Bundles are compared by 128 bits of hash (anchor and
    content), windows in shards byte by byte.

    Null text is empty: 0 bytes, nothing removed. Rows with equal doc_id are documents of their own, so equal
    long rows remove each other wholly. An empty table gives an empty result; other columns are not read.
    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.
    """
    short_batches(docs.sparkSession)
    base = numbered(docs, "suffix-base", F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))
    spans = repeated_spans(base.select("rid", "data"), length, k)
    of_doc = spans.groupBy("rid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return base.join(of_doc, "rid", "left").select("doc_id", "data", "spans").mapInArrow(_without, REMOVED)
