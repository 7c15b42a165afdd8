"""Removal of repeated word sequences, by compacting a de Bruijn graph of token k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .anchors import OTHER_BASE, Rolling, bundles, cover, runs, word_bounds, word_symbols
from .common import dropped, likely, numbered, semi, short_batches, small, text_or_empty, written

PATHS = "rid long, doc_id long, lo int, hi int, kmer long, path long"


def _symbols(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, dtype=np.uint8)
    return word_symbols(x, *word_bounds(x))


def _buffers(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in column]


def _path_rows(length: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bundles([_symbols(x) for x in _buffers(batch.column("data"))], length, k)
            of = pa.array(found["doc"])
            cols = [batch.column("rid").take(of), batch.column("doc_id").take(of), *(pa.array(found[c].astype(np.int32)) for c in ("lo", "hi")), pa.array(found["anchor"]), pa.array(found["content"])]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "doc_id", "lo", "hi", "kmer", "path"])

    return rows


READ = "w1 long, w2 long, owner long, first_doc long, at int, digest binary"


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _at_sources(length: int):
    """What stands at source coordinates: a digest of the words of a compacted path (``total`` windows), and two hashes of each window of a branching edge."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        for batch in batches:
            w1, w2, owner, first, at = [none], [none], [none], [none], [none]
            digests: list[tuple[int, bytes]] = []
            for data, asked in zip(_buffers(batch.column("data")), batch.column("asked").to_pylist(), strict=True):
                words = data.split() if any(a["total"] for a in asked) else []  # of bytes: at ASCII white space only
                x = _symbols(data) if any(a["branching"] for a in asked) else none
                for a in asked:
                    if a["total"]:
                        digests.append((a["owner"], _digest(words[a["lo"] : a["lo"] + a["total"] + length - 1])))
                    if a["branching"]:
                        part = x[a["lo"] : a["hi"] + length]
                        n = np.arange(a["hi"] - a["lo"] + 1)
                        w1.append(Rolling(part).of(n, length).view(np.int64))
                        w2.append(Rolling(part, OTHER_BASE).of(n, length).view(np.int64))
                        owner.append(np.full(len(n), a["owner"], dtype=np.int64))
                        first.append(np.full(len(n), a["first_doc"], dtype=np.int64))
                        at.append(n)
            n, m = sum(map(len, at)), len(digests)
            of_windows = [pa.array(np.concatenate(c)) for c in (w1, w2, owner, first)] + [pa.array(np.concatenate(at).astype(np.int32)), pa.nulls(n, pa.binary())]
            of_paths = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([o for o, _ in digests], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array([d for _, d in digests], pa.binary())]
            for cols in (of_windows, of_paths):
                yield pa.RecordBatch.from_arrays(cols, names=["w1", "w2", "owner", "first_doc", "at", "digest"])

    return rows


EDGE = ["kmer", "path"]


def edges_of(shared: DataFrame) -> DataFrame:
    """Distinct edges of ``shared`` (occurrences) with their source, the first and last document that has them, and the edge that follows, and comes
    before, all of their occurrences (null where that is not one and the same)."""
    here = W.partitionBy("rid").orderBy("lo")
    beside = lambda f, touches: F.when(touches(f("lo").over(here), f("hi").over(here)), F.struct(f("kmer").over(here).alias("kmer"), f("path").over(here).alias("path")))
    linked = shared.select("*", beside(F.lead, lambda lo, _: lo == F.col("hi") + 1).alias("next"), beside(F.lag, lambda _, hi: hi == F.col("lo") - 1).alias("prev"))
    n = F.count(F.lit(1))

    def only(side: str) -> list[Column]:
        one = F.count(side) == n
        for c in EDGE:
            one &= F.min(f"{side}.{c}") == F.max(f"{side}.{c}")
        return [F.when(one, F.min(f"{side}.{c}")).alias(f"{side}_{c}") for c in EDGE]

    src = F.min(F.struct("doc_id", "rid", "lo", "hi")).alias("src")
    return linked.groupBy(*EDGE).agg(src, F.max("doc_id").alias("last_doc"), F.first("branching").alias("branching"), *only("next"), *only("prev")).withColumn("owner", F.monotonically_increasing_id())


def compacted(edges: DataFrame) -> DataFrame:
    """Nonbranching paths of ``edges``: the first edge of each (``kmer, path``) and the ``total`` of its windows.

    Two edges are joined where the one always follows the other and the other always comes before it, so that all documents that have one of them run through
    both. Then the sources of both stand side by side in one document, too, and so do those of all edges of a path: a running count of the edges that no join
    has linked to the one before them numbers the paths, however long they are."""
    before = edges.where("next_kmer is not null").select(F.col("kmer").alias("prev_kmer"), F.col("path").alias("prev_path"), F.col("next_kmer").alias("kmer"), F.col("next_path").alias("path"))
    after = edges.where("prev_kmer is not null").select(*EDGE, "prev_kmer", "prev_path")
    inner = before.join(after, [*EDGE, "prev_kmer", "prev_path"]).select(*EDGE, F.lit(True).alias("inner"))
    placed = edges.select(*EDGE, "src.rid", "src.lo", (F.col("src.hi") - F.col("src.lo") + 1).cast("long").alias("windows")).join(inner, EDGE, "left")
    nth = F.count_if(F.col("inner").isNull()).over(W.partitionBy("rid").orderBy("lo").rowsBetween(W.unboundedPreceding, 0))
    first = [F.min_by(c, "lo").alias(c) for c in EDGE]
    return written(placed.withColumn("nth", nth).groupBy("rid", "nth").agg(*first, F.sum("windows").alias("total")).select(*EDGE, "total"), "substring-compacted")


def repeated_spans(base: DataFrame, length: int, k: int) -> DataFrame:
    """Spans (``rid, begin, end, digest`` in words, overlapping) of ``base`` (``rid, doc_id, data``) covered by windows whose
    word sequence starts in a document with a smaller doc_id, too. ``digest`` is that of the words at the source, where a whole path was copied."""
    many = lambda df: F.broadcast(df) if small(df, 200_000) else df
    found = written(base.where("doc_id is not null").mapInArrow(_path_rows(length, k), PATHS), "substring-paths")
    met = (
        found.groupBy("kmer")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min("path").alias("p0"), F.max("path").alias("p1"))
        .where("first_doc < last_doc")
    )
    met = written(met.select("kmer", (F.col("p0") != F.col("p1")).alias("branching")), "substring-met")
    shared = written(likely(found, met, "kmer").join(met, "kmer"), "substring-shared")
    dropped(found, met)
    edges = written(edges_of(shared), "substring-edges")
    repeated = edges.where("src.doc_id < last_doc")
    paths = compacted(repeated)
    one = F.struct("owner", F.col("src.doc_id").alias("first_doc"), "src.lo", "src.hi", F.coalesce("total", F.lit(0)).cast("int").alias("total"), "branching")
    asks = edges.join(many(paths), EDGE, "left").where("branching OR total is not null")
    asked = written(asks.select(F.col("src.rid").alias("rid"), one.alias("x")).groupBy("rid").agg(F.collect_list("x").alias("asked")), "substring-asked")
    texts = semi(base.select("rid", "data"), asked.select("rid"), ["rid"]).join(asked, "rid")
    read = written(texts.mapInArrow(_at_sources(length), READ), "substring-read")
    named = edges.select("owner", *EDGE, F.col("src.doc_id").alias("first_doc"))
    # paths: each later document that enters one runs through the whole of it
    sources = read.where("digest is not null").select("owner", "digest").join(named, "owner").join(many(paths), EDGE)
    sources = written(sources.select(*EDGE, "first_doc", "total", "digest"), "substring-sources")
    copies = shared.join(many(sources), EDGE).where("doc_id > first_doc").select("rid", F.col("lo").alias("begin"), (F.col("lo") + F.col("total") + (length - 1)).alias("end"), "digest")
    copies = written(copies, "substring-copies")
    # branching edges that agree in part: single windows
    windows = read.where("digest is null").drop("digest")
    again = windows.groupBy("w1", "w2").agg(F.min("first_doc").alias("window_doc"), F.max("first_doc").alias("last_doc")).where("window_doc < last_doc").drop("last_doc")
    later = windows.join(written(again, "substring-again"), ["w1", "w2"]).where("first_doc > window_doc").groupBy("owner").agg(F.collect_list("at").alias("ats"))
    later = written(later.join(named, "owner").select(*EDGE, "first_doc", "ats"), "substring-later")
    in_first = shared.join(many(later), EDGE).where("doc_id = first_doc").select("rid", "lo", F.explode("ats").alias("at"))
    rest = in_first.select("rid", (F.col("lo") + F.col("at")).alias("begin"), (F.col("lo") + F.col("at") + length).alias("end"), F.lit(None).cast("binary").alias("digest"))
    spans = written(copies.union(rest).select("rid", F.col("begin").cast("int"), F.col("end").cast("int"), "digest"), "substring-spans")
    dropped(shared, edges, read, copies)
    return spans


REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, data, spans in zip(batch.column("doc_id").to_pylist(), _buffers(batch.column("data")), batch.column("spans").to_pylist(), strict=True):
            words = data.split()  # of bytes: at ASCII white space only
            n = len(words)
            spans = [s for s in spans or () if s["digest"] is None or _digest(words[s["begin"] : s["end"]]) == s["digest"]]
            if spans:
                at = cover(n, np.array([s["begin"] for s in spans]), np.array([s["end"] for s in spans]))
                words = list(compress(words, ~at))
            out.append((doc, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame, length: int = 50, k: int = 16) -> DataFrame:
    """Remove each word of ``docs`` (``doc_id, text``) covered by a window of ``length`` consecutive words whose
    word sequence also starts in a document with a smaller doc_id; windows are judged on the input.

    1. Of the graph's token k-mers, those stay that a window of ``length`` words chooses by hash (see ``anchors``), about one for each 17 words. An edge
       is a k-mer with the words of the windows that chose it; the edges of a document follow each other without gaps. Edges whose
       k-mer is in one document only go. 2. Where one edge always follows another and that one always comes before it,
       the two are joined; a nonbranching path of any length becomes one row (``compacted``). 3. The
       first document that has a path is its source. It is read again at its coordinates, and each later span is removed only if its words
       have the digest of those at the source. 4. Edges that share a k-mer and differ agree in part: their sources are
       read window by window, under two hashes, and windows meet by a shuffle, so a common k-mer never
       gathers its documents in one task.

    Words are runs of bytes without ASCII white space, unchanged. Null text has none. Rows with equal doc_id
    do not remove anything in each other; a null doc_id removes nothing and loses nothing. An empty
    table gives an empty result; other columns are not read.
    Returns ``doc_id, n_words, n_removed, kept_sha256`` (of the kept words joined by one space).
    """
    short_batches(docs.sparkSession)
    base = numbered(docs, "substring-base", F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))
    spans = repeated_spans(base, length, k)
    of_doc = spans.groupBy("rid").agg(F.collect_list(F.struct("begin", "end", "digest")).alias("spans"))
    return base.join(of_doc, "rid", "left").select("doc_id", "data", "spans").mapInArrow(_without, REMOVED)
