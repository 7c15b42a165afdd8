"""Exact deduplication by composable polynomial fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_worker, short_batches, small, text_or_empty, written

#: Two primes below 2**31 (products of residues fit 64 bits) and a base for each.
PRIMES = (2147483629, 2147483587)
BASES = (1000003, 69069069)
CHUNK = 1 << 16


@lru_cache(maxsize=8)
def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**(n-1), ..., base, 1 modulo prime."""
    out = np.ones(n, dtype=np.int64)
    have = 1
    while have < n:  # doubling
        step = pow(base, have, prime)
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step % prime
        have += more
    return out[::-1].copy()


def chunk_hash(data: np.ndarray, base: int, prime: int, chunk: int = CHUNK) -> int:
    """Polynomial hash of one chunk of at most ``chunk`` bytes; a byte counts as its value plus 1."""
    return int(np.dot(data.astype(np.int64) + 1, _powers(base, prime, chunk)[chunk - len(data) :]) % prime)


def combine(left: int, right: int, right_length: int, base: int, prime: int) -> int:
    """Fingerprint of two joined strings from theirs: the left one is shifted by the right one's length."""
    return (left * pow(base, right_length, prime) + right) % prime


def fingerprint(data: bytes, primes: tuple[int, ...] = PRIMES, chunk: int = CHUNK) -> list[int]:
    """Fingerprint by chunks: a document of any length is hashed and combined piece by piece."""
    whole = np.frombuffer(data, dtype=np.uint8)
    out = []
    for base, prime in zip(BASES, primes, strict=False):
        h = 0
        for at in range(0, len(whole), chunk):
            piece = whole[at : at + chunk]
            h = combine(h, chunk_hash(piece, base, prime, chunk), len(piece), base, prime)
        out.append(h)
    return out


DIGEST = "f1 long, f2 long, n_bytes long, text_sha256 string"


def _digests(primes: tuple[int, ...]):
    @F.arrow_udf(DIGEST)
    def digests(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        free_worker()
        for batch in texts:
            rows = []
            for x in batch:
                data = x.as_buffer().to_pybytes().lower()  # bytes.lower() changes A-Z only
                f = fingerprint(data, primes)
                rows.append((f[0], f[1], len(data), hashlib.sha256(data).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.StructArray.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())],
                names=["f1", "f2", "n_bytes", "text_sha256"],
            )

    return digests


KEY = ["f1", "f2", "n_bytes"]


def _chunks(text: Column, chunk: int) -> Column:
    """Normalised text as an array of (at, part): ASCII letters in lower case, cut every ``chunk`` bytes."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    data = F.translate(text, upper, lower).cast("binary")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(text) - 1, F.lit(0)), F.lit(chunk))
    return F.transform(starts, lambda s: F.struct(s.alias("at"), F.substring(data, s + 1, F.lit(chunk)).alias("part")))


def exact_dedup(docs: DataFrame, primes: tuple[int, ...] = PRIMES, chunk: int = CHUNK, row: str | None = None) -> DataFrame:
    """Classes of equal texts in ``docs`` (``doc_id, text``), equal meaning identical after lower-casing
    A-Z alone; the row with the largest doc_id stays.

    Every text gets a fingerprint (two polynomial hashes combined from chunk hashes, and its length).
    Rows whose fingerprints meet are compared: their texts are cut in chunks, and equal chunks of a
    fingerprint merge before and after the shuffle, so each distinct chunk travels once a task however
    many copies there are. A fingerprint with two different chunks at one place is a collision; its
    rows are told apart by the SHA-256 of their text.

    Null text counts as empty. Rows with a null doc_id can belong to a class but stay only in a class
    that has no other (keep_id null then). Of rows with equal text and equal doc_id all are ``kept`` or
    none. An empty table gives an empty result; further columns are not read.
    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.

    With ``row``, the name of a column of ``docs`` that tells its rows apart in every job, that column is returned too, and of each
    class exactly one row is ``kept``: of those with the largest doc_id, and where all are null of all, the one with the largest ``row``.
    """
    short_batches(docs.sparkSession)
    text = text_or_empty()
    digest = _digests(primes)
    ids = ["doc_id", row] if row else ["doc_id"]
    slim = written(docs.select(*ids, digest(text.cast("binary")).alias("d")).select(*ids, "d.*"), "exact")
    met = written(slim.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY), "exact-met")
    again = docs.select(text.alias("text")).select("text", digest(F.col("text").cast("binary")).alias("d")).select("text", "d.f1", "d.f2", "d.n_bytes")
    few = small(met, 200_000)
    parts = (
        again.join(F.broadcast(met) if few else met, KEY, "left_semi")
        .select(*KEY, F.explode(_chunks(F.col("text"), chunk)).alias("c"))
        .groupBy(*KEY, "c.at", "c.part")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    collided = written(parts.groupBy(*KEY, "at").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").select(*KEY).distinct(), "exact-collided")
    told = F.when(F.col("collided"), F.col("text_sha256")).otherwise(F.lit(""))
    marked = slim
    if collided.isEmpty():
        marked = marked.withColumn("class", F.lit(""))
    else:
        marked = marked.join(collided.withColumn("collided", F.lit(True)), KEY, "left").withColumn("class", F.coalesce(told, F.lit(""))).drop("collided")
    keep_row = [F.max(F.struct(*ids))[row].alias("keep_row")] if row else []  # a null doc_id is the least
    classes = written(marked.groupBy(*KEY, "class").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), *keep_row).where("group_size > 1"), "exact-classes")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    kept = F.col("group_size").isNull() | F.col(row).eqNullSafe(F.col("keep_row")) if row else F.col("doc_id").eqNullSafe(keep_id)
    return marked.join(classes, [*KEY, "class"], "left").select(
        *ids,
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(kept, F.lit(False)).alias("kept"),
        "text_sha256",
    )
