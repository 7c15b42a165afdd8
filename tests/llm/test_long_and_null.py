"""Texts longer than what is worked on at once, and rows without doc_id."""

import hashlib
import random

import numpy as np
import pytest

from sparkloom.llm import anchors
from sparkloom.llm.exact_dedup import exact_dedup
from sparkloom.llm.sharding import shard
from sparkloom.llm.substring_dedup import substring_dedup
from sparkloom.llm.suffix_dedup import suffix_dedup


def windows(found):
    """(document, window, anchor's place, anchor) of all windows of bundles."""
    return {(d, w, a, k) for d, lo, hi, a, k in zip(*(found[c].tolist() for c in ("doc", "lo", "hi", "at", "anchor")), strict=True) for w in range(lo, hi + 1)}


@pytest.mark.parametrize("at_once", [64, 100, 257])
def test_cut_documents_have_the_same_anchors(monkeypatch, at_once):
    rng = np.random.default_rng(at_once)
    docs = [rng.integers(1, 1 << 60, n).astype(np.uint64) for n in (1000, 19, 20, 63, 64, 65, 300)]
    whole = windows(anchors.bundles(docs, 20, 6))
    words = b" ".join(b"w%d" % i for i in rng.integers(0, 99, 500))
    data = np.frombuffer(words, dtype=np.uint8)
    symbols = anchors.word_symbols(data, *anchors.word_bounds(data))
    monkeypatch.setattr(anchors, "AT_ONCE", at_once)
    assert windows(anchors.bundles(docs, 20, 6)) == whole
    assert (anchors.word_symbols(data, *anchors.word_bounds(data)) == symbols).all()


def test_long_copies(spark):
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(150_000))  # over 1 MiB of bytes
    rows = [(1, long), (2, long + " end"), (3, long[:-1] + "#"), (4, long.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id: (x.keep_id, x.group_size) for x in exact_dedup(docs).collect()}
    assert kept == {1: (4, 2), 2: (2, 1), 3: (3, 1), 4: (4, 2)}
    words = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup(docs).collect()}
    assert words == {1: (150_000, 0), 2: (150_001, 150_000), 3: (150_000, 149_999), 4: (150_000, 0)}
    bytes_ = {x.doc_id: (x.n_bytes, x.n_removed) for x in suffix_dedup(docs).collect()}
    n = len(long)
    assert bytes_ == {1: (n, n), 2: (n + 4, n), 3: (n, n - 1), 4: (n, 0)}


def test_rows_without_ids(spark):
    r = random.Random(2)
    long = " ".join(f"x{r.randrange(10**6)}" for _ in range(80))
    rows = [(None, long), (None, long), (None, None), (7, long), (7, "short"), (7, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = sorted((str(x.doc_id), x.n_words, x.n_removed) for x in substring_dedup(docs).collect())
    assert removed == sorted([("None", 80, 0), ("None", 80, 0), ("None", 0, 0), ("7", 80, 0), ("7", 1, 0), ("7", 1, 0)])
    n = len(long)
    removed = sorted((str(x.doc_id), x.n_bytes, x.n_removed) for x in suffix_dedup(docs).collect())
    assert removed == sorted([("None", n, n), ("None", n, n), ("None", 0, 0), ("7", n, n), ("7", 5, 0), ("7", 5, 0)])
    found = exact_dedup(docs).collect()
    assert sorted((str(x.doc_id), str(x.keep_id), x.group_size, x.text_sha256) for x in found) == sorted(
        (str(d), str(7 if t else None), {long: 3, "short": 2, None: 1}[t], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows
    )
    assert shard(docs, shards=3).count() == len(rows)
