"""Importance resampling against counts in dictionaries, one text after another."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import importance
from sparkloom.llm.importance import Group, feature_dictionary, groups, importance_resampling, shifted

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return w, w + [" ".join(x) for x in zip(w, w[1:])] + [" ".join(x) for x in zip(w, w[1:], w[2:])]


def slow(docs, target, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    n_s, n_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * n_s / (float(s[b] + 1) * n_t))) for b in range(10000)]
    rows = []
    for d, x in docs:
        w, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in f)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    enough = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(enough) // 100
    return [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(enough)] + [(*r[:4], None) for r in rows if r[4] < least]


def texts(n, seed):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "naïve", "漢字", "x1", "42", "é", "K", "don't", "long" * 40, "z" * 65, "y" * 64] + [f"w{i}" for i in range(60)]
    return ["".join(r.choice(vocabulary) + r.choice([" ", " ", ", ", "\n", "--", "_"]) for _ in range(r.randrange(50))) for _ in range(n)]


@pytest.mark.parametrize("at_once", [7, 64, 1 << 20])
def test_rows(spark, at_once):
    docs = list(enumerate(texts(150, 1))) + [(900, None), (901, ""), (902, "!!"), (None, "a b " * 20), (None, "a b " * 20), (903, "one"), (904, "one two"), (5, "the of a " * 9), (5, "the of a " * 9)]
    target = texts(20, 2) + [None, ""]
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("weight"), F.lit("q").alias("data"), F.lit(3).alias("rank"))
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = [tuple(r) for r in importance_resampling(d, t, percent=30, at_once=at_once).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(slow(docs, target, 30, 20), key=key)


def test_dictionary(spark):
    docs = texts(200, 3) + ["same line of words here\n" * 300, None, ""]
    want = Counter(f for x in docs for f in features(x)[1])
    frame = spark.createDataFrame([(x,) for x in docs], "text string").repartition(5)
    for part_bytes, at_once in ((3 << 20, 1 << 20), (1000, 500), (200, 50)):
        got = feature_dictionary(frame, part_bytes, at_once).collect()
        assert len(got) == len(want) and {r.feature: r.n for r in got} == want


def test_numbered_pairs(monkeypatch):
    """A part with too many words for three numbers in 63 bits."""
    texts_ = [x.encode() for x in texts(80, 4)]
    packed = [x for g in groups(texts_, 300) for x in importance._packed(g, 1)]
    found = []
    for most in (importance.MOST_WORDS, 3):
        monkeypatch.setattr(importance, "MOST_WORDS", most)
        part = importance.Part([n for _, n, _ in packed], [b for _, _, b in packed])
        found.append({b" ".join(part.words[w] for w in f): c for cols, counts in zip(part.columns, part.counts, strict=True) for *f, c in zip(*(x.tolist() for x in cols), counts.tolist(), strict=True)})
    assert found[0] == found[1] == Counter(f.encode() for x in texts(80, 4) for f in features(x)[1])


def test_many_different_words():
    """More words than 16 bits number, and a text cut in pieces."""
    words = b" ".join(b"v%d" % i for i in range(150_000))
    found = list(groups([b"a b", words, b"", b"c"], 40_000))
    assert sum(owns for g in found for _, _, owns in g.pieces) == 150_003 and all(isinstance(g, Group) for g in found)
    assert sum(len(start) for g in found for order, start, _ in g.runs() if order == 3) == 150_000 - 2
    assert {d for g in found for d, _, _ in g.pieces} == {0, 1, 3}


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 66, 1000, 123_457])
def test_joined_hashes(n):
    tail = bytes(random.Random(n).randrange(256) for _ in range(n))
    joined = shifted(np.array([zlib.crc32(b"head")], dtype=np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(tail))
    assert joined[0] == zlib.crc32(b"head" + tail)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance_resampling(none, some).collect() == []
    (r,) = importance_resampling(some, none, percent=100, least_words=1).collect()
    assert (r.n_features, r.rank) == (6, 1)
    rows = [(*map(str, r),) for r in [(1, 6, r.weight, r.score, 1)]]
    assert rows == [tuple(map(str, x)) for x in slow([(1, "a b c")], [], 100, 1)]
