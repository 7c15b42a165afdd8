"""Removal of repeated word and byte strings, and exact copies, against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest

from sparkloom.llm.exact_dedup import BASES, PRIMES, combine, chunk_hash, exact_dedup, fingerprint
from sparkloom.llm.substring_dedup import substring_dedup
from sparkloom.llm.suffix_dedup import suffix_dedup
from sparkloom.llm.suffixes import repeated, suffix_array

SCHEMA = "doc_id long, text string, rid string, data int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)


def words_brute(rows, n):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def bytes_brute(rows, n):
    seen = defaultdict(int)
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] += 1
    out = []
    for d, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed, n=60, length=40):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["ñ", "日本"]
    passages = [[r.choice(words) for _ in range(r.choice([length - 1, length, length + 3, 3 * length]))] for _ in range(5)]
    rows = []
    for d in range(n):
        text = []
        for _ in range(r.randint(0, 6)):
            text += r.choice(passages) if r.random() < 0.5 else [r.choice(words) for _ in range(r.randint(1, 2 * length))]
        if r.random() < 0.2:
            text += ["a"] * r.randint(length, 3 * length)
        rows.append((d * 3 % n, r.choice([" ", "\n", "  "]).join(text)))
    return rows


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


W = ("doc_id", "n_words", "n_removed", "kept_sha256")
B = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    rows = corpus(seed)
    assert got(substring_dedup(frame(spark, rows), length=20, k=6), *W) == words_brute(rows, 20)


@pytest.mark.parametrize(("seed", "group"), [(3, 1024), (4, 3)])
def test_bytes(spark, monkeypatch, seed, group):
    monkeypatch.setattr("sparkloom.llm.suffix_dedup.GROUP", group)  # a small one sends groups the other ways
    rows = corpus(seed, n=40, length=20)
    assert got(suffix_dedup(frame(spark, rows), length=80, k=16), *B) == bytes_brute(rows, 80)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(substring_dedup(docs), *W) == words_brute(rows, 50)
    assert got(suffix_dedup(docs), *B) == bytes_brute(rows, 400)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a"), (5, long), (5, long), (6, long), (7, long + " end")]
    assert got(substring_dedup(frame(spark, rows)), *W) == words_brute(rows, 50)
    rows = [*rows, (8, "z" * 1200)]
    assert got(suffix_dedup(frame(spark, rows), length=150), *B) == bytes_brute(rows, 150)
    nothing = frame(spark, rows).where("doc_id < 0")
    assert got(substring_dedup(nothing), *W) == got(suffix_dedup(nothing), *B) == got(exact_dedup(nothing), "doc_id") == []


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    import numpy as np

    r = random.Random(seed)
    text = np.array([r.randint(1, r.choice([2, 4, 200])) for _ in range(r.choice([1, 2, 50, 400]))])
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert suffix_array(text, len(text)).tolist() == want


def test_repeated_bytes():
    flags = repeated([b"abcdabcd", b"xbcdx", b"zz"], 3)
    assert [f.tolist() for f in flags] == [[True, True, False, False, True, True], [False, True, False], []]


def test_fingerprints_combine():
    r = random.Random(5)
    data = r.randbytes(5000)
    assert fingerprint(data, chunk=64) == fingerprint(data, chunk=1000)
    import numpy as np

    a, b = np.frombuffer(data[:100], np.uint8), np.frombuffer(data[100:130], np.uint8)
    for base, prime in zip(BASES, PRIMES, strict=True):
        whole = chunk_hash(np.frombuffer(data[:130], np.uint8), base, prime)
        assert combine(chunk_hash(a, base, prime), chunk_hash(b, base, prime), 30, base, prime) == whole


@pytest.mark.parametrize("primes", [PRIMES, (7, 5)])  # tiny primes make collisions, which chunks must tell apart
def test_exact_copies(spark, primes):
    r = random.Random(6)
    rows = [(d, r.choice(["", None, "Ab", "aB", "ä", "Ä", "abc", "bca", "cab", "x" * 300, "X" * 300, "x" * 299 + "y"])) for d in range(80)]
    low = lambda t: (t or "").encode().lower()
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    want = sorted((d, max(groups[low(t)]), len(groups[low(t)]), d == max(groups[low(t)]), hashlib.sha256(low(t)).hexdigest()) for d, t in rows)
    assert got(exact_dedup(frame(spark, rows), primes=primes, chunk=64), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


@pytest.mark.parametrize("seed", range(6))
def test_permuted_common_prefixes(seed):
    import numpy as np

    from sparkloom.llm.suffixes import permuted_common_prefixes

    r = random.Random(seed)
    part = [r.randint(1, 3) for _ in range(90)]
    text = np.array([x for _ in range(5) for x in (part[r.randint(0, 20) :] if r.random() < 0.7 else [r.randint(1, 3) for _ in range(40)])], dtype=np.uint16)
    sa = suffix_array(text, len(text))
    before, shared = permuted_common_prefixes(text, sa, 50)
    for x, y in zip(sa[:-1], sa[1:], strict=True):
        n = 0
        while max(x, y) + n < len(text) and text[x + n] == text[y + n] and n < 50:
            n += 1
        assert before[y] == x and shared[y] == n
    assert before[sa[0]] == -1
