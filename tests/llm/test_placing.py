"""Packing, mixing, sharding: their laws checked row by row."""

import random
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import packing
from sparkloom.llm.mixing import mix
from sparkloom.llm.packing import WordIds, best_fit, local_search, pack
from sparkloom.llm.sharding import shard

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, size string, target int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, "x", 1) for d, t, s in rows], SCHEMA)


def check_packed(rows, out, size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    want = []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want.append((d, k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


TEXTS = ["Hello, World! It's 2024.", None, "", "  \t", "naïve café Ünïcode 日本語 text", "don't <|endoftext|> stop", "a" * 500, "İstanbul ǅ ß", "x 1234 --- !!"]


@pytest.mark.parametrize("groups", [16_384, 20])
def test_pack(spark, groups):
    r = random.Random(1)
    words = ["alpha", "beta", "don't", "42", "é", "Zug,", "日本", "...", "hyphen-ated"]
    rows = [(d, t) for d, t in enumerate(TEXTS)] + [(100 + d, " ".join(r.choice(words) for _ in range(int(r.expovariate(1 / 40))))) for d in range(150)] + [(7, "again"), (500, "long " * 700)]
    out = pack(frame(spark, [(d, t, "s") for d, t in rows]), PATH, size=128, group_pieces=groups, open_bins=3).collect()
    n = check_packed(rows, out, 128)
    assert n <= -(-sum(x.length for x in out) // 128) + 3


def test_pack_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = pack(docs, PATH).collect()
    assert check_packed(rows, out, 2048) <= 1.01 * sum(r.length for r in out) / 2048 + 1
    assert pack(docs.where("doc_id < 0"), PATH).count() == 0


def test_words_are_tokenized_once(monkeypatch):
    """Ids are those of the tokenizer on whole texts; frequent words aren't tokenized again when others have filled the memory of words."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "REMEMBERED", 40)
    whole, ids, asked = Tokenizer.from_file(PATH), WordIds(PATH), defaultdict(int)
    model = ids.tokenize

    def tokenize(p):
        asked[p] += 1
        return model(p)

    ids.tokenize = tokenize
    often = [f"Often{chr(97 + i)}" for i in range(20)]
    strange = ["", " ", "\x0b\x0c", "\x85 a\xa0b\x1f", " lead trail ", "ÀÉ ſ Ā ĳ İ", "日本 ok 日本", "<|endoftext|> <|ENDOFTEXT|> x<|y", "a\u0301 É", "\x00 \x7f"]
    for k in range(30):
        texts = [" ".join([*often, *(f"rare{chr(97 + k)}{chr(97 + i)}," for i in range(26))]), *strange, *often]
        got, begin = ids(pa.array(texts))
        assert [got[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(asked[w.lower()] == 1 for w in often)
    assert max(asked.values()) == 1
    assert [len(x) for x in ids(pa.array(["", ""]))] == [0, 3] and [len(x) for x in ids(pa.array([], pa.string()))] == [0, 1]


def test_local_search_empties_bins():
    r = random.Random(2)
    for _ in range(30):
        size = 60
        lengths = [r.randint(5, 35) for _ in range(80)]
        before = best_fit(lengths, size)
        after = local_search([list(b) for b in before], lengths, size)
        assert sorted(i for b in after for i in b) == list(range(80))
        assert all(sum(lengths[i] for i in b) <= size for b in after)
        assert len(after) <= len(before)


def test_mix(spark):
    r = random.Random(3)
    rows = [(d, " ".join("w" * r.randint(0, 60)), r.choice(["b", "a", "c", "d", "Z", None, "tiny"] if d % 50 else ["tiny"])) for d in range(600)] + [(601, None, "a"), (602, "", "none"), (3, "x y", "a")]
    out = mix(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes, order = defaultdict(int), sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    free, left, target = set(order), float(sum(sizes.values())), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken, largest = defaultdict(int), defaultdict(int)
    for x in out:
        assert x.source_size == sizes[x.source] and abs(x.target - target[x.source]) < 1e-6
        assert x.taken == x.repeats * x.size <= 3 * x.size
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    again = mix(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mix(frame(spark, rows).where("doc_id < 0")).count() == 0


def test_mix_without_ids(spark):
    r = random.Random(4)
    rows = [(None, " ".join("w" * r.randint(1, 30)) + f" {r.randrange(50)}", r.choice("abc")) for _ in range(900)] + [(5, "same words here", "a")] * 200
    out = mix(frame(spark, rows)).collect()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for x in out:
        taken[x.source] += x.taken
        target[x.source] = x.target
        largest[x.source] = max(largest[x.source], x.size)
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    again = mix(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def least_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, n, fill = (lo + hi) // 2, 1, 0
        for s in sizes:
            n, fill = (n, fill + s) if fill + s <= mid else (n + 1, s)
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize(("n", "shards"), [(900, 24), (30, 24), (3, 5), (0, 24)])
def test_shard(spark, n, shards):
    r = random.Random(n)
    texts = ["é" * r.randint(0, 200) + str(k) for k in range(max(1, n // 3))] + [None, "", "hot"]
    rows = [(d, "hot" if r.random() < 0.2 else r.choice(texts), "s") for d in range(n)]
    out = shard(frame(spark, rows), shards=shards, slices=64).collect()
    text = dict((d, t) for d, t, _ in rows)
    assert sorted(x.doc_id for x in out) == list(range(n))
    slots, total, of_text = defaultdict(list), defaultdict(int), {}
    for x in out:
        data = (text[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        assert 0 <= x.shard < shards and of_text.setdefault(data, x.shard) == x.shard
        slots[x.shard].append(x.slot)
        total[x.shard] += x.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if n:
        groups = defaultdict(int)
        for d, t, _ in rows:
            groups[t or ""] += len((t or "").encode()) + 8
        assert max(total.values()) <= sum(total.values()) / shards + 2 * max(groups.values())


def test_shard_capacity_is_least(spark):
    from sparkloom.llm.sharding import cut_points, smallest_capacity

    r = random.Random(5)
    cases = [([r.randint(1, 50) for _ in range(r.randint(1, 60))], k) for k in (1, 2, 5, 9)]
    for sizes, k in cases:
        row = spark.createDataFrame([(sizes,)], "s array<long>").withColumn("c", smallest_capacity(F.col("s"), k)).withColumn("cuts", cut_points(F.col("s"), F.col("c"))).first()
        assert row.c == least_capacity(sizes, k) and len(row.cuts) <= k - 1 + (0 in row.cuts)
