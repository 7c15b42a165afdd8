import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from sparkloom.llm import common
from sparkloom.llm.jaccard_join import Cells, _assign, _join_regions, _may_be_linked, bucket_counts, components, jaccard_join, overlaps, shingles

SCHEMA = "doc_id long, text string, class string, cell int"


def brute(rows, width=3, least=90):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = min(width, len(words))
        sets.append({b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= least * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(ids[find(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, texts = [], []
    for d in range(n):
        if texts and r.random() < 0.7:
            t = list(r.choice(texts))
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(words) if r.random() < 0.8 else ""
            t = [x for x in t if x] or ["one"]
        else:
            t = [r.choice(words) for _ in range(r.choice([1, 2, 3, 11, 13, 30, 60, 120, 300]))]
        texts.append(t)
        text = " ".join(t)
        rows.append((1000 + d * 7 % n, text.upper() if r.random() < 0.2 else text))
    return rows


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize(("seed", "limit", "pivots"), [(1, 512, 24), (2, 4, 3), (3, 2, 2)])
def test_equals_brute_force(spark, seed, limit, pivots):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    assert got(jaccard_join(df, limit=limit, pivots=pivots)) == brute(rows)


@pytest.mark.parametrize(("seed", "limit", "often"), [(5, 512, 64), (6, 3, 2)])
def test_lower_similarity(spark, seed, limit, often):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    assert got(jaccard_join(df, width=5, least=80, limit=limit, pivots=3, often=often)) == brute(rows, 5, 80)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(jaccard_join(docs)) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "a b"), (8, "ab"), (9, "a b c a b c a b c a b c a b c"), (9, "a b c")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    assert got(jaccard_join(df)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 4), (8, 1, 8), (9, 1, 6), (9, 3, 9)]
    assert got(jaccard_join(df.where("doc_id < 0"))) == []
    null_id = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (None, "q")], "doc_id long, text string")
    assert sorted(jaccard_join(null_id).collect(), key=str) == sorted([(None, 2, 3), (3, 2, 3), (None, 1, None)], key=str)


def test_linked_sets_share_a_cell():
    r = random.Random(4)
    cells = Cells(90)
    import numpy as np

    for _ in range(3000):
        n = r.choice([9, 10, 11, 12, 15, 19, 20, 33, 57, 100, 250])
        a = np.array(r.sample(range(1 << 60), n), dtype=np.uint64) * np.uint64(16)
        out = r.randint(0, n // 10)
        b = np.concatenate([a[out:], np.array(r.sample(range(1 << 60), r.randint(0, n // 10)), dtype=np.uint64) * np.uint64(16) + np.uint64(1)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both) and (len(a) != len(b) or (a != b).any()):
            assert len(np.intersect1d(cells.of(a), cells.of(b)))


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(90, 80), (90, 81), (91, 81), (95, 91), (95, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.member: r.root for r in components(df).collect()}
    assert set(found.values()) == {0} and len(found) == 41 + 5


def test_shingles():
    assert len(shingles(b"a b c d", 3)) == 2
    assert len(shingles(b"", 3)) == 0
    assert (shingles(b"A b", 3) == shingles(b"a   B", 3)).all()


def test_counts_bound_the_distance():
    import numpy as np

    from sparkloom.llm.jaccard_join import bucket_counts

    r = random.Random(7)
    for _ in range(300):
        a = {r.randrange(1 << 62) for _ in range(r.randint(1, 200))}
        b = {x for x in a if r.random() < 0.8} | {r.randrange(1 << 62) for _ in range(r.randint(0, 40))}
        x, y = (np.frombuffer(bucket_counts(np.array(sorted(s), dtype=np.uint64)), dtype=np.uint8).astype(int) for s in (a, b))
        assert abs(x - y).sum() <= len(a ^ b)


def test_near_pairs_lose_no_link():
    import numpy as np

    from sparkloom.llm.jaccard_join import BUCKETS, bucket_counts, near_pairs

    r = random.Random(8)
    for least in (80, 90):
        sets = [{r.randrange(1 << 62) for _ in range(r.randint(5, 300))} for _ in range(12)]
        sets += [{x for x in s if r.random() < 0.93} | {r.randrange(1 << 62) for _ in range(len(s) // 30)} for s in sets for _ in range(2)]
        sets.sort(key=len)
        root = np.array([r.randrange(8) for _ in sets])
        counts = np.stack([np.frombuffer(bucket_counts(np.array(sorted(s), dtype=np.uint64)), dtype=np.uint8) for s in sets])
        assert counts.shape[1] == BUCKETS
        marked = near_pairs(np.array([len(s) for s in sets]), counts, least, root)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if root[i] != root[j] and 100 * len(a & b) >= least * len(a | b):
                    assert marked[i] and marked[j]


def test_overlaps_count_piece_by_piece():
    """Sets that share nearly everything: what is held at once doesn't grow with what they share (36 MB; when whole sets were counted at once, 140 MB)."""
    universe = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 20_200).astype(np.uint64))
    right = [universe[i : i + 20_000] for i in range(60)]
    left = [*right[::7], np.zeros(0, dtype=np.uint64), universe[:1], universe[-50:] + np.uint64(1)]
    tracemalloc.start()
    found = [row for _, counts in overlaps(left, right) for row in counts]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [list(row) for row in found] == [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert most < 80 << 20


def test_region_tasks_give_memory_back(monkeypatch):
    """Workers stay beside the heap of their executor, so each of a region's functions empties its caches at its end."""
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    texts = [b"a b c d e f g h i j", b"a b c d e f g h i j k"]
    rows = pd.DataFrame({"region": [1, 1], "member": [1, 2], "data": texts})
    assert _join_regions(1, 80)(rows).to_numpy().tolist() == [[2, 1]]
    pivots = pd.DataFrame({"region": [1], "pivot": [1], "data": texts[:1]})
    assert _assign(1, 80)(rows, pivots)["star"].tolist() == [1, 1]
    counts = [bucket_counts(shingles(t, 1)) for t in texts]
    near = pd.DataFrame({"region": [1, 1], "member": [1, 2], "hits": [1, 1], "root": [1, 2], "n": [10, 11], "counts": counts})
    assert sorted(_may_be_linked(80)(near)["member"]) == [1, 2]
    assert len(calls) == 3
