"""Neighbours against brute force; toxicity and main text by held-out accuracy."""

import random

import numpy as np
import pytest

from sparkloom.llm.html_text import Field, blocks, extract, labelled_pages, trained_field
from sparkloom.llm.neighbours import neighbours
from sparkloom.llm.toxicity import INPUTS, WIDTH, Network, tokens, toxicity


def brute(rows, queries, k):
    dims = [len(v) for _, v in rows if v is not None]
    dim = max(set(dims), key=dims.count)
    usable = {i: np.array(v, dtype=np.float64) for i, v in rows if v is not None and len(v) == dim and None not in v}
    usable = {i: v for i, v in usable.items() if np.isfinite(v).all() and v.any()}
    out = {}
    for q in queries:
        if q in usable:
            best = sorted((-float((v * usable[q]).sum()), i) for i, v in usable.items() if i != q)[:k]
            out[q] = best
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[5][1]) for i in range(100)]  # copies of one vector
    rows += [(4000, None), (4020, [0.0] * 16), (4040, [float("nan")] * 16), (4060, [None, *[1.0] * 15]), (4080, [1.0]), (4100, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours(df, df.vec_id % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, range(0, 4200, 20), 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 2.0]), (21, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours(df, df.vec_id % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 21, 1.0), (0, 2, 20, 0.0), (20, 1, 21, 2.0), (20, 2, 0, 0.0)]
    assert neighbours(df.where("vec_id < 0"), df.vec_id % 20 == 0).count() == 0
    assert neighbours(df.where("vec_id = 0"), df.vec_id % 20 == 0).count() == 0


def test_network_gradients():
    rng = np.random.default_rng(2)
    net = Network(hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    inputs, index = rng.standard_normal((9, INPUTS)), rng.integers(0, 9, (6, 4))
    mask = np.arange(6)[:, None] < np.array([6, 3, 1, 5])
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        z = net.logits(inputs, index, mask)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grads = net.gradients(inputs, index, mask, y)
    of_inputs = grads.pop("inputs")
    for i, j in ((0, 0), (4, WIDTH), (8, INPUTS - 1)):
        keep = inputs[i, j]
        inputs[i, j] = keep + 1e-3
        up = loss()
        inputs[i, j] = keep - 1e-3
        down = loss()
        inputs[i, j] = keep
        assert abs((up - down) / 2e-3 - of_inputs[i, j]) < 1e-3
    for name, g in grads.items():
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-3
        up = loss()
        net.p[name][at] = keep - 1e-3
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / 2e-3 - g[at]) < 1e-3, name


def test_vectors_of_forms_and_their_gradients():
    rng = np.random.default_rng(3)
    net = Network(hidden=3)
    t = tokens([b"some words, and some longer ones", b"x"])
    evidence, way = rng.standard_normal(len(t.words)), rng.standard_normal((len(t.words), INPUTS)).astype(np.float32)
    grads = net.vector_gradients(t, way)
    before = float((net.inputs(t, evidence) * way).sum())
    for name in ("words", "grams"):
        row = int(np.flatnonzero(np.abs(grads[name]).sum(axis=1))[1])
        net.p[name][row, 2] += 1.0
        assert abs(float((net.inputs(t, evidence) * way).sum()) - before - grads[name][row, 2]) < 1e-4
        net.p[name][row, 2] -= 1.0
    assert np.allclose(net.inputs(t, evidence)[:, -1], evidence)


def area(scores, labels):
    ranked = sorted(range(len(scores)), key=lambda i: scores[i])
    below = won = 0
    for i in ranked:
        won, below = (won + below, below) if labels[i] else (won, below + 1)
    return won / (below * (len(labels) - below))


def test_toxicity_from_few_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").select("held_out", "score", "toxic").collect()
    for held_out, least in ((False, 0.9), (True, 0.8)):
        part = [(r.score, r.toxic) for r in rows if r.held_out == held_out]
        assert area(*zip(*part, strict=True)) > least


def test_repeated_ids_are_learned_from_once(spark):
    rows = [(i, ("vile awful " if i % 2 else "calm day ") * 9) for i in range(40)] + [(1, "vile awful " * 9)] * 300 + [(None, "vile")] * 3
    labels = spark.createDataFrame([(i, 50, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert toxicity(docs, labels).count() == 343


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert len(toxic) > 50 and sum(r.predicted for r in toxic) / len(toxic) >= 0.9
    assert sum(r.predicted for r in clean) / len(clean) <= 0.05
    assert scored.where("score < 0 OR score > 1 OR score is null").count() == 0


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, 50, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    filler = random.Random(1)
    text = lambda i: " ".join(filler.choice("abcdefghij") * filler.randint(1, 6) for _ in range(30)) + (" vile awful" if i % 2 else " calm day")
    rows = [(i, text(i)) for i in range(40)] + [(50, None), (51, ""), (52, "..."), (53, "vile awful " * 5000), (None, "calm")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert got[50].score == got[51].score == got[52].score == 0 and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values()) and got[53].predicted == 1
    assert toxicity(docs.where("doc_id < 0"), labels).count() == 0
    one = toxicity(docs, labels.where("toxic = 0")).collect()
    assert {r.predicted for r in one} == {0}


def test_field_decodes_the_likeliest_path():
    r = random.Random(3)
    field = trained_field(60, seed=2)
    for page, _ in labelled_pages(20, seed=9):
        page = page[: r.randint(1, 7)]
        unary = [sum(field.weight[x] for x in f) for f in field.features(page)]

        def value(labels, unary=unary):
            return field.start[labels[0]] + sum(u[b] for u, b in zip(unary, labels, strict=True)) + sum(field.step[a, b] for a, b in zip(labels, labels[1:], strict=False))

        n = len(page)
        best = max(([(k >> i) & 1 for i in range(n)] for k in range(1 << n)), key=value)
        assert abs(value(best) - value(field.decode(page))) < 1e-9


def test_field_on_other_pages():
    field = trained_field()
    right = total = 0
    for page, labels in labelled_pages(100, seed=77):
        found = field.decode(page)
        right += sum(a == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total >= 0.97


def test_extract(spark):
    page = "<html><head><title>T</title><script>x<y</script></head><body><nav><a href=/>Home</a> <a href=/a>About</a></nav><article><h1>A title &amp; more</h1><p>The first\n paragraph, with <b>bold</b> words and a long sentence.<p>Another paragraph &#233;nds here, after some more words.</article><footer>&copy; 2024 Someone. All rights reserved.</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page), (4, "w", "<p>" * 3000 + "<!-- open")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract(df).collect())
    text = "A title & more The first paragraph, with bold words and a long sentence. Another paragraph énds here, after some more words."
    assert got == [(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (4, "", 0)]
    assert extract(df.where("page_id < 0")).count() == 0


@pytest.mark.parametrize("page", ["<", "<a", "</", "a < b", "<p", "&amp;&#x41;&bogus;", "<script>", "<textarea>x", '<div class="x', "<![CDATA[ x", "\0<p>\ud800".encode("utf8", "replace").decode()])
def test_blocks_of_broken_pages(page):
    assert isinstance(blocks(page), list) and isinstance(Field().text(page), str)
