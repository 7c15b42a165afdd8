"""Fill-in-the-middle against cuts found line by line."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.infill import Checkpoints, fill_in_middle, restored

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def slow(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    lines = LINES.findall(text)
    n = len(lines)
    s = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("every,block", [(1, 3), (2, 7), (4, 1 << 20), (64, 50)])
def test_checkpoints(every, block):
    r = random.Random(every)
    for _ in range(60):
        text = "".join(r.choice("aé漢𝄞\n\n x") for _ in range(r.randrange(90)))
        lines = LINES.findall(text)
        index = Checkpoints.count(text.encode(), every, block)
        assert (index.n, index.chars) == (len(lines), len(text))
        assert index.units == list(range(0, text.count("\n") + 1, every))
        for k in range(len(lines) + 1):
            before = "".join(lines[:k])
            assert index.cut(k) == (len(before.encode()), len(before))


def rows():
    r = random.Random(1)
    texts = ["".join(r.choice(["word ", "é", "漢\n", "𝄞", "\n", "<", "<P", ">", "S>", "\r"]) for _ in range(r.randrange(60))) for _ in range(80)]
    texts += [None, "", "\n", "\n\n\n", "no end", "end\n", "a <P> b\nc", "<S>\n<M>", "x\n" * 70_000, "é" * 300_000 + "\nlast"]
    return [(i % 71, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc"), (None, None), (5, "same\nrow"), (5, "same\nrow"), (-3, "a\nb")]


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0)])
def test_rows_against_lines(spark, rate, spm):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").select("*", F.lit("x").alias("n"), F.lit("y").alias("form"), F.lit("z").alias("output"))
    made = fill_in_middle(docs, rate, spm).withColumn("back", restored("output", "form"))
    got = made.collect()
    assert Counter(tuple(x)[:6] for x in got) == Counter(slow(d, t, rate, spm) for d, t in rows())
    assert Counter((x.doc_id, x.back) for x in got) == Counter((d, t or "") for d, t in rows())
    assert {x.form for x in got} >= ({"plain", "spm", "psm"} if spm else {"plain", "psm"})


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
