"""License notices against a search word by word."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.licenses import NOTICES, PHRASES, licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    places = [(i, label) for label, phrase in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def texts():
    r = random.Random(3)
    parts = [p for _, p in PHRASES] + ["GNU General", "Public License", "CC-BY", "cc", "by", "MIT", "license", "of the", "é", "naïve", "Apache", "\n", "under", "KELVIN K"]
    made = [r.choice([" ", ", ", "-"]).join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(120)]
    return made + [None, "", "   \n", "mit", "MIT License", "mit license " * 3000, "word " * 200_000 + "gnu general public license"]


def test_phrases(spark):
    rows = [(i % 50, t) for i, t in enumerate(texts())] + [(None, "CC BY"), (None, None), (7, "Apache License"), (7, "Apache License")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("rid"), F.lit(1).alias("label"), F.lit(2).alias("labels"))
    got = sorted((str(x.doc_id), x.n_words, x.n_base, str(x.first_word), str(x.last_word), x.base_labels) for x in licenses(docs).collect())
    want = [(d, *base(t)) for d, t in rows]
    assert got == sorted((str(d), n, b, str(f), str(last), labels) for d, n, b, f, last, labels in want)
    for x in licenses(docs).collect():
        assert set(filter(None, x.base_labels.split(","))) <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1
        assert x.score == 1 or not x.base_labels


@pytest.mark.parametrize("change", ["none", "case", "insert", "drop"])
def test_notices(spark, change):
    """A notice is found whole, in other case, and with a word put in or left out of a long one; no other label comes with it."""
    r = random.Random(change)
    rows, want = [], {}
    for i, (label, notice) in enumerate(NOTICES):
        words = notice.split()
        if change in ("insert", "drop") and len(words) < 12:
            continue
        at = len(words) // 2
        words = words[:at] + ["oddity"] + words[at:] if change == "insert" else words[:at] + words[at + 1 :] if change == "drop" else words
        text = " ".join(words).upper() if change == "case" else " ".join(words)
        filler = " ".join(f"w{r.randrange(999)}" for _ in range(300))
        rows.append((i, f"{filler}. {text}; {filler}"))
        want[i] = {label} | set(filter(None, base(text)[4].split(",")))
    got = {x.doc_id: (set(x.labels.split(",")), x.score) for x in licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: labels for i, (labels, _) in got.items()} == want
    assert all(s >= 0.75 for _, s in got.values())


def test_near_notices_have_no_label(spark):
    rows = [(1, "gnu lesser general license"), (2, "licensed under cc"), (3, "permission is hereby granted to nobody"), (4, "free of charge to any person"), (5, "all rights reserved")]
    got = {x.doc_id: x.labels for x in licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {""}


def test_empty_table(spark):
    assert licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_are_cut_into_words_once(spark):
    """The number of words comes from the scan for runs: the result's plan cuts no text again. Case outside ASCII stays as it is."""
    rows = [(1, "KELVIN MIT LICENSE"), (2, "ÀPACHE APACHE License Éa"), (3, "İ CC By"), (4, "Apache LICENSE"), (5, ""), (6, None), (7, "one"), (8, "MİT LICENSE K"), (8, "mit LICENſE")]
    found = licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((x.doc_id, x.n_words, x.n_base, str(x.first_word), str(x.last_word), x.base_labels) for x in found.collect())
    want = [(d, *base(t)) for d, t in rows]
    assert got == sorted((d, n, b, str(f), str(last), labels) for d, n, b, f, last, labels in want)
