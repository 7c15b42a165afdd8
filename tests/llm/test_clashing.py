"""Further columns, named as the operators name their own, change nothing; texts above 1 MiB are read whole."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sparkloom.llm.exact_dedup import exact_dedup
from sparkloom.llm.html_text import extract
from sparkloom.llm.importance import importance_resampling
from sparkloom.llm.infill import fill_in_middle
from sparkloom.llm.licenses import licenses
from sparkloom.llm.mixing import mix
from sparkloom.llm.neighbours import neighbours
from sparkloom.llm.packing import pack
from sparkloom.llm.sharding import shard

CLASHES = ["rid", "row", "kept", "size", "at", "cell", "h", "w", "n", "k", "score", "rank", "label", "weight", "text_crc32", "hash", "part", "_row", "uid", "leaf", "repeats", "length"]
TOKENS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df):
    """``df`` with further columns, of other types than the operators' own."""
    return df.select("*", *[F.array(F.lit(f"no {c}")).alias(c) for c in CLASHES])


def bag(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    words = [f"w{n}" for n in range(400)]
    texts = [" ".join(r.choices(words, k=r.randrange(1, 60))) for _ in range(30)]
    texts += [texts[0], texts[1].upper(), texts[2] + " end", "released under the mit license\nsecond line", "", None]
    return spark.createDataFrame([(n, t, "en", "ab"[n % 2], len(t or "")) for n, t in enumerate(texts)], SCHEMA)


OPERATORS = {
    "pack": lambda df: pack(df, TOKENS, size=64),
    "mix": mix,
    "shard": lambda df: shard(df, shards=3),
    "exact": exact_dedup,
    "importance": lambda df: importance_resampling(df, df.where("doc_id < 3").withColumnRenamed("doc_id", "item_id"), buckets=100, percent=20, least_words=5, seed=42),
    "infill": lambda df: fill_in_middle(df, rate=100, spm=50, seed=7),
    "licenses": licenses,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns(docs, name):
    run = OPERATORS[name]
    plain = run(docs)
    columns = [c for c in plain.columns if c != "sequence_id"]  # any numbers
    assert bag(run(clashing(docs)).select(*columns)) == bag(plain.select(*columns))


def test_columns_of_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "u", "<body><nav>menu</nav><article><p>One long sentence of an article, with many words in it.</p></article></body>"), (2, None, None)], "page_id long, url string, html string")
    assert bag(extract(clashing(pages).withColumn("text", F.lit("no"))).select("page_id", "url", "text", "n_chars")) == bag(extract(pages))
    r = random.Random(5)
    rows = spark.createDataFrame([(n, [r.gauss(0, 1) for _ in range(6)]) for n in range(120)], "vec_id long, embedding array<double>")
    query = F.col("vec_id") % 20 == 0
    assert bag(neighbours(clashing(rows), query, k=5)) == bag(neighbours(rows, query, k=5))


@pytest.mark.parametrize("stage", [cp.without_copies, cp.without_near_copies, cp.mixed])
def test_columns_of_stages(spark, docs, stage):
    out = stage(spark, clashing(docs), "")
    assert out.columns == cp.COLUMNS and bag(out) == bag(stage(spark, docs, ""))


def test_long_texts(spark):
    """Two texts of some 2 MB that differ in their last letter only."""
    body = "ab cd\n" * 350_000
    docs = spark.createDataFrame([(1, body + "x", "en", "a", 0), (2, body + "X", "en", "a", 0), (3, body + "y", "en", "a", 0)], SCHEMA)
    assert {(r.doc_id, r.keep_id) for r in exact_dedup(docs).collect()} == {(1, 2), (2, 2), (3, 3)}
    assert {(r.size) for r in mix(docs).collect()} == {700_001}
    assert {r["size"] for r in shard(docs, shards=2).collect()} == {len(body) + 9}
    pieces = pack(docs, TOKENS).groupBy("doc_id").agg(F.sum("length").alias("ids"), F.max(F.col("start") + F.col("length")).alias("end")).collect()
    assert len(pieces) == 3 and all(p.ids == p.end > 700_000 for p in pieces)
    made = fill_in_middle(docs, rate=100, spm=50, seed=7).select("n", F.length("output").alias("size")).collect()
    assert {(m.n, m["size"]) for m in made} == {(350_001, len(body) + 10)}
