"""Rows whose doc_id is null or repeated are decided each, in every stage of the pipeline."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from sparkloom.llm.mixing import mix

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], SCHEMA)


def got(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_toxic_rows(spark, monkeypatch):
    monkeypatch.setattr(cp, "toxicity", lambda docs, labels, threshold: docs.withColumn("predicted", F.col("text").contains("bad").cast("int")))
    rows = [(None, "bad"), (None, "good"), (1, "bad one"), (1, "good one"), (2, "bad"), (3, "good"), (3, "good")]
    assert got(cp.without_toxic(spark, frame(spark, rows), FOLDER)) == Counter([(None, "good"), (1, "good one"), (3, "good"), (3, "good")])


def test_exact_rows(spark):
    rows = [(None, "same"), (None, "same"), (5, "x y"), (5, "x y"), (5, "other"), (7, "Other"), (None, "other"), (5, "unique")]
    assert got(cp.without_copies(spark, frame(spark, rows), FOLDER)) == Counter([(None, "same"), (5, "x y"), (7, "Other"), (5, "unique")])


def test_near_rows(spark):
    r = random.Random(2)
    a, b, c, d = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(None, a), (None, a), (None, f"{a} end"), (3, b), (3, b), (4, f"{b} end"), (None, b), (3, c), (2, f"{c} end"), (None, d), (8, ""), (8, "")]
    after = got(cp.without_near_copies(spark, frame(spark, rows), FOLDER))
    one = [k for k in after if k[0] is None and k[1].startswith(a)]
    assert len(one) == 1 and after.pop(one[0]) == 1
    assert after == Counter([(3, b), (2, f"{c} end"), (None, d), (8, ""), (8, "")])


def test_mixed_and_packed_rows(spark):
    rows = [(None if i % 5 == 0 else i % 7, f"a b c {i % 9}") for i in range(60)]
    docs = frame(spark, rows)
    taken = Counter()
    for r in mix(docs, payload=("text",)).collect():
        taken[(r.doc_id, r.text)] += r.repeats
    assert got(cp.mixed(spark, docs, FOLDER)) == +taken
    pieces = cp.packed(spark, docs, FOLDER).where("piece = 0").collect()
    assert Counter(p.doc_id for p in pieces) == Counter(d for d, _ in rows)


def test_names_of_rows(spark, tmp_path):
    """Rows of files have one name however the files are split; rows of other frames are numbered in a written table."""
    from sparkloom.llm.common import named

    spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("rid"), F.lit("y").alias("file")).repartition(3).write.parquet(f"{tmp_path}/t")
    found = []
    for parts in ("1", "50"):
        spark.conf.set("spark.sql.files.minPartitionNum", parts)
        found.append({r.doc_id: r.rid for r in named(spark.read.parquet(f"{tmp_path}/t"), "names", "doc_id").collect()})
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert found[0] == found[1] and len(set(found[0].values())) == 5000
    other = named(spark.createDataFrame([(1,), (1,)], "doc_id long"), "names", "doc_id")
    assert len({r.rid for r in other.collect()} | {r.rid for r in other.collect()}) == 2
