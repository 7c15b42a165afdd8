"""Operators whose scan is split otherwise in later jobs than in the first, as when an executor goes."""

import pytest

from sparkloom.llm import jaccard_join, substring_dedup, suffix_dedup
from tests.llm.test_jaccard_join import brute
from tests.llm.test_jaccard_join import corpus as near_corpus
from tests.llm.test_removal import bytes_brute, corpus, words_brute

SPLITS = "spark.sql.files.minPartitionNum"
CASES = {
    "op3": (substring_dedup, lambda docs: substring_dedup.substring_dedup(docs, length=40), lambda: corpus(1), lambda rows: words_brute(rows, 40)),
    "op9": (jaccard_join, jaccard_join.jaccard_join, lambda: near_corpus(1), brute),
    "op10": (suffix_dedup, lambda docs: suffix_dedup.suffix_dedup(docs, length=100), lambda: corpus(1), lambda rows: bytes_brute(rows, 100)),
}


@pytest.mark.parametrize("case", CASES)
def test_other_splits_in_later_jobs(spark, monkeypatch, tmp_path, case):
    module, run, rows_of, slow = CASES[case]
    rows = rows_of()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/docs")
    write = module.written

    def written(df, name):
        out = write(df, name)
        spark.conf.set(SPLITS, "64")
        return out

    monkeypatch.setattr(module, "written", written)
    spark.conf.set(SPLITS, "1")
    try:
        got = sorted(tuple(r) for r in run(spark.read.parquet(f"{tmp_path}/docs")).collect())
    finally:
        spark.conf.unset(SPLITS)
    assert got == slow(rows)
