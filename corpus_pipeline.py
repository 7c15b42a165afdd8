"""Cleaning, mixing and packing of a corpus: each stage works on what the one before it kept.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
Rows are decided each, by their place in the file that ``docs`` is read from (or by a number in a written table, if it isn't read from files), so null and repeated doc_ids lose and keep nothing by their id.
Null and empty texts, repeated rows and further columns are handled as the operators say; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import named, small, written
from sparkloom.llm.exact_dedup import exact_dedup
from sparkloom.llm.jaccard_join import jaccard_join
from sparkloom.llm.mixing import mix
from sparkloom.llm.packing import pack
from sparkloom.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SEQUENCE = 2048


def _kept(rows: DataFrame, decided: DataFrame, name: str) -> DataFrame:
    """Rows of ``rows`` (numbered) that ``decided`` (``rid, kept``) keeps: each is decided by its own number, whatever its doc_id. The numbers that go,
    mostly few, are broadcast only when counted to be."""
    gone = written(decided.where("NOT kept").select("rid"), name)
    return rows.join(F.broadcast(gone) if small(gone, 200_000) else gone, "rid", "left_anti").select(*COLUMNS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels that may be learned from, doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs.select(*COLUMNS), labels, threshold=0.3).where("predicted = 0").select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z and a-z, one row with the largest doc_id."""
    rows = named(docs, "pipeline-exact-rows", *COLUMNS)
    return _kept(rows, exact_dedup(rows, row="rid").select("rid", "kept"), "pipeline-exact")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by five-word shingles and a similarity of 0.8, one row with the smallest doc_id."""
    rows = named(docs, "pipeline-near-rows", *COLUMNS)
    return _kept(rows, jaccard_join(rows, width=5, least=80, row="rid").select("rid", "kept"), "pipeline-near")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = named(docs, "pipeline-mixing-rows", *COLUMNS)
    taken = mix(rows, payload=("text", "lang", "n_chars"), row="rid").where("repeats > 0")
    return taken.select("*", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences for training."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier, the shingle join and the tokenizer can't be said in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
