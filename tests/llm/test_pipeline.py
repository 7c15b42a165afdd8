"""Each stage of the pipeline on its own input."""

import zlib

import corpus_pipeline as cp
from tests.llm.test_jaccard_join import brute
from tests.llm.test_placing import check_packed

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {}
    for name, stage in cp.STAGES:
        rows = docs.collect()
        result = stage(spark, docs, FOLDER)
        if name != "packing":
            assert result.columns == cp.COLUMNS
        out[name] = (rows, result.collect())
        docs = spark.createDataFrame(out[name][1], result.schema)
    before, after = out["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 1").collect()}
    learned = {d for d in toxic if zlib.crc32(str(d).encode()) % 4 != 2}
    kept = {r.doc_id for r in after}
    gone = {r.doc_id for r in before} - kept
    assert kept <= {r.doc_id for r in before} and len(gone - toxic) <= 0.05 * len(before)
    assert len(gone & learned) >= 0.8 * len(learned) > 0  # 9 toxic labels are too few to ask for more
    before, after = out["exact dedup"]
    last = {}
    for r in before:
        key = (r.text or "").encode().lower()
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(last.values())
    before, after = out["near dedup"]
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in brute([(r.doc_id, r.text) for r in before], width=5, least=80)})
    before, after = out["mixing"]
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    words = [sum(len((r.text or "").split()) for r in rows) for rows in (before, after)]
    assert abs(words[1] - words[0]) <= 0.1 * words[0]
    before, after = out["packing"]
    check_packed([(r.doc_id, r.text) for r in before], after, cp.SEQUENCE)


def test_run_and_empty_table(spark):
    assert cp.run(spark, FOLDER).count() > 100
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 0")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
