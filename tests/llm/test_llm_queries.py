"""The registered queries and the pipeline on the smallest tables."""

import pytest

import corpus_pipeline
from listingloom.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.compare import compare, duckdb_on
from tests.llm.test_text_operators import hits_brute

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_against_sql(spark, name):
    assert compare(duckdb_on(FOLDER), LLM_QUERIES[name](spark, FOLDER), LLM_ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(LLM_QUERIES) - set(LLM_ORACLES) - {"pipeline"}))
def test_whole_table(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = LLM_QUERIES[name](spark, FOLDER).collect()
    if name.startswith("op2"):
        items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
        texts = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 3000]
        want = hits_brute(texts, [(r.item_id, r.text) for r in items.collect()])
        short = {d for d, _ in texts}
        assert {(r.doc_id, r.item_id) for r in rows if r.doc_id in short} == want
    else:
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_stage_by_stage(spark):
    """Each stage keeps the columns and only what its operator keeps."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    here, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in here.collect()}
        here = stage(spark, here, FOLDER)
        assert here.columns == columns
        after = {r.doc_id: r.text for r in here.collect()}
        assert after.items() <= before.items()
        if name == "exact dedup":
            last = {}
            for doc_id, text in sorted(before.items()):
                last[text] = doc_id
            assert set(after) == set(last.values())
        here = spark.createDataFrame([r for r in here.collect()], docs.schema)
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in here.collect()}
    assert len(corpus_pipeline.STAGES) == 5 and LLM_QUERIES["pipeline"](spark, FOLDER).count() == len(packed)
