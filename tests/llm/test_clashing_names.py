"""The stages that drop rows keep every column of theirs, whatever it is called."""

import pytest
from pyspark.sql import functions as F

from listingloom.llm import decontamination, exact_dedup, simhash_trie, toxicity
from listingloom.llm.common import free_names

INTERNAL = [
    "_toxicity", "_text_hash", "_hit_id", "_hit_hash", "_near_id", "_near_hash", "_no_text", "row",
    "key", "root", "fp", "bucket", "chain", "keep_id", "group_size", "leads", "first", "text_hash",
    "score", "n", "size", "toxic", "item_id", "component_id",
]
SENTENCE = "the quick brown fox jumps over the lazy dog near the old river bank today"
ROWS = [
    (1, SENTENCE), (2, SENTENCE), (3, None), (4, ""), (5, "you damned idiot go away"),
    (6, "a calm text about nothing at all and then some more"), (7, "you damned idiot get lost"),
    (8, "benchmark words come here one after the other in a row of ten"), (None, "no id"),
] + [(i, f"harmless text number {i} with words of its own like w{i * 7} and v{i * 13}") for i in range(20, 60)] + [
    (i, f"you damned idiot number {i} x{i * 3}") for i in range(60, 80)
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id LONG, text STRING")
    plain = docs.withColumn("lang", F.lit("en"))
    wide = plain.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in INTERNAL))
    marks = [(i, 1, int("idiot" in (t or ""))) for i, t in ROWS if i]
    labels = spark.createDataFrame(marks, "doc_id LONG, quality INT, toxic INT")
    items = spark.createDataFrame([(1, ROWS[7][1])], "item_id LONG, text STRING")
    return plain, wide, labels, items


STAGES = {
    "toxicity": lambda docs, labels, items: toxicity.drop_toxic(docs, labels),
    "copies": lambda docs, labels, items: exact_dedup.drop_copies(docs),
    "near": lambda docs, labels, items: simhash_trie.drop_near_copies(docs),
    "benchmark": lambda docs, labels, items: decontamination.drop_contaminated(docs, items),
}


@pytest.mark.parametrize("stage", STAGES)
def test_clashing_names(tables, stage):
    plain, wide, labels, items = tables
    want = STAGES[stage](plain, labels, items)
    got = STAGES[stage](wide, labels, items)
    assert got.columns == wide.columns
    kept = sorted((tuple(r) for r in want.select("doc_id", "text").collect()), key=str)
    rows = got.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == kept and 0 < len(kept) < len(ROWS)
    for r in rows:
        own = -1 if r.doc_id is None else r.doc_id
        assert all(r[c] == f"{c}:{own}" for c in INTERNAL)


def test_free_names(spark):
    docs = spark.createDataFrame([], "a INT, B INT, b_ INT")
    assert free_names(docs, "a", "b", "c", "c") == ["a_", "b__", "c", "c_"]
