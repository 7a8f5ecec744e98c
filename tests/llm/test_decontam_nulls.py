"""Benchmark items without an id contaminate like any other."""

import pytest
from pyspark.sql import functions as F

from treeloom.llm import decontam

PASSAGE = " ".join(f"token{k}" for k in range(20))
OTHER = "seven plain words make one short item"


def tables(spark, items, docs):
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumns({"_it": F.lit(1), "doc_id": F.lit(5)})
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")), benchmark


DOCS = [(1, f"before {PASSAGE} after"), (2, PASSAGE), (3, "clean text of no benchmark at all"), (4, f"say {OTHER} again"), (None, PASSAGE), (2, PASSAGE)]


@pytest.mark.parametrize("broadcast_mb", [32, 0])
def test_null_item_ids(spark, monkeypatch, broadcast_mb):
    monkeypatch.setattr(decontam, "BROADCAST_MB", broadcast_mb)
    alone = [(None, PASSAGE)]
    docs, benchmark = tables(spark, alone, DOCS)
    got = sorted((tuple(r) for r in decontam.contaminated(docs, benchmark).collect()), key=str)
    assert got == sorted([(1, None, 20, 20, 1), (2, None, 20, 20, 0), (None, None, 20, 20, 0)], key=str)
    assert sorted(r["doc_id"] for r in decontam.clean_documents(docs, benchmark).collect()) == [3, 4]


def test_null_beside_others_and_repeated(spark):
    items = [(None, PASSAGE), (None, PASSAGE), (None, OTHER), (7, PASSAGE), (8, "nothing that any document holds in its text"), (None, None), (9, None)]
    docs, benchmark = tables(spark, items, DOCS)
    got = {(r["doc_id"], r["item_id"], r["matched_tokens"]) for r in decontam.contaminated(docs, benchmark).collect()}
    assert got == {(1, None, 20), (1, 7, 20), (2, None, 20), (2, 7, 20), (None, None, 20), (None, 7, 20), (4, None, 7)}
    clean = decontam.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert [r["doc_id"] for r in clean.collect()] == [3]
