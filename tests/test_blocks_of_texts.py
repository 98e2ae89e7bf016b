"""Blocks made of texts where they lie against blocks made of postings."""

import pytest
from pyspark.sql import functions as F

from papyra.operators import blocks, indexing, search
from papyra.operators.indexing import Index
from tests.test_blocks import QUERIES, tables


def rows(table):
    return sorted((r["bucket"], r["term"], r["block"], sorted(zip(*r["items"])), r["max_tf"], r["min_length"], r["marks"]) for r in table.collect())


@pytest.mark.parametrize("few, batch", [(0, 2000), (0, 7), (10**9, 7)])
def test_blocks_of_texts_are_those_of_postings(spark, monkeypatch, few, batch):
    monkeypatch.setattr(indexing, "FEW_TOKENS", few)
    index = Index.build(*tables(spark, 130, 5), auto_glossary=False)
    want = rows(blocks.blocks_of(index.numbered_postings, 8, 4))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = rows(indexing.blocks_of_texts(index.nodes, index.documents, 8, 4, index.n_tokens))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want and {m for r in got for *_, m in r[3]} >= {0, 1, 2, 4}


def test_nothing_but_rows_of_blocks_is_exchanged(spark, monkeypatch):
    monkeypatch.setattr(indexing, "FEW_TOKENS", 0)
    dealt, kept = [], blocks._written
    monkeypatch.setattr(blocks, "_written", lambda rows: dealt.append(rows) or kept(rows))
    index = Index.build(*tables(spark, 40, 6), auto_glossary=False)
    found = search.best(index, search.query_terms(index, search.query_frame(spark, QUERIES)), 5)
    assert found.count() and "numbered_postings" not in index.made()
    plan = dealt[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("RepartitionByExpression")[0] and "explode(arrays_zip" not in plan


def test_empty_nodes_and_no_description(spark):
    documents, nodes = tables(spark, 3, 7)
    index = Index.build(documents.withColumn("description", F.lit(None).cast("string")), nodes.withColumns({"content": F.lit(""), "title": F.lit("")}), auto_glossary=False)
    assert index.blocks.count() == 0 == index.vocab.count()


def test_descriptions_too_many_to_broadcast(spark, monkeypatch):
    index = Index.build(*tables(spark, 60, 8), auto_glossary=False)
    want = sorted(map(str, index.postings.drop("fold").collect()))
    monkeypatch.setattr(indexing, "MOST_GONE", 0)
    tokens = indexing.node_tokens(index.nodes, index.documents, 4)
    assert sorted(map(str, indexing.postings_of(tokens).drop("nid", "fold").collect())) == want
