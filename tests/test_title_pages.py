"""Pages at any offset from ranges of titles."""

import re

import pytest
from pyspark.sql import functions as F

from papyra.operators import catalog
from papyra.operators.indexing import Index
from papyra.operators.schema import DOCUMENTS, NODES

TITLES = ("a", "B", "é", "Z", None, "same", "same", "same", "Überblick", "ab")


def documents(spark, n):
    rows = [(f"d{k}", k, f"p/{k}.md", TITLES[k % 10], "x" if k % 7 else "odd one", 1, 1, 1, "", ["t"] if k % 3 else [], "", "one" if k % 4 else "two", {"type": ["guide" if k % 5 else "faq"]}, []) for k in range(n)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="module")
def index(spark):
    docs = documents(spark, 300)
    nodes = docs.selectExpr("doc_id", "doc_ord", "0 ord", "concat(doc_id, ':n1') node_id", "title", "1 level", "cast(null as string) parent_id", "'words' content", "'' summary", "1 word_count", "1 line_start", "1 line_end", "cast(null as string) kind", "cast(null as boolean) exported", "array(concat(doc_id, ':n1')) path")
    return Index.build(docs, nodes.to(spark.createDataFrame([], NODES).schema), auto_glossary=False)


def ids(df):
    return [r["doc_id"] for r in df.collect()]


@pytest.mark.parametrize("which", [{}, {"collection": "two"}, {"tag": "T"}, {"filters": {"type": "faq"}}, {"query": "odd"}, {"collection": "none"}])
def test_every_page_is_that_of_a_sort(index, which):
    pages = catalog.TitlePages.build(index.documents, 20)
    found = catalog.matching(index, **which)
    order = ids(found.orderBy(*catalog.by_title()))
    for offset in (0, 7, 55, 170, 299, 1000):
        rows, total = catalog.far_page(index, 30, offset, pages, **which)
        assert total == len(order) and ids(rows) == order[offset : offset + 30]
        assert rows.columns == index.documents.columns


def test_a_title_that_many_share_is_cut(spark):
    docs = documents(spark, 400).withColumn("title", F.lit("same"))
    pages = catalog.TitlePages.build(docs, 50)
    sizes = [r["n"] for r in pages.counts.groupBy("part").agg(F.sum("n").alias("n")).collect()]
    assert sum(sizes) == 400 and max(sizes) < 120


def test_a_page_reads_its_ranges_alone(index, capsys):
    pages = catalog.TitlePages.build(index.documents, 20)
    catalog.far_page(index, 5, 150, pages)[0].explain("formatted")
    opened = re.search(r"PartitionFilters: \[part#\d+ (?:IN \(([\d,]+)\)|= (\d+))|PartitionFilters: \[isnotnull\(part#\d+\), \(part#\d+ = (\d+)\)", capsys.readouterr().out)
    assert opened and len(next(g for g in opened.groups() if g).split(",")) <= 2
    assert pages.rows.select("part").distinct().count() > 10


def test_listing_changes_over_to_ranges(index, monkeypatch):
    near = catalog.list_documents(index, 20, 100)
    monkeypatch.setattr(catalog, "NEAR", 50)
    far = catalog.list_documents(index, 20, 100)
    assert ids(near[0]) == ids(far[0]) and near[1] == far[1] == 300 and "pages" in index._bits
    assert "pages" not in index.remove(["d3"])._bits
    none = catalog.TitlePages.build(index.documents.limit(0))
    rows, total = none.find(none.rows, none.counts.select("part", "n"), 5, 0)
    assert total == 0 and rows.count() == 0
