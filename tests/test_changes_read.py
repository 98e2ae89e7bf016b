"""What a change reads doesn't grow with the store; scans rank paths alone."""

from pyspark.sql import functions as F

from papyra.operators import indexing
from papyra.operators.indexing import Index
from papyra.operators.schema import Collection, Config
from papyra.sources import files
from tests.test_blocks import tables


def test_a_change_reads_the_folders_of_its_documents(spark, monkeypatch):
    monkeypatch.setattr(indexing, "NODES_A_FOLD", 8)
    one, read = spark.createDataFrame([("d7",)], "doc_id string"), []
    for n in (40, 400):
        index = Index.build(*tables(spark, n, 5), auto_glossary=False)
        own = index.postings_in(one)
        assert "PartitionFilters" in own._jdf.queryExecution().executedPlan().toString()
        assert own.where("doc_id = 'd7'").count() == index.postings.where("doc_id = 'd7'").count() > 0
        read.append(index.postings.count() / index.folds)  # of a folder, on the average
        assert own.count() < 6 * read[-1]
        files_read = {r[0] for r in own.select(F.input_file_name()).distinct().collect()}
        assert len(files_read) * 4 <= len({r[0] for r in index.postings.select(F.input_file_name()).distinct().collect()})
        # a document that stays the same leaves totals and frequencies alone
        same = index.upsert(index.documents.where("doc_id = 'd7'"), index.nodes.where("doc_id = 'd7'"))
        assert (same.n_nodes, same.n_tokens) == (index.n_nodes, index.n_tokens)
        assert sorted(map(tuple, same.vocab.select("term", "df").collect())) == sorted(map(tuple, index.vocab.select("term", "df").collect()))
    assert index.folds > 100 and read[1] < 2 * read[0]


def test_a_document_with_most_nodes_is_dealt_further(spark):
    docs, nodes = tables(spark, 6, 6)
    big = nodes.where("doc_id = 'd1' AND ord = 0").select(*[c for c in nodes.columns if c not in ("ord", "node_id")], F.explode(F.sequence(F.lit(10), F.lit(300))).alias("ord"))
    nodes = nodes.unionByName(big.withColumn("node_id", F.concat(F.lit("d1:n"), F.col("ord"))).select(*nodes.columns))
    index = Index.build(docs, nodes, auto_glossary=False)
    held = index.postings.where("doc_id = 'd1'").select(F.input_file_name()).distinct().count()
    assert held > 1 and index.postings.select("fold", "doc_id").distinct().groupBy("doc_id").count().where("count > 1").count() == 0
    want = Index.build(docs, nodes, auto_glossary=False).vocab
    assert sorted(map(tuple, index.vocab.collect())) == sorted(map(tuple, want.collect()))


def test_paths_are_ranked_without_texts(spark, tmp_path):
    for name in ("b/x.md", "a/z.md", "a/y.md", "c.md", "code/m.py"):
        p = tmp_path / "r" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"# {name}\n")
    cs = [Collection("src", f"{tmp_path}/r", kind="code"), Collection("docs", f"{tmp_path}/r"), Collection("more", f"{tmp_path}/r/a")]
    rows = files.scan_all(spark, cs)
    got = [(r["collection"], r["file_path"]) for r in rows.orderBy("doc_ord").collect()]
    assert got == [("docs", "c.md"), ("docs", "a/y.md"), ("docs", "a/z.md"), ("docs", "b/x.md"), ("more", "y.md"), ("more", "z.md"), ("src", "code/m.py")]
    assert rows.select("doc_ord").distinct().count() == 7 and "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    index = files.open_index(spark, Config(tuple(cs)))
    assert index.documents.count() == 7
