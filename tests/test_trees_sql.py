"""Paths written with nodes, trees without self-joins, parsers as table functions in SQL."""

import random

from pyspark.sql import functions as F

from papyra.operators import tree
from papyra.operators.code import udtf
from papyra.plans import corpora


def test_paths_are_the_chains_of_parents(spark):
    rng = random.Random(3)
    rows = [(f"d{d}", k, f"d{d}:{k}", rng.randint(0, 6)) for d in range(12) for k in range(rng.randint(0, 25))]
    nodes = tree.with_parents(spark.createDataFrame(rows, "doc_id string, ord int, node_id string, level int"))
    up = {r["node_id"]: r["parent_id"] for r in nodes.collect()}
    for r in nodes.collect():
        want = [r["node_id"]]
        while up[want[-1]] is not None:
            want.append(up[want[-1]])
        assert r["path"] == want
    # with the path the same pairs as by joins, and no join among nodes
    by_path, by_joins = tree.ancestors(nodes), tree.ancestors(nodes.drop("path"))
    assert sorted(map(tuple, by_path.collect())) == sorted(map(tuple, by_joins.collect()))
    assert "Join" not in by_path._jdf.queryExecution().optimizedPlan().toString()
    wanted = nodes.where("ord % 3 = 0").select("doc_id", F.col("node_id").alias("root"))
    pick = lambda df: sorted((r["root"], r["node_id"], r["depth"]) for r in df.collect())
    assert pick(tree.subtrees(nodes, wanted)) == pick(tree.subtrees(nodes.drop("path"), wanted))
    assert tree.subtrees(nodes, wanted)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_subtree_of_one_node_is_a_predicate(spark):
    index = corpora.geo_index(spark, "/root/testdata/sf0.001")
    got = tree.subtree(index, "geo:2", "geo:2:-1:-1")
    rows = got.collect()
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and rows[0]["node_id"] == "geo:2:-1:-1" and rows[0]["depth"] == 0
    assert [r["node_id"] for r in rows] == [r["node_id"] for r in tree.subtrees(index.nodes, spark.createDataFrame([("geo:2", "geo:2:-1:-1")], "doc_id string, root string")).orderBy("depth", "ord").collect()]


def test_table_functions_of_odd_texts(spark):
    udtf.register(spark)
    spark.createDataFrame([("a.py", "def f():\n    pass\n"), ("b.py", None), (None, "x"), ("c.md", "# One\ntext\n\nTwo\n---\nmore")], "path string, text string").createOrReplaceTempView("odd_texts")
    got = spark.sql("SELECT t.path, s.name, s.kind FROM odd_texts t, LATERAL code_symbols(t.path, t.text) s WHERE t.path = 'a.py' OR t.text IS NULL OR t.path IS NULL").collect()
    assert [tuple(r) for r in got] == [("a.py", "f", "function")]
    got = spark.sql("SELECT s.ord, s.level, s.title, s.content FROM odd_texts t, LATERAL markdown_sections(t.text) s WHERE t.path = 'c.md' ORDER BY 1").collect()
    assert [tuple(r) for r in got] == [(0, 1, "One", "text"), (1, 2, "Two", "more")]
