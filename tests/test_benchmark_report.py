"""The report of indexing a folder of sources."""

from pyspark.sql import functions as F

from papyra.operators import evaluate, search
from papyra.operators.schema import Collection
from papyra.sources.files import scan_all


def test_report(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("import os\n\n\nclass Rotator:\n    def turn(self):\n        return 1\n\n    def stop(self):\n        return 'x|y'\n")
    (src / "b.py").write_text("import os\nimport sys\n")
    (src / "c.go").write_text("package m\n\nfunc turn(a int) int {\n\treturn a\n}\n")
    (src / "d.go").write_text("package m\n\nfunc other() {\n}\n")
    b = evaluate.benchmark(scan_all(spark, [Collection("src", str(src), kind="code")]))
    assert b.parse_seconds > 0 and b.load_seconds > 0
    one = evaluate.index_stats(b.index.nodes, b.index.documents).first()
    per = sorted(r["n"] for r in b.index.nodes.groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    assert (one["files"], one["median_nodes"], one["max_nodes"], one["import_only_files"], one["empty_files"]) == (4, per[2], per[-1], 1, 0)
    more = b.index.documents.unionByName(b.index.documents.limit(1).withColumn("doc_id", F.lit("lone")))
    assert evaluate.index_stats(b.index.nodes, more).first()["empty_files"] == 1
    kinds = {r["kind"]: (r["n"], r["files"]) for r in evaluate.kind_table(b.index.documents, b.index.nodes).collect()}
    assert kinds["method"] == (2, 1) and kinds["function"] == (2, 2) and "imports" not in kinds
    queries = spark.createDataFrame([(1, "turn"), (2, "nowhere|found")], "qid int, query string")
    lines = b.lines("src", queries, 2)
    text = [r["text"] for r in lines.orderBy("section", "place").collect()]
    assert text[0] == "# Benchmark: src" and "| Files indexed | 4 |" in text and "| go | 2 |" in text and "| Files with only imports | 1 |" in text
    at = text.index("## Sample files (top 2)")
    assert text[at + 3].startswith("| `a.py` | 4 |") and text[at + 5] == "## Queries"
    want = [f"| turn | {r['score']:.1f} | {r['node_title']} | " for r in search.search(b.index, "turn", 8).collect()]  # the class holds its methods' text
    got = [t for t in text if t.startswith("| turn | ")]
    assert len(want) == 3 and all(t.startswith(w) for t, w in zip(got, want, strict=True)) and not any(t.startswith("| nowhere") for t in text)
    evaluate.write_report(lines, f"{tmp_path}/out", "benchmark.md")
    assert (tmp_path / "out/benchmark.md").read_text() == "\n".join(text) + "\n"
    none = evaluate.benchmark(spark.createDataFrame([], "file_path string, text string, collection string, kind string, modified timestamp, doc_ord long"))
    assert none.lines("none", queries).where("text = '| Files indexed | 0 |'").count() == 1
