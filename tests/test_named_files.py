"""Files written and read back with their names; failed writes leave nothing."""

import os
import time

import pytest
from pyspark.sql import functions as F

from papyra.sources import files, named


@pytest.fixture(scope="module")
def texts(spark):
    named.register(spark)
    rows = [(f"d{k % 7}/sub{k % 3}/n{k}.md", f"# N{k}\r\n\ttext é {k}\n" * (k % 5)) for k in range(200)] + [("top.md", ""), ("none.md", None), ("sp ace/ü.md", "x"), ("other.txt", "y")]
    return rows


def settled(root):
    """What a failed write has left, once its last tasks have ended."""
    for _ in range(20):
        if not held(root):
            break
        time.sleep(0.5)
    return held(root)


def held(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), newline="", encoding="utf-8").read() for d, _, fs in os.walk(root) for f in fs}


def test_round_trip_keeps_names_and_bytes(spark, texts, tmp_path):
    df = spark.createDataFrame(texts, "file_path string, text string").repartition(6)
    df.write.format("named_files").mode("append").save(f"{tmp_path}/o")
    assert held(f"{tmp_path}/o") == {n: t or "" for n, t in texts}
    read = spark.read.format("named_files").option("glob", "*.md").option("partition_bytes", "400").load(f"{tmp_path}/o")
    assert {(r["file_path"], r["text"]) for r in read.collect()} == {(n, t or "") for n, t in texts if n.endswith(".md")}
    assert read.rdd.getNumPartitions() > 5  # one folder is several tasks' work
    assert spark.read.format("named_files").load(f"file://{tmp_path}/o").where(F.col("file_path") == "top.md").select("file_path").collect()[0][0] == "top.md"
    # append replaces files of one path, overwrite all
    one = spark.createDataFrame([("top.md", "new")], "file_path string, text string")
    one.write.format("named_files").mode("append").save(f"{tmp_path}/o")
    assert held(f"{tmp_path}/o")["top.md"] == "new" and len(held(f"{tmp_path}/o")) == len(texts)
    one.write.format("named_files").mode("overwrite").save(f"{tmp_path}/o")
    assert held(f"{tmp_path}/o") == {"top.md": "new"}


def test_a_failed_write_leaves_nothing(spark, texts, tmp_path):
    good = spark.createDataFrame(texts, "file_path string, text string").repartition(4)
    for bad in ("../out.md", "/abs.md", "", None, "a/../../b.md", "_attempts/x.md"):
        with pytest.raises(Exception):
            good.unionByName(spark.createDataFrame([(bad, "x")], good.schema)).write.format("named_files").mode("append").save(f"{tmp_path}/f")
        assert settled(f"{tmp_path}/f") == {} and not os.path.exists(f"{tmp_path}/out.md")
    with pytest.raises(Exception, match="one path"):
        good.unionByName(good.limit(1)).write.format("named_files").mode("append").save(f"{tmp_path}/f")
    assert settled(f"{tmp_path}/f") == {}
    good.limit(0).write.format("named_files").mode("append").save(f"{tmp_path}/e")
    assert held(f"{tmp_path}/e") == {}


def test_markdown_sink_by_collection(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.md", "# X\n", "one"), ("a/x.md", "# Y\n", "two")], "file_path string, text string, collection string")
    files.write_markdown(rows, f"{tmp_path}/s")
    assert held(f"{tmp_path}/s") == {"one/a/x.md": "# X\n", "two/a/x.md": "# Y\n"}
    files.write_markdown(rows.drop("collection").limit(1), f"{tmp_path}/t")
    assert list(held(f"{tmp_path}/t")) == ["a/x.md"]
