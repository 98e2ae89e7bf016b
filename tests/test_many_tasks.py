"""Files made of a narrow table, and whole files of a folder, are many tasks' work."""

import pyarrow as pa
import pytest

from papyra.plans import corpora, queries
from papyra.sources import named

SF = "/root/testdata/sf0.001"


def test_parsers_run_in_many_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert corpora.read(spark, SF, "part").rdd.getNumPartitions() == 1 < n
    for name in ("symbols_by_sql", "symbols_by_language", "sections_by_sql"):
        df = queries.QUERIES[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "ArrowEvalPythonUDTF" not in plan, name
    rows = lambda name: sorted(map(tuple, queries.QUERIES[name](spark, SF).collect()), key=str)
    assert rows("symbols_by_sql") == rows("symbols_by_language")


def test_small_files_are_written_read_and_moved_by_many(spark, tmp_path, monkeypatch):
    named.register(spark)
    for k in range(300):
        (tmp_path / "o").mkdir(exist_ok=True)
        (tmp_path / "o" / f"n{k}.md").write_text("x")
    monkeypatch.setattr(named, "FILES", 50)
    parts = named.Reader({"path": f"{tmp_path}/o"}).partitions()
    assert len(parts) >= 6 and sorted(n for p in parts for n in p.names) == sorted(f"n{k}.md" for k in range(300))
    # 300 files by lots of 7 to the place where they belong; a name that two tasks wrote is found
    monkeypatch.setattr(named, "LOT", 7)
    writer = named.Writer({"path": f"{tmp_path}/w"}, False)
    batch = lambda a, z: iter([pa.RecordBatch.from_pydict({"file_path": [f"d{k % 3}/n{k}.md" for k in range(a, z)], "text": [str(k) for k in range(a, z)]})])
    writer.commit([writer.write(batch(0, 200)), None, writer.write(batch(200, 300))])
    assert {p.relative_to(tmp_path / "w").as_posix(): p.read_text() for p in (tmp_path / "w").rglob("*.*")} == {f"d{k % 3}/n{k}.md": str(k) for k in range(300)}
    writer = named.Writer({"path": f"{tmp_path}/t"}, False)
    with pytest.raises(ValueError, match="one path"):
        writer.commit([writer.write(batch(0, 9)), writer.write(batch(8, 12))])
    assert not list((tmp_path / "t").rglob("*.*"))
    # a task that still runs when its write is given up makes no folder anew
    late = writer.write
    with pytest.raises(Exception):
        late(batch(0, 3))
    assert not list((tmp_path / "t").iterdir())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    corpora._kept.clear()
    assert queries.QUERIES["named_files"](spark, SF).count() == corpora.read(spark, SF, "part").where("p_name IS NOT NULL AND p_partkey IS NOT NULL").count() and n > 1
