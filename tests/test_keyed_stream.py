"""A followed folder whose changes are told from keyed state."""

from papyra.operators import search
from papyra.operators.indexing import Index
from papyra.operators.schema import Collection
from papyra.sources import files
from papyra.streaming import upsert
from papyra.streaming.upsert import LiveIndex, follow


def test_only_changed_files_come_and_documents_are_read_once(spark, tmp_path, monkeypatch):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.md").write_text("# A\nzebra one\n")
    (root / "b.md").write_text("# B\nzebra two\n")
    index = Index.build(*files.documents_and_nodes(files.scan_all(spark, [Collection("docs", str(root))])), auto_glossary=False)
    live, put, reads = LiveIndex(index), [], []
    own, manifest = LiveIndex.put, upsert.read_manifest
    monkeypatch.setattr(LiveIndex, "put", lambda self, new: (put.append(sorted(r["file_path"] for r in new.collect())), own(self, new))[1])
    monkeypatch.setattr(upsert, "read_manifest", lambda i: (reads.append(1), manifest(i))[1])

    def step():
        q = follow(live, Collection("docs", str(root)), f"{tmp_path}/state", keyed=True)
        assert q.awaitTermination(120) and q.exception() is None

    step()  # the index has both already
    (root / "c.md").write_text("# C\nzebra three\n")
    step()
    (root / "sub").mkdir()
    (root / "sub/b.md").write_text("# B2\nzebra four\n")
    (root / "a2.md").write_text("# A\nzebra one\n")
    step()
    assert put[0] == [] and put[1] == ["c.md"] and put[2] == ["a2.md", "sub/b.md"] and len(reads) == 1
    found = {r["doc_id"] for r in search.search(live.index, "zebra").collect()}
    assert found == {"docs:a", "docs:b", "docs:c", "docs:a2", "docs:sub:b"}
    orders = [r["doc_ord"] for r in live.index.documents.collect()]
    assert len(set(orders)) == len(orders) == 5


def test_state_of_a_path_keeps_its_last_text():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, x):
            self.exists, self.get = True, x

    s = State()

    def step(*texts):
        rows = [pd.DataFrame({"file_path": ["p"], "collection": ["c"], "kind": ["md"], "text": [t], "modified": [pd.Timestamp(k, unit="s")]}) for k, t in enumerate(texts)]
        return [r for d in upsert._if_changed(("c", "p"), iter(rows), s) for r in d["text"]]

    assert step("x") == ["x"] and step("x") == [] and step("y", "z") == ["z"] and step("y", "z") == [] and step("x") == ["x"] and step(None) == [None] and step("") == []
