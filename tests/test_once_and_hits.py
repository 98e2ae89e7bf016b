"""The last document of an id counts; glossary keys found by automata, against brute force."""

import random
import re
import time

import pytest

from papyra.operators import curate, search
from papyra.operators.indexing import Index
from papyra.operators.schema import Collection, Config
from papyra.sources import files


def test_last_of_two_folders_with_one_name(spark, tmp_path):
    for root, texts in (("a", {"x.md": "# One\nzebra first\n\n## Two\nzebra\n", "y.md": "# Y\nother\n"}), ("b", {"x.md": "# Last\nzebra zebra\n"})):
        (tmp_path / root).mkdir()
        for name, text in texts.items():
            (tmp_path / root / name).write_text(text)
    index = files.open_index(spark, Config((Collection("docs", f"{tmp_path}/a"), Collection("docs", f"{tmp_path}/b"))))
    assert sorted((r["node_id"], r["title"]) for r in index.nodes.collect()) == [("docs:x:n1", "Last"), ("docs:y:n1", "Y")]
    found = search.search(index, "zebra").collect()
    assert [(r["node_id"], r["rank"]) for r in found] == [("docs:x:n1", 1)] and "zebra zebra" in found[0]["snippet"]
    assert {r["term"]: r["df"] for r in index.vocab.collect()}["zebra"] == 1 and index.n_nodes == 2
    # the document keeps the place of the one it replaces
    assert [r["doc_id"] for r in index.documents.orderBy("doc_ord").collect()] == ["docs:x", "docs:y"]
    again = index.upsert(*[t.unionByName(t.withColumn("doc_ord", t["doc_ord"] + 100)) for t in (index.documents, index.nodes)])
    assert again.n_nodes == 2 and again.documents.count() == 2 and search.search(again, "zebra").count() == 1


def by_regex(keys, text):
    """Keys by one expression each, boundaries as the search for whole words has them."""
    low, out = text.lower(), set()
    for k in keys:
        if len(k) < 2:
            continue
        if re.search(r"\s", k):
            hit = k in low
        elif re.match(r"\A[0-9A-Za-z_]+\Z", k):
            hit = re.search(rf"(?a:\b{re.escape(k)}\b)", low)
        else:
            hit = any((m.start() > 0 and word(low[m.start() - 1])) != word(k[0]) and (m.end() < len(low) and word(low[m.end()])) != word(k[-1]) for m in re.finditer(f"(?={re.escape(k)})", low) for m in [Span(m.start(), m.start() + len(k))])
        if hit:
            out.add(k)
    return out


class Span:
    def __init__(self, a, z):
        self.a, self.z = a, z

    def start(self):
        return self.a

    def end(self):
        return self.z


def word(c):
    return c == "_" or c.isalpha() or c.isdecimal()


def with_keys(spark, keys):
    # no other table of the index is read
    g = spark.createDataFrame([(k, "x", i) for i, k in enumerate(keys)], "key string, expansion string, pos long")
    return Index(g, g, g, g, g, g, g, g, 0, 0)


@pytest.mark.parametrize("size", [2 << 20, 40])
def test_hits_match_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(curate, "AUTOMATON", size)
    rng = random.Random(7)
    letters = ["a", "b", "é", "_", "1", "-", " ", ".", "ü", "c"]
    keys = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))).strip() for _ in range(120)} | {"a b", "c++", "k8s", "über", "no\nbreak"} - {""})
    texts = [(str(i), "".join(rng.choice([*letters, "A", "Ü", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(80)] + [("n", None), ("e", ""), ("z", "C++ k8s, Über no\nbreak")]
    got = {}
    for r in curate.glossary_hits(with_keys(spark, keys), spark.createDataFrame(texts, "qid string, content string")).collect():
        got.setdefault(r["qid"], []).append(r["key"])
    for q, t in texts:
        mine = got.get(q, [])
        assert sorted(mine) == sorted(by_regex(keys, t or "")), (q, t)
    none = curate.glossary_hits(with_keys(spark, ["x"]), spark.createDataFrame(texts, "qid string, content string"))
    assert none.collect() == []


def test_many_keys_and_long_texts_cost_linear_time(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(100_000)]
    texts = [(str(i), " ".join(rng.choice(words) for _ in range(20_000))) for i in range(8)]
    began = time.time()
    rows = curate.glossary_hits(with_keys(spark, sorted(set(words))), spark.createDataFrame(texts, "qid string, content string")).collect()
    took = time.time() - began
    got = {}
    for r in rows:
        got.setdefault(r["qid"], set()).add(r["key"])
    assert all(got[q] == set(t.split()) for q, t in texts) and took < 60
