"""Tables of entries: checks and texts against those of one entry, drafts, and writing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from papyra.operators import curate, entries, search
from papyra.operators.schema import Collection, Config
from papyra.sources import files

PATHS = [
    "a.md", "a/b.md", "./a//b.md", "a/../b.md", "../b.md", "a/../../b.md", "/b.md", "C:/b.md", "c:\\b.md", "b.txt", "", None, " ", "b.MD", "../docs/b.md", "../docsx/b.md", "..md", ".md",
    "a/..md", "../../root/docs/x.md", "../../../../../root/docs/x.md", "x/../../docs/é.md", "a b/c d.md", "..", "../docs", "a/.md/../x.md",
]
METAS = [
    {"title": "T"}, {}, {"a": None, "b": True, "c": False}, {"n": 1, "x": 2.5, "w": 2.0, "neg": -3}, {"l": ["a", " b ", 1, 2.0], "e": []}, {"q": 'say "x"', "s": "it's", "h": "a#b", "br": "[x", "cl": "]x", "in": "a[b"},
    {"l": ['q"x', "#h"]}, {"a b": 1}, {"_a": 1}, {"ä": 1}, {"1a": 1}, {"": 1}, {"a": "x\ny"}, {"a": "x\ry"}, {"a": ["x\ny"]}, {"a": [True]}, {"a": [None]}, {"a": [[1]]}, {"a": {"b": 1}}, {"a-b_c9": "ü"}, [], ["x"], "x", 1, None,
]


@pytest.mark.parametrize("root", ["/root/docs", "/docs", "/"])
def test_paths_as_of_one_entry(spark, root):
    df = spark.createDataFrame([(k, p) for k, p in enumerate(PATHS)], "k int, path string")
    got = {r["k"]: (r["code"], r["clean"]) for r in df.select("k", entries.path_code(F.col("path"), root).alias("code"), entries.clean_path(F.col("path"), root).alias("clean")).collect()}
    for k, p in enumerate(PATHS):
        if root == "/":  # nothing leads out of it
            assert got[k][0] in (None, "PATH_INVALID") and (got[k][0] is None) == bool(p and p.endswith(".md") and not p.startswith("/") and p[1:2] != ":")
            continue
        try:
            full = curate.validate_path(root, p)
        except curate.CuratorError as e:
            assert got[k][0] == e.code, p
        else:
            assert got[k] == (None, os.path.relpath(full, root)), p


def test_frontmatter_as_of_one_entry(spark):
    raw = [json.dumps(m) for m in METAS] + ["", "{", "{}x", '{"a":1', None, " {} ", '{"a":"\\u2028x"}']
    df = spark.createDataFrame([(k, m, f"body {k}\n \t\n") for k, m in enumerate(raw)], "k int, meta string, body string")
    rows = df.select("k", entries.meta_code(F.col("meta")).alias("code"), entries.serialized(F.col("meta"), F.col("body")).alias("text")).collect()
    for r in rows:
        try:
            meta = json.loads(raw[r["k"]] or "")
            curate.validate_frontmatter(meta)
        except (ValueError, curate.CuratorError):
            assert r["code"] == "FRONTMATTER_INVALID", raw[r["k"]]
        else:
            assert r["code"] is None and r["text"] == curate.serialize(meta, f"body {r['k']}\n \t\n"), raw[r["k"]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("entries") / "docs"
    for name, text in (("runbooks/rotate.md", "---\ntags: [keys, ops]\ncategory: runbook\n---\n# Rotate\nSigning keys rotate every ninety days. TLS (Transport Layer Security) is required.\n"), ("notes.md", "# Notes\nplain words about clusters\n")):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    return str(base), files.open_index(spark, Config((Collection("docs", str(base)),)))


SAME = "Signing keys rotate every ninety days, TLS required"


def test_drafts(spark, index):
    root, i = index
    topics = [("1", "Key rotation", SAME, None, "https://x"), ("2", "other-thing", "qwertz zuiop", "guides/../guides/o.md", None), ("3", "bad", "x", "../out.md", None), ("4", "", None, None, None)]
    got = {r["qid"]: r for r in entries.draft_batch(i, spark.createDataFrame(topics, "qid string, topic string, content string, suggested_path string, source_url string"), root).collect()}
    one = curate.draft(i, "Key rotation", SAME, source_url="https://x")
    a = got["1"]
    assert (a["suggested_path"], a["title"], a["category"], a["tags"], a["glossary_hits"], a["source_url"]) == ("key-rotation.md", one["frontmatter"]["title"], "runbook", ["keys", "ops"], one["glossary_hits"], "https://x")
    assert a["glossary_hits"] == ["tls"] and a["duplicate_warning"].asDict() == one["duplicate_warning"] and [b.asDict() for b in a["backlinks"]] == one["backlinks"]
    assert (got["2"]["suggested_path"], got["2"]["type"], got["2"]["backlinks"], got["2"]["tags"], got["2"]["duplicate_warning"]) == ("guides/o.md", "guide", [], [], None)
    assert got["3"]["code"] == "PATH_INVALID" and got["3"]["backlinks"] is None and got["4"]["suggested_path"] == "untitled.md" and got["4"]["title"] == "Untitled"
    with pytest.raises(curate.CuratorError) as e:
        curate.draft(i, "bad", "x", "../out.md", root=root)
    assert e.value.code == "PATH_INVALID"


COLS = "qid string, path string, meta string, content string"


def test_writing(spark, index, tmp_path):
    root, i = index
    rows = [
        ("1", "new/x.md", '{"title":"X"}', "# X\nunheardof qwertz\n\n"), ("2", "new/x.md", "{}", "again other"), ("3", "notes.md", "{}", "third zuiop"), ("4", "../x.md", "{}", "a"), ("5", "y.md", "[]", "a"),
        ("6", "dup.md", "{}", SAME), ("7", "./z/é ü.md", "{}", "asdfgh"), ("8", None, None, None), ("9", "dup.md", "{}", "yxcvb"),
    ]
    df = spark.createDataFrame(rows, COLS)
    said, same = entries.write_batch(i, df, root, "docs")
    assert same is i and {r["code"] for r in said.collect()} == {"WRITE_FAILED"}  # off unless enabled
    want = {"1": None, "2": "EXISTS", "3": "EXISTS", "4": "PATH_ESCAPE", "5": "FRONTMATTER_INVALID", "6": "DUPLICATE", "7": None, "8": "PATH_INVALID", "9": None}
    said, same = entries.write_batch(i, df, root, "docs", dry_run=True, enabled=True)
    got = {r["qid"]: r for r in said.collect()}
    assert same is i and {k: r["code"] for k, r in got.items()} == want and not any(r["written"] for r in got.values()) and not os.path.exists(f"{root}/new")
    assert got["1"]["bytes"] == len("---\ntitle: X\n---\n\n# X\nunheardof qwertz\n") and got["6"]["duplicate_warning"]["doc_id"] == "docs:runbooks:rotate"
    said, after = entries.write_batch(i, df, root, "docs", enabled=True)
    assert {r["qid"]: r["code"] for r in said.collect()} == want and {r["doc_id"] for r in said.where("written").collect()} == {"docs:new:x", "docs:z:é ü", "docs:dup"}
    assert open(f"{root}/new/x.md").read() == "---\ntitle: X\n---\n\n# X\nunheardof qwertz\n" and os.path.exists(f"{root}/z/é ü.md")
    assert [r["doc_id"] for r in search.search(after, "unheardof").collect()] == ["docs:new:x"] and after.n_nodes == i.n_nodes + 3
    # with overwrite the last of a path stands, and duplicates aren't looked for
    more = spark.createDataFrame([("1", "notes.md", "{}", "first over"), ("2", "notes.md", "{}", SAME)], COLS)
    said, last = entries.write_batch(after, more, root, "docs", overwrite=True, enabled=True)
    assert [r["code"] for r in said.collect()] == [None, None] and SAME in open(f"{root}/notes.md").read() and last.n_nodes == after.n_nodes
    assert "docs:notes" in [r["doc_id"] for r in search.search(last, "ninety").collect()] and search.search(last, "clusters").count() == 0
    # a folder that isn't there yet, and nothing to write
    said, none = entries.write_batch(i, df.limit(0), f"{tmp_path}/none", "docs", enabled=True)
    assert none is i and said.count() == 0 and not os.path.exists(f"{tmp_path}/none")


def test_whole_texts_are_compared(spark, index):
    late = " ".join(f"filler{k}" for k in range(250)) + " signing keys rotate every ninety days"
    asked = spark.createDataFrame([("q", "Late", late, None, None)], "qid string, topic string, content string, suggested_path string, source_url string")
    drafted = entries.draft_batch(index[1], asked).first()
    assert [x["doc_id"] for x in drafted["backlinks"]] == ["docs:runbooks:rotate"] and drafted["duplicate_warning"] is None
    row = search.similar_batch(index[1], asked.select("qid", "content")).first()
    assert row["overlap"] == pytest.approx(row["n_matched"] / 256) and row["n_matched"] == 6
    assert search.similar_batch(index[1], asked.select("qid", "content"), most_tokens=200).count() == 0
