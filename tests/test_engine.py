"""Index, search, catalog, trees, curation, rendering and streaming on a small corpus of files."""

import pytest
from pyspark.sql import functions as F

from papyra.operators import catalog, curate, evaluate, glossary, render, search, tree
from papyra.operators.indexing import Index
from papyra.operators.schema import Collection, Config
from papyra.sources import files
from papyra.streaming.upsert import LiveIndex, follow

DOCS = {
    "auth/tokens.md": "---\ntitle: \"Token handling\"\ndescription: How bearer tokens are issued\ntags: [security, tokens]\ncategory: auth\n---\n# Tokens\nA token is issued by the server. See [rotation](../runbooks/rotate.md#rotate-keys).\n\n## Refresh\n```python\nrefresh_token(session)\n```\nRefresh tokens live long.\n",
    "runbooks/rotate.md": "# Overview\nSteps to rotate signing keys.\n\n## Rotate keys\nKeys rotate every ninety days. TLS (Transport Layer Security) is required.\n\n### Verify\nCheck the deployment.\n",
    "guides/deploy.md": "---\ntags: ops\n---\n# Deploying\nDeployment of the service to a cluster.\n\nTitle two\n---------\nSome | table\n--- | ---\na | b\n\n> quoted words here\n\n- first item\n- second item\n",
    "notes.md": "Just text without any heading about clusters.\n",
}
CODE = {
    "app.py": "import os\n\nclass Store(object):\n    \"\"\"doc\"\"\"\n\n    def get_token(self, key):\n        return key\n\n    def _hidden(self):\n        pass\n\nMAX_SIZE = 10\n\ndef deploy_all(a,\n               b):\n    return a\n",
    "lib/main.go": "package main\n\ntype Server struct {\n\tname string\n}\n\nfunc (s *Server) Start() error {\n\treturn nil\n}\n\nfunc helper() {\n}\n",
    "empty.rb": "# nothing here\n",
    "skip.txt": "class NotCode {}",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    for kind, group in (("md", DOCS), ("code", CODE)):
        for path, text in group.items():
            p = base / kind / path
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
    (base / "glossary.json").write_text('{"K8s": ["kubernetes cluster"], "JWT": ["token"]}')
    return base


@pytest.fixture(scope="module")
def index(spark, root):
    c = Config((Collection("src", f"{root}/code", kind="code"), Collection("docs", f"{root}/md")), glossary_path=f"{root}/glossary.json")
    return files.open_index(spark, c)


def ids(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]


def test_documents(index):
    docs = {r["doc_id"]: r for r in index.documents.collect()}
    assert set(docs) == {"docs:auth:tokens", "docs:runbooks:rotate", "docs:guides:deploy", "docs:notes", "src:app_py", "src:lib:main_go", "src:empty_rb"}
    t = docs["docs:auth:tokens"]
    assert (t["title"], t["description"], t["tags"]) == ("Token handling", "How bearer tokens are issued", ["security", "tokens"])
    assert t["facets"] == {"category": ["auth"], "has_code": ["true"], "code_languages": ["python"], "has_links": ["true"]} and t["references"] == ["runbooks/rotate.md"]
    assert docs["docs:runbooks:rotate"]["title"] == "Runbooks — Overview" and docs["docs:runbooks:rotate"]["facets"]["type"] == ["runbook"]
    assert docs["docs:notes"]["title"] == "(document root)" and docs["docs:guides:deploy"]["tags"] == ["ops"]
    assert docs["src:app_py"]["facets"]["language"] == ["python"] and docs["src:app_py"]["tags"] == ["Store", "get_token", "MAX_SIZE", "deploy_all"]
    assert docs["src:app_py"]["description"] == "1 classes: Store; 1 functions: deploy_all" and docs["src:empty_rb"]["heading_count"] == 1


def test_nodes_and_trees(index):
    rows = {r["node_id"]: r for r in index.nodes.where("doc_id LIKE 'docs:%'").collect()}
    assert rows["docs:runbooks:rotate:n3"]["parent_id"] == "docs:runbooks:rotate:n2" and rows["docs:notes:n1"]["level"] == 0
    assert "[code:python] refresh_token(session)" in rows["docs:auth:tokens:n2"]["content"]
    deploy = rows["docs:guides:deploy:n2"]
    assert deploy["title"] == "Title two" and deploy["level"] == 2 and "[table] Some table a b" in deploy["content"] and "> quoted words here" in deploy["content"]
    assert ids(tree.subtree(index, "docs:runbooks:rotate", "docs:runbooks:rotate:n1"), "node_id", "depth") == [(f"docs:runbooks:rotate:n{k + 1}", k) for k in range(3)]
    assert ids(tree.roots(index.nodes.where("doc_id = 'docs:guides:deploy'")), "root_nodes") == [["docs:guides:deploy:n1"]]
    refs = index.spark.createDataFrame([("a", "x/rotate.md#rotate-keys"), ("b", "rotate.md#nothing"), ("c", "missing.md")], "ref_id string, ref string")
    assert sorted(ids(tree.resolve_refs(index, refs), "ref_id", "node_id")) == [("a", "docs:runbooks:rotate:n2"), ("b", None)]
    code = {r["node_id"]: r for r in index.nodes.where("doc_id = 'src:lib:main_go'").collect()}
    assert [(r["title"], r["level"], r["exported"]) for _, r in sorted(code.items())] == [("class Server", 1, True), ("method Start", 2, True), ("function helper", 1, False)]


def test_search_and_filters(index):
    top = search.search(index, "rotate keys").collect()
    assert top[0]["node_id"] == "docs:runbooks:rotate:n2" and top[0]["matched_terms"] == ["rotate", "key"] and top[0]["rank"] == 1
    assert search.search(index, "zzz").count() == 0 and search.search(index, "!").count() == 0
    assert set(ids(search.search(index, "token", filters={"category": "auth"}), "doc_id")) == {"docs:auth:tokens"}
    assert search.search(index, "token", filters={"nokey": "x"}).count() == 0
    assert set(ids(search.search(index, "deploy", collection="src"), "doc_id")) == {"src:app_py"}
    assert len(ids(search.search(index, "the", limit=2), "node_id")) <= 2
    jwt = search.search(index, "jwt").collect()
    assert jwt and jwt[0]["doc_id"] in ("docs:auth:tokens", "src:app_py")
    up = search.search(index.with_weights(docs=10.0), "token").first()
    assert up["doc_id"] == "docs:auth:tokens"
    plain = {r["node_id"]: r["score"] for r in search.search(index, "tokens").collect()}
    heavy = {r["node_id"]: r["score"] for r in search.search(index.with_ranking(title_weight=30.0), "tokens").collect()}
    assert heavy["docs:auth:tokens:n1"] > plain["docs:auth:tokens:n1"]


def test_find_symbol(index):
    rows = search.find_symbol(index, "get_token", "method", "python").collect()
    assert rows and all(r["doc_id"] == "src:app_py" for r in rows)
    assert ids(search.find_symbol(index, "get_token", "method", strict_kind=True), "node_title") == ["method get_token"]
    with pytest.raises(ValueError):
        search.find_symbol(index, "x", "widget")


def test_catalog(index):
    page, total = catalog.list_documents(index, limit=2, offset=1)
    assert total == 7 and page.count() == 2
    assert ids(catalog.matching(index, tag="SECUR"), "doc_id") == ["docs:auth:tokens"]
    assert ids(catalog.matching(index, query="BEARER"), "doc_id") == ["docs:auth:tokens"]
    counts = {(r["key"], r["value"]): r["n"] for r in catalog.facet_counts(index.documents).collect()}
    assert counts["collection", "docs"] == 4 and counts["language", "go"] == 1
    s = catalog.stats(index).first()
    assert s["document_count"] == 7 and s["total_nodes"] == index.n_nodes and s["collections"] == ["docs", "src"]
    assert catalog.has_document(index, "docs:notes") and not catalog.has_document(index, "nope")
    assert "document_count" in catalog.stats_json(index).first()[0]


def test_glossary(spark, index):
    keys = set(ids(glossary.terms(index.glossary), "key"))
    assert {"k8s", "kubernetes cluster", "tls", "transport layer security"} <= keys
    texts = spark.createDataFrame([("1", "Uses k8s and transport layer security"), ("2", "none")], "qid string, content string")
    assert sorted(ids(curate.glossary_hits(index, texts), "qid", "key")) == [("1", "k8s"), ("1", "transport layer security")]
    assert glossary.read_json(spark, "/nowhere/glossary.json").count() == 0


def test_upsert_and_remove(index):
    less = index.remove(["docs:notes"])
    assert less.n_nodes == index.n_nodes - 1 and search.search(less, "heading").count() == 0
    docs = index.documents.where("doc_id = 'docs:notes'").withColumn("title", F.lit("Notes two"))
    nodes = index.nodes.where("doc_id = 'docs:notes'").withColumn("content", F.lit("brandnew words"))
    more = index.upsert(docs, nodes)
    assert more.n_nodes == index.n_nodes and search.search(more, "brandnew").count() == 1 and search.search(more, "clusters without").where("doc_id = 'docs:notes'").count() == 0


def test_many_changes_are_the_same_as_a_new_index(spark, index):
    """By deltas and, after some changes, written whole; totals and frequencies by difference."""
    now = index
    for k in range(11):
        docs = index.documents.where("doc_id = 'docs:notes'").withColumn("doc_id", F.lit(f"docs:x{k % 4}")).withColumn("doc_ord", F.lit(1000 + k).cast("long"))
        nodes = index.nodes.where("doc_id = 'docs:notes'").withColumn("doc_id", F.lit(f"docs:x{k % 4}")).withColumn("node_id", F.lit(f"docs:x{k % 4}:n1")).withColumn("content", F.lit(f"brandnew word{k} words"))
        now = now.remove(["docs:x1", "none"]) if k == 6 else now.upsert(docs, nodes)
    fresh = Index.build(now.documents, now.nodes, now.ranking, now.weights, now.glossary, False)
    assert (now.n_nodes, now.n_tokens) == (fresh.n_nodes, fresh.n_tokens) and 0 < now.changes < 11
    for name in ("vocab", "postings", "node_stats", "facets", "refs"):
        a, b = ([tuple(map(str, r)) for r in getattr(i, name).select(*sorted(fresh.vocab.columns if name == "vocab" else getattr(fresh, name).columns)).collect()] for i in (now, fresh))
        assert sorted(a) == sorted(b)


def test_save_and_load(spark, index, tmp_path):
    index.save(str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    a, b = (ids(search.search(i, "token rotation"), "node_id", "score") for i in (index, again))
    assert a == b


def test_similar_draft_and_write(spark, index, tmp_path):
    text = "Keys rotate every ninety days and signing keys rotate with steps to verify deployment"
    rows = search.find_similar(index, text).collect()
    assert rows[0]["doc_id"] == "docs:runbooks:rotate" and 0 < rows[0]["overlap"] <= 1 and rows[0]["suggest_merge"]
    assert search.find_similar(index, "").count() == 0
    d = curate.draft(index, "Key rotation", text, source_url="https://x")
    assert d["suggested_path"] == "key-rotation.md" and d["frontmatter"]["title"] == "Key Rotation" and d["duplicate_warning"]["doc_id"] == "docs:runbooks:rotate"
    assert len({b["doc_id"] for b in d["backlinks"]}) == len(d["backlinks"])
    write = lambda *a, **k: curate.write_entry(index, str(tmp_path), "docs", *a, enabled=True, **k)
    for path, meta, content, code in (
        ("../x.md", {}, "a", "PATH_ESCAPE"), ("/x.md", {}, "a", "PATH_INVALID"), ("x.txt", {}, "a", "PATH_INVALID"), ("", {}, "a", "PATH_INVALID"),
        ("x.md", {"a b": 1}, "a", "FRONTMATTER_INVALID"), ("x.md", {"a": "x\ny"}, "a", "FRONTMATTER_INVALID"), ("x.md", [], "a", "FRONTMATTER_INVALID"), ("x.md", {}, text, "DUPLICATE"),
    ):
        with pytest.raises(curate.CuratorError) as e:
            write(path, meta, content)
        assert e.value.code == code
    with pytest.raises(curate.CuratorError):
        curate.write_entry(index, str(tmp_path), "docs", "new/x.md", {}, "off unless enabled")
    said = curate.answer(lambda: write("../x.md", {}, "a"))
    assert said["is_error"] and said["text"].startswith("Error: PATH_ESCAPE: ") and curate.answer(lambda: search.find_similar(index, text, threshold=11))["is_error"]
    assert curate.answer(lambda: search.find_similar(index, text, 1))["text"].startswith("```json\n[")
    report, same = write("new/x.md", {"title": "X", "tags": ["a", "b"]}, "# X\nunheardof qwertz zuiop\n\n", dry_run=True)
    assert same is index and report["content"] == "---\ntitle: X\ntags: [a, b]\n---\n\n# X\nunheardof qwertz zuiop\n" and not (tmp_path / "new").exists()
    report, after = write("new/x.md", {"title": "X", "tags": ["a", "b"]}, "# X\nunheardof qwertz zuiop\n")
    assert report["doc_id"] == "docs:new:x" and (tmp_path / "new/x.md").exists()
    assert ids(search.search(after, "unheardof"), "doc_id") == ["docs:new:x"]
    with pytest.raises(curate.CuratorError) as e:
        write("new/x.md", {}, "other")
    assert e.value.code == "EXISTS"


def test_rendering(index):
    text = [r["text"] for r in render.results(index, search.search(index, "token")).collect()]
    assert text and "score" in text[0] and any("refs: runbooks/rotate.md → docs:runbooks:rotate" in t for t in text)
    lines = [r["text"] for r in render.outline(tree.outline(index, "docs:runbooks:rotate")).collect()]
    assert lines[1].startswith("  - Rotate keys") and render.outline(tree.outline(index, "docs:notes")).first()["text"].startswith("- (document root)")
    assert "refs: runbooks/rotate.md" in render.listing(catalog.document(index, "docs:auth:tokens")).first()[0]
    assert render.navigation(tree.subtree(index, "docs:runbooks:rotate", "docs:runbooks:rotate:n2")).count() == 2
    assert render.navigation(tree.subtree(index, "docs:runbooks:rotate", "docs:runbooks:rotate:n3")).first()["text"] == "### Verify [docs:runbooks:rotate:n3]\nCheck the deployment."
    assert render.navigation_head(tree.subtree(index, "docs:runbooks:rotate", "docs:runbooks:rotate:n2")).first()["text"].startswith("Subtree: Rotate keys (2 sections, ")
    assert render.symbols(search.find_symbol(index, "get_token")).count() >= 1


def test_node_content_bounds(index):
    rows = tree.node_content(index, "docs:notes", ["docs:notes:n1", "x", "docs:notes:n1"])
    assert ids(rows, "pos") == [0, 2]
    with pytest.raises(ValueError):
        tree.node_content(index, "docs:notes", [])


def test_evaluation(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("z", "c", 1)], "qid string, item string, rank int")
    rels = spark.createDataFrame([("q", "b", 3), ("q", "a", 1), ("z", "x", 0)], "qid string, item string, relevance int")
    got = dict(ids(evaluate.ndcg(ranked, rels), "qid", "ndcg"))
    import math

    assert got["z"] == 1.0 and got["q"] == pytest.approx((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert dict(ids(evaluate.reciprocal_rank(ranked, rels), "qid", "rr")) == {"q": 0.5, "z": 0.0}


def test_stream_upserts_changed_files(spark, index, tmp_path):
    folder, c = tmp_path / "live", Collection("live", f"{tmp_path}/live")
    folder.mkdir()
    (folder / "one.md").write_text("# One\nfirstword here\n")
    live = LiveIndex(index)
    follow(live, c, f"{tmp_path}/ck").awaitTermination(120)
    assert ids(search.search(live.index, "firstword"), "doc_id") == ["live:one"]
    (folder / "two.md").write_text("# Two\nsecondword here\n")
    follow(live, c, f"{tmp_path}/ck").awaitTermination(120)
    assert ids(search.search(live.index, "secondword"), "doc_id") == ["live:two"] and live.batches == 2
    assert search.search(live.index, "firstword").count() == 1


def test_retrieval_quality(spark, index):
    """A gate on ranking: NDCG and MRR over judged queries."""
    judged = [("rotate signing keys", "Runbooks", "Rotate keys", 3), ("refresh token", "Token", "Refresh", 3), ("deployment cluster", "Deploying", "Deploying", 3), ("get token", "app.py", "method get_token", 3)]
    rels = evaluate.resolve_qrels(index, spark.createDataFrame(judged, "qid string, doc_title string, node_title string, relevance int"))
    found = search.search_batch(index, search.query_frame(spark, [(q, q) for q, *_ in judged]), 10, snippets=False).select("qid", F.col("node_id").alias("item"), "rank")
    assert rels.count() == 4
    assert evaluate.ndcg(found, rels).agg(F.avg("ndcg")).first()[0] >= 0.65 and evaluate.mrr(found, rels).first()[0] >= 0.7
