"""Tables of an index are made when they are asked for; judgements meet nodes by their text."""

from pyspark.sql import functions as F

from papyra.operators import catalog, code, evaluate
from papyra.operators.indexing import Index
from papyra.plans import corpora

SF = "/root/testdata/sf0.001"
DEAR = {"numbered_postings", "blocks"}


def test_terms_and_catalogs_need_no_postings(spark):
    index = Index.build(*corpora.conv_tables(spark, SF), auto_glossary=False)
    assert not index.made() & {*DEAR, "vocab", "facets", "refs", "numbered_stats"}
    assert catalog.stats(index).first()["total_nodes"] == index.nodes.count()
    assert catalog.matching(index.with_weights(conv=2.0), filters={"collection": ["conv"]}).count() == index.documents.count()
    assert not index.made() & DEAR
    early = sorted(map(tuple, index.vocab.collect()))
    counted = index.numbered_postings.groupBy("term").agg(F.count("*").alias("df"))
    assert index.made() & DEAR == {"numbered_postings"} and early == sorted(map(tuple, counted.collect()))
    assert index.make().made() >= {*DEAR, "vocab", "facets", "refs", "numbered_stats", "n_nodes"}


def test_a_copy_shares_what_is_made_later(spark):
    index = Index.build(*corpora.conv_tables(spark, SF), auto_glossary=False)
    other = index.with_ranking(k1=1.5)
    assert other.facets is index.facets and other.ranking.k1 == 1.5 != index.ranking.k1


def test_no_judgement_is_compared_with_all_nodes_of_its_document(spark):
    index = corpora.geo_index(spark, SF)
    nodes = [r.asDict() for r in index.nodes.join(index.documents.select("doc_id", F.col("title").alias("dt")), "doc_id").select("doc_id", "dt", "node_id", "ord", "title", "content").collect()]
    wants = sorted({w for n in nodes[:12] for w in (n["title"], n["title"][:3], n["title"][2:5].lower(), n["content"][3:9], n["node_id"])}) + ["", "zz none", None]
    asked = [(f"{i}-{d}", d, w, 1) for i, w in enumerate(wants) for d in ("a", "ASIA", "")]

    def step(n, w):
        t, c = n["title"].lower(), n["content"].lower()
        held = [] if w is None else [t == w.lower(), t.startswith(w.lower()), w.lower() in t, w.lower() in c]
        return next((k for k, h in enumerate(held) if h), 4 if n["ord"] == 0 else None)

    want = []
    for q, d, w, _ in asked:
        for doc in {n["doc_id"] for n in nodes if d.lower() in n["dt"].lower()}:
            own = [(step(n, w), n["ord"], n["node_id"]) for n in nodes if n["doc_id"] == doc and step(n, w) is not None]
            want.append((q, min(own)[2]))
    found = evaluate.resolve_qrels(index, spark.createDataFrame(asked, "qid string, doc_title string, node_title string, relevance int"))
    assert sorted((r["qid"], r["item"]) for r in found.collect()) == sorted(want)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()  # which ranked a row for each judgement and node


def test_source_files_are_parsed_once(spark):
    documents, nodes = code.index_code(corpora.many_files(spark, SF))
    assert all("MapInArrow" not in t._jdf.queryExecution().optimizedPlan().toString() for t in (documents, nodes))
    assert nodes.select("doc_id").distinct().count() == documents.count() == corpora.read(spark, SF, "part").count()
