"""Search by blocks against the sum over all postings; bounds, buckets, changes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyra.operators import blocks, search
from papyra.operators.indexing import Index
from papyra.operators.schema import DOCUMENTS, NODES, Ranking

WORDS = ["alpha", "alphabet", "beta", "betas", "gamma", "gam", "delta", "deltoid", "omega", "x1", "ab", "alp", "token", "tokens", "run", "running"]


def tables(spark, n, seed, first=0, tag=""):
    rng = random.Random(seed)
    some = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, k)))
    docs, nodes = [], []
    for d in range(first, first + n):
        doc = f"d{d}"
        docs.append((doc, d, f"{doc}.md", some(3), some(3), 1, 1, 1, "", [], "", rng.choice(["one", "two"]), {"kind": [rng.choice("abc")], "size": [rng.choice("xy")]}, []))
        for k in range(rng.randint(1, 4)):
            body = some(30) + (" [code:py] " + some(4) if rng.random() < 0.3 else "") + tag
            nodes.append((doc, d, k, f"{doc}:n{k}", some(2), 1, None, body, "", 1, 1, 1, None, None, [f"{doc}:n{k}"]))
    return spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(nodes, NODES).repartition(5)


QUERIES = [("q1", "alpha beta"), ("q2", "tokens running gam"), ("q3", "omega"), ("q4", "alp bet tok"), ("q5", "nothing"), ("q6", "delta delta x1 ab gamma")]


def rows(df):
    return sorted((r["qid"], r["rank"], r["node_id"], r["n_matched"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(*tables(spark, 90, 1), auto_glossary=False)


@pytest.mark.parametrize(
    "how",
    [
        {}, {"prefix": False}, {"bonuses": False}, {"filters": {"kind": ["a", "b"], "size": "x"}}, {"filters": {"kind": "zz"}}, {"collection": "two"}, {"doc_id": "d7"},
        {"filters": {"kind": "a"}, "collection": "one", "doc_id": "d3"}, {"weights": {"one": 2.5, "two": 0.5}}, {"weights": {"one": -1.0}}, {"ranking": {"title_weight": 9.0, "b": 0.1, "term_proximity_bonus": -1.0}},
    ],
)
def test_same_as_all_postings(spark, index, how):
    how = dict(how)
    own = index.with_weights(**how.pop("weights", {})).with_ranking(**how.pop("ranking", {}))
    terms = search.query_terms(own, search.query_frame(spark, QUERIES))
    for limit in (1, 5, 1000):
        got, want = rows(search.best(own, terms, limit, **how)), rows(search.top(search.scored(own, terms, **how), limit))
        assert got == want
    assert want or how.get("filters") == {"kind": "zz"} or "doc_id" in how


def test_few_queries_at_a_time_and_too_many_terms(spark, index, monkeypatch):
    terms = search.query_terms(index, search.query_frame(spark, QUERIES))
    want = rows(search.top(search.scored(index, terms), 5))
    monkeypatch.setattr(search, "QUERIES", 2)
    assert rows(search.best(index, terms, 5)) == want
    monkeypatch.setattr(search, "MOST_TERMS", 12)
    assert rows(search.best(index, terms, 5)) == want
    monkeypatch.setattr(search, "MOST_TERMS", 2)
    assert rows(search.best(index, terms, 5)) == want


def test_changes_and_whole_writes(spark, index, tmp_path, monkeypatch):
    from papyra.operators import indexing

    monkeypatch.setattr(indexing, "MOST_CHANGES", 2)
    monkeypatch.setattr(indexing, "MOST_SEGMENTS", 3)  # nodes are numbered anew at the whole write
    own, docs, nodes = index, *tables(spark, 30, 2, 70, " fresh tokens")
    steps = [lambda i: i.remove([f"d{k}" for k in range(0, 40, 3)]), lambda i: i.upsert(docs, nodes), lambda i: i.remove(["d71", "d1", "none"]), lambda i: i.upsert(docs, nodes)]
    for k, step in enumerate(steps):
        own = step(own)
        terms = search.query_terms(own, search.query_frame(spark, [*QUERIES, ("q7", "fresh")]))
        assert rows(search.best(own, terms, 7)) == rows(search.top(search.scored(own, terms), 7)), k
        filtered = {"filters": {"kind": ["a", "c"]}}
        assert rows(search.best(own, terms, 7, **filtered)) == rows(search.top(search.scored(own, terms, **filtered), 7)), k
    assert own.changes == 1 and own.dead is not None and own.segment == 1
    own.save(f"{tmp_path}/i")
    again = Index.load(spark, f"{tmp_path}/i")
    terms = search.query_terms(again, search.query_frame(spark, QUERIES))
    assert rows(search.best(again, terms, 7)) == rows(search.top(search.scored(own, terms), 7))
    grown = again.upsert(*tables(spark, 5, 3, 500))
    assert grown.numbered_stats.select("nid").distinct().count() == grown.n_nodes


def test_a_search_opens_the_folders_of_its_terms(spark, index):
    wanted = spark.createDataFrame([("omega", 0), ("omegas", 1), ("x1", 2)], "term string, t int")
    own = {r[0] for r in wanted.select(blocks.bucket_of(F.col("term"), index.buckets)).collect()}
    read = blocks.read_blocks(index.blocks, wanted, sorted(own))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80] and len(own) < index.buckets
    files = {r[0] for r in index.blocks.where(F.col("bucket").isin(sorted(own))).select(F.input_file_name()).distinct().collect()}
    whole = {r[0] for r in index.blocks.select(F.input_file_name()).distinct().collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files} <= own and len(files) < len(whole)
    assert "positions" not in plan


def test_bounds_skip_blocks_and_lose_nothing():
    rng = np.random.default_rng(4)
    n_queries, n_terms, n_blocks = 6, 9, 40
    asked = (rng.random((n_queries, n_terms)) < 0.4).astype(np.uint8)
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("tf", pa.int32()), ("length", pa.int32()), ("marks", pa.int32())]))
    names = ["block", "t", "items", "max_tf", "min_length", "marks", "bits", "w"]
    tables_, scores = [], {}
    for b in range(n_blocks):
        top = 30 if b in (1, 2) else 3  # two rich blocks come first
        rows_ = []
        for t in range(n_terms):
            slots = np.flatnonzero(rng.random(50) < (0.95 if top > 3 else 0.3))
            items = [{"slot": int(s), "tf": int(rng.integers(1, top + 1)), "length": int(rng.integers(20, 60)), "marks": int(top > 3)} for s in slots]
            if items:
                rows_.append((b, t, items, max(i["tf"] for i in items), min(i["length"] for i in items), int(np.bitwise_or.reduce([i["marks"] for i in items])), None, None))
        types = [pa.int64(), pa.int32(), kind, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64()]
        tables_.append(pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows_), types)], names=names))

    def batch(limit):
        return blocks.Batch([f"q{i}" for i in range(n_queries)], asked.sum(1).astype(np.int64), asked, np.arange(n_terms + 1), np.arange(n_terms), rng.random(n_terms) * 0 + np.linspace(0.5, 3, n_terms), Ranking(), 40.0, True, limit, False, 1.0, 8)

    def run(limit):
        b = batch(limit)
        best = blocks._Best(b)
        done = [blocks._score(pa.Table.from_batches([t]), b, best) for t in tables_]
        return best, done

    whole, _ = run(10**6)
    few, done = run(5)
    for q in range(n_queries):
        want = sorted(zip(-whole.found[q][0], whole.found[q][1]))[:5]
        assert sorted(zip(-few.found[q][0], few.found[q][1]))[:5] == want
    assert not all(done) and sum(done) < n_blocks / 2 and not scores
    # the stream gives the same, however it is cut into batches
    class Sent:
        value = batch(5)

    for size in (3, 100):
        whole_rows = pa.Table.from_batches(tables_)
        got = next(iter(blocks.scorer(Sent)(iter(whole_rows.to_batches(max_chunksize=size)))))
        assert sorted(got.column("score").to_pylist()) == sorted(np.concatenate([f[0] for f in few.found]).tolist())
