"""Ranked search over an Index, for one query or a batch.

Order: exact and prefix BM25 summed, proximity bonus, coverage bonus, times the
collection weight, sort, limit. Filters choose documents but never change N, df or the
mean length. Late materialisation: titles and snippets are made for the top rows only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from papyra.functions import text as T
from papyra.operators import blocks
from papyra.operators.indexing import Index

Filters = Mapping[str, "str | Sequence[str]"]


def query_frame(spark: SparkSession, queries: Sequence[tuple[object, str]] | str) -> DataFrame:
    rows = [("0", queries)] if isinstance(queries, str) else [(str(q), t) for q, t in queries]
    return spark.createDataFrame(rows, "qid string, query string")


def query_terms(index: Index, queries: DataFrame, expand: bool = True) -> DataFrame:
    """(qid, idx, term, n_terms): stems of two letters at least, with glossary expansions, each once (Q01, Q02)."""
    stemmed = F.filter(T.stems(T.raw_tokens(F.col("query"))), lambda t: F.length(t) >= 2)
    base = queries.select("qid", F.posexplode(stemmed).alias("i", "term"))
    out = base.select("qid", (F.col("i").cast("long") * 1_000_000).alias("o"), "term")
    if expand:
        added = F.filter(T.stems(T.raw_tokens(F.col("expansion"))), lambda t: F.length(t) >= 2)
        hits = base.join(index.glossary.withColumnRenamed("key", "term"), "term").select("qid", "i", "pos", F.posexplode(added).alias("j", "t"))
        w = Window.partitionBy("qid", "i").orderBy("pos", "j")
        out = out.unionByName(hits.select("qid", (F.col("i").cast("long") * 1_000_000 + F.row_number().over(w)).alias("o"), F.col("t").alias("term")))
    once = out.groupBy("qid", "term").agg(F.min("o").alias("o"))
    w = Window.partitionBy("qid")
    return once.select("qid", "term", F.row_number().over(w.orderBy("o")).alias("idx"), F.count("*").over(w).alias("n_terms"))


def term_matches(index: Index, terms: DataFrame, prefix: bool = True) -> DataFrame:
    """(qid, qterm, idx, n_terms, term, df, penalty): exact terms, and indexed terms that begin with a query term (Q06, Q07).

    The prefix join is an equality join on the first three letters with the rest as a condition.
    """
    exact = terms.join(index.vocab, "term").select("qid", F.col("term").alias("qterm"), "idx", "n_terms", "term", "df", F.lit(1.0).alias("penalty"))
    if not prefix:
        return exact
    q = terms.where(F.length("term") >= 3).select("qid", F.col("term").alias("qterm"), "idx", "n_terms", F.left("term", F.lit(3)).alias("p"))
    v = index.vocab.where(F.length("term") > 3).withColumn("p", F.left("term", F.lit(3)))
    longer = q.join(v, "p").where(F.startswith("term", F.col("qterm")) & (F.col("term") != F.col("qterm")))
    return exact.unionByName(longer.select("qid", "qterm", "idx", "n_terms", "term", "df", F.lit(index.ranking.prefix_penalty).alias("penalty")))


def scope(index: Index, filters: Filters | None = None, collection: str | None = None) -> DataFrame | None:
    """Documents that pass: any of the values of a key, all of the keys (Q03, Q04); None if all do."""
    wanted = {k: [v] if isinstance(v, str) else list(v) for k, v in (filters or {}).items()}
    found = None
    for key, values in [*wanted.items(), *([("collection", [collection])] if collection else [])]:
        one = index.facets.where((F.col("key") == key) & F.col("value").isin(values)).select("doc_id").distinct()
        found = one if found is None else found.join(one, "doc_id", "left_semi")
    return found


def scope_bits(index: Index, filters: Filters | None = None, collection: str | None = None, doc_id: str | None = None) -> DataFrame | None:
    """(block, bits) of the nodes that pass: values of a key are joined by OR, keys by AND, all on bitmaps (Q03-Q05); None if all do."""
    wanted = {k: [v] if isinstance(v, str) else list(v) for k, v in (filters or {}).items()}
    asked = [*wanted.items(), *([("collection", [collection])] if collection else [])]
    each = [index.facet_bits().where((F.col("key") == k) & F.col("value").isin(vs)).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits")) for k, vs in asked]
    if doc_id is not None:
        each.append(blocks.bits_of(index.numbered_stats.where(F.col("doc_id") == doc_id), index.slot_bits))
    if not each:
        return None
    rows = reduce(DataFrame.unionByName, each)
    return rows if len(each) == 1 else rows.groupBy("block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(each)).drop("n")


def allowed_postings(index: Index, filters: Filters | None = None, collection: str | None = None, doc_id: str | None = None) -> DataFrame:
    """Postings of the documents that pass (Q03-Q05)."""
    postings = index.postings
    if doc_id is not None:
        postings = postings.where(F.col("doc_id") == doc_id)
    allowed = scope(index, filters, collection)
    return postings if allowed is None else postings.join(allowed, "doc_id", "left_semi")


#: Rows of query terms, or of indexed terms wanted, that a join may broadcast or a batch send; beyond that both sides are dealt by term.
MOST_TERMS = 500_000
#: Queries that are scored together.
QUERIES = 512


def scored(index: Index, terms: DataFrame, filters: Filters | None = None, collection: str | None = None, doc_id: str | None = None,
           prefix: bool = True, bonuses: bool = True) -> DataFrame:
    """(qid, doc_id, node_id, doc_ord, ord, score, n_matched) of every match (Q05-Q12).

    Queries share terms, and a term's prefixes lead to many indexed ones: a node's score
    is summed for each distinct query term first, then for the queries that have it. The
    matching postings are dealt by node once; both sums follow without a further exchange.
    Up to MOST_TERMS the indexed terms that are wanted are broadcast, so that the postings
    are read where they lie and not dealt by term. best() gives the best rows alone, sooner.
    """
    r = index.ranking
    matches = term_matches(index, terms, prefix)
    tf, df, n = F.col("tf"), F.col("df"), F.lit(float(index.n_nodes))
    idf = F.ln((n - df + 0.5) / (df + 0.5) + 1.0)
    norm = tf * (r.k1 + 1) / (tf + r.k1 * (1 - r.b + r.b * F.col("total_tokens") / F.lit(index.avgdl or 1.0)))
    weight = F.greatest(
        F.lit(1.0), F.when(F.col("has_title"), r.title_weight).otherwise(1.0),
        F.when(F.col("has_desc"), max(1.0, r.description_weight)).otherwise(1.0), F.when(F.col("has_code"), r.code_weight).otherwise(1.0),
    )
    wanted = matches.select("qterm", "term", (idf * F.col("penalty")).alias("u")).distinct()
    few = wanted.limit(MOST_TERMS + 1).toArrow()
    wanted = F.broadcast(index.spark.createDataFrame(few, wanted.schema)) if len(few) <= MOST_TERMS else wanted
    # the scan reads no positions; what a posting is worth without the query is computed before the join
    worth = allowed_postings(index, filters, collection, doc_id).select("term", "doc_id", "node_id", "doc_ord", "ord", (norm * weight).alias("v"))
    node = ["doc_ord", "ord", "doc_id", "node_id"]
    each = worth.join(wanted, "term").select(*node, "qterm", (F.col("u") * F.col("v")).alias("s")).repartition("doc_id", "node_id")
    summed = each.groupBy(*node, "qterm").agg(F.sum("s").alias("s"))
    asked = terms.select("qid", F.col("term").alias("qterm"), "n_terms")
    asked = F.broadcast(asked) if terms.count() <= MOST_TERMS else asked
    agg = summed.join(asked, "qterm").groupBy(*node, "qid", "n_terms").agg(F.sum("s").alias("score"), F.count("*").cast("int").alias("n_matched"))
    score = F.col("score")
    if bonuses:
        score = score + F.when(F.col("n_matched") > 1, (F.col("n_matched") - 1) * r.term_proximity_bonus).otherwise(0.0)
        score = score + F.when((F.col("n_matched") == F.col("n_terms")) & (F.col("n_terms") > 1), r.full_coverage_bonus).otherwise(0.0)
    agg = agg.withColumn("score", score)
    if index.weights:
        w = index.spark.createDataFrame([(k, float(v)) for k, v in index.weights.items()], "collection string, weight double")
        of = index.documents.select("doc_id", "collection").join(F.broadcast(w), "collection").select("doc_id", "weight")
        agg = agg.join(of, "doc_id", "left").withColumn("score", F.col("score") * F.coalesce("weight", F.lit(1.0)))
    return agg.select("qid", "doc_id", "node_id", "doc_ord", "ord", "score", "n_matched")


def _batch(index: Index, asked: pa.Table, limit: int, filtered: bool, prefix: bool, bonuses: bool) -> tuple[blocks.Batch, DataFrame, list[int]] | None:
    """What tasks need to score these queries (qid, term, n_terms): with it the wanted terms (term, t) and their buckets; None if those are too many."""
    spark = index.spark
    own = pc.unique(asked.column("term"))
    own = spark.createDataFrame(pa.table({"qid": pa.array([""] * len(own)), "term": own, "idx": pa.array([0] * len(own), pa.int32()), "n_terms": pa.array([0] * len(own), pa.int64())}), "qid string, term string, idx int, n_terms long")
    found = term_matches(index, F.broadcast(own), prefix)
    found = found.select("qterm", "term", "df", "penalty", blocks.bucket_of(F.col("term"), index.buckets).alias("bucket")).limit(MOST_TERMS + 1).toArrow()
    if len(found) > MOST_TERMS:
        return None
    qids, terms = asked.column("qid").combine_chunks().dictionary_encode(), asked.column("term").combine_chunks().dictionary_encode()
    matrix = np.zeros((len(qids.dictionary), len(terms.dictionary)), np.uint8)
    matrix[qids.indices.to_numpy(), terms.indices.to_numpy()] = 1
    names = found.column("term").combine_chunks().dictionary_encode()
    t = names.indices.to_numpy().astype(np.int64)
    order = np.argsort(t, kind="stable")
    df, penalty = found.column("df").to_numpy().astype(float), found.column("penalty").to_numpy()
    u = np.log((index.n_nodes - df + 0.5) / (df + 0.5) + 1.0) * penalty
    batch = blocks.Batch(
        qids.dictionary.to_pylist(), matrix.sum(1).astype(np.int64), matrix, np.searchsorted(t[order], np.arange(len(names.dictionary) + 1)),
        pc.index_in(found.column("qterm").combine_chunks(), terms.dictionary).to_numpy().astype(np.int64)[order], u[order], index.ranking, index.avgdl or 1.0, bonuses, limit, filtered,
        max([1.0, *index.weights.values()]), index.slot_bits,
    )
    wanted = spark.createDataFrame(pa.table({"term": names.dictionary, "t": pa.array(np.arange(len(names.dictionary), dtype=np.int32))}), "term string, t int")
    return batch, wanted, sorted(set(found.column("bucket").to_pylist()))


def _many(index: Index, asked: pa.Table, limit: int, filtered: bool, prefix: bool, bonuses: bool) -> tuple[blocks.Batch, DataFrame]:
    """As _batch() for any number of wanted terms: none goes to the driver. Each indexed term meets the query terms of its first three letters, and brings what it is worth to them."""
    qids, terms = asked.column("qid").combine_chunks().dictionary_encode(), asked.column("term").combine_chunks().dictionary_encode()
    matrix = np.zeros((len(qids.dictionary), len(terms.dictionary)), np.uint8)
    matrix[qids.indices.to_numpy(), terms.indices.to_numpy()] = 1
    none = np.zeros(0, np.int64)
    batch = blocks.Batch(
        qids.dictionary.to_pylist(), matrix.sum(1).astype(np.int64), matrix, none, none, none, index.ranking, index.avgdl or 1.0, bonuses, limit, filtered,
        max([1.0, *index.weights.values()]), index.slot_bits, index.n_nodes,
    )
    own = index.spark.createDataFrame(pa.table({"q": terms.dictionary, "id": pa.array(np.arange(len(terms.dictionary), dtype=np.int32))}), "q string, id int")
    own = own.groupBy(F.left("q", F.lit(3)).alias("p")).agg(F.collect_list(F.struct("q", "id")).alias("qs"))  # MOST_TERMS at most
    found = index.vocab.withColumn("p", F.left("term", F.lit(3))).join(F.broadcast(own), "p")
    meets = lambda x: F.startswith(F.col("term"), x["q"]) if prefix else x["q"] == F.col("term")
    pairs = F.transform(F.filter("qs", meets), lambda x: x["id"] * 2 + (x["q"] == F.col("term")).cast("int"))
    return batch, found.select("term", "df", pairs.alias("pairs")).where(F.size("pairs") > 0)


def best(index: Index, terms: DataFrame, limit: int, filters: Filters | None = None, collection: str | None = None, doc_id: str | None = None,
         prefix: bool = True, bonuses: bool = True) -> DataFrame:
    """The best rows of each query with their rank, as top(scored(...)) gives them (Q05-Q12, Q15), by blocks.

    QUERIES queries at a time are sent to the tasks, with the indexed terms they want; no
    table is written. Tasks read the blocks of those terms from their buckets, keep the best
    nodes of each query over all their blocks, and skip what bounds rule out. Where queries
    want more than MOST_TERMS terms, each row brings what its term is worth, by a join with
    the terms. More than MOST_TERMS rows of query terms are scored by joins of postings.
    """
    limit = limit or 20
    asked = terms.select("qid", "term", F.col("n_terms").cast("long").alias("n_terms")).orderBy("qid").limit(MOST_TERMS + 1).toArrow()
    by_joins = lambda t: top(scored(index, t, filters, collection, doc_id, prefix, bonuses), limit)
    if len(asked) > MOST_TERMS or index.blocks is None or any(w < 0 for w in index.weights.values()):
        return by_joins(terms)
    bits = scope_bits(index, filters, collection, doc_id)
    side = [] if bits is None else [blocks.side_rows(bits, blocks.ALLOWED)]
    if index.dead is not None:
        side.append(blocks.side_rows(index.dead, blocks.DEAD))
    weighed = {k: float(w) for k, w in index.weights.items() if w != 1.0}
    if weighed:
        w = F.create_map(*(F.lit(x) for kv in weighed.items() for x in kv))
        own = index.facet_bits().where((F.col("key") == "collection") & F.col("value").isin(list(weighed)))
        side.append(blocks.side_rows(own, blocks.WEIGHT, w[F.col("value")]))
    codes = asked.column("qid").combine_chunks().dictionary_encode().indices.to_numpy() // QUERIES if len(asked) else np.zeros(0, int)
    out = []
    for k in range(int(codes.max(initial=0)) + 1):
        own = asked.filter(pa.array(codes == k))
        made = _batch(index, own, limit, bits is not None, prefix, bonuses)
        if made is None:
            batch, wanted = _many(index, own, limit, bits is not None, prefix, bonuses)
            buckets = [r[0] for r in index.spark.createDataFrame(own.select(["term"]), "term string").select(blocks.bucket_of(F.col("term"), index.buckets)).distinct().collect()]
            rows = blocks.read_many(index.blocks, wanted, buckets, wanted.limit(MOST_TERMS + 1).count() <= MOST_TERMS)
            rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [rows, *side])
            # a fixed number of partitions: by the size of the rows alone too few tasks would score
            rows = rows.repartition(int(index.spark.conf.get("spark.sql.shuffle.partitions")), "block")
        else:
            batch, wanted, buckets = made
            rows = reduce(DataFrame.unionByName, [blocks.read_blocks(index.blocks, wanted, buckets), *side]).repartition("block")
        sent = index.spark.sparkContext.broadcast(batch)
        hits = rows.sortWithinPartitions("block", "t").mapInArrow(blocks.scorer(sent), "qid string, nid long, score double, n_matched int")
        places = index.numbered_stats.select("nid", "doc_id", "node_id", "doc_ord", "ord")
        out.append(hits.join(places, "nid").select("qid", "doc_id", "node_id", "doc_ord", "ord", "score", "n_matched"))
    return top(reduce(DataFrame.unionByName, out), limit)


def details(index: Index, terms: DataFrame, best: DataFrame, prefix: bool = True) -> DataFrame:
    """matched_terms and sorted match_positions of the best rows alone (Q09, Q13)."""
    few = index.postings.join(best.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_semi").select("term", "doc_id", "node_id", "positions")
    hits = few.join(term_matches(index, terms, prefix), "term").join(best.select("qid", "doc_id", "node_id"), ["qid", "doc_id", "node_id"], "left_semi")
    found = hits.groupBy("qid", "doc_id", "node_id").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("idx", "qterm"))), lambda x: x["qterm"]).alias("matched_terms"),
        F.array_sort(F.flatten(F.collect_list("positions"))).alias("match_positions"),
    )
    return best.join(found, ["qid", "doc_id", "node_id"])


def top(matches: DataFrame, limit: int) -> DataFrame:
    """The best rows of each query with their rank; scores equal to nine places tie and go by load order (Q15)."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_ord", "ord")
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (limit or 20))


def enrich(index: Index, best: DataFrame) -> DataFrame:
    """Titles, paths, facets and snippets of the top rows (Q14, Q16)."""
    node = index.nodes.select("doc_id", "node_id", F.col("title").alias("node_title"), "level", "content", *[c for c in ("kind",) if c in index.nodes.columns])
    doc = index.documents.select("doc_id", F.col("title").alias("doc_title"), "file_path", "collection", "facets", "references")
    rows = best.join(node, ["doc_id", "node_id"]).join(doc, "doc_id")
    return rows.withColumn("snippet", T.snippet(F.col("content"), F.col("match_positions"), F.col("node_title"))).drop("content")


def search_batch(index: Index, queries: DataFrame, limit: int = 20, filters: Filters | None = None, collection: str | None = None,
                 doc_id: str | None = None, prefix: bool = True, expand: bool = True, snippets: bool = True) -> DataFrame:
    """Search many queries (qid, query) at once; one row a result, with its rank."""
    terms = query_terms(index, queries, expand)  # as small as the queries; made anew for the longest, for scores and for details
    if snippets:
        _ = index.numbered_postings  # positions are wanted, so blocks are made of them
    found = best(index, terms, limit, filters, collection, doc_id, prefix)
    return enrich(index, details(index, terms, found, prefix)) if snippets else found


def search(index: Index, query: str, limit: int = 15, filters: Filters | None = None, collection: str | None = None, doc_id: str | None = None) -> DataFrame:
    """One query, 1 to 50 results in order (Q17)."""
    limit = min(max(limit, 1), 50)
    return search_batch(index, query_frame(index.spark, query), limit, filters, collection, doc_id).orderBy("rank")


SYMBOL_KINDS = ("class", "interface", "function", "method", "type", "enum", "variable")


def find_symbol(index: Index, query: str, kind: str | None = None, language: str | None = None, limit: int = 15, strict_kind: bool = False) -> DataFrame:
    """Search code; kind is a facet of documents unless strict_kind asks for nodes of that kind (Q18)."""
    if kind is not None and kind not in SYMBOL_KINDS:
        raise ValueError(f"kind must be one of {', '.join(SYMBOL_KINDS)}")
    filters = {"content_type": "code"} | ({"symbol_kind": kind} if kind else {}) | ({"language": language} if language else {})
    limit = min(max(limit, 1), 50)
    if not (strict_kind and kind):
        return search(index, query, limit, filters)
    terms = query_terms(index, query_frame(index.spark, query))
    own = index.nodes.where(F.col("kind") == kind).select("doc_id", "node_id")
    found = top(scored(index, terms, filters).join(own, ["doc_id", "node_id"], "left_semi"), limit)
    return enrich(index, details(index, terms, found)).orderBy("rank")


def similar_batch(index: Index, inputs: DataFrame, limit: int = 5, threshold: float = 0.1, duplicate_threshold: float = 0.35, collection: str | None = None,
                  most_tokens: int | None = None) -> DataFrame:
    """Documents like each text of inputs (qid, content): overlap of its distinct tokens of three letters, of the whole text unless most_tokens says how many.

    suggest_merge holds for a query if any result, before the threshold, overlaps by duplicate_threshold.
    """
    body = F.regexp_replace(F.coalesce("content", F.lit("")), r"(?s)\A---.*?\n---\n", "")
    toks = F.array_distinct(T.raw_tokens(body, 3))
    toks = toks if most_tokens is None else F.slice(toks, 1, most_tokens)
    q = inputs.select("qid", toks.alias("toks")).withColumn("n", F.size("toks"))
    found = search_batch(index, q.select("qid", F.array_join("toks", " ").alias("query")), max(3 * limit, 15), collection=collection, snippets=False)
    rows = found.join(q.select("qid", "n"), "qid").withColumn("overlap", F.least(F.lit(1.0), F.col("n_matched") / F.col("n")))
    rows = rows.withColumn("suggest_merge", F.max("overlap").over(Window.partitionBy("qid")) >= duplicate_threshold)
    w = Window.partitionBy("qid").orderBy("rank")
    kept = rows.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    titles = index.nodes.select("doc_id", "node_id", F.col("title"))
    return kept.join(titles, ["doc_id", "node_id"]).select("qid", "rank", "doc_id", "node_id", "title", "score", "overlap", "n_matched", "suggest_merge", "doc_ord", "ord")


def find_similar(index: Index, content: str, limit: int = 5, threshold: float = 0.1, duplicate_threshold: float = 0.35, collection: str | None = None) -> DataFrame:
    if not 0 <= threshold <= 10:
        raise ValueError("threshold must be from 0 to 10")
    one = index.spark.createDataFrame([("0", content)], "qid string, content string")
    return similar_batch(index, one, min(max(limit, 1), 20), threshold, duplicate_threshold, collection).orderBy("rank")
