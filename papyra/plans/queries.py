"""Queries over the data folder, one for each operator, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from papyra.functions import text as T
from papyra.operators import catalog, code, curate, entries, evaluate, glossary, indexing, markdown, search, tree
from papyra.operators import render as R
from papyra.operators.code import udtf
from papyra.plans import corpora as C
from papyra.plans import sql as S
from papyra.session import scratch_path
from papyra.sources import files, named

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put




THREE = [("a", "tion the heonth"), ("b", "edings ereth"), ("c", "nicht lich von")]
PAIR = [("x", "ention thereds"), ("y", "quement leur")]


def _best(df: DataFrame) -> DataFrame:
    return df.select("qid", "doc_id", "node_id", "rank", F.round("score", 6).alias("score"))


_BEST = "SELECT qid, doc_id, node_id, rank, round(score, 6) AS score FROM r"

# -- text and index ----------------------------------------------------------


@query("tokenize_counts", f"SELECT doc_id, len({S.tok('text')}) AS n_tokens, len(list_distinct({S.tok('text')})) AS n_distinct FROM documents")
def tokenize_counts(spark, d):
    t = T.raw_tokens(F.col("text"))
    return C.read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("stem_vocab", f"WITH allt AS (SELECT DISTINCT unnest({S.tok('text')}) AS t FROM documents), {S.STEMS} SELECT t AS token, s AS stem FROM st")
def stem_vocab(spark, d):
    v = C.read(spark, d, "documents").select(F.explode(T.raw_tokens(F.col("text"))).alias("token")).distinct()
    return v.select("token", T.stems(F.array("token"))[0].alias("stem"))


@query("vocab_df", f"WITH {S.postings('docs')} SELECT term, df FROM df")
def vocab_df(spark, d):
    return C.docs_index(spark, d).vocab.select("term", "df")


@query("postings_tf_positions", f"WITH {S.postings('conv')} SELECT term, doc_id, node_id, tf, array_to_string(positions, ',') AS positions FROM p")
def postings_tf_positions(spark, d):
    return C.conv_index(spark, d).postings.select("term", "doc_id", "node_id", F.col("tf").cast("long").alias("tf"), F.array_join("positions", ",").alias("positions"))


@query("posting_weights", f"WITH {S.postings('conv')} SELECT term, node_id, ht AS has_title, hd AS has_desc, hc AS has_code FROM p WHERE ht OR hd OR hc")
def posting_weights(spark, d):
    return C.conv_index(spark, d).postings.where("has_title OR has_desc OR has_code").select("term", "node_id", "has_title", "has_desc", "has_code")


@query("node_stats", f"WITH {S.postings('conv')} SELECT doc_id, node_id, total_tokens FROM ns")
def node_stats(spark, d):
    return C.conv_index(spark, d).node_stats.select("doc_id", "node_id", F.col("total_tokens").cast("long").alias("total_tokens"))


@query("corpus_stats", f"WITH {S.postings('docs')} SELECT n AS n_nodes, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS n_terms FROM c")
def corpus_stats(spark, d):
    i = C.docs_index(spark, d)
    return i.vocab.agg(F.count("*").alias("n_terms")).select(F.lit(i.n_nodes).cast("long").alias("n_nodes"), F.round(F.lit(i.avgdl), 6).alias("avgdl"), "n_terms")


_MARKED = f"list_transform(string_split(content, '[code:')[2:], lambda p: {S.tok("string_split(substr(p, position(']' IN p) + 1), chr(10) || chr(10))[1]")})"


@query("code_tokens", f"WITH n AS ({S.NODES['conv']}) SELECT node_id, len(list_distinct(flatten({_MARKED}))) AS n_code FROM n")
def code_tokens(spark, d):
    return C.conv_index(spark, d).nodes.select("node_id", F.size(T.code_tokens(F.col("content"))).cast("long").alias("n_code"))


# -- search ------------------------------------------------------------------


def _run(spark, index, rows, **how) -> DataFrame:
    prefix, bonuses, limit = how.pop("prefix", True), how.pop("bonuses", True), how.pop("limit", 20)
    q = search.query_terms(index, search.query_frame(spark, rows), how.pop("expand", False))
    more = how.pop("more", False)
    best = search.best(index, q, limit, prefix=prefix, bonuses=bonuses, **how)
    return search.details(index, q, best, prefix) if more else best


@query("bm25_exact", f"WITH {S.search('docs', S.values(THREE), prefix=False, bonus=False)} {_BEST}")
def bm25_exact(spark, d):
    return _best(_run(spark, C.docs_index(spark, d), THREE, prefix=False, bonuses=False))


@query("bm25_prefix", f"WITH {S.search('docs', S.values(PAIR), bonus=False)} {_BEST}")
def bm25_prefix(spark, d):
    return _best(_run(spark, C.docs_index(spark, d), PAIR, bonuses=False))


@query("bm25_bonus", f"WITH {S.search('docs', S.values(THREE), prefix=False)} {_BEST}")
def bm25_bonus(spark, d):
    return _best(_run(spark, C.docs_index(spark, d), THREE, prefix=False))


@query("bm25_full", f"WITH {S.search('docs', S.values(THREE))} {_BEST}")
def bm25_full(spark, d):
    return _best(_run(spark, C.docs_index(spark, d), THREE))


_BATCH = "SELECT CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark"


@query("bm25_batch", f"WITH {S.search('docs', _BATCH, limit=10)} {_BEST}")
def bm25_batch(spark, d):
    """Every token of each benchmark text is searched."""
    q = C.read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))
    return _best(search.search_batch(C.docs_index(spark, d), q, 10, expand=False, snippets=False))


@query("bm25_filtered", f"""WITH {S.search('docs', S.values(THREE), where="doc_id IN (SELECT 'docs:' || doc_id FROM documents WHERE lang IN ('fr', 'de') AND source IN ('src0', 'src1', 'src2', 'src3'))")} {_BEST}""")
def bm25_filtered(spark, d):
    return _best(_run(spark, C.docs_index(spark, d), THREE, filters={"lang": ["fr", "de"], "source": ["src0", "src1", "src2", "src3"]}))


@query("bm25_collection_scope", f"""WITH {S.search('docs', S.values(THREE), where="doc_ord % 2 = 1")} {_BEST}""")
def bm25_collection_scope(spark, d):
    return _best(_run(spark, C.docs_index(spark, d), THREE, collection="odd"))


@query("bm25_collection_weight", f"WITH {S.search('docs', S.values(THREE), weight='CASE WHEN doc_ord % 2 = 1 THEN 2.0 ELSE 0.5 END')} {_BEST}")
def bm25_collection_weight(spark, d):
    return _best(_run(spark, C.docs_index(spark, d).with_weights(odd=2.0, even=0.5), THREE))


@query("bm25_doc_scope", f"""WITH {S.search('conv', S.values(THREE), where="doc_id = 'conv:1'")} {_BEST}""")
def bm25_doc_scope(spark, d):
    return _best(_run(spark, C.conv_index(spark, d), THREE, doc_id="conv:1"))


@query("bm25_title_weight", f"WITH {S.search('conv', S.values([('t', 'user thention'), ('u', 'assistant von')]), title=7.0)} {_BEST}")
def bm25_title_weight(spark, d):
    return _best(_run(spark, C.conv_index(spark, d).with_ranking(title_weight=7.0), [("t", "user thention"), ("u", "assistant von")]))


@query("bm25_description_weight", f"WITH {S.search('conv', S.values([('t', 'the nicht'), ('u', 'les')]), desc=9.0)} {_BEST}")
def bm25_description_weight(spark, d):
    return _best(_run(spark, C.conv_index(spark, d).with_ranking(description_weight=9.0), [("t", "the nicht"), ("u", "les")]))


@query("bm25_code_weight", f"WITH {S.search('conv', S.values(THREE), code=4.0)} {_BEST}")
def bm25_code_weight(spark, d):
    return _best(_run(spark, C.conv_index(spark, d).with_ranking(code_weight=4.0), THREE))


@query("matched_terms", f"WITH {S.search('conv', S.values(THREE))} SELECT qid, node_id, array_to_string(matched, ' ') AS matched, array_to_string(pos, ',') AS positions FROM r")
def matched_terms(spark, d):
    return _run(spark, C.conv_index(spark, d), THREE, more=True).select("qid", "node_id", F.array_join("matched_terms", " ").alias("matched"), F.array_join("match_positions", ",").alias("positions"))


@query(
    "snippet_density",
    rf"""WITH {S.search('docs', S.values(THREE), prefix=False)},
w0 AS (SELECT r.qid, r.doc_id, content, title, string_split_regex(content, '\s+') AS ws, list_filter(pos, lambda z: z < len(string_split_regex(content, '\s+'))) AS v FROM r JOIN n USING (node_id)),
w1 AS (SELECT *, CASE WHEN content = '' THEN title ELSE content END AS body, list_transform(range(0, greatest(0, len(ws) - 30) + 1), lambda b: len(list_filter(v, lambda z: z >= b AND z < b + 30))) AS cnt FROM w0),
w2 AS (SELECT *, list_position(cnt, list_max(cnt)) - 1 AS bs FROM w1),
w3 AS (SELECT *, array_to_string(ws[bs + 1:bs + 30], ' ') AS sn, left(array_to_string(ws[bs + 1:bs + 30], ' '), 180) AS cut FROM w2),
w4 AS (SELECT *, CASE WHEN contains(cut, ' ') THEN length(cut) - position(' ' IN reverse(cut)) ELSE -1 END AS k FROM w3)
SELECT qid, doc_id, CASE WHEN len(v) = 0 OR content = '' THEN left(body, 180) || CASE WHEN length(body) > 180 THEN '…' ELSE '' END
ELSE CASE WHEN bs > 0 THEN '…' ELSE '' END || CASE WHEN length(sn) <= 180 THEN sn WHEN k > 126 THEN left(cut, k) ELSE cut END || CASE WHEN bs + 30 < len(ws) THEN '…' ELSE '' END END AS snippet
FROM w4""",
)
def snippet_density(spark, d):
    """Every top row, also those whose snippet is the head of the text."""
    i = C.docs_index(spark, d)
    return search.enrich(i, _run(spark, i, THREE, prefix=False, more=True)).select("qid", "doc_id", "snippet")


GLOSSARY = {"tion": ["ention heon"], "von": ["über"], "xq": ["thereds ereth", "lich"]}
_GL = "(VALUES ('tion', 'ention heon', 0), ('von', 'über', 1000), ('xq', 'thereds ereth', 2000), ('xq', 'lich', 2001), ('ention heon', 'tion', 1000000000), ('über', 'von', 1000001000), ('thereds ereth', 'xq', 1000002000), ('lich', 'xq', 1000002001)) gl(key, expansion, pos)"
_EXPANDED = rf"UNION ALL SELECT qid, o, s FROM (SELECT qid, i * 1000000 + row_number() OVER (PARTITION BY qid, i ORDER BY pos) AS o, unnest({S.tok('expansion')}) AS t FROM (SELECT qid, i, s FROM qt JOIN st USING (t)) z JOIN {_GL} ON z.s = gl.key) y JOIN st USING (t) WHERE length(s) >= 2"
_GLQ = [("a", "tion the"), ("b", "xq nicht"), ("c", "lich")]


@query("glossary_expand_search", f"WITH {S.search('docs', S.values(_GLQ + [('zz', 'ention heon thereds ereth über xq')]), prefix=False, extra=_EXPANDED)} {_BEST} WHERE qid <> 'zz'")
def glossary_expand_search(spark, d):
    return _best(_run(spark, C.docs_index(spark, d).with_glossary(GLOSSARY), _GLQ, prefix=False, expand=True))


_DEFINED = """p AS (SELECT p_partkey AS k, 'P' || (p_partkey % 40) AS a, lower(p_name) AS e FROM part WHERE p_name IS NOT NULL),
g AS (SELECT a, e FROM p WHERE k % 5 < 4 UNION ALL SELECT 'X' || a, e FROM p WHERE k % 5 = 3)"""


@query("glossary_extract", f"WITH {_DEFINED} SELECT a AS acronym, e AS expansion, count(*) AS n FROM g GROUP BY ALL")
def glossary_extract(spark, d):
    """Every pair with the number of its definitions."""
    return glossary.definitions(C.defined_texts(spark, d)).groupBy("acronym", "expansion").agg(F.count("*").alias("n"))


@query("glossary_automatic", f"WITH {_DEFINED} SELECT DISTINCT lower(a) AS key, e AS expansion FROM g UNION SELECT e, lower(a) FROM g")
def glossary_automatic(spark, d):
    """The glossary that building an index finds by itself."""
    return C.defined_index(spark, d).glossary.select("key", "expansion")


@query("glossary_both_ways", f"SELECT key, expansion FROM {_GL}")
def glossary_both_ways(spark, d):
    return glossary.both_ways(glossary.from_dict(spark, GLOSSARY)).select("key", "expansion")


# -- catalog -----------------------------------------------------------------

_DOC = "SELECT 'docs:' || doc_id AS doc_id, doc_id AS k, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, CASE WHEN doc_id % 2 = 1 THEN 'odd' ELSE 'even' END AS collection, 'Doc ' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS title FROM documents WHERE doc_id IS NOT NULL"


@query("list_filter_tag", f"WITH d AS ({_DOC}) SELECT doc_id FROM d WHERE contains(lang, 'e') AND collection = 'odd'")
def list_filter_tag(spark, d):
    return catalog.matching(C.docs_index(spark, d), tag="E", collection="odd").select("doc_id")


@query("list_filter_query", f"WITH d AS ({_DOC}) SELECT doc_id FROM d WHERE (contains(lower(title), 'src1') OR contains(lang || ' ' || source, 'src1') OR contains(lang || '/' || source || '/d' || k || '.md', 'src1')) AND lang IN ('fr', 'es')")
def list_filter_query(spark, d):
    return catalog.matching(C.docs_index(spark, d), query="SRC1", filters={"lang": ["fr", "es"]}).select("doc_id")


@query("list_page", f"WITH d AS ({_DOC}) SELECT doc_id, title FROM d WHERE collection = 'odd' ORDER BY title, k LIMIT 25 OFFSET 50")
def list_page(spark, d):
    i = C.docs_index(spark, d)
    return catalog.page(catalog.matching(i, collection="odd"), 25, 50).select("doc_id", "title")


_AMID = "SELECT doc_id, title, r - h AS place, n AS total FROM (SELECT doc_id, title, row_number() OVER (ORDER BY title, k) AS r, count(*) OVER () AS n, count(*) OVER () // 2 AS h FROM d) WHERE r > h AND r <= h + 25"


def _amid(spark, d, **which) -> DataFrame:
    """The page of 25 that begins after half of the documents, from ranges of some 50 titles; with their places in it."""
    index = C.docs_index(spark, d)
    pages = C.kept(spark, d, "pages", lambda *_: catalog.TitlePages.build(index.documents, 50))
    half = catalog.far_page(index, 1, 0, pages, **which)[1] // 2
    rows, total = catalog.far_page(index, 25, half, pages, **which)
    place = F.row_number().over(Window.orderBy("title", "doc_ord"))  # of the page's rows alone
    return rows.select("doc_id", "title", place.cast("long").alias("place"), F.lit(total).cast("long").alias("total"))


@query("list_page_far", f"WITH d AS (SELECT * FROM ({_DOC}) WHERE collection = 'odd') {_AMID}")
def list_page_far(spark, d):
    return _amid(spark, d, collection="odd")


@query("list_page_far_filtered", f"WITH d AS (SELECT * FROM ({_DOC}) WHERE lang IN ('fr', 'es')) {_AMID}")
def list_page_far_filtered(spark, d):
    return _amid(spark, d, filters={"lang": ["fr", "es"]})


_FACETS = "SELECT doc_id, 'lang' AS key, lang AS value FROM d UNION ALL SELECT doc_id, 'source', source FROM d UNION ALL SELECT doc_id, 'tags', lang FROM d UNION ALL SELECT doc_id, 'collection', collection FROM d"


@query("facet_counts", f"WITH d AS ({_DOC}), f AS ({_FACETS}) SELECT key, value, count(*) AS n FROM f GROUP BY ALL")
def facet_counts(spark, d):
    return catalog.facet_counts(C.docs_index(spark, d).documents)


@query("facet_filtered_counts", f"WITH d AS (SELECT * FROM ({_DOC}) WHERE lang = 'fr'), f AS ({_FACETS}) SELECT key, value, count(*) AS n FROM f GROUP BY ALL")
def facet_filtered_counts(spark, d):
    return catalog.facet_counts(catalog.matching(C.docs_index(spark, d), filters={"lang": "fr"}))


@query("get_facets", f"WITH d AS ({_DOC}), f AS ({_FACETS}) SELECT key, value, count(DISTINCT doc_id) AS n FROM f GROUP BY ALL")
def get_facets(spark, d):
    return catalog.get_facets(C.docs_index(spark, d))


@query("facet_rollup", f"WITH d AS ({_DOC}), f AS ({_FACETS}) SELECT key, value, count(DISTINCT doc_id) AS n FROM f GROUP BY ROLLUP (key, value)")
def facet_rollup(spark, d):
    return catalog.facet_rollup(C.docs_index(spark, d))


@query("facet_index", f"WITH d AS ({_DOC}), f AS ({_FACETS}) SELECT DISTINCT key, value, doc_id FROM f")
def facet_index(spark, d):
    return C.docs_index(spark, d).facets


@query(
    "store_stats",
    f"""WITH {S.postings('conv')}, w AS (SELECT doc_id, len(list_filter(string_split_regex(content, '\\s+'), lambda z: z <> '')) AS w FROM n)
SELECT (SELECT count(DISTINCT doc_id) FROM n) AS document_count, (SELECT n FROM c) AS total_nodes, (SELECT count(*) FROM df) AS indexed_terms,
(SELECT CAST(floor(avgdl + 0.5) AS BIGINT) FROM c) AS avg_node_length, 'conv' AS collections, 'collection' AS facet_keys""",
)
def store_stats(spark, d):
    s = catalog.stats(C.conv_index(spark, d))
    return s.select(
        "document_count", F.col("total_nodes").cast("long").alias("total_nodes"), "indexed_terms", F.col("avg_node_length").cast("long").alias("avg_node_length"),
        F.array_join("collections", ",").alias("collections"), F.array_join("facet_keys", ",").alias("facet_keys"),
    )


# -- trees -------------------------------------------------------------------


@query("tree_parent", f"WITH {S.GEO} SELECT node_id, parent_id FROM g")
def tree_parent(spark, d):
    return C.geo_index(spark, d).nodes.select("node_id", "parent_id")


@query(
    "tree_parent_turns",
    """SELECT 'conv:' || conv_id || ':n' || (turn + 1) AS node_id, CASE WHEN role = 'user' THEN NULL ELSE 'conv:' || conv_id || ':n' ||
(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1) END AS parent_id FROM conversations WHERE conv_id IS NOT NULL""",
)
def tree_parent_turns(spark, d):
    return C.conv_index(spark, d).nodes.select("node_id", "parent_id")


@query("tree_children", f"WITH {S.GEO} SELECT parent_id AS node_id, string_agg(node_id, ',' ORDER BY ord) AS children FROM g WHERE parent_id IS NOT NULL GROUP BY parent_id")
def tree_children(spark, d):
    return tree.children(C.geo_index(spark, d).nodes).select("node_id", F.array_join("children", ",").alias("children"))


@query("tree_outline", f"WITH {S.GEO} SELECT ord, node_id, title, level, words AS word_count FROM g WHERE doc_id = 'geo:2'")
def tree_outline(spark, d):
    return tree.outline(C.geo_index(spark, d), "geo:2").select(F.col("ord").cast("long").alias("ord"), "node_id", "title", "level", F.col("word_count").cast("long").alias("word_count"))


@query("tree_roots", f"WITH {S.GEO} SELECT doc_id, string_agg(node_id, ',' ORDER BY ord) AS root_nodes FROM g WHERE parent_id IS NULL GROUP BY doc_id")
def tree_roots(spark, d):
    return tree.roots(C.geo_index(spark, d).nodes).select("doc_id", F.array_join("root_nodes", ",").alias("root_nodes"))


_BFS = f"""WITH RECURSIVE {S.GEO}, t AS (SELECT node_id, doc_id, ord, words, 0 AS depth, node_id AS root FROM g WHERE level <= 2
UNION ALL SELECT g.node_id, g.doc_id, g.ord, g.words, depth + 1, root FROM g JOIN t ON g.parent_id = t.node_id)"""


def _all_subtrees(spark, d) -> DataFrame:
    n = C.geo_index(spark, d).nodes
    return tree.subtrees(n, n.where("level <= 2").select("doc_id", F.col("node_id").alias("root")))


@query("subtree_bfs", f"{_BFS} SELECT root, node_id, depth, row_number() OVER (PARTITION BY root ORDER BY depth, ord) AS place FROM t")
def subtree_bfs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("root").orderBy("depth", "ord")
    return _all_subtrees(spark, d).select("root", "node_id", "depth", F.row_number().over(w).cast("long").alias("place"))


@query("subtree_words", f"{_BFS} SELECT root, count(*) AS sections, CAST(sum(words) AS BIGINT) AS words FROM t GROUP BY root")
def subtree_words(spark, d):
    return _all_subtrees(spark, d).groupBy("root").agg(F.count("*").alias("sections"), F.sum("word_count").alias("words"))


@query("node_content_order", "SELECT * FROM (VALUES (0, 'geo:1:-1:-1'), (2, 'geo:1:1:-1'), (3, 'geo:1:-1:-1')) v(pos, node_id)")
def node_content_order(spark, d):
    return tree.node_content(C.geo_index(spark, d), "geo:1", ["geo:1:-1:-1", "none", "geo:1:1:-1", "geo:1:-1:-1"]).select("pos", "node_id")


@query(
    "resolve_ref",
    """WITH f AS (SELECT n_regionkey AS rk, min_by(n_name, n_nationkey) AS name, min(n_nationkey) AS nk FROM nation GROUP BY 1)
SELECT 'x/' || lower(r_name) || '.md#' || lower(name) AS ref, 'geo:' || rk AS doc_id, 'geo:' || rk || ':' || nk || ':-1' AS node_id FROM f JOIN region ON rk = r_regionkey
UNION ALL SELECT '../' || lower(r_name) || '.md', 'geo:' || r_regionkey, NULL FROM region UNION ALL SELECT lower(r_name) || '.md#none', 'geo:' || r_regionkey, NULL FROM region""",
)
def resolve_ref(spark, d):
    """Of each region: a reference to its first nation, one without a fragment, one to no node, one to no file."""
    first = C.read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.min_by("n_name", "n_nationkey").alias("name"))
    low = F.lower("r_name")
    each = F.array(F.concat(F.lit("x/"), low, F.lit(".md#"), F.lower("name")), F.concat(F.lit("../"), low, F.lit(".md")), F.concat(low, F.lit(".md#none")), F.concat(F.lit("no"), low, F.lit(".md")))
    refs = C.read(spark, d, "region").join(first, "r_regionkey").select(F.col("r_regionkey").cast("string").alias("k"), F.posexplode(each).alias("p", "ref"))
    return tree.resolve_refs(C.geo_index(spark, d), refs.select(F.concat_ws("-", "k", "p").alias("ref_id"), "ref")).select("ref", "doc_id", "node_id")


# -- markdown ----------------------------------------------------------------


@query("frontmatter_kv", f"""WITH {S.MD} SELECT doc_id, e.k AS key, e.v AS value FROM f, LATERAL (VALUES ('title', n), ('tags', lower(r) || '|nation'), ('category', 'geo'), ('order', CAST(f.k AS VARCHAR))) e(k, v) WHERE has""")
def frontmatter_kv(spark, d):
    files = C.md_files(spark, d).select(markdown.doc_id(F.lit("md"), F.col("file_path")).alias("doc_id"), markdown.frontmatter_map(markdown.frontmatter(F.col("text"))).alias("m"))
    return files.select("doc_id", F.explode("m").alias("key", "v")).select("doc_id", "key", F.array_join("v", "|").alias("value"))


_SECTIONS = f"""WITH {S.MD} SELECT doc_id, e.ord, e.title, e.level, e.l + CASE WHEN has THEN 0 ELSE 0 END AS line_start, e.parent FROM f,
LATERAL (VALUES (0, 'Overview', 1, 2, NULL), (1, 'Data', 2, 5, 'n1'), (2, 'Terms', 3, 11, 'n2')) e(ord, title, level, l, parent)"""


def _sections(spark, d, mode):
    return C.md_tables(spark, d, mode)[1].select("doc_id", "ord", "title", "level", "line_start", F.regexp_extract("parent_id", r":(n\d+)$", 1).alias("p")).select(
        "doc_id", "ord", "title", "level", "line_start", F.nullif("p", F.lit("")).alias("parent")
    )


@query("heading_sections", _SECTIONS)
def heading_sections(spark, d):
    return _sections(spark, d, "line")


@query("block_sections", _SECTIONS)
def block_sections(spark, d):
    return _sections(spark, d, "block")


@query("block_code_marks", f"""WITH {S.MD} SELECT doc_id, e.ord, e.content FROM f, LATERAL (VALUES (0, 'Nation ' || n || ' of ' || r || '. More about it.'),
(1, '[code:sql] select ' || k || chr(10) || 'See region and home or web.'), (2, 'NKB (Nation Key Book) and ' || n || ' here.')) e(ord, content)""")
def block_code_marks(spark, d):
    return C.md_tables(spark, d, "block")[1].select("doc_id", "ord", "content")


_MD_TITLE = "CASE WHEN has THEN n ELSE CASE folder WHEN 'guides' THEN 'Guides — Overview' WHEN 'ops/deploy' THEN 'Deploy — Overview' ELSE 'Misc — Overview' END END"


@query("title_resolve", f"WITH {S.MD} SELECT doc_id, {_MD_TITLE} AS title FROM f")
def title_resolve(spark, d):
    return C.md_tables(spark, d)[0].select("doc_id", "title")


@query("summary_first_sentence", f"WITH {S.MD} SELECT doc_id, 'Nation ' || n || ' of ' || r || '.' AS description FROM f")
def summary_first_sentence(spark, d):
    return C.md_tables(spark, d)[0].select("doc_id", "description")


@query("type_from_path", f"WITH {S.MD} SELECT doc_id, CASE folder WHEN 'guides' THEN 'guide' WHEN 'ops/deploy' THEN 'operations' END AS type FROM f")
def type_from_path(spark, d):
    return C.md_tables(spark, d)[0].select("doc_id", F.get(F.try_element_at("facets", F.lit("type")), F.lit(0)).alias("type"))


@query(
    "md_facets",
    f"""WITH {S.MD}, e AS (SELECT doc_id, 'has_code' AS key, 'true' AS value FROM f UNION ALL SELECT doc_id, 'code_languages', 'sql' FROM f UNION ALL SELECT doc_id, 'has_links', 'true' FROM f
UNION ALL SELECT doc_id, 'category', 'geo' FROM f WHERE has UNION ALL SELECT doc_id, 'order', CAST(k AS VARCHAR) FROM f WHERE has
UNION ALL SELECT doc_id, 'type', CASE folder WHEN 'guides' THEN 'guide' ELSE 'operations' END FROM f WHERE folder <> 'misc'
UNION ALL SELECT doc_id, 'tags', unnest([lower(r), 'nation']) FROM f WHERE has UNION ALL SELECT doc_id, 'collection', 'md' FROM f) SELECT doc_id, key, value FROM e""",
)
def md_facets(spark, d):
    return indexing.facets_of(C.md_tables(spark, d)[0]).select("doc_id", "key", "value")


@query(
    "reference_extract",
    f"""WITH {S.MD} SELECT doc_id, CASE folder WHEN 'ops/deploy' THEN 'ops/' ELSE '' END || lower(r) || '.md' || ',index.md' AS refs FROM f""",
)
def reference_extract(spark, d):
    return C.md_tables(spark, d)[0].select("doc_id", F.array_join("references", ",").alias("refs"))


@query("doc_totals", f"WITH {S.MD} SELECT doc_id, 3 AS heading_count, 3 AS max_depth FROM f")
def doc_totals(spark, d):
    return C.md_tables(spark, d)[0].select("doc_id", F.col("heading_count").cast("int").alias("heading_count"), "max_depth")


@query(
    "headless_files",
    """SELECT 'bare:b:p' || p_partkey AS doc_id, 'bare:b:p' || p_partkey || ':n1' AS node_id, '(document root)' AS title, 0 AS level, p_name || chr(10) || 'no heading of ' || p_partkey AS content, 2 AS line_end
FROM part WHERE p_name IS NOT NULL""",
)
def headless_files(spark, d):
    """A file without a heading is one root node with the whole text."""
    key = F.col("p_partkey").cast("string")
    rows = C.read(spark, d, "part").where("p_name IS NOT NULL").select(
        F.concat(F.lit("b/p"), key, F.lit(".md")).alias("file_path"), F.concat("p_name", F.lit("\nno heading of "), key).alias("text"), F.lit("bare").alias("collection"),
        F.lit("2024-01-02 03:04:05").cast("timestamp").alias("modified"), F.col("p_partkey").cast("long").alias("doc_ord"),
    )
    return markdown.index_markdown(rows)[1].select("doc_id", "node_id", "title", "level", "content", "line_end")


@query("html_titles", "SELECT p_partkey, p_brand || ' ' || p_name AS title FROM part")
def html_titles(spark, d):
    """Tags in a heading go, what they hold stays."""
    marked = F.concat(F.lit("<b class='x'>"), "p_brand", F.lit("</b> "), "p_name", F.lit("<br/> "))
    return C.read(spark, d, "part").select("p_partkey", T.strip_html(marked).alias("title"))


@query("topic_titles", "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(p_name, '[ _-]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part WHERE p_name IS NOT NULL")
def topic_titles(spark, d):
    joined = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.replace("p_name", F.lit(" "), F.lit("__")))
    return C.read(spark, d, "part").where("p_name IS NOT NULL").select("p_partkey", T.title_of_topic(joined).alias("title"))


_EXTENSIONS = ["py", "PYI", "ts", "mts", "cjs", "java", "go", "rs", "kt", "hpp", "rb", "zsh", "md", "txt", "json", ""]


@query("code_extensions", f"SELECT p_partkey, p_partkey % {len(_EXTENSIONS)} < 12 AS is_code FROM part")
def code_extensions(spark, d):
    ext = F.get(F.array(*map(F.lit, _EXTENSIONS)), (F.col("p_partkey") % len(_EXTENSIONS)).cast("int"))
    return C.read(spark, d, "part").select("p_partkey", code.is_code_file(F.concat(F.lit("a.b/f"), F.col("p_partkey").cast("string"), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))).alias("is_code"))


@query("glossary_term_list", f"WITH {_DEFINED} SELECT DISTINCT lower(a) AS key FROM g UNION SELECT e FROM g")
def glossary_term_list(spark, d):
    return glossary.terms(C.defined_index(spark, d).glossary)


@query("documents_listing", f"WITH d AS ({_DOC}) SELECT title || chr(10) || '  ' || doc_id || chr(10) || '  ' || lang || ' ' || source AS text FROM d WHERE collection = 'odd'")
def documents_listing(spark, d):
    return R.listing(catalog.matching(C.docs_index(spark, d), collection="odd"))


@query("slug_title", r"SELECT p_partkey, left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM part")
def slug_title(spark, d):
    return C.read(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


# -- curation ----------------------------------------------------------------

#: Distinct tokens of a text that SQL and code of find_similar, duplicate_flag, backlinks and facet_vote use; draft_entries uses all.
_FIRST = 200


def _sim(tokens: str) -> str:
    return rf"SELECT CAST(item_id AS VARCHAR) AS qid, array_to_string({tokens}, ' ') AS query, len({tokens}) AS nt FROM (SELECT item_id, list_transform(list_filter(list_zip({S.tok('text', 3)}, range(1, len({S.tok('text', 3)}) + 1)), lambda z: list_position({S.tok('text', 3)}, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_ordered FROM benchmark)"


_SIM, _SIM_WHOLE = _sim(f"list_slice(list_distinct_ordered, 1, {_FIRST})"), _sim("list_distinct_ordered")


def _similar(spark, d) -> DataFrame:
    items = C.read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("content"))
    return C.kept(spark, d, "similar", lambda s, x: indexing.write_table(search.similar_batch(C.docs_index(s, x), items, 5, most_tokens=_FIRST), "similar"))


def _like(sim: str) -> str:
    return f"""WITH {S.search('docs', f'SELECT qid, query FROM ({sim})', limit=15)}, nt AS (SELECT qid, nt FROM ({sim})),
ov AS (SELECT r.*, least(1.0, m / nt) AS overlap, max(least(1.0, m / nt)) OVER (PARTITION BY qid) >= 0.35 AS merge FROM r JOIN nt USING (qid)),
s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rk FROM ov WHERE score >= 0.1)"""


_SIMILAR = _like(_SIM)


@query("find_similar", f"{_SIMILAR} SELECT qid, rk AS rank, doc_id, round(score, 6) AS score, round(overlap, 6) AS overlap FROM s WHERE rk <= 5")
def find_similar(spark, d):
    return _similar(spark, d).select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"), F.round("overlap", 6).alias("overlap"))


@query("duplicate_flag", f"{_SIMILAR} SELECT qid, bool_or(merge) AS suggest_merge FROM s WHERE rk <= 5 GROUP BY qid")
def duplicate_flag(spark, d):
    return _similar(spark, d).groupBy("qid").agg(F.bool_or("suggest_merge").alias("suggest_merge"))


@query("backlinks", f"{_SIMILAR} SELECT qid, doc_id, min(rk) AS rank FROM s WHERE rk <= 5 GROUP BY ALL")
def backlinks(spark, d):
    return curate.backlinks(_similar(spark, d)).select("qid", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(
    "facet_vote",
    f"""{_SIMILAR}, v AS (SELECT qid, coalesce(lang, 'none') AS tag, count(*) AS n, min(rk) AS seen FROM s JOIN documents ON s.doc_id = 'docs:' || documents.doc_id WHERE rk <= 5 GROUP BY ALL)
SELECT qid, string_agg(tag, ',' ORDER BY n DESC, seen) AS tags FROM v GROUP BY qid""",
)
def facet_vote(spark, d):
    return curate.facet_vote(C.docs_index(spark, d), _similar(spark, d)).select("qid", F.array_join("tags", ",").alias("tags"))


@query(
    "glossary_hits",
    f"""SELECT CAST(item_id AS VARCHAR) AS qid, key FROM benchmark, (SELECT DISTINCT key FROM {_GL}) g
WHERE CASE WHEN contains(key, ' ') THEN contains(lower(text), key) ELSE list_contains(regexp_extract_all(lower(text), '[0-9A-Za-z_]+'), key) OR (key = 'über' AND regexp_matches(lower(text), '(^|[^0-9a-zA-Z_üäöß])über([^0-9a-zA-Z_äöüß]|$)')) END""",
)
def glossary_hits(spark, d):
    items = C.read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("content"))
    return curate.glossary_hits(C.docs_index(spark, d).with_glossary(GLOSSARY), items).select("qid", "key")


_PART_KEYS = """k AS (SELECT DISTINCT lower(w) AS key FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE length(w) >= 2
UNION SELECT DISTINCT left(lower(text), 14) FROM documents WHERE doc_id % 10 = 3 AND regexp_matches(left(lower(text), 14), '[ ]') UNION SELECT DISTINCT lower(w) FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE regexp_matches(w, '^[A-Za-z_0-9]{2,}$'))"""


def _document_keys(spark, d) -> DataFrame:
    """Words of parts and benchmark texts, and beginnings of documents that hold a blank."""
    words = C.read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("key"))
    texts = C.read(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("key")).where(F.col("key").rlike("^[A-Za-z_0-9]{2,}$"))
    heads = C.read(spark, d, "documents").where("doc_id % 10 = 3").select(F.left(F.lower("text"), F.lit(14)).alias("key")).where(F.contains("key", F.lit(" ")))
    return words.unionByName(texts).unionByName(heads).select(F.lower("key").alias("key")).distinct().select("key", F.lit("x").alias("expansion"), F.lit(0).cast("long").alias("pos"))


@query(
    "glossary_hits_documents",
    f"""WITH {_PART_KEYS}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z_]+')) AS key FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS qid, key FROM w JOIN k USING (key)
UNION SELECT CAST(doc_id AS VARCHAR), key FROM documents JOIN k ON contains(lower(text), key) WHERE contains(key, ' ')""",
)
def glossary_hits_documents(spark, d):
    """Whole documents against some thousand keys; the keys are words of letters and digits, and phrases."""
    i = C.docs_index(spark, d).but(glossary=_document_keys(spark, d).where(F.col("key").rlike("^[a-z_0-9]{2,}$| ")))
    texts = C.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("qid"), F.col("text").alias("content"))
    return curate.glossary_hits(i, texts)


# -- maintenance -------------------------------------------------------------


def _maintained(spark, d, what) -> indexing.Index:
    def make(s, x):
        i = C.conv_index(s, x)
        gone = i.documents.where(F.col("doc_ord") % 5 == 0).select("doc_id")
        if what == "remove":
            return i.remove(gone)
        docs = i.documents.join(gone, "doc_id", "left_semi").withColumn("description", F.lit("fresh words"))
        nodes = i.nodes.join(gone, "doc_id", "left_semi").withColumn("content", F.concat(F.lit("freshly put "), "content"))
        return i.upsert(docs, nodes)

    return C.kept(spark, d, what, make)


@query(
    "remove_docs",
    f"WITH {S.postings('conv').replace('FROM conversations WHERE', 'FROM conversations WHERE conv_id % 5 <> 0 AND')} SELECT term, df, (SELECT n FROM c) AS n_nodes, (SELECT round(avgdl, 6) FROM c) AS avgdl FROM df",
)
def remove_docs(spark, d):
    i = _maintained(spark, d, "remove")
    return i.vocab.select("term", "df", F.lit(i.n_nodes).cast("long").alias("n_nodes"), F.round(F.lit(i.avgdl), 6).alias("avgdl"))


@query(
    "upsert_docs",
    "WITH "
    + S.postings("conv").replace("CASE WHEN turn % 3 = 1 THEN '[code:x] ' ELSE '' END", "CASE WHEN conv_id % 5 = 0 THEN 'freshly put ' ELSE '' END || CASE WHEN turn % 3 = 1 THEN '[code:x] ' ELSE '' END")
    + " SELECT term, df, (SELECT n FROM c) AS n_nodes, (SELECT round(avgdl, 6) FROM c) AS avgdl FROM df",
)
def upsert_docs(spark, d):
    i = _maintained(spark, d, "upsert")
    return i.vocab.select("term", "df", F.lit(i.n_nodes).cast("long").alias("n_nodes"), F.round(F.lit(i.avgdl), 6).alias("avgdl"))


@query("changed_docs", "SELECT 'p' || doc_id AS file_path FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0")
def changed_docs(spark, d):
    new = C.read(spark, d, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("file_path"), F.lower(F.hex(F.xxhash64("text"))).alias("content_hash"), "doc_id")
    old = new.where("doc_id % 7 <> 0").select("file_path", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))
    return indexing.changed(new, old).select("file_path")


@query("last_wins", "SELECT doc_id % 100 AS doc_id, max(doc_id) AS kept, min(doc_id) AS doc_ord FROM documents GROUP BY 1")
def last_wins(spark, d):
    rows = C.read(spark, d, "documents").select((F.col("doc_id") % 100).alias("doc_id"), F.col("doc_id").alias("kept"), F.col("doc_id").alias("doc_ord"))
    return indexing.last_wins(rows)


@query(
    "last_file_wins",
    """WITH f AS (SELECT p_partkey AS k, coalesce(p_name, '') AS name, p_partkey % 3 = 0 AS late FROM part)
SELECT 'twice:parts:p' || k || ':n' || e.ord AS node_id, k AS doc_ord, e.title AS title, CASE e.ord WHEN 1 THEN CASE WHEN late THEN 'later ' ELSE 'earlier ' END || name WHEN 2 THEN CASE WHEN late THEN 'newzz words' ELSE 'gonezz words' END ELSE 'more' END AS content
FROM f, LATERAL (VALUES (1, 'Part ' || k), (2, CASE WHEN late THEN 'New' ELSE 'Old' END), (3, 'Older')) e(ord, title) WHERE NOT late OR e.ord < 3""",
)
def last_file_wins(spark, d):
    """Nodes of an index over two folders with the same paths."""
    return C.twice_index(spark, d).nodes.select("node_id", "doc_ord", "title", F.regexp_replace("content", r"\s+$", "").alias("content"))


@query(
    "last_file_terms",
    """WITH f AS (SELECT p_partkey % 3 = 0 AS late FROM part)
SELECT e.term, e.n AS df FROM LATERAL (VALUES ('earlier', (SELECT count(*) FROM f WHERE NOT late)), ('later', (SELECT count(*) FROM f WHERE late)), ('gonezz', (SELECT count(*) FROM f WHERE NOT late)), ('newzz', (SELECT count(*) FROM f WHERE late))) e(term, n)""",
)
def last_file_terms(spark, d):
    """How many nodes hold a word that only one of the two files of a path has."""
    return C.twice_index(spark, d).vocab.where(F.col("term").isin("earlier", "later", "gonezz", "newzz")).select("term", "df")


@query(
    "last_file_search",
    """SELECT p_partkey AS doc_ord, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1""",
)
def last_file_search(spark, d):
    """A search for a word of the later files finds each of their nodes once."""
    i = C.twice_index(spark, d)
    found = search.scored(i, search.query_terms(i, search.query_frame(spark, "later")), prefix=False)
    return found.groupBy("doc_ord").agg(F.count("*").alias("n"))


@query(
    "named_files",
    """SELECT 'p' || (p_partkey % 9) || '/n' || p_partkey || '.md' AS file_path, '# ' || p_name || chr(13) || chr(10) || p_partkey AS text FROM part WHERE p_name IS NOT NULL AND p_partkey IS NOT NULL""",
)
def named_files(spark, d):
    """A file a part written by the data source, and read back by it with its name."""
    key = F.col("p_partkey").cast("string")
    part = C.read(spark, d, "part").where("p_name IS NOT NULL AND p_partkey IS NOT NULL").select("p_partkey", "p_name")
    rows = C.dealt(part, "p_partkey").select(
        F.concat(F.lit("p"), (F.col("p_partkey") % 9).cast("string"), F.lit("/n"), key, F.lit(".md")).alias("file_path"), F.concat(F.lit("# "), "p_name", F.lit("\r\n"), key).alias("text")
    )

    def make(s, x):
        path = scratch_path(s, "named")
        files.write_markdown(rows, path)
        return s.read.format("named_files").option("glob", "*.md").load(path)

    return C.kept(spark, d, "named", make).select("file_path", "text")


@query(
    "path_types",
    f"""SELECT p_partkey, e.type FROM part JOIN (VALUES {", ".join(f"({k}, '{t}')" for k, (_, t) in enumerate(T.PATH_TYPES))}) e(k, type) ON e.k = p_partkey % {len(T.PATH_TYPES)}""",
)
def path_types(spark, d):
    """Every type that a folder's name can tell."""
    names = ["runbooks", "user-guide", "Tutorials/a", "reference", "api-docs", "architectural", "adr", "rfcs/x", "procedures", "playbook", "troubleshooting", "faq", "changelogs", "release_notes", "howto", "ops", "deployments", "pipelines", "onboarding", "postmortems"]
    path = F.concat(F.lit("docs/"), F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int")), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".md"))
    return C.read(spark, d, "part").select("p_partkey", T.type_of_path(path).alias("type"))


@query("ref_map", "SELECT lower(r_name) || '.md' AS basename, 'geo:' || r_regionkey AS doc_id FROM region")
def ref_map(spark, d):
    return C.geo_index(spark, d).refs


# -- evaluation --------------------------------------------------------------


def _judged(spark, d) -> tuple[DataFrame, DataFrame]:
    """Documents ranked by id within (lang); relevance is quality * 2 + toxic."""
    from pyspark.sql import Window

    docs = C.read(spark, d, "documents").select("doc_id", F.col("lang").alias("qid"))
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id"))).select("qid", F.col("doc_id").alias("item"), "rank")
    rels = C.read(spark, d, "labels").join(docs, "doc_id").select("qid", F.col("doc_id").alias("item"), (F.col("quality") * 2 + F.col("toxic")).alias("relevance"))
    return ranked, rels


_JUDGED = """ranked AS (SELECT lang AS qid, doc_id AS item, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents),
rels AS (SELECT lang AS qid, doc_id AS item, quality * 2 + toxic AS relevance FROM labels JOIN documents USING (doc_id))"""


@query(
    "ndcg_at_10",
    f"""WITH {_JUDGED}, g AS (SELECT qid, sum(relevance / log2(rank + 1)) AS dcg FROM ranked JOIN rels USING (qid, item) WHERE rank <= 10 GROUP BY qid),
i AS (SELECT qid, sum(relevance / log2(r + 1)) AS ideal FROM (SELECT qid, relevance, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC) AS r FROM rels) WHERE r <= 10 GROUP BY qid)
SELECT qid, round(CASE WHEN ideal = 0 THEN 1.0 ELSE coalesce(dcg, 0) / ideal END, 6) AS ndcg FROM i LEFT JOIN g USING (qid)""",
)
def ndcg_at_10(spark, d):
    return evaluate.ndcg(*_judged(spark, d)).select("qid", F.round("ndcg", 6).alias("ndcg"))


@query("mrr", f"WITH {_JUDGED}, f AS (SELECT qid, min(CASE WHEN relevance >= 3 THEN rank END) AS r FROM ranked JOIN rels USING (qid, item) GROUP BY qid) SELECT round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM f")
def mrr(spark, d):
    return evaluate.mrr(*_judged(spark, d), 3).select(F.round("mrr", 6).alias("mrr"))


@query("hit_at_k", f"WITH {_JUDGED}, w AS (SELECT qid, max(item) AS item FROM rels WHERE relevance = 2 GROUP BY qid) SELECT w.qid, coalesce(rank <= 100, false) AS hit FROM w LEFT JOIN ranked USING (qid, item)")
def hit_at_k(spark, d):
    ranked, rels = _judged(spark, d)
    return evaluate.hit_at(ranked, rels.where("relevance = 2").groupBy("qid").agg(F.max("item").alias("item")).withColumn("k", F.lit(100)))


@query("resolve_qrels", f"WITH {S.GEO} SELECT lower(title) AS qid, node_id AS item, 2 AS relevance FROM g WHERE level = 2")
def resolve_qrels(spark, d):
    i = C.geo_index(spark, d)
    asked = i.nodes.where("level = 2").join(i.documents.select("doc_id", F.col("title").alias("dt")), "doc_id").select(F.lower("title").alias("qid"), "dt", "title")
    return evaluate.resolve_qrels(i, asked.select("qid", F.col("dt").alias("doc_title"), F.col("title").alias("node_title"), F.lit(2).alias("relevance")))


@query(
    "qrel_steps",
    f"""WITH {S.GEO}, c AS (SELECT 'geo:' || rk AS doc_id, 'geo:' || rk || ':' || nk || ':' || sk AS node_id, lower(content) AS content FROM g0),
j AS (SELECT node_id || '/' || e.k AS qid, doc_id, e.want FROM g, LATERAL (VALUES ('equal', lower(title)), ('begins', lower(left(title, 4))), ('holds', lower(title[3:6])), ('text', 'supplier ' || lower(title)), ('none', 'zz' || node_id)) e(k, want)),
s AS (SELECT j.qid, g.node_id, g.ord, CASE WHEN lower(title) = want THEN 1 WHEN starts_with(lower(title), want) THEN 2 WHEN contains(lower(title), want) THEN 3 WHEN contains(c.content, want) THEN 4 WHEN ord = 0 THEN 5 END AS step
  FROM j JOIN g USING (doc_id) JOIN c USING (node_id))
SELECT qid, arg_min(node_id, step * 1000000 + ord) AS item FROM s WHERE step IS NOT NULL GROUP BY qid""",
)
def qrel_steps(spark, d):
    """Judgements that resolve by each of the five steps."""
    i = C.geo_index(spark, d)
    t = F.lower("title")
    wants = {"equal": t, "begins": F.lower(F.left("title", F.lit(4))), "holds": F.lower(F.substring("title", 3, 4)), "text": F.concat(F.lit("supplier "), t), "none": F.concat(F.lit("zz"), "node_id")}
    each = F.array(*(F.struct(F.lit(k).alias("k"), w.alias("want")) for k, w in wants.items()))
    asked = i.nodes.join(i.documents.select("doc_id", F.col("title").alias("dt")), "doc_id").select("node_id", F.lower("dt").alias("doc_title"), F.explode(each).alias("e"))
    judged = asked.select(F.concat_ws("/", "node_id", "e.k").alias("qid"), "doc_title", F.col("e.want").alias("node_title"), F.lit(1).alias("relevance"))
    return evaluate.resolve_qrels(i, judged).select("qid", "item")


# -- code --------------------------------------------------------------------

_CODE = r"""
k AS (SELECT r_regionkey AS rk, regexp_replace(upper(left(r_name, 1)) || lower(r_name[2:]), '[^A-Za-z]', '', 'g') AS c0, r_name FROM region),
k1 AS (SELECT rk, CASE WHEN r_name = 'MIDDLE EAST' THEN 'MiddleEast' ELSE c0 END AS c FROM k),
ms AS (SELECT n_regionkey AS rk, regexp_replace(lower(n_name), '[^a-z0-9]', '_', 'g') AS m, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation),
sy AS (SELECT rk, 0 AS ord, 'import' AS kind, 'imports' AS name, false AS exported, 1 AS line_start, NULL AS parent_ord FROM k1
  UNION ALL SELECT rk, 1, 'class', c, true, 5, NULL FROM k1 UNION ALL SELECT rk, 1 + i, 'method', m, true, 3 + 3 * i, 1 FROM ms
  UNION ALL SELECT rk, 2 + n, 'variable', 'LIMIT', true, 8 + 3 * n - 1, NULL FROM k1 JOIN (SELECT DISTINCT rk, n FROM ms) USING (rk)
  UNION ALL SELECT rk, 3 + n, 'function', 'load_' || lower(c), true, 8 + 3 * n + 2, NULL FROM k1 JOIN (SELECT DISTINCT rk, n FROM ms) USING (rk))
"""


@query("code_symbols", f"WITH {_CODE} SELECT rk AS doc_ord, ord, kind, name, exported, parent_ord FROM sy")
def code_symbols(spark, d):
    files = C.code_files(spark, d).withColumn("doc_id", F.col("file_path"))
    return code.parse_symbols(files).select("doc_ord", F.col("ord").cast("long").alias("ord"), "kind", "name", "exported", "parent_ord")


@query("code_nodes", f"WITH {_CODE} SELECT 'code:src:' || lower(c) || '_py' AS doc_id, ord, CASE kind WHEN 'import' THEN name ELSE kind || ' ' || name END AS title, CASE WHEN kind = 'method' THEN 2 ELSE 1 END AS level FROM sy JOIN k1 USING (rk)")
def code_nodes(spark, d):
    return C.code_index(spark, d).nodes.select("doc_id", F.col("ord").cast("long").alias("ord"), "title", "level")


@query("code_description", f"WITH {_CODE} SELECT 'code:src:' || lower(c) || '_py' AS doc_id, '1 classes: ' || c || '; 1 functions: load_' || lower(c) AS description FROM k1")
def code_description(spark, d):
    return C.code_index(spark, d).documents.select("doc_id", "description")


@query(
    "code_facets",
    f"""WITH {_CODE} SELECT 'code:src:' || lower(c) || '_py' AS doc_id, e.key, e.value FROM k1, (VALUES ('language', 'python'), ('content_type', 'code'), ('symbol_kind', 'class'), ('symbol_kind', 'function'), ('symbol_kind', 'method'), ('symbol_kind', 'variable'), ('collection', 'code')) e(key, value)""",
)
def code_facets(spark, d):
    return C.code_index(spark, d).facets.where("key <> 'tags'").select("doc_id", "key", "value")


@query("code_tags", f"WITH {_CODE} SELECT 'code:src:' || lower(c) || '_py' AS doc_id, string_agg(name, ',' ORDER BY ord) AS tags FROM sy JOIN k1 USING (rk) WHERE kind <> 'import' AND ord <= 20 GROUP BY 1")
def code_tags(spark, d):
    return C.code_index(spark, d).documents.select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("find_symbol_strict", f"WITH {_CODE} SELECT 'code:src:' || lower(c) || '_py:n' || (ord + 1) AS node_id FROM sy JOIN k1 USING (rk) WHERE kind = 'method' AND starts_with(name, (SELECT left(min(m), 3) FROM ms))")
def find_symbol_strict(spark, d):
    """Methods whose name begins as the first nation's does, found by prefix."""
    first = C.read(spark, d, "nation").agg(F.min(F.left(F.regexp_replace(F.lower("n_name"), "[^a-z0-9]", "_"), F.lit(3)))).first()[0]
    return search.find_symbol(C.code_index(spark, d), first or "none", "method", "python", 50, strict_kind=True).select("node_id")


@query("find_symbol")
def find_symbol(spark, d):
    return search.find_symbol(C.code_index(spark, d), "load japan", language="python").select("rank", "node_id", "node_title", F.round("score", 6).alias("score"))


# what the parsers find in the files of `many_files`, by language: kind, name before the key, exported, first and last line, place of the parent
_FOUND = {
    "ts": [("import", "imports", False, 1, 1, None), ("class", "C", True, 2, 6, None), ("method", "run", False, 3, 5, 1), ("function", "go", True, 7, 7, None)],
    "cts": [("interface", "I", True, 1, 3, None), ("property", "size", False, 2, 2, 0), ("enum", "E", False, 4, 4, None), ("function", "load", True, 5, 8, None)],
    "java": [("import", "imports", False, 1, 2, None), ("class", "J", True, 4, 8, None), ("method", "run", True, 5, 7, 1)],
    "go": [("class", "S", True, 3, 5, None), ("method", "Run", True, 7, 9, 0), ("variable", "constants", False, 11, 13, None), ("function", "make", False, 15, 17, None)],
    "rs": [("class", "P", True, 2, 4, None), ("method", "new", True, 6, 8, 0), ("function", "f", False, 10, 11, None)],
    "py": [("import", "imports", False, 1, 1, None), ("class", "A", True, 3, 6, None), ("method", "run", True, 4, 6, 1), ("variable", "TOP", True, 8, 8, None), ("function", "_f", False, 10, 11, None)],
    "rb": [("import", "imports", False, 1, 1, None), ("class", "R", True, 3, 6, None), ("method", "run", True, 4, 5, 1)],
    "cpp": [("import", "imports", False, 1, 1, None), ("class", "Q", False, 3, 5, None), ("function", "calc", True, 6, 8, None)],
}
_FOUND_ROWS = ", ".join(
    f"('{x}', {k}, '{kind}', '{name}', {str(out).lower()}, {a}, {z}, {'NULL' if up is None else up})" for x, rows in _FOUND.items() for k, (kind, name, out, a, z, up) in enumerate(rows)
)


@query(
    "symbols_by_language",
    f"""SELECT p_partkey AS doc_ord, e.ord, e.kind, e.name || CASE WHEN e.name IN ('imports', 'constants', 'run', 'Run', 'size', 'new') THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS name, e.exported, e.line_start, e.line_end, e.parent_ord
FROM part JOIN (VALUES {_FOUND_ROWS}) e(ext, ord, kind, name, exported, line_start, line_end, parent_ord) ON e.ext = ['{"', '".join(C.MANY)}'][p_partkey % {len(C.MANY)} + 1]""",
)
def symbols_by_language(spark, d):
    files = C.many_files(spark, d).withColumn("doc_id", F.col("file_path"))
    return code.parse_symbols(files).select("doc_ord", "ord", "kind", "name", "exported", "line_start", "line_end", "parent_ord")


@query("symbols_by_sql", SQL["symbols_by_language"])
def symbols_by_sql(spark, d):
    """The same by SQL text: the parsers as a table function over a column of sources."""
    udtf.register(spark)
    C.many_files(spark, d).createOrReplaceTempView("papyra_sources")
    return spark.sql(
        "SELECT f.doc_ord, s.ord, s.kind, s.name, s.exported, s.line_start, s.line_end, s.parent_ord FROM papyra_sources f, LATERAL code_symbols(f.file_path, f.text) s"
    )


@query(
    "sections_by_sql",
    """WITH f AS (SELECT p_partkey AS k, coalesce(p_name, '') AS name, false AS late FROM part UNION ALL SELECT p_partkey, coalesce(p_name, ''), true FROM part WHERE p_partkey % 3 = 0)
SELECT CASE WHEN late THEN k + 1099511627776 ELSE k END AS doc_ord, e.ord, e.level, e.title, e.content, e.a AS line_start, e.z AS line_end
FROM f, LATERAL (VALUES (0, 1, 'Part ' || k, CASE WHEN late THEN 'later ' ELSE 'earlier ' END || name, 1, 3), (1, 2, CASE WHEN late THEN 'New' ELSE 'Old' END, CASE WHEN late THEN 'newzz words' ELSE 'gonezz words' END, 4, CASE WHEN late THEN 6 ELSE 6 END), (2, 2, 'Older', 'more', 7, 9)) e(ord, level, title, content, a, z)
WHERE NOT late OR e.ord < 2""",
)
def sections_by_sql(spark, d):
    """Sections of markdown texts by SQL, from a table function."""
    udtf.register(spark)
    C.twice_files(spark, d).createOrReplaceTempView("papyra_texts")
    return spark.sql("SELECT f.doc_ord, s.ord, s.level, s.title, s.content, s.line_start, s.line_end FROM papyra_texts f, LATERAL markdown_sections(f.text) s")


@query("symbol_stats", f"WITH {_CODE}, p AS (SELECT rk, count(*) AS n FROM sy GROUP BY rk) SELECT count(*) AS files, avg(n) AS avg_nodes, max(n) AS max_nodes, 0 AS import_only_files FROM p")
def symbol_stats(spark, d):
    return evaluate.index_stats(C.code_index(spark, d).nodes).select("files", "avg_nodes", "max_nodes", F.col("import_only_files").cast("int").alias("import_only_files"))


# nodes of a file of each language, by the kinds of _FOUND
_KINDS = f"""k AS (SELECT p_partkey, e.ext, e.ord, e.kind, e.name, p_partkey % {len(C.MANY)} AS turn FROM part JOIN (VALUES {_FOUND_ROWS}) e(ext, ord, kind, name, exported, line_start, line_end, parent_ord) ON e.ext = ['{"', '".join(C.MANY)}'][p_partkey % {len(C.MANY)} + 1])"""


def _many_benchmark(spark, d) -> evaluate.Benchmark:
    return C.kept(spark, d, "many-benchmark", lambda s, x: evaluate.benchmark(C.many_files(s, x).withColumn("kind", F.lit("code"))))


@query("kinds_and_files", f"WITH {_KINDS} SELECT kind, count(*) AS n, count(DISTINCT p_partkey) AS files FROM k WHERE kind <> 'import' GROUP BY kind")
def kinds_and_files(spark, d):
    i = _many_benchmark(spark, d).index
    return evaluate.kind_table(i.documents, i.nodes)


@query("files_by_language", "SELECT ['typescript', 'typescript', 'java', 'go', 'rust', 'python', 'ruby', 'cpp'][p_partkey % 8 + 1] AS language, count(*) AS files FROM part GROUP BY 1")
def files_by_language(spark, d):
    return evaluate.language_table(_many_benchmark(spark, d).index.documents)


@query(
    "nodes_per_file",
    f"""WITH {_KINDS}, per AS (SELECT p_partkey, count(*) AS n FROM k GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS c FROM per)
SELECT count(*) AS files, round(avg(n), 6) AS avg_nodes, max(CASE WHEN r = c // 2 + 1 THEN n END) AS median_nodes, max(n) AS max_nodes, 0 AS empty_files, 0 AS import_only_files FROM o""",
)
def nodes_per_file(spark, d):
    i = _many_benchmark(spark, d).index
    return evaluate.index_stats(i.nodes, i.documents).withColumn("avg_nodes", F.round("avg_nodes", 6)).withColumns({c: F.col(c).cast("int") for c in ("empty_files", "import_only_files")})


@query(
    "sample_files",
    f"""WITH {_KINDS}, per AS (SELECT p_partkey, ext, count(*) AS n FROM k GROUP BY ALL)
SELECT 'many/p' || p_partkey || '.' || ext AS file_path, n FROM per ORDER BY n DESC, p_partkey LIMIT 10""",
)
def sample_files(spark, d):
    i = _many_benchmark(spark, d).index
    return evaluate.sample_files(i.documents, i.nodes).select("file_path", "n")


@query("kind_counts", f"WITH {_CODE} SELECT kind, count(*) AS n FROM sy GROUP BY kind")
def kind_counts(spark, d):
    return evaluate.kind_counts(C.code_index(spark, d).nodes)


# -- rendering ---------------------------------------------------------------


@query("render_outline", f"WITH {S.GEO} SELECT ord, repeat('  ', level - 1) || '- ' || title || ' [' || node_id || '] (' || words || ' words)' AS text FROM g WHERE doc_id = 'geo:2'")
def render_outline(spark, d):
    return R.outline(C.geo_index(spark, d).nodes.where("doc_id = 'geo:2'")).select(F.col("ord").cast("long").alias("ord"), "text")


@query("render_badge", f"WITH {S.MD} SELECT doc_id, ' [code: sql | has_links]' AS badge FROM f")
def render_badge(spark, d):
    return C.md_tables(spark, d)[0].select("doc_id", R.badge(F.col("facets")).alias("badge"))


@query("reference_lines", "SELECT 'geo:' || r_regionkey AS doc_id, (SELECT 'geo/asia.md#japan → geo:' || r_regionkey FROM region WHERE r_name = 'ASIA') || ', ' || (SELECT '../europe.md → geo:' || r_regionkey FROM region WHERE r_name = 'EUROPE') AS line FROM region")
def reference_lines(spark, d):
    i = C.geo_index(spark, d)
    return R.reference_lines(i, i.documents)


@query("render_results")
def render_results(spark, d):
    i = C.geo_index(spark, d)
    return R.results(i, search.search_batch(i, search.query_frame(spark, [("j", "japan supplier")]), 5))


# -- entries -----------------------------------------------------------------

# @ stands for the key of a part, and ~ for its name
_PATHS = ["a/b/n@.md", "./x//n@.md", "a/../n@.md", "../n@.md", "a/../../n@.md", "/n@.md", "C:/n@.md", "n@.txt", "", "../entries/n@.md", "a/b/../../c/./n@.md", "n@.MD", "a/../../../entries/n@.md"]
_METAS = [
    '{"title":"~","order":@,"tags":["~"," n@ ",7]}', '{"title":"say \\"~\\" #@","draft":true,"none":null}', '{"a b":"~"}', '{"note":"~\\n@"}', '{"deep":{"k":"~"}}', '{"flags":[true]}', '["~"]',
    '{"half":@.5,"whole":@.0,"br":"]~","empty":[]}', '{"title":"~"', '{"_k":"~"}', '{"l":["x\\ny"]}', '{"z":1,"a":"~\'s"}', "",
]
_WRITTEN = ["w/n@.md", "w/../w/n@.md", "../n@.md", "v/n@.md"]


def _variants(texts: list[str]):
    which = (F.col("p_partkey") % len(texts)).cast("int")
    return F.replace(F.replace(F.get(F.array(*map(F.lit, texts)), which), F.lit("@"), F.col("p_partkey").cast("string")), F.lit("~"), F.coalesce("p_name", F.lit("")))


def _variants_sql(texts: list[str]) -> str:
    each = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"replace(replace(([{each}])[p_partkey % {len(texts)} + 1], '@', CAST(p_partkey AS VARCHAR)), '~', coalesce(p_name, ''))"


def _paths_sql(path: str) -> str:
    """Codes and full paths of a table e, by walking the steps of a path from the root's name on."""
    return rf"""w AS (SELECT *, list_reduce(list_concat(['/entries'], list_filter(string_split({path}, '/'), lambda s: s NOT IN ('', '.'))), lambda acc, s: CASE WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || s END) AS full_path FROM e),
c AS (SELECT *, CASE WHEN NOT regexp_matches({path}, '\.md$') OR regexp_matches({path}, '^(/|[A-Za-z]:)') THEN 'PATH_INVALID' WHEN NOT starts_with(full_path, '/entries/') THEN 'PATH_ESCAPE' END AS code FROM w)"""


_META_SQL = r"""v AS (SELECT *, coalesce(json_type(CASE WHEN json_valid(meta) THEN meta ELSE '[]' END) = 'OBJECT', false) AS ob FROM e),
k AS (SELECT *, CASE WHEN ob THEN list_transform(json_keys(meta), lambda k: {'k': k, 't': json_type(json_extract(meta, '$."' || k || '"')), 'j': json_extract(meta, '$."' || k || '"'), 's': json_extract_string(meta, '$."' || k || '"')}) END AS ks
  FROM (SELECT * REPLACE (CASE WHEN ob THEN meta ELSE '{}' END AS meta) FROM v)),
m AS (SELECT *, NOT ob OR len(list_filter(ks, lambda x: NOT regexp_full_match(x.k, '[A-Za-z][A-Za-z0-9_-]*') OR x.t = 'OBJECT' OR (x.t = 'VARCHAR' AND contains(x.s, chr(10)))
  OR (x.t = 'ARRAY' AND len(list_filter(json_extract(x.j, '$[*]'), lambda y: json_type(y) NOT IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') OR contains(y ->> '$', chr(10)))) > 0))) > 0 AS bad FROM k),
x AS (SELECT *, '---' || chr(10) || array_to_string(list_transform(list_filter(ks, lambda x: x.t <> 'NULL'), lambda x: x.k || ': ' || CASE
  WHEN x.t = 'ARRAY' THEN '[' || array_to_string(list_transform(json_extract(x.j, '$[*]'), lambda y: trim(y ->> '$')), ', ') || ']'
  WHEN x.t = 'VARCHAR' AND (left(x.s, 1) IN ('[', ']') OR contains(x.s, '"') OR contains(x.s, '''') OR contains(x.s, '#')) THEN '"' || replace(x.s, '"', '\"') || '"'
  WHEN x.t = 'DOUBLE' THEN regexp_replace(x.s, '\.0$', '') ELSE x.s END || chr(10)), '') || '---' || chr(10) || chr(10) || 'Body ' || p_partkey || chr(10) AS text FROM m)"""


@query("entry_paths", f"WITH e AS (SELECT p_partkey, {_variants_sql(_PATHS)} AS path FROM part), {_paths_sql('path')} SELECT p_partkey, code, CASE WHEN code IS NULL THEN substr(full_path, 10) END AS path FROM c")
def entry_paths(spark, d):
    path = _variants(_PATHS)
    return C.read(spark, d, "part").select("p_partkey", entries.path_code(path).alias("code"), F.when(entries.path_code(path).isNull(), entries.clean_path(path)).alias("path"))


@query("entry_texts", f"WITH e AS (SELECT p_partkey, {_variants_sql(_METAS)} AS meta FROM part), {_META_SQL} SELECT p_partkey, CASE WHEN bad THEN 'FRONTMATTER_INVALID' END AS code, CASE WHEN NOT bad THEN text END AS text FROM x")
def entry_texts(spark, d):
    body = F.concat(F.lit("Body "), F.col("p_partkey").cast("string"), F.lit(" \n\n"))
    rows = C.read(spark, d, "part").select("p_partkey", _variants(_METAS).alias("meta"), body.alias("body"))
    rows = rows.select("p_partkey", entries.meta_code(F.col("meta")).alias("code"), entries.serialized(F.col("meta"), F.col("body")).alias("text"))
    return rows.withColumn("text", F.when(F.col("code").isNull(), F.col("text")))


_DRAWN = "left(qid, 1) >= '3'"


@query(
    "draft_entries",
    f"""{_like(_SIM_WHOLE)}, t5 AS (SELECT * FROM s WHERE rk <= 5), v AS (SELECT qid, coalesce(lang, 'none') AS tag, count(*) AS n, min(rk) AS seen FROM t5 JOIN documents ON t5.doc_id = 'docs:' || documents.doc_id GROUP BY ALL),
vt AS (SELECT qid, string_agg(tag, ',' ORDER BY n DESC, seen) AS tags FROM v GROUP BY qid), l AS (SELECT qid, string_agg(doc_id, ',' ORDER BY rk) AS links FROM (SELECT qid, doc_id, min(rk) AS rk FROM t5 GROUP BY ALL) GROUP BY qid)
SELECT qid, CASE WHEN NOT {_DRAWN} THEN 'PATH_INVALID' END AS code, CASE WHEN {_DRAWN} THEN 'topic-no-' || regexp_replace(lower(qid), '[^a-z0-9]+', '-', 'g') || '.md' END AS path,
CASE WHEN {_DRAWN} THEN coalesce(tags, '') END AS tags, CASE WHEN {_DRAWN} THEN coalesce(links, '') END AS links, CASE WHEN {_DRAWN} THEN a.doc_id END AS like_doc, CASE WHEN {_DRAWN} THEN round(a.overlap, 6) END AS overlap
FROM (SELECT CAST(item_id AS VARCHAR) AS qid FROM benchmark) LEFT JOIN vt USING (qid) LEFT JOIN l USING (qid) LEFT JOIN (SELECT * FROM s WHERE rk = 1 AND overlap >= 0.35) a USING (qid)""",
)
def draft_entries(spark, d):
    qid = F.col("item_id").cast("string")
    topics = C.read(spark, d, "benchmark").select(
        qid.alias("qid"), F.concat(F.lit("topic_no-"), qid).alias("topic"), F.col("text").alias("content"), F.when(F.left(qid, F.lit(1)) < "3", F.lit("../out.md")).alias("suggested_path"), F.lit(None).cast("string").alias("source_url")
    )
    made = entries.draft_batch(C.docs_index(spark, d), topics)
    return made.select(
        "qid", "code", F.col("suggested_path").alias("path"), F.array_join("tags", ",").alias("tags"), F.array_join(F.transform("backlinks", lambda x: x["doc_id"]), ",").alias("links"),
        F.col("duplicate_warning.doc_id").alias("like_doc"), F.round("duplicate_warning.overlap", 6).alias("overlap"),
    )


def _entries(spark, d) -> DataFrame:
    """An entry a part; two neighbours have one path, at times."""
    n = F.floor(F.col("p_partkey") / 2)
    path = F.replace(F.get(F.array(*map(F.lit, _WRITTEN)), (n % len(_WRITTEN)).cast("int")), F.lit("@"), F.floor(F.col("p_partkey") / 4).cast("string"))
    text = F.concat(F.lit("# Written "), F.col("p_partkey").cast("string"), F.lit("\nunheardof\n\n"))
    return C.read(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("qid"), path.alias("path"), _variants(_METAS).alias("meta"), text.alias("content"))


@query(
    "write_entries",
    f"""WITH e AS (SELECT *, replace((['{"', '".join(_WRITTEN)}'])[(p_partkey // 2) % {len(_WRITTEN)} + 1], '@', CAST(p_partkey // 4 AS VARCHAR)) AS asked, {_variants_sql(_METAS)} AS meta FROM part), {_paths_sql('asked')},
e2 AS (SELECT p_partkey, code, substr(full_path, 10) AS path, meta FROM c), {_META_SQL.replace('FROM e)', 'FROM e2)')},
f AS (SELECT p_partkey, path, text, coalesce(code, CASE WHEN bad THEN 'FRONTMATTER_INVALID' END) AS code FROM x), g AS (SELECT *, CASE WHEN code IS NULL THEN row_number() OVER (PARTITION BY path, code IS NULL ORDER BY p_partkey) END AS nth FROM f)
SELECT lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS qid, coalesce(code, CASE WHEN nth > 1 THEN 'EXISTS' END) AS code, CASE WHEN nth = 1 THEN 'new:' || replace(path[:-4], '/', ':') END AS doc_id,
CASE WHEN nth = 1 THEN replace(text, 'Body ' || p_partkey, '# Written ' || p_partkey || chr(10) || 'unheardof') END AS text, CASE WHEN nth = 1 THEN 1 ELSE 0 END AS found FROM g""",
)
def write_entries(spark, d):
    """Entries written to a new folder: the report, the files as they are read again, and whether a search of the new index finds them."""
    root = scratch_path(spark, "written") + "/entries"
    said, index = entries.write_batch(C.defined_index(spark, d), _entries(spark, d), root, "new", allow_duplicate=True, enabled=True)
    named.register(spark)
    there = spark.read.format("named_files").load(root).select(F.col("file_path").alias("path"), "text")
    asked = spark.createDataFrame([("q", "unheardof")], "qid string, query string")
    hit = search.search_batch(index, asked, index.n_nodes, collection="new", snippets=False).select("doc_id").distinct().withColumn("found", F.lit(1))
    own = said.select("qid", "code", "doc_id", F.when(F.col("code").isNull(), F.col("path")).alias("path"))
    return own.join(there, "path", "left").join(hit, "doc_id", "left").select("qid", "code", "doc_id", "text", F.coalesce("found", F.lit(0)).alias("found"))
