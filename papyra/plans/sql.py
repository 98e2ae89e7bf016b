"""DuckDB SQL that says what the queries of this folder compute, built from a few common table expressions."""

from __future__ import annotations


def tok(x: str, least: int = 2) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9_\-./]', ' ', 'g'), '\s+'), lambda t: length(t) >= {least})"


#: From table allt(t) of tokens: stems st(t, s).
STEMS = r"""
s3 AS (SELECT DISTINCT t, regexp_replace(regexp_replace(regexp_replace(t, 'ies$', 'y'), 'ied$', 'y'), '(es|s)$', '') AS w FROM allt),
s4 AS (SELECT t, CASE WHEN suffix(w, 'ing') AND length(t) - (length(w) - 3) > 4 THEN left(w, length(w) - 3) ELSE w END AS w FROM s3),
s5 AS (SELECT t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, 'tion$', 't'), 'ment$', ''), 'ness$', ''), 'able$', ''), 'ible$', '') AS w FROM s4),
st AS (SELECT t, CASE WHEN length(t) < 4 THEN t ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, 'ally$', ''), 'ful$', ''), 'ous$', ''), 'ive$', ''), 'ly$', '') END AS s FROM s5)
"""

#: Nodes of the corpora: doc_id, doc_ord, ord, node_id, title, content, description.
NODES = {
    "docs": """SELECT 'docs:' || doc_id AS doc_id, doc_id AS doc_ord, 0 AS ord, 'docs:' || doc_id || ':n1' AS node_id,
      coalesce(lang, 'none') || ' ' || coalesce(source, 'none') AS title, coalesce(text, '') AS content, coalesce(lang, 'none') || ' ' || coalesce(source, 'none') AS description
      FROM documents WHERE doc_id IS NOT NULL""",
    "conv": """SELECT 'conv:' || conv_id AS doc_id, conv_id AS doc_ord, turn AS ord, 'conv:' || conv_id || ':n' || (turn + 1) AS node_id, coalesce(role, '') || ' ' || turn AS title,
      CASE WHEN turn % 3 = 1 THEN '[code:x] ' ELSE '' END || coalesce(text, '') AS content, CASE WHEN conv_id % 3 = 0 THEN 'the nicht les' ELSE '' END AS description
      FROM conversations WHERE conv_id IS NOT NULL""",
}


def postings(corpus: str, queries: str | None = None) -> str:
    """CTEs n, x (tokens), st, p (postings), ns (lengths), df, c (totals); with queries (qid, query) also qt."""
    more = f"qi AS ({queries}), qt0 AS (SELECT qid, {tok('query')} AS a FROM qi), qt AS (SELECT qid, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM qt0)," if queries else ""
    return f"""
n AS ({NODES[corpus]}),
t0 AS (SELECT doc_id, node_id, doc_ord, ord, {tok('title')} AS tt, {tok('content')} AS bt, {tok('description')} AS dt, content FROM n),
t1 AS (SELECT *, list_concat(tt, bt) AS al, len(tt) AS tl FROM t0),
x AS (SELECT doc_id, node_id, doc_ord, ord, tl, unnest(al) AS t, generate_subscripts(al, 1) - 1 AS pos FROM t1),
{more}
allt AS (SELECT t FROM x UNION SELECT unnest(dt) FROM t1 {'UNION SELECT t FROM qt' if queries else ''}),
{STEMS},
ds AS (SELECT DISTINCT node_id, s FROM (SELECT node_id, unnest(dt) AS t FROM t1 WHERE ord = 0) d JOIN st USING (t)),
ct AS (SELECT DISTINCT node_id, unnest({tok("regexp_replace(content, '^.code:x. ', '')")}) AS t FROM t1 WHERE content LIKE '[code:x] %'),
o AS (SELECT x.*, st.s AS term, pos < tl AS it, ds.s IS NOT NULL AND pos >= tl AS idd, ct.t IS NOT NULL AND ds.s IS NULL AND pos >= tl AS ic
  FROM x JOIN st ON x.t = st.t LEFT JOIN ds ON ds.node_id = x.node_id AND ds.s = st.s LEFT JOIN ct ON ct.node_id = x.node_id AND ct.t = x.t WHERE length(st.s) >= 2),
p AS (SELECT doc_id, node_id, doc_ord, ord, term, count(*) AS tf, list(pos ORDER BY pos) AS positions, bool_or(it) AS ht, bool_or(idd) AS hd, bool_or(ic) AS hc FROM o GROUP BY ALL),
ns AS (SELECT doc_id, node_id, len(al) AS total_tokens FROM t1),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (SELECT count(*) AS n, avg(total_tokens) AS avgdl FROM ns)
"""


def search(corpus: str, queries: str, prefix: bool = True, bonus: bool = True, where: str = "true", weight: str = "1.0", title: float = 3.0, desc: float = 2.0, code: float = 1.5,
           limit: int = 20, extra: str = "") -> str:
    """CTEs up to r: qid, doc_id, node_id, score, rank, matched (list), pos (list). extra: SELECTs of (qid, o, term) of expansions."""
    pre = "UNION ALL SELECT qid, q.term, idx, n_terms, df.term, df, 0.5 FROM q JOIN df ON length(q.term) >= 3 AND starts_with(df.term, q.term) AND df.term <> q.term" if prefix else ""
    add = "+ CASE WHEN m > 1 THEN (m - 1) * 2.0 ELSE 0 END + CASE WHEN m = n_terms AND n_terms > 1 THEN 5.0 ELSE 0 END" if bonus else ""
    return f"""
{postings(corpus, queries)},
q1 AS (SELECT qid, i * 1000000 AS o, s AS term FROM qt JOIN st USING (t) WHERE length(s) >= 2 {extra}),
q2 AS (SELECT qid, term, min(o) AS o FROM q1 GROUP BY ALL),
q AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY o) AS idx, count(*) OVER (PARTITION BY qid) AS n_terms FROM q2),
mt AS (SELECT qid, q.term AS qterm, idx, n_terms, df.term, df, 1.0 AS pen FROM q JOIN df ON q.term = df.term {pre}),
h AS (SELECT qid, p.doc_id, p.node_id, doc_ord, ord, qterm, idx, n_terms, positions,
  ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * total_tokens / avgdl))
  * greatest(1.0, CASE WHEN ht THEN {title} ELSE 1.0 END, CASE WHEN hd THEN greatest(1.0, {desc}) ELSE 1.0 END, CASE WHEN hc THEN {code} ELSE 1.0 END) * pen AS s
  FROM mt JOIN p USING (term) JOIN ns USING (doc_id, node_id), c),
a AS (SELECT qid, doc_id, node_id, doc_ord, ord, sum(s) AS score, count(DISTINCT qterm) AS m, any_value(n_terms) AS n_terms, list_sort(flatten(list(positions))) AS pos,
  list_sort(list(DISTINCT {{'i': idx, 't': qterm}})) AS ms FROM h GROUP BY ALL),
b AS (SELECT a.*, (score {add}) * ({weight}) AS sc FROM a WHERE {where}),
r AS (SELECT qid, doc_id, node_id, doc_ord, ord, sc AS score, m, pos, list_transform(ms, lambda z: z.t) AS matched, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, doc_ord, ord) AS rank
  FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, doc_ord, ord) <= {limit})
"""


def values(rows: list[tuple[str, str]]) -> str:
    quoted = ", ".join("('" + a.replace("'", "''") + "', '" + b.replace("'", "''") + "')" for a, b in rows)
    return f"SELECT * FROM (VALUES {quoted}) v(qid, query)"


#: Markdown files of the corpus `md`, as the query side builds them: key, region, nation, folder, has (frontmatter).
MD = """
md AS (SELECT n_nationkey AS k, r_name AS r, n_name AS n, CASE n_nationkey % 3 WHEN 0 THEN 'guides' WHEN 1 THEN 'ops/deploy' ELSE 'misc' END AS folder,
  n_nationkey % 4 <> 0 AS has FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT *, 'md:' || replace(folder, '/', ':') || ':n' || k AS doc_id, folder || '/n' || k || '.md' AS file_path FROM md)
"""

#: The tree of corpus `geo`: g(doc_id, ord, node_id, title, level, parent_id, words).
GEO = """
g0 AS (
  SELECT r_regionkey AS rk, -1 AS nk, -1 AS sk, r_name AS title, 1 AS level, NULL AS parent_id, 'region ' || r_name AS content FROM region
  UNION ALL SELECT r_regionkey, n_nationkey, -1, n_name, 2, 'geo:' || r_regionkey || ':-1:-1', 'nation ' || n_name || ' of ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_regionkey, n_nationkey, s_suppkey, s_name, 3, 'geo:' || r_regionkey || ':' || n_nationkey || ':-1', 'supplier ' || s_name || ' in ' || n_name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT 'geo:' || rk AS doc_id, row_number() OVER (PARTITION BY rk ORDER BY nk, sk) - 1 AS ord, 'geo:' || rk || ':' || nk || ':' || sk AS node_id, title, level, parent_id,
  len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) AS words FROM g0)
""".replace("\\\\s", "\\s")
