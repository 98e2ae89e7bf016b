"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

Test items are cut into windows of WINDOW consecutive words. One pass over the training
texts stores the postings (term, row, place) of every test term as a table; a term's list
is its rows of that table, its length the term's frequency over all documents. A window's
lists are intersected from the rarest term: its postings are kept where the next rarest
term has one within reach, and around those that are left the postings of all lists meet.
Seen from the rarest term, a phrase match has every term at its own offset; a proximity
match has every term within WINDOW - 1 places, in any order. Phrase matches are among them.

Texts are read once, in place, and never shuffled; what moves is postings and matches.
Lists meet by row and cells of a few places, so a frequent term, a long document or a
common passage is no hot key. The tables that are broadcast (test terms, windows) are
counted first; beyond BROADCAST rows they are worked off in parts of that size, each an
exact pass of its own.

Defined cases: null texts have no words (n_words 0, not contaminated); an item without
words has no window; one of fewer than WINDOW words is one window; repeated items and
windows count once; every row of docs is matched on its own, repeated or not; items
without an id mark words as hit, but aren't listed or counted; an empty benchmark or
table gives no hits; very long texts are a row as any other; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from papyra.llm.common import beside, table
from papyra.session import write_table

WINDOW = 10
BROADCAST = 500_000
#: Tables made of test items have a file for so many items: few files, but more as the benchmark grows.
ITEMS_A_FILE = 5_000
#: Tables of anchors and matches have a file for so many anchors.
ANCHORS_A_FILE = 250_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(w: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))


def raw_words(text: Column) -> Column:
    """Words in their case; the first and the last may be empty strings. Null: no words."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, _SEPARATORS))


def word_count(w: Column) -> Column:
    """Words among raw words: without the empty strings at either end."""
    first, last = F.get(w, F.lit(0)) == "", (F.size(w) > 1) & (F.get(w, F.size(w) - 1) == "")
    return (F.size(w) - F.when(first, 1).otherwise(0) - F.when(last, 1).otherwise(0)).cast("long")


def windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window_id, words) of the distinct windows of items (item_id, text), and (window_id, item_id)."""
    words = F.transform(F.filter(raw_words(F.col("text")), lambda w: w != ""), fold_ascii)
    each = (
        items.select("item_id", words.alias("w")).where(F.size("w") > 0).withColumn("n", F.least(F.lit(size), F.size("w")))
        .withColumn("s", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
        .select("item_id", F.slice("w", F.col("s"), F.col("n")).alias("words"))
        .distinct()
    )
    n = 1 + items.count() // ITEMS_A_FILE
    each = write_table(each.coalesce(n), "item-windows")
    named = write_table(each.select("words").distinct().coalesce(n).withColumn("window_id", F.monotonically_increasing_id()), "windows")
    return named, write_table(each.join(named, "words").select("window_id", "item_id").distinct().coalesce(n), "window-items")


def vocabulary(named: DataFrame, files: int = 1) -> DataFrame:
    """(term, t): the distinct terms of the windows, numbered; written as a table."""
    terms = named.select(F.explode("words").alias("term")).distinct().coalesce(files)
    return write_table(terms.withColumn("t", F.monotonically_increasing_id()), "terms")


def parts(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """df in parts of about most rows, by a hash of the key; one part if it is small."""
    n = -(-max(df.count(), 1) // most)
    if n == 1:
        return [df]
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def index(docs: DataFrame, terms: DataFrame, most: int = BROADCAST) -> DataFrame:
    """The positional index of docs (doc_id, text), written as a table in one pass over the texts.

    A posting is (t, rid, pos): term, row and place. Beside them each row has one line with
    its doc_id, a hash of its text and its number of words, where n_words isn't null.
    """
    of_terms = parts(terms, "term", most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("rid"))
    if len(of_terms) > 1:
        rows = write_table(rows, "numbered")  # all passes must see the same numbers
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), "rid", raw_words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "th", "rid", "words", F.size("words").alias("size"), word_count(F.col("words")).alias("n"))
    tokens = rows.select("doc_id", "th", "rid", "size", "n", F.posexplode_outer("words").alias("pos", "raw")).withColumn("term", fold_ascii(F.col("raw")))
    last = F.col("pos").isNull() | (F.col("pos") == F.col("size") - 1)
    out = []
    for part in of_terms:
        own = F.lit(not out) & last  # the row's own line comes once
        out.append(
            tokens.join(F.broadcast(part), "term", "left").where(F.col("t").isNotNull() | own)
            .select("t", "rid", "pos", *(F.when(own, F.col(c)).alias(n) for c, n in (("doc_id", "doc_id"), ("th", "th"), ("n", "n_words"))))
        )
    return write_table(union(out), "postings")


def lists(postings: DataFrame) -> DataFrame:
    return postings.where("t IS NOT NULL").select("t", "rid", "pos")


def documents(postings: DataFrame) -> DataFrame:
    """(rid, doc_id, th, n_words) of every row indexed."""
    return postings.where("n_words IS NOT NULL").select("rid", "doc_id", "th", "n_words")


def by_rarity(named: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Windows all of whose terms occur, by rarity over all documents.

    t1, o1: the rarest term (of equals the first) and its offset; t2: the next rarest
    other term (t1 if there is none); ts: the terms; at: each term with its offset from
    the rarest, as one number.
    """
    counts = lists(postings).groupBy("t").agg(F.count("*").alias("n"))
    if terms.count() <= BROADCAST:  # else the windows of a frequent term are split as Spark splits skewed joins
        terms, counts = F.broadcast(terms), F.broadcast(counts)
    each = named.select("window_id", F.posexplode("words").alias("o", "term")).join(terms, "term").join(counts, "t", "left")
    ranked = each.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "o", "t"))).alias("r")).where(F.col("r")[0]["n"] > 0)
    first = F.col("r")[0]
    others = F.filter("r", lambda x: x["t"] != first["t"])
    return ranked.select(
        "window_id", first["t"].alias("t1"), first["o"].alias("o1"), F.size("r").alias("len"), first["n"].alias("n1"),
        F.coalesce(F.get(others, F.lit(0))["t"], first["t"]).alias("t2"),
        F.array_distinct(F.transform("r", lambda x: x["t"])).alias("ts"),
        F.transform("r", lambda x: _place(x["t"], x["o"] - first["o"])).alias("at"),
    )


def _place(t: Column, distance: Column) -> Column:
    """A term and its distance from another, -REACH to REACH, as one number."""
    return t * 64 + distance + 32


def _cells(pos: Column, reach: int) -> Column:
    """The cells of reach + 1 places that lie within reach."""
    return F.array_distinct(F.array(*(F.floor((pos + d) / (reach + 1)) for d in (-reach, 0, reach))))


def anchors(postings: DataFrame, ranked: DataFrame, size: int = WINDOW, most: int = BROADCAST) -> DataFrame:
    """(rid, pos, t1): postings of rarest terms with a next rarest term of one of its windows within reach.

    The two lists meet by row, term and cell of a few places, so no key is hot however
    frequent the term or long the document.
    """
    reach, out = size - 1, []
    for part in parts(ranked.select("t1", "t2").distinct(), "t1", most):
        first = lists(postings).join(F.broadcast(part), F.col("t") == F.col("t1")).select("rid", "pos", "t1", "t2", F.explode(_cells(F.col("pos"), reach)).alias("cell"))
        wanted = F.broadcast(part.select(F.col("t2").alias("t")).distinct())
        second = lists(postings).join(wanted, "t", "left_semi").select("rid", F.col("t").alias("t2"), F.col("pos").alias("p2"), F.floor(F.col("pos") / size).alias("cell"))
        out.append(first.join(second, ["rid", "t2", "cell"]).where(F.abs(F.col("pos") - F.col("p2")) <= reach).select("rid", "pos", "t1"))
    return union(out).distinct()


def neighbourhoods(postings: DataFrame, found: DataFrame, size: int = WINDOW) -> DataFrame:
    """(rid, pos, t1, around): of all lists, the postings within reach of an anchor, as places seen from it."""
    reach = size - 1
    near = lists(postings).join(beside(found.select("rid").distinct()), "rid", "left_semi")
    near = near.select("rid", "t", F.col("pos").alias("p2"), F.floor(F.col("pos") / size).alias("cell"))
    spread = found.withColumn("cell", F.explode(_cells(F.col("pos"), reach)))
    gap = F.col("p2") - F.col("pos")
    return spread.join(near, ["rid", "cell"]).where(F.abs(gap) <= reach).groupBy("rid", "pos", "t1").agg(F.collect_list(_place(F.col("t"), gap)).alias("around"))


def matches(postings: DataFrame, ranked: DataFrame, size: int = WINDOW, most: int = BROADCAST) -> DataFrame:
    """(rid, window_id, start, len, exact), written as a table: windows all of whose terms stand within reach of an occurrence of the rarest.

    start is where the window would begin; exact: every list has its term at its offset,
    which is a phrase match. The others are proximity matches only, in any order.
    """
    bound = ranked.select("t1", "t2", "n1").distinct().agg(F.sum("n1")).first()[0] or 0
    found = write_table(anchors(postings, ranked, size, most).repartition(1 + bound // ANCHORS_A_FILE), "anchors")
    hoods = neighbourhoods(postings, found, size).withColumn("near", F.transform("around", lambda x: F.shiftright(x, 6)))
    out = []
    for part in parts(ranked, "window_id", most):
        both = hoods.join(F.broadcast(part.drop("n1", "t2")), "t1").where(F.size(F.array_except("ts", "near")) == 0)
        out.append(both.select("rid", "window_id", (F.col("pos") - F.col("o1")).alias("start"), "len", (F.size(F.array_except("at", "around")) == 0).alias("exact")))
    return write_table(union(out).repartition(1 + found.count() // ANCHORS_A_FILE), "matches")


def covered(phrases: DataFrame) -> DataFrame:
    """(rid, n_hit): words inside any phrase match."""
    spans = phrases.groupBy("rid", "start").agg(F.max(F.col("start") + F.col("len")).alias("stop"))
    before = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.col("start"))))
    return spans.withColumn("fresh", fresh).groupBy("rid").agg(F.sum("fresh").cast("long").alias("n_hit"))


def search(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of docs (doc_id, text), the matches in them, and the items of each window."""
    named, owners = windows(benchmark)
    files = 1 + benchmark.count() // ITEMS_A_FILE
    terms = vocabulary(named, files)
    postings = index(docs, terms)
    ranked = write_table(by_rarity(named, terms, postings).coalesce(files), "ranked")
    return documents(postings), matches(postings, ranked), owners


def matched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(did, th) of the rows of docs (doc_id, text) that hold a phrase match; a null doc_id is -1."""
    rows, found, _ = search(docs, benchmark)
    hit = rows.join(found.where("exact").select("rid").distinct(), "rid", "left_semi")
    return hit.select(F.coalesce("doc_id", F.lit(-1)).alias("did"), "th").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_proximity."""
    rows, found, owners = search(docs, benchmark)
    listed = found.select("rid", "window_id", "exact").distinct().join(owners, "window_id").where("item_id IS NOT NULL").groupBy("rid").agg(
        F.collect_set(F.when(F.col("exact"), F.col("item_id").cast("string"))).alias("items"), F.collect_set("item_id").alias("near")
    )
    hits = covered(found.where("exact")).join(listed, "rid", "full")
    items, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0))
    return rows.join(hits, "rid", "left").select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce(F.size("near"), F.lit(0)).cast("long").alias("n_proximity"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
    CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[])
    ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM bs),
sizes AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT rid, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s FROM d, sizes),
dw AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM ds),
m AS (SELECT DISTINCT rid, dw.n, s, dw.k FROM dw JOIN (SELECT DISTINCT n, k FROM bw) x ON dw.n = x.n AND dw.k = x.k),
p AS (SELECT DISTINCT rid, unnest(range(s, s + n)) AS p FROM m),
h AS (SELECT rid, count(*) AS n_hit FROM p GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT rid, n, k FROM m) m JOIN bw ON m.n = bw.n AND m.k = bw.k GROUP BY rid),
tok AS (SELECT rid, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS pos FROM d),
tc AS (SELECT t, count(*) AS n FROM tok GROUP BY t),
x AS (SELECT row_number() OVER () AS wid, ws FROM (SELECT DISTINCT w[s:s + n - 1] AS ws FROM bs)),
xt AS (SELECT wid, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS o FROM x),
r AS (SELECT wid, xt.t, row_number() OVER (PARTITION BY wid ORDER BY coalesce(n, 0), o) AS k FROM xt LEFT JOIN tc ON xt.t = tc.t),
q AS (SELECT DISTINCT rid, wid FROM r JOIN tok ON r.t = tok.t AND k = 1 JOIN x USING (wid) JOIN d USING (rid)
  WHERE list_has_all(w[greatest(1, pos - 9):pos + 9], ws)),
o AS (SELECT rid, count(DISTINCT item_id) AS n_proximity FROM q JOIN x USING (wid) JOIN (SELECT DISTINCT item_id, w[s:s + n - 1] AS ws FROM bs) y ON x.ws = y.ws GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_proximity, 0) AS BIGINT) AS n_proximity
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN i ON d.rid = i.rid LEFT JOIN o ON d.rid = o.rid
"""
