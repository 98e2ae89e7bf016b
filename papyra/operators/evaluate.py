"""Retrieval quality: NDCG, reciprocal rank, hits, index statistics (E01-E05); a report of them."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from papyra.functions import text as T
from papyra.operators import catalog, search
from papyra.operators.indexing import MOST_GONE, Index, Later, Made
from papyra.session import write_table
from papyra.sources.files import documents_and_nodes, write_markdown


def ndcg(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg): linear gain, discount log2(rank + 1); 1 where nothing is relevant. ranked: qid, item, rank; qrels: qid, item, relevance."""
    got = ranked.where(F.col("rank") <= k).join(qrels, ["qid", "item"]).groupBy("qid").agg(F.sum(F.col("relevance") / F.log2(F.col("rank") + 1)).alias("dcg"))
    w = Window.partitionBy("qid").orderBy(F.desc("relevance"))
    best = qrels.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("qid").agg(F.sum(F.col("relevance") / F.log2(F.col("r") + 1)).alias("ideal"))
    return best.join(got, "qid", "left").select("qid", F.when(F.col("ideal") == 0, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def reciprocal_rank(ranked: DataFrame, qrels: DataFrame, least: int = 2) -> DataFrame:
    """(qid, rr): one over the first rank with at least this relevance, or 0."""
    first = ranked.join(qrels.where(F.col("relevance") >= least), ["qid", "item"]).groupBy("qid").agg(F.min("rank").alias("r"))
    return qrels.select("qid").distinct().join(first, "qid", "left").select("qid", F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("rr"))


def mrr(ranked: DataFrame, qrels: DataFrame, least: int = 2) -> DataFrame:
    return reciprocal_rank(ranked, qrels, least).agg(F.avg("rr").alias("mrr"))


def hit_at(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, hit): whether the wanted item stands within its k. wanted: qid, item, k."""
    own = wanted.join(ranked, ["qid", "item"], "left")
    return own.groupBy("qid").agg(F.coalesce(F.bool_or(F.col("rank") <= F.col("k")), F.lit(False)).alias("hit"))


def resolve_qrels(index, judged: DataFrame) -> DataFrame:
    """Judgements by title fragments (qid, doc_title, node_title, relevance) to nodes.

    A document matches if its title contains the fragment; of its nodes the best step
    counts: equal title, title begins with it, title contains it, content contains it,
    first node. Case doesn't matter. Fragments meet the titles that hold their first
    three characters by an equality join, and are compared then.

    No judgement is compared with every node of its document: the runs of a title or a
    content that are as long as some fragment asked meet the fragments by an equality
    join. Contents are read for the fragments alone that no title of the document holds.
    """
    low = lambda c: F.lower(F.col(c))
    docs = index.documents.select(F.col("doc_id").alias("d"), F.lower("title").alias("dt"))
    held = docs.withColumn("g", F.explode(T.grams(F.col("dt"))))
    hit = judged.withColumn("g", F.left(low("doc_title"), F.lit(3))).join(held, "g").where(F.contains(F.col("dt"), low("doc_title")))
    hit = write_table(hit.dropDuplicates(["qid", "doc_title", "node_title", "d"]).select("qid", "relevance", "d", low("node_title").alias("want")), "judged")
    nodes = index.nodes.select(F.col("doc_id").alias("d"), "node_id", "ord", "title", "content")
    asked = write_table(hit.select("d", "want").where("want IS NOT NULL").distinct(), "asked")
    titled = write_table(_least_holding(nodes.withColumn("t", low("title")), asked, 1, 2, 3), "titled")
    rest = write_table(asked.join(titled, ["d", "want"], "left_anti"), "untitled")
    found = titled.unionByName(_least_holding(nodes.withColumn("t", low("content")), rest, 4, 4, 4))
    first = nodes.where("ord = 0").groupBy("d").agg(F.min("node_id").alias("first"))
    best = hit.join(found, ["d", "want"], "left").join(first, "d", "left")
    return best.select("qid", F.coalesce("n.node_id", "first").alias("item"), "relevance").where("item IS NOT NULL")


def _least_holding(texts: DataFrame, asked: DataFrame, equal: int, begins: int, holds: int) -> DataFrame:
    """(d, want, n: step, ord, node_id): of each asked (d, want) the first node in order of step whose text t holds it, if any.

    The runs of t of each length that is asked for are dealt where they lie if the asked are
    counted few, else by (d, want); their number is that of t's characters times the lengths.
    """
    lens = sorted(r[0] for r in asked.select(F.length("want")).distinct().collect())  # lengths of titles
    if not lens:
        return asked.select("d", "want", F.struct(F.lit(holds).alias("step"), F.lit(0).alias("ord"), F.lit("").alias("node_id")).alias("n")).limit(0)
    size = F.length("t")
    each = texts.select("d", "node_id", "ord", "t", F.explode(F.array(*map(F.lit, lens))).alias("l")).where(F.col("l") <= size)
    runs = each.select("d", "node_id", "ord", (F.col("l") == size).alias("whole"), F.posexplode(F.transform(F.sequence(F.lit(1), size - F.col("l") + 1), lambda i: F.substring("t", i, F.col("l")))).alias("p", "want"))
    side = F.broadcast(asked) if asked.count() <= MOST_GONE else asked
    step = F.when((F.col("p") == 0) & F.col("whole"), equal).when(F.col("p") == 0, begins).otherwise(holds)
    return runs.join(side, ["d", "want"], "left_semi").groupBy("d", "want").agg(F.min(F.struct(step.alias("step"), "ord", "node_id")).alias("n"))


def index_stats(nodes: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row of nodes per file: mean, median (of an even number the upper one), greatest; files that are imports only.

    With documents, those without nodes count too (empty_files).
    """
    per = nodes.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("title") == "imports", F.lit(False))).alias("only"))
    if documents is not None:
        per = documents.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("only", F.lit(False)).alias("only"))
    return per.agg(
        F.count("*").alias("files"), F.avg("n").alias("avg_nodes"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n DESC)").alias("median_nodes"),
        F.max("n").alias("max_nodes"), F.count_if(F.col("n") == 0).alias("empty_files"), F.count_if(F.col("only") & (F.col("n") == 1)).alias("import_only_files"),
    )


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def kind_table(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, n, files): nodes by the first word of their title, imports left out, and the files whose facets name that kind, if any."""
    total = nodes.where("title <> 'imports'").groupBy(F.split_part("title", F.lit(" "), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))
    named = documents.select(F.explode(F.try_element_at("facets", F.lit("symbol_kind"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("files"))
    return total.join(named, "kind", "left").select("kind", "n", "files")


def language_table(documents: DataFrame) -> DataFrame:
    """(language, files)."""
    return documents.select(F.explode(F.try_element_at("facets", F.lit("language"))).alias("language")).groupBy("language").agg(F.count("*").alias("files"))


def sample_files(documents: DataFrame, nodes: DataFrame, top: int = 10) -> DataFrame:
    """(file_path, n, description): the files of most nodes, ties by load order; 70 characters of the description."""
    per = nodes.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = documents.join(per, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.orderBy(F.desc("n"), "doc_ord").limit(top).select("file_path", "n", F.left("description", F.lit(70)).alias("description"))


@dataclass(repr=False)
class Benchmark:
    """What indexing files took and gave (S13); the tables are made when they are asked for."""

    index: Index
    parse_seconds: float
    load_seconds: float = Made()

    def lines(self, name: str, queries: DataFrame, top: int = 10, limit: int = 8) -> DataFrame:
        """The report as rows (section, place, text), in that order: figures, symbols, kinds, languages, sample files, results of queries (qid, query)."""
        i, docs, nodes = self.index, self.index.documents, self.index.nodes
        cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
        row = lambda *cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))

        def table(section: int, head: str, df: DataFrame, order: list, *cells) -> DataFrame:
            """A heading, and the rows of a small table below it in order."""
            n = head.count("|") - 1
            titles = [(section, k, t) for k, t in enumerate([*head.split("\n"), "|" + "---|" * n])] if n > 0 else [(section, 0, head)]
            place = (F.row_number().over(Window.orderBy(*order)) + 9).cast("int")
            return i.spark.createDataFrame(titles, "section int, place int, text string").unionByName(df.select(F.lit(section).alias("section"), place.alias("place"), row(*cells).alias("text")))

        def figures(section: int, head: str, df: DataFrame, own: list[tuple[str, str]]) -> DataFrame:
            return table(section, head, df.select(F.posexplode(F.array(*[F.struct(F.lit(k).alias("k"), F.expr(v).cast("string").alias("v")) for k, v in own])).alias("p", "x")), ["p"], F.col("x.k"), F.col("x.v"))

        whole = catalog.stats(i).withColumns({"parse": F.lit(self.parse_seconds), "load": F.lit(self.load_seconds)})
        parts = [
            i.spark.createDataFrame([(0, 0, f"# Benchmark: {name}")], "section int, place int, text string"),
            figures(1, "## Indexing\n| Metric | Value |", whole, [
                ("Files indexed", "document_count"), ("Parse time", "concat(format_number(parse, 2), 's')"), ("Store load time", "concat(format_number(load, 2), 's')"),
                ("Files/second", "cast(round(document_count / greatest(parse, 0.001)) as bigint)"), ("Total nodes", "total_nodes"), ("Indexed terms", "indexed_terms"), ("Total words", "total_words"),
            ]),
            figures(2, "## Symbols\n| Metric | Value |", index_stats(nodes, docs), [
                ("Avg nodes/file", "format_number(avg_nodes, 1)"), ("Median nodes/file", "median_nodes"), ("Max nodes/file", "max_nodes"),
                ("Files with 0 symbols", "empty_files"), ("Files with only imports", "import_only_files"),
            ]),
            table(3, "### Nodes by kind\n| Kind | Nodes | Files |", kind_table(docs, nodes), [F.desc("n"), "kind"], cell("kind"), F.col("n").cast("string"), F.coalesce(F.col("files").cast("string"), F.lit("—"))),
            table(4, "### Languages\n| Language | Files |", language_table(docs), [F.desc("files"), "language"], cell("language"), F.col("files").cast("string")),
            table(5, f"## Sample files (top {top})\n| File | Nodes | Description |", sample_files(docs, nodes, top), [F.desc("n"), "file_path"], F.concat(F.lit("`"), "file_path", F.lit("`")), F.col("n").cast("string"), cell("description")),
        ]
        queries = queries.select(F.col("qid").cast("string").alias("qid"), "query")
        found = search.search_batch(i, queries, limit).join(queries, "qid")
        head = i.spark.createDataFrame([(6, 0, "## Queries"), (6, 1, "| Query | Score | Symbol | Snippet |"), (6, 2, "|---|---|---|---|")], "section int, place int, text string")
        ranked = found.withColumn("place", (F.row_number().over(Window.orderBy("qid", "rank")) + 9).cast("int")).withColumn("cut", F.left("snippet", F.lit(80)))
        parts += [head, ranked.select(F.lit(6).alias("section"), "place", row(cell("query"), F.format_number("score", 1), cell("node_title"), cell("cut")).alias("text"))]
        return reduce(DataFrame.unionByName, parts)


def benchmark(files: DataFrame) -> Benchmark:
    """Index files (file_path, text, collection, kind, modified, doc_ord) and time parsing, then the building of the index."""
    t = time.perf_counter()
    docs, nodes = (write_table(x, "benchmark") for x in documents_and_nodes(files))
    parsed = time.perf_counter()
    index = Index.build(docs, nodes)
    built = time.perf_counter()

    def load() -> float:
        """Seconds of building the whole index, which is made for it if it isn't there."""
        begun = time.perf_counter()
        index.make()
        return built - parsed + time.perf_counter() - begun

    return Benchmark(index, parsed - t, Later(load))


def write_report(lines: DataFrame, path: str, name: str) -> None:
    """The report as one markdown file of that name in a folder."""
    text = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "place", "text"))), lambda x: x["text"]), "\n").alias("text"))  # a report's lines are few
    write_markdown(text.select(F.lit(name).alias("file_path"), F.concat("text", F.lit("\n")).alias("text")), path)
