"""Texts for people: result lists, outlines, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.operators.indexing import Index
from papyra.operators.tree import resolve_refs, subtrees


def badge(facets: Column) -> Column:
    """`[code: python, sh]`, `[has_code]`, `[has_links]` as they hold."""
    langs = F.try_element_at(facets, F.lit("code_languages"))
    code = F.when(F.size(langs) > 0, F.concat(F.lit("code: "), F.array_join(langs, ", "))).when(F.map_contains_key(facets, F.lit("has_code")), F.lit("has_code"))
    links = F.when(F.map_contains_key(facets, F.lit("has_links")), F.lit("has_links"))
    text = F.concat_ws(" | ", code, links)
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(" ["), text, F.lit("]")))


def reference_lines(index: Index, results: DataFrame) -> DataFrame:
    """(doc_id, line): references that resolve, as `path → doc_id`."""
    refs = results.select("doc_id", "references").distinct().select(F.col("doc_id").alias("src"), F.posexplode("references").alias("p", "ref"))
    asked = refs.select(F.concat_ws("|", "src", "p").alias("ref_id"), "ref")
    found = resolve_refs(index, asked).join(refs.withColumn("ref_id", F.concat_ws("|", "src", "p")).select("ref_id", "src", "p"), "ref_id")
    return found.groupBy(F.col("src").alias("doc_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.concat("ref", F.lit(" → "), "doc_id").alias("t")))), lambda x: x["t"]), ", ").alias("line")
    )


def results(index: Index, found: DataFrame, inline: int = 3) -> DataFrame:
    """(qid, rank, text): one block a result; the first `inline` carry their whole subtree."""
    head = F.concat(
        F.col("rank").cast("string"), F.lit(". "), "doc_title", F.lit(" › "), "node_title", F.lit(" (score "), F.format_string("%.1f", F.col("score")), F.lit(")"), badge(F.col("facets")),
        F.lit("\n   doc_id: "), "doc_id", F.lit("  node_id: "), "node_id", F.lit("  terms: "), F.array_join("matched_terms", ", "),
    )
    wanted = found.where(F.col("rank") <= inline).select("doc_id", F.col("node_id").alias("root")).distinct()
    part = F.concat(F.repeat(F.lit("#"), F.greatest(F.col("level"), F.lit(1))), F.lit(" "), "title", F.lit("\n"), "content")
    trees = subtrees(index.nodes, wanted).groupBy("doc_id", F.col("root").alias("node_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ord", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("tree")
    )
    rows = found.join(trees, ["doc_id", "node_id"], "left").join(reference_lines(index, found), "doc_id", "left")
    body = F.when((F.col("rank") <= inline) & F.col("tree").isNotNull(), F.col("tree")).otherwise(F.concat(F.lit("   "), "snippet"))
    return rows.select("qid", "rank", F.concat_ws("\n", head, body, F.concat(F.lit("   refs: "), "line")).alias("text")).orderBy("qid", "rank")


def outline(nodes: DataFrame) -> DataFrame:
    """(ord, text): indented by level; level 0 stands at the margin."""
    indent = F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0)))
    return nodes.select("ord", F.concat(indent, F.lit("- "), "title", F.lit(" ["), "node_id", F.lit("] ("), F.col("word_count").cast("string"), F.lit(" words)")).alias("text")).orderBy("ord")


def listing(docs: DataFrame) -> DataFrame:
    """One text a document with at most five references."""
    return docs.select(
        F.concat_ws("\n", F.concat("title", badge(F.col("facets"))), F.concat(F.lit("  "), "doc_id"), F.concat(F.lit("  "), "description"),
                    F.when(F.size("references") > 0, F.concat(F.lit("  refs: "), F.array_join(F.slice("references", 1, 5), ", ")))).alias("text")
    )


def symbols(found: DataFrame) -> DataFrame:
    """One line a symbol."""
    return found.select("rank", F.concat(F.col("rank").cast("string"), F.lit(". "), "node_title", F.lit("  "), "file_path", F.lit("  "), "node_id").alias("text")).orderBy("rank")


def navigation(tree: DataFrame) -> DataFrame:
    """The sections of a subtree, indented from the root."""
    base = tree.agg(F.min("level")).first()[0] or 0
    indent = F.repeat(F.lit("  "), F.greatest(F.col("level") - base, F.lit(0)))
    body = F.when(F.coalesce("content", F.lit("")) == "", F.lit("(empty)")).otherwise(F.col("content"))
    text = F.concat(indent, F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "title", F.lit(" ["), "node_id", F.lit("]\n"), indent, body)
    return tree.select("depth", "ord", text.alias("text")).orderBy("depth", "ord")


def navigation_head(tree: DataFrame) -> DataFrame:
    """One line over a subtree: its title, sections and words."""
    root = F.min_by("title", F.struct("depth", "ord"))
    return tree.agg(F.concat(F.lit("Subtree: "), root, F.lit(" ("), F.count("*").cast("string"), F.lit(" sections, "), F.sum("word_count").cast("string"), F.lit(" words)")).alias("text")).where("text IS NOT NULL")


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
