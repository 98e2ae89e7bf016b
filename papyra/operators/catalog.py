"""Catalog: filtered listing, facet counts, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.indexing import Index
from papyra.operators.search import Filters, scope
from papyra.session import scratch_path, write_table


def matching(index: Index, tag: str | None = None, collection: str | None = None, filters: Filters | None = None, query: str | None = None) -> DataFrame:
    """Documents with a tag that contains this, in a collection, with facets, whose title, description or path contains the query; letters' case doesn't matter."""
    docs = index.documents
    if collection is not None:
        docs = docs.where(F.col("collection") == collection)
    if tag:
        docs = docs.where(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(tag.lower()))))
    if query:
        q = F.lit(query.lower())
        docs = docs.where(F.contains(F.lower("title"), q) | F.contains(F.lower("description"), q) | F.contains(F.lower("file_path"), q))
    allowed = scope(index, filters)
    return docs if allowed is None else docs.join(allowed, "doc_id", "left_semi")


def by_title() -> tuple:
    """The order of a catalog: title (ICU collation), then load order."""
    return F.collate("title", "UNICODE"), F.col("doc_ord")


def page(docs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in order of title. Each task keeps its first offset + limit rows: for pages near the beginning; see TitlePages for others."""
    return docs.orderBy(*by_title()).offset(offset or 0).limit(limit or 50)


#: Documents of a range of titles, about; ranges at most (their counts go to the driver).
RANGE_ROWS = 100_000
MOST_RANGES = 4096
#: Pages that end before this row are found without the ranges.
NEAR = 10_000


@dataclass
class TitlePages:
    """Documents in folders by ranges of titles, with the number of documents of each range and collection.

    A page opens the one or two ranges that the running sum of the counts names, whatever
    its offset. The load order belongs to the key, so a title that many share is cut too.
    """

    rows: DataFrame
    counts: DataFrame

    @classmethod
    def build(cls, documents: DataFrame, range_rows: int = RANGE_ROWS) -> TitlePages:
        """One exchange of the documents; each range is sorted as it is written."""
        ranges = min(MOST_RANGES, 1 + documents.count() // range_rows)
        dealt = documents.repartitionByRange(ranges, *by_title()).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *by_title())
        path = scratch_path(documents.sparkSession, "title-pages")
        dealt.write.partitionBy("part").parquet(path)
        rows = documents.sparkSession.read.schema(dealt.schema).parquet(path)
        return cls(rows, write_table(rows.groupBy("part", "collection").agg(F.count("*").alias("n")).coalesce(1), "title-counts"))

    def find(self, docs: DataFrame, counts: DataFrame, limit: int, offset: int) -> tuple[DataFrame, int]:
        """A page of docs (rows that match) and their number; counts: (part, n) of them, in one row a range or more."""
        before, opened, skip = 0, [], 0
        for part, n in sorted(tuple(r) for r in counts.groupBy("part").agg(F.sum("n")).collect()):  # MOST_RANGES at most
            if before < offset + limit and before + n > offset:
                skip = skip if opened else offset - before
                opened.append(part)
            before += n
        return docs.where(F.col("part").isin(opened)).drop("part").orderBy(*by_title()).offset(max(skip, 0)).limit(limit), before


def title_pages(index: Index) -> TitlePages:
    """The ranges of an index, made once, when a far page is first asked for."""
    if "pages" not in index._bits:
        index._bits["pages"] = TitlePages.build(index.documents)
    return index._bits["pages"]


def far_page(index: Index, limit: int = 50, offset: int = 0, pages: TitlePages | None = None, **which) -> tuple[DataFrame, int]:
    """As page() of matching(), with the number of all that match, at any offset.

    Without a filter, or with a collection alone, the counts are there already; else those
    that match are counted by range in one scan, which sorts and moves nothing.
    """
    pages = pages or title_pages(index)
    docs = matching(index.but(documents=pages.rows), **which)
    if any(v for k, v in which.items() if k != "collection"):
        counts = docs.groupBy("part").agg(F.count("*").alias("n"))
    else:
        counts = pages.counts if which.get("collection") is None else pages.counts.where(F.col("collection") == which["collection"])
    return pages.find(docs, counts, limit, offset)


def list_documents(index: Index, limit: int = 30, offset: int = 0, **which) -> tuple[DataFrame, int]:
    """A page of 1 to 100 documents and the number of all that match."""
    limit, offset = min(max(limit, 1), 100), max(offset, 0)
    if offset + limit > NEAR:
        return far_page(index, limit, offset, **which)
    docs = matching(index, **which)
    return page(docs, limit, offset), docs.count()


def facet_counts(docs: DataFrame) -> DataFrame:
    """(key, value, n): occurrences over these documents, repeats within one counted."""
    own = docs.select(F.explode("facets").alias("key", "vs")).select("key", F.explode("vs").alias("value"))
    tags = docs.select(F.lit("tags").alias("key"), F.explode("tags").alias("value"))
    coll = docs.select(F.lit("collection").alias("key"), F.col("collection").alias("value")).where("value IS NOT NULL")
    return own.unionByName(tags).unionByName(coll).groupBy("key", "value").agg(F.count("*").alias("n"))


def get_facets(index: Index) -> DataFrame:
    """(key, value, n): distinct documents over the whole store."""
    return index.facets.groupBy("key", "value").agg(F.count("*").alias("n"))


def facet_rollup(index: Index) -> DataFrame:
    """Facet counts with subtotals per key and overall."""
    return index.facets.rollup("key", "value").agg(F.count_distinct("doc_id").alias("n"))


def stats(index: Index) -> DataFrame:
    """One row of totals."""
    docs = index.documents.agg(
        F.count("*").alias("document_count"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"),
        F.array_sort(F.collect_set("collection")).alias("collections"),
    )
    terms = index.vocab.agg(F.count("*").alias("indexed_terms"))
    keys = index.facets.agg(F.array_sort(F.collect_set("key")).alias("facet_keys"))
    one = docs.withColumn("k", F.lit(1)).join(terms.withColumn("k", F.lit(1)), "k").join(keys.withColumn("k", F.lit(1)), "k").drop("k")
    return one.withColumn("total_nodes", F.lit(index.n_nodes)).withColumn("avg_node_length", F.lit(int(index.avgdl + 0.5)))


def stats_json(index: Index) -> DataFrame:
    return stats(index).select(F.to_json(F.struct("*")).alias("json"))


def has_document(index: Index, doc_id: str) -> bool:
    return bool(index.documents.where(F.col("doc_id") == doc_id).limit(1).count())


def document(index: Index, doc_id: str) -> DataFrame:
    return index.documents.where(F.col("doc_id") == doc_id)
