"""Many entries at once: drafts, checks and writing (W02, W03, W06-W08) as jobs over tables of entries.

An entry is a row (qid, path, meta, content); meta is its frontmatter as a JSON object, in
order of the keys. What curate.py does for one entry of a conversation is done here for a
table: one batch search for all duplicates, one write of files, one upsert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from papyra.functions import text as T
from papyra.operators import markdown
from papyra.operators.curate import DUPLICATE_THRESHOLD, backlinks, facet_vote, glossary_hits
from papyra.operators.indexing import Index
from papyra.operators.search import similar_batch
from papyra.session import write_table
from papyra.sources.files import scan, write_markdown
from papyra.operators.schema import Collection

BACKLINKS = 5


def segments(path: Column, root: str = "/entries") -> Column:
    """The folders and name that a path relative to root stands for, from the file system's root on; `.` and `..` resolved."""
    steps = F.filter(F.split(F.concat(F.lit(root.rstrip("/") + "/"), path), "/"), lambda s: (s != "") & (s != "."))
    return F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda held, s: F.when(s != "..", F.concat(held, F.array(s))).when(F.size(held) > 0, F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(held),
    )


def _depth(root: str) -> int:
    return len([s for s in root.split("/") if s not in ("", ".")])


def path_code(path: Column, root: str = "/entries") -> Column:
    """PATH_INVALID (empty, not .md, absolute, the root itself), PATH_ESCAPE (leads out of root), or null for a good path."""
    held, n = segments(path, root), _depth(root)
    top = F.lit([s for s in root.split("/") if s not in ("", ".")]).cast("array<string>")
    return (
        F.when(F.coalesce(path, F.lit("")) == "", F.lit("PATH_INVALID"))
        .when(~F.endswith(path, F.lit(".md")) | F.startswith(path, F.lit("/")) | path.rlike(r"\A[A-Za-z]:[\\/]"), F.lit("PATH_INVALID"))
        .when((F.size(held) < n) | ~F.slice(held, 1, n).eqNullSafe(top) if n else F.lit(False), F.lit("PATH_ESCAPE"))
        .when(F.size(held) == n, F.lit("PATH_INVALID"))
    )


def clean_path(path: Column, root: str = "/entries") -> Column:
    """A good path without `.` and `..`."""
    return F.array_join(F.slice(segments(path, root), F.lit(_depth(root) + 1), F.lit(1 << 20)), "/")


def _pairs(meta: Column) -> Column:
    """Entries of a JSON object in their order, values as variants; null if it is none."""
    return F.map_entries(F.from_json(meta, "map<string,variant>", {"mode": "PERMISSIVE"}))


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"\A[A-Z]+", 0)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def meta_code(meta: Column) -> Column:
    """FRONTMATTER_INVALID unless it is an object of plain keys with strings, numbers, booleans, nulls or lists of strings and numbers, without line breaks."""
    plain = lambda v, kinds: _kind(v).isin(*kinds) & ~((_kind(v) == "STRING") & _text(v).rlike(r"[\r\n]"))
    listed = lambda v: (_kind(v) == "ARRAY") & F.coalesce(F.forall(_items(v), lambda x: plain(x, ("STRING", *NUMBERS))), F.lit(False))
    good = lambda e: e["key"].rlike(r"\A[A-Za-z][A-Za-z0-9_-]*\z") & (e["value"].isNull() | plain(e["value"], ("STRING", "BOOLEAN", "VOID", *NUMBERS)) | listed(e["value"]))
    whole = meta.rlike(r"(?s)\A\s*\{.*\}\s*\z")
    return F.when(~F.coalesce(whole & F.forall(_pairs(meta), good), F.lit(False)), F.lit("FRONTMATTER_INVALID"))


def _line(e: Column) -> Column:
    key, v = e["key"], e["value"]
    quoted = F.concat(F.lit('"'), F.replace(_text(v), F.lit('"'), F.lit('\\"')), F.lit('"'))
    scalar = F.when((_kind(v) == "STRING") & (_text(v).rlike(r"\A[\[\]]") | _text(v).rlike("[\"'#]")), quoted).otherwise(_text(v))
    trimmed = lambda x: F.regexp_replace(_text(x), r"\A\s+|\s+\z", "")
    value = F.when(_kind(v) == "ARRAY", F.concat(F.lit("["), F.array_join(F.transform(_items(v), trimmed), ", "), F.lit("]"))).otherwise(scalar)
    return F.concat(key, F.lit(": "), value)


def serialized(meta: Column, content: Column) -> Column:
    """The text of a file: frontmatter lines without nulls, and the body, right-trimmed, with one line break at the end."""
    lines = F.transform(F.filter(_pairs(meta), lambda e: e["value"].isNotNull() & (_kind(e["value"]) != "VOID")), _line)
    body = F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+\z", "")
    return F.concat(F.array_join(F.concat(F.array(F.lit("---")), lines, F.array(F.lit("---"), F.lit(""))), "\n"), F.lit("\n"), body, F.lit("\n"))


def draft_batch(index: Index, topics: DataFrame, root: str = "/entries", duplicate_threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """Drafts of entries (qid, topic, content, suggested_path, source_url): one row each.

    code is PATH_INVALID if a path was suggested that won't do, and the draft's fields are null
    then. One batch search finds what is like each; at most BACKLINKS rows of it stay with an entry.
    """
    asked = F.coalesce("suggested_path", F.lit("")) != ""
    code = F.when(asked & path_code(F.col("suggested_path"), root).isNotNull(), F.lit("PATH_INVALID"))
    path = F.when(asked, clean_path(F.col("suggested_path"), root)).otherwise(F.concat(T.slug(F.col("topic")), F.lit(".md")))
    heads = topics.withColumn("code", code)
    good = heads.where("code IS NULL").select("qid", "topic", "content", "source_url", path.alias("path"))
    found = write_table(similar_batch(index, good.select("qid", "content"), BACKLINKS, duplicate_threshold=duplicate_threshold), "similar")
    links = backlinks(found).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id", "doc_id", "title", "score"))).alias("backlinks"))
    best = found.where("rank = 1").where(F.col("overlap") >= duplicate_threshold).select("qid", F.struct("doc_id", "overlap").alias("duplicate_warning"))
    hits = glossary_hits(index, good.select("qid", "content")).groupBy("qid").agg(F.array_sort(F.collect_set("key")).alias("glossary_hits"))
    made = good.select("qid", F.col("path").alias("suggested_path"), T.title_of_topic(F.col("topic")).alias("title"), T.type_of_path(F.col("path")).alias("type"), "source_url")
    rows = heads.select("qid", "code").join(made, "qid", "left").join(facet_vote(index, found), "qid", "left").join(hits, "qid", "left").join(links, "qid", "left").join(best, "qid", "left")
    none = lambda c, t: F.when(F.col("code").isNull(), F.coalesce(c, F.array().cast(t))).alias(c)
    return rows.select(
        "qid", "code", "suggested_path", "title", "type", "category", none("tags", "array<string>"), "source_url", none("glossary_hits", "array<string>"),
        F.when(F.col("code").isNull(), F.coalesce(F.transform("backlinks", lambda x: x.dropFields("rank").withField("reason", F.lit("bm25"))), F.array())).alias("backlinks"), "duplicate_warning",
    )


def checked(index: Index, entries: DataFrame, present: DataFrame, root: str = "/entries", allow_duplicate: bool = False, overwrite: bool = False,
            duplicate_threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """Entries with code, path (clean), text and duplicate_warning, checked in the order path, presence, frontmatter, duplicate.

    present: (file_path) of the files that are there. Of entries of one batch with one path
    the first by qid stands, and the others are EXISTS; with overwrite all stand, and the last is the one
    kept (column kept). Duplicates are looked for in the index as it is before the batch.
    """
    rows = entries.withColumn("code", path_code(F.col("path"), root)).withColumn("path", F.when(F.col("code").isNull(), clean_path(F.col("path"), root)).otherwise(F.col("path")))
    rows = rows.withColumn("text", serialized(F.col("meta"), F.col("content"))).withColumn("meta_code", meta_code(F.col("meta")))
    if not overwrite:
        rows = rows.join(present.select(F.col("file_path").alias("path")).distinct().withColumn("there", F.lit(True)), "path", "left")
        rows = rows.withColumn("code", F.coalesce("code", F.when(F.col("there"), F.lit("EXISTS")))).drop("there")
    rows = write_table(rows.withColumn("code", F.coalesce("code", "meta_code")).drop("meta_code"), "entries")
    rows = rows.withColumn("duplicate_warning", F.lit(None).cast("struct<doc_id:string,overlap:double>"))
    if not overwrite:
        found = similar_batch(index, rows.where("code IS NULL").select("qid", "content"), 1, duplicate_threshold=duplicate_threshold)
        like = found.where(F.col("overlap") >= duplicate_threshold).select("qid", F.struct("doc_id", "overlap").alias("like"))
        rows = rows.drop("duplicate_warning").join(like, "qid", "left").withColumnRenamed("like", "duplicate_warning")
        if not allow_duplicate:
            rows = rows.withColumn("code", F.coalesce("code", F.when(F.col("duplicate_warning").isNotNull(), F.lit("DUPLICATE"))))
    # rows that won't be written have partitions of their own, so they don't stand in the way
    w = Window.partitionBy("path", F.col("code").isNull()).orderBy(F.desc("qid") if overwrite else F.col("qid"))
    rows = rows.withColumn("nth", F.row_number().over(w)).withColumn("kept", F.col("code").isNull() & (F.col("nth") == 1))
    return rows.withColumn("code", F.coalesce("code", F.when(F.lit(not overwrite) & (F.col("nth") > 1), F.lit("EXISTS")))).drop("nth")


def report(rows: DataFrame, collection: str, written: bool) -> DataFrame:
    """(qid, code, path, doc_id, bytes, written, duplicate_warning) of checked entries; doc_id and bytes of those without a code."""
    good = F.col("code").isNull()
    return rows.select(
        "qid", "code", "path", F.when(good, markdown.doc_id(F.lit(collection), F.col("path"))).alias("doc_id"), F.when(good, F.octet_length("text")).alias("bytes"),
        (good & F.lit(written)).alias("written"), "duplicate_warning",
    )


def _present(index: Index, root: str) -> DataFrame:
    """Paths of the markdown below a folder, which may not be there yet; contents aren't read."""
    spark = index.spark
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "file_path string")
    return scan(spark, Collection("present", root)).select("file_path")


def write_batch(index: Index, entries: DataFrame, root: str, collection: str, dry_run: bool = False, allow_duplicate: bool = False, overwrite: bool = False,
                enabled: bool = False, duplicate_threshold: float = DUPLICATE_THRESHOLD) -> tuple[DataFrame, Index]:
    """Check entries, write the good ones as files below root, and index them: the report, and the new index.

    Off unless enabled (W11). Files appear together when all are written, or none does (see
    sources/named.py); then one upsert indexes them. root may be on any file system.
    """
    if not enabled:
        return report(entries.withColumns({"code": F.lit("WRITE_FAILED"), "text": F.lit(None).cast("string"), "duplicate_warning": F.lit(None).cast("struct<doc_id:string,overlap:double>")}), collection, False), index
    base = root.split("://", 1)[-1]
    rows = write_table(checked(index, entries, _present(index, root), base, allow_duplicate, overwrite, duplicate_threshold), "checked")
    said = report(rows, collection, not dry_run)
    kept = rows.where("kept")
    if dry_run or kept.isEmpty():
        return said, index
    write_markdown(kept.select(F.col("path").alias("file_path"), "text"), root)
    last = index.documents.agg(F.coalesce(F.max("doc_ord"), F.lit(-1))).first()[0]
    # ids come from one write_table, so a repeated task gives the same places
    placed = write_table(kept.select(F.col("path").alias("file_path"), "text", F.lit(collection).alias("collection"), F.current_timestamp().alias("modified"), (F.monotonically_increasing_id() + last + 1).alias("doc_ord")), "written")
    return said, index.upsert(*markdown.index_markdown(placed))
