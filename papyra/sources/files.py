"""Sources and sinks: collections of markdown and source files, manifests, glossary, entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from papyra.operators import code, glossary, markdown
from papyra.operators.indexing import MOST_GONE, Index, of_the_last, repeated
from papyra.operators.schema import Collection, Config
from papyra.session import write_table
from papyra.sources import named

FILES = "file_path string, text string, collection string, modified timestamp"


def scan(spark: SparkSession, c: Collection) -> DataFrame:
    """Whole files under a root, recursively, with paths relative to it.

    Binary reading keeps every line break; what is no UTF-8 is replaced, and a file that
    vanishes or can't be read is skipped.
    """
    pattern = c.glob or ("*.md" if c.kind == "md" else "*.{" + ",".join(code.EXTENSIONS) + "}")
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern.rsplit("/", 1)[-1])
        .option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(c.root)
    )
    root = F.lit(c.root.split("://")[-1].split(":", 1)[-1].rstrip("/") + "/")
    at = F.instr(F.col("path"), root)
    rel = F.when(at > 0, F.substring(F.col("path"), at + F.length(root), F.lit(1 << 20))).otherwise(F.col("path"))
    rows = raw.select(rel.alias("file_path"), F.decode("content", "UTF-8").alias("text"), F.lit(c.name).alias("collection"), F.col("modificationTime").alias("modified"))
    return rows.where(code.is_code_file(F.col("file_path"))) if c.kind == "code" else rows


def scan_all(spark: SparkSession, collections: list[Collection]) -> DataFrame:
    """All collections, markdown before code, in the order given; doc_ord is the load order."""
    ordered = [c for c in collections if c.kind == "md"] + [c for c in collections if c.kind == "code"]
    each = [scan(spark, c).withColumn("kind", F.lit(c.kind)).withColumn("c_ord", F.lit(i)) for i, c in enumerate(ordered)]
    # paths alone are ranked (contents aren't read for it), in each folder by itself; the order is joined back to the texts
    folder = F.regexp_replace("file_path", "[^/]*$", "")
    paths = reduce(DataFrame.unionByName, [e.select("c_ord", "file_path") for e in each]).withColumn("folder", folder)
    folders = paths.select("c_ord", "folder").distinct().withColumn("f_ord", F.row_number().over(Window.partitionBy("c_ord").orderBy("folder")))
    ranked = paths.withColumn("n", F.row_number().over(Window.partitionBy("c_ord", "folder").orderBy("file_path"))).join(folders, ["c_ord", "folder"])
    place = F.col("c_ord").cast("long") * (1 << 52) + F.col("f_ord").cast("long") * (1 << 24) + F.col("n")
    places = write_table(ranked.select("c_ord", "file_path", place.alias("doc_ord")), "places")
    side = F.broadcast(places) if places.count() <= MOST_GONE else places
    return reduce(DataFrame.unionByName, each).join(side, ["c_ord", "file_path"]).drop("c_ord")


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """One folder of markdown as collection `docs`."""
    return scan_all(spark, [Collection("docs", root)])


def read_manifest(index: Index) -> DataFrame:
    """(file_path, content_hash) of what is indexed."""
    return index.documents.select("file_path", "content_hash")


def documents_and_nodes(files: DataFrame, mode: str = "block") -> tuple[DataFrame, DataFrame]:
    """Index markdown and code files (with their kind) together (S05, S06); of files with one doc_id the one loaded last alone is read."""
    own = F.when(F.col("kind") == "md", markdown.doc_id(F.col("collection"), F.col("file_path"))).otherwise(code.doc_id(F.col("collection"), F.col("file_path")))
    named = files.withColumn("doc_id", own)
    files = of_the_last(named, repeated(named.select("doc_id", "doc_ord"))).drop("doc_id")
    md_docs, md_nodes = markdown.index_markdown(files.where("kind = 'md'"), mode)
    code_docs, code_nodes = code.index_code(files.where("kind = 'code'"))
    return md_docs.unionByName(code_docs), md_nodes.unionByName(code_nodes)


def open_index(spark: SparkSession, config: Config) -> Index:
    """Scan, parse and index everything a configuration names."""
    files = scan_all(spark, list(config.collections))
    docs, nodes = documents_and_nodes(files)
    own = glossary.read_json(spark, config.glossary_path) if config.glossary_path else None
    return Index.build(docs, nodes, config.ranking, config.weights(), own)


def write_markdown(rows: DataFrame, path: str) -> None:
    """Sink (S12): (file_path, text) as files of those names, in a folder a collection where there is that column."""
    named.register(rows.sparkSession)
    name = F.concat_ws("/", *[c for c in ("collection", "file_path") if c in rows.columns])
    rows.select(name.alias("file_path"), "text").write.format("named_files").mode("append").save(path)
