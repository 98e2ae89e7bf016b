"""Source files to documents and nodes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators.code import generic, go, java, python, rust, typescript
from papyra.operators.code.scan import Source
from papyra.operators.schema import DOCUMENTS
from papyra.session import write_table

#: File extensions and the languages they stand for.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python",
    "java": "java", "kt": "kotlin", "scala": "scala", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp",
    "rb": "ruby", "swift": "swift", "php": "php", "lua": "lua", "r": "r", "sh": "shell", "bash": "shell", "zsh": "shell",
}
PARSERS = {e: m.parse for m in (typescript, python, java, go, rust) for e in m.EXTENSIONS}
EXTENSIONS = (*PARSERS, *generic.EXTENSIONS)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, extension(path)), F.lit("unknown"))


def is_code_file(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def symbols(text: str, path: str) -> tuple[Source, list]:
    """Scan one file with the parser of its extension."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    src = Source(text)
    if ext in PARSERS:
        PARSERS[ext](src)
    else:
        generic.parse(src, ext)
    return src, src.symbols


SYMBOLS = (
    "doc_id string, doc_ord long, ord int, name string, kind string, signature string, content string, line_start int, line_end int, exported boolean, parent_ord int, above array<int>"
)


def _above(found: list, k: int) -> list[int]:
    """Places of a symbol and of what it stands in, the nearest first."""
    out = [k]
    while found[out[-1]].parent is not None:
        out.append(found[out[-1]].parent)
    return out


def _run(batches):
    for b in batches:
        rows = []
        for d, o, path, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_ord", "file_path", "text"))):
            src, found = symbols(text or "", path)
            rows += [(d, o, k, s.name, s.kind, s.signature, src.content(s), s.start + 1, s.end + 1, s.exported, s.parent, _above(found, k)) for k, s in enumerate(found)]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.int32())]
        cols = list(zip(*rows)) if rows else [[]] * len(kinds)
        names = [c.split()[0] for c in SYMBOLS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)


def parse_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (doc_id, doc_ord, file_path, text): an Arrow batch operator."""
    return files.select("doc_id", "doc_ord", "file_path", "text").mapInArrow(_run, SYMBOLS)


def level_of(kind: Column, has_parent: Column) -> Column:
    return F.when(~has_parent, 1).when(kind == "property", 3).otherwise(2)


def nodes_of(files: DataFrame) -> DataFrame:
    """Nodes of files; one without symbols is a single node with the file's name (C02, C03). Files are parsed once: what is found is written."""
    found = write_table(parse_symbols(files), "symbols")
    title = F.when(F.col("kind") == "import", F.col("name")).otherwise(F.concat_ws(" ", "kind", "name"))
    rows = found.select(
        "doc_id", "doc_ord", "ord", F.concat("doc_id", F.lit(":n"), F.col("ord") + 1).alias("node_id"), title.alias("title"),
        level_of(F.col("kind"), F.col("parent_ord").isNotNull()).alias("level"),
        F.when(F.col("parent_ord").isNotNull(), F.concat("doc_id", F.lit(":n"), F.col("parent_ord") + 1)).alias("parent_id"),
        "content", F.left("signature", F.lit(200)).alias("summary"), "line_start", "line_end", "kind", "exported",
        F.transform("above", lambda o: F.concat(F.col("doc_id"), F.lit(":n"), o + 1)).alias("path"),
    )
    lone = files.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", "doc_ord", F.lit(0).alias("ord"), F.concat("doc_id", F.lit(":n1")).alias("node_id"), T.base_name(F.col("file_path")).alias("title"),
        F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.col("text").alias("content"), F.left("text", F.lit(200)).alias("summary"),
        F.lit(1).alias("line_start"), F.size(F.split("text", "\n")).alias("line_end"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("boolean").alias("exported"),
        F.array(F.concat("doc_id", F.lit(":n1"))).alias("path"),
    )
    both = rows.unionByName(lone)
    return both.select(
        "doc_id", "doc_ord", "ord", "node_id", "title", "level", "parent_id", "content", "summary", T.word_count(F.col("content")).alias("word_count"),
        "line_start", "line_end", "kind", "exported", "path",
    )


def description(nodes: DataFrame) -> DataFrame:
    """(doc_id, description): numbers and names of top-level classes, interfaces, functions and types, 200 characters at most."""
    top = nodes.where("parent_id IS NULL")
    names = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("ord", F.regexp_replace("title", r"^\w+ ", "").alias("n"))))), lambda x: x["n"])
    kinds = {"class": "classes", "interface": "interfaces", "function": "functions", "type": "types"}
    agg = top.groupBy("doc_id").agg(*(names(k).alias(v) for k, v in kinds.items()))
    one = lambda v: F.when(F.size(v) > 0, F.concat(F.size(v).cast("string"), F.lit(f" {v}: "), F.array_join(v, ", ")))
    text = F.concat_ws("; ", *(one(v) for v in kinds.values()))
    return agg.select("doc_id", F.when(F.length(text) > 200, F.concat(F.left(text, F.lit(197)), F.lit("..."))).otherwise(text).alias("description"))


def doc_id(collection: Column, path: Column) -> Column:
    return F.concat(collection, F.lit(":"), F.regexp_replace(F.regexp_replace(path, r"\.([^./]+)$", "_$1"), r"[/\\]", ":"))


def index_code(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, nodes) of source files (file_path, text, collection, modified, doc_ord)."""
    own = files.select("doc_ord", "file_path", "collection", "modified", F.coalesce("text", F.lit("")).alias("text"), doc_id(F.col("collection"), F.col("file_path")).alias("doc_id"))
    nodes = nodes_of(own)
    agg = nodes.groupBy("doc_id").agg(
        F.sum("word_count").cast("long").alias("word_count"), F.count("*").alias("heading_count"), F.max("level").alias("max_depth"),
        F.array_sort(F.collect_set(F.when(F.col("kind") != "import", F.col("kind")))).alias("kinds"),
        F.array_sort(F.collect_list(F.when(F.col("exported") & (F.col("kind") != "import"), F.struct("ord", F.regexp_replace("title", r"^\w+ ", "").alias("n"))))).alias("tags"),
    )
    rows = own.join(agg, "doc_id").join(description(nodes), "doc_id", "left")
    lang = language(F.col("file_path"))
    facets = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("language").alias("key"), F.array(lang).alias("value")),
                F.struct(F.lit("content_type").alias("key"), F.array(F.lit("code")).alias("value")),
                F.struct(F.lit("symbol_kind").alias("key"), F.col("kinds").alias("value")),
            ),
            lambda e: F.size(e["value"]) > 0,
        )
    )
    docs = rows.select(
        "doc_id", "doc_ord", "file_path", T.base_name(F.col("file_path")).alias("title"),
        F.when(F.coalesce("description", F.lit("")) == "", F.concat(lang, F.lit(" source file"))).otherwise(F.col("description")).alias("description"),
        "word_count", "heading_count", "max_depth", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("last_modified"),
        F.transform(F.slice("tags", 1, 20), lambda x: x["n"]).alias("tags"), F.lower(F.hex(F.xxhash64("text"))).alias("content_hash"), "collection",
        facets.alias("facets"), F.array().cast("array<string>").alias("references"),
    )
    import re

    return docs.select(*(c.split()[0] for c in re.split(r",\s*(?=\w+ \w)", DOCUMENTS))), nodes
