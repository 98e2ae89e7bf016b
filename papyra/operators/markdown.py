"""Markdown to documents and nodes (P01-P20): column expressions, a line mode in SQL operators, a block mode in Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from papyra.functions import text as T
from papyra.operators.schema import DOCUMENTS
from papyra.operators.tree import with_parents

FRONTMATTER = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
#: Frontmatter keys that are no facets.
NO_FACETS = ("title", "description", "layout", "permalink", "slug", "draft", "date", "tags")


def frontmatter(text: Column) -> Column:
    """The lines between the fences, or an empty string."""
    return F.when(text.rlike(FRONTMATTER), F.regexp_extract(text, FRONTMATTER, 1)).otherwise(F.lit(""))


def body(text: Column) -> Column:
    return F.when(text.rlike(FRONTMATTER), F.regexp_extract(text, FRONTMATTER, 2)).otherwise(text)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def frontmatter_map(fm: Column) -> Column:
    """map<string, array<string>>: `[a, b]` is a list, all else one value; the last of equal keys counts."""
    line = r"^(\w+):\s*(.+)$"
    found = F.filter(F.split(fm, "\n"), lambda x: x.rlike(line))

    def entry(x: Column) -> Column:
        value = _strip(F.regexp_extract(x, line, 2))
        many = F.transform(
            F.filter(F.transform(F.split(F.regexp_replace(value, r"[\[\]]", ""), ","), _strip), lambda v: v != ""),
            lambda v: F.regexp_replace(v, r"""^["']|["']$""", ""),
        )
        one = F.array(F.regexp_replace(value, r"""^["']|["']$""", ""))
        return F.struct(F.regexp_extract(x, line, 1).alias("key"), F.when(F.startswith(value, F.lit("[")), many).otherwise(one).alias("value"))

    entries = F.transform(found, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda z: z["key"] == e["key"]))
    return F.map_from_entries(last)


def meta_facets(meta: Column) -> Column:
    return F.map_filter(meta, lambda k, v: ~k.isin(*NO_FACETS))


def content_facets(b: Column) -> Column:
    """has_code, code_languages and has_links of a body, as far as they hold."""
    languages = F.array_sort(F.array_distinct(F.transform(F.filter(F.regexp_extract_all(b, F.lit(r"```(\w+)?"), F.lit(1)), lambda x: x != ""), F.lower)))
    links = F.filter(F.regexp_extract_all(b, F.lit(r"\[[^\]]*\]\([^)]+\)"), F.lit(0)), lambda x: ~x.rlike(r"(?i)\]\(https?://"))
    true = F.array(F.lit("true"))
    pairs = F.array(
        F.struct(F.lit("has_code").alias("key"), F.when(F.contains(b, F.lit("```")), true).alias("value")),
        F.struct(F.lit("code_languages").alias("key"), F.when(F.size(languages) > 0, languages).alias("value")),
        F.struct(F.lit("has_links").alias("key"), F.when(F.size(links) > 0, true).alias("value")),
    )
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def all_facets(meta: Column, b: Column, path: Column) -> Column:
    """Frontmatter facets, then those of the content and of the path where a key is missing."""
    own = meta_facets(meta)
    more = F.map_filter(content_facets(b), lambda k, v: ~F.map_contains_key(own, k))
    named = T.type_of_path(path)
    kind = F.when(named.isNotNull() & ~F.map_contains_key(own, F.lit("type")), F.create_map(F.lit("type"), F.array(named)))
    return F.map_concat(own, more, F.coalesce(kind, F.create_map().cast("map<string,array<string>>")))


def references(b: Column, path: Column) -> Column:
    """Paths of local links, without fragments, resolved against the file's folder, each once in order."""
    targets = F.transform(F.regexp_extract_all(b, F.lit(r"\[([^\]]*)\]\(([^)]+)\)"), F.lit(2)), lambda x: _strip(F.split(x, "#")[0]))
    local = F.filter(targets, lambda x: (x != "") & ~x.rlike("(?i)^(https?://|mailto:)"))
    folder = T.directory(path)

    def resolve(x: Column) -> Column:
        return F.when(F.startswith(x, F.lit("/")), F.regexp_replace(x, "^/", "")).otherwise(
            T.normal_path(F.when(folder == "", x).otherwise(F.concat(folder, F.lit("/"), x)))
        )

    return F.array_distinct(F.transform(local, resolve))


def doc_id(collection: Column, path: Column) -> Column:
    return F.concat(collection, F.lit(":"), F.regexp_replace(F.regexp_replace(path, r"(?i)\.md$", ""), r"[/\\]", ":"))


# -- line mode ---------------------------------------------------------------

HEADING = r"^(#{1,6})\s+(.+)$"


def line_sections(files: DataFrame) -> DataFrame:
    """Sections by heading lines alone (P04, P08); files: doc_id, doc_ord, body. Text before the first heading is dropped.

    Columns: doc_id, doc_ord, ord, level, title, content, line_start, line_end.
    """
    lines = files.select("doc_id", "doc_ord", F.posexplode(F.split("body", "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i")
    head = F.col("line").rlike(HEADING)
    numbered = lines.withColumn("h", head).withColumn("section", F.sum(F.col("h").cast("int")).over(w))
    parts = numbered.where("section >= 1").groupBy("doc_id", "section").agg(
        F.first("doc_ord").alias("doc_ord"), F.min("i").alias("i"), F.max("i").alias("j"), F.min_by("line", "i").alias("head"),
        F.sort_array(F.collect_list(F.when(~F.col("h"), F.struct("i", "line")))).alias("rest"),
    )
    return parts.select(
        "doc_id", "doc_ord", (F.col("section") - 1).cast("int").alias("ord"), F.length(F.regexp_extract("head", HEADING, 1)).alias("level"),
        T.strip_html(F.regexp_extract("head", HEADING, 2)).alias("title"), _strip(F.array_join(F.transform("rest", lambda x: x["line"]), "\n")).alias("content"),
        (F.col("i") + 1).alias("line_start"), (F.col("j") + 1).alias("line_end"),
    )


# -- block mode --------------------------------------------------------------

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^`\s]*)[^`]*$")
_ITEM = re.compile(r"^ {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_INLINE = ((re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"`+([^`]*)`+"), r"\1"), (re.compile(r"(\*\*|__|\*)(?=\S)(.+?)(?<=\S)\1"), r"\2"))
_TAG = re.compile(r"<[^>]+>")


def _plain(s: str) -> str:
    for pattern, put in _INLINE:
        s = pattern.sub(put, s)
    return _TAG.sub("", s).strip()


def block_sections(text: str) -> list[tuple[int, str, str, int, int]]:
    """(level, title, content, line_start, line_end) by a block scan: fences, tables, lists and quotes are blocks, headings inside them are not."""
    lines = text.split("\n")
    out: list[list] = []
    buffer: list[str] = []
    para: list[str] = []

    def end_para() -> None:
        if para:
            buffer.append(_plain(" ".join(x.strip() for x in para)))
            para.clear()

    def start(level: int, title: str, line: int) -> None:
        end_para()
        if out:
            out[-1][2] = "\n".join(buffer).strip()
            out[-1][4] = line - 1
        buffer.clear()
        out.append([level, _plain(title), "", line, len(lines)])

    i = 0
    while i < len(lines):
        line = lines[i]
        fence = _FENCE.match(line)
        if fence:
            end_para()
            close = re.compile(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$")
            j = i + 1
            while j < len(lines) and not close.match(lines[j]):
                j += 1
            buffer.append(f"[code:{fence[2]}] " + "\n".join(lines[i + 1 : j]))
            i = j + 1
            continue
        head = _ATX.match(line)
        if head:
            start(len(head[1]), head[2] or "", i + 1)
        elif para and _SETEXT.match(line):
            title, first = " ".join(x.strip() for x in para), i + 1 - len(para)
            para.clear()
            start(1 if line.strip()[0] == "=" else 2, title, first)
        elif not line.strip():
            end_para()
        elif _RULE.match(line):
            end_para()
        elif line.lstrip().startswith(">"):
            end_para()
            quote = []
            while i < len(lines) and lines[i].strip():
                quote.append(re.sub(r"^\s*>\s?", "", lines[i]))
                i += 1
            buffer.append("> " + _plain(" ".join(x.strip() for x in quote)))
            continue
        elif _ITEM.match(line) and not (para and not re.match(r"^ {0,3}[-*+1]", line)):
            end_para()
            item: list[str] = []
            while i < len(lines):
                if _ITEM.match(lines[i]):
                    if item:
                        buffer.append("- " + _plain(" ".join(item)))
                    item = [_ITEM.sub("", lines[i]).strip()]
                elif not lines[i].strip():
                    if i + 1 >= len(lines) or not (_ITEM.match(lines[i + 1]) or lines[i + 1].startswith(("  ", "\t"))):
                        break
                elif _ATX.match(lines[i]) or _FENCE.match(lines[i]):
                    break
                else:
                    item.append(lines[i].strip())
                i += 1
            if item:
                buffer.append("- " + _plain(" ".join(item)))
            continue
        elif "|" in line and not para and i + 1 < len(lines) and _DELIMITER.match(lines[i + 1]):
            rows = [line]
            i += 2
            while i < len(lines) and "|" in lines[i]:
                rows.append(lines[i])
                i += 1
            cells = [" ".join(_plain(c) for c in r.strip().strip("|").split("|")) for r in rows]
            buffer.append("[table] " + " ".join(cells))
            continue
        else:
            para.append(line)
        i += 1
    end_para()
    if out:
        out[-1][2] = "\n".join(buffer).strip()
    return [tuple(x) for x in out]


def _block_run(batches):
    for b in batches:
        rows = []
        for d, o, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_ord", "body"))):
            rows += [(d, o, k, *s) for k, s in enumerate(block_sections(text or ""))]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        cols = list(zip(*rows)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "doc_ord", "ord", "level", "title", "content", "line_start", "line_end"])


SECTIONS = "doc_id string, doc_ord long, ord int, level int, title string, content string, line_start int, line_end int"


def block_mode(files: DataFrame) -> DataFrame:
    return files.select("doc_id", "doc_ord", "body").mapInArrow(_block_run, SECTIONS)


# -- documents and nodes -----------------------------------------------------


def nodes_of(files: DataFrame, mode: str = "block") -> DataFrame:
    """Nodes of files (doc_id, doc_ord, body); a file without headings is one root node of level 0."""
    sections = (block_mode if mode == "block" else line_sections)(files)
    text = _strip(F.col("body"))
    lone = files.join(sections.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", "doc_ord", F.lit(0).alias("ord"), F.lit(0).alias("level"), F.lit("(document root)").alias("title"), text.alias("content"),
        F.lit(1).alias("line_start"), F.size(F.split("body", "\n")).alias("line_end"),
    )
    summary = F.when(F.col("level") == 0, F.left("content", F.lit(200))).otherwise(T.first_sentence(F.col("content")))
    rows = sections.unionByName(lone).withColumn("node_id", F.concat("doc_id", F.lit(":n"), F.col("ord") + 1)).withColumn("summary", summary)
    return with_parents(rows).select(
        "doc_id", "doc_ord", "ord", "node_id", "title", "level", "parent_id", "content", "summary", T.word_count(F.col("content")).alias("word_count"),
        "line_start", "line_end", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("boolean").alias("exported"), "path",
    )


def doc_totals(nodes: DataFrame) -> DataFrame:
    """Per document: words, nodes, greatest level, title of the first node of level 0 or 1, summary of the first node (P20)."""
    return nodes.groupBy("doc_id").agg(
        F.sum("word_count").cast("long").alias("word_count"), F.count("*").alias("heading_count"), F.max("level").alias("max_depth"),
        F.min_by(F.when(F.col("level") <= 1, F.col("title")), F.when(F.col("level") <= 1, F.col("ord"))).alias("__first_title"), F.min_by("summary", "ord").alias("__first_summary"),
    )


def index_markdown(files: DataFrame, mode: str = "block") -> tuple[DataFrame, DataFrame]:
    """(documents, nodes) of files (file_path, text, collection, modified, doc_ord)."""
    own = files.select(
        doc_id(F.col("collection"), F.col("file_path")).alias("doc_id"), "doc_ord", "file_path", "collection", "modified",
        F.lower(F.hex(F.xxhash64("text"))).alias("content_hash"), frontmatter_map(frontmatter(F.col("text"))).alias("meta"), body(F.col("text")).alias("body"),
    )
    nodes = nodes_of(own, mode)
    rows = own.join(doc_totals(nodes), "doc_id", "left")
    one = lambda k: F.nullif(F.get(F.try_element_at("meta", F.lit(k)), F.lit(0)), F.lit(""))
    base = F.regexp_replace(T.base_name(F.col("file_path")), r"(?i)\.md$", "")
    first = F.nullif("__first_title", F.lit(""))
    docs = rows.select(
        "doc_id", "doc_ord", "file_path", T.better_title(F.coalesce(one("title"), first, base), F.col("file_path")).alias("title"),
        F.coalesce(one("description"), F.col("__first_summary"), F.lit("")).alias("description"),
        F.coalesce("word_count", F.lit(0)).cast("long").alias("word_count"), F.coalesce("heading_count", F.lit(0)).cast("long").alias("heading_count"), F.coalesce("max_depth", F.lit(0)).alias("max_depth"),
        F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("last_modified"),
        F.coalesce(F.try_element_at("meta", F.lit("tags")), F.array().cast("array<string>")).alias("tags"), "content_hash", "collection",
        all_facets(F.col("meta"), F.col("body"), F.col("file_path")).alias("facets"), references(F.col("body"), F.col("file_path")).alias("references"),
    )
    return docs.select(*(c.split()[0] for c in re.split(r",\s*(?=\w+ \w)", DOCUMENTS))), nodes
