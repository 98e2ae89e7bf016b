"""Curation: drafts, facet votes, validation, writing with duplicate checks."""

from __future__ import annotations

import json
import os
import posixpath
import re
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from papyra.functions import text as T
from papyra.operators import markdown
from papyra.operators.indexing import Index
from papyra.operators.search import find_similar

DUPLICATE_THRESHOLD = 0.35


def answer(call: Callable[[], object]) -> dict:
    """A curation call's result as text (W10): a block of JSON, or the error with its code."""
    try:
        value = call()
        if isinstance(value, DataFrame):
            value = [r.asDict(recursive=True) for r in value.collect()]  # as many as the call's limit
        return {"text": "```json\n" + json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n```", "is_error": False}
    except CuratorError as e:
        return {"text": f"Error: {e.code}: {e}", "is_error": True}
    except Exception as e:  # noqa: BLE001  whatever went wrong is the answer
        return {"text": f"Error: {e}", "is_error": True}


class CuratorError(Exception):
    """code: PATH_ESCAPE, PATH_INVALID, EXISTS, FRONTMATTER_INVALID, DUPLICATE or WRITE_FAILED."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def facet_vote(index: Index, matches: DataFrame, tags: int = 5) -> DataFrame:
    """(qid, category, tags): the category and tags that most matches have; a match votes with its document's; ties by first seen."""
    docs = index.documents.select("doc_id", "tags", F.try_element_at("facets", F.lit("category")).alias("category"))
    rows = matches.join(docs, "doc_id").select("qid", "rank", "tags", "category")
    each = rows.select("qid", "rank", F.lit("tag").alias("what"), F.posexplode("tags").alias("p", "v")).unionByName(
        rows.select("qid", "rank", F.lit("category").alias("what"), F.posexplode("category").alias("p", "v"))
    )
    votes = each.groupBy("qid", "what", "v").agg(F.count("*").alias("n"), F.min(F.struct("rank", "p")).alias("seen"))
    w = Window.partitionBy("qid", "what").orderBy(F.desc("n"), "seen")
    top = votes.withColumn("r", F.row_number().over(w)).where((F.col("r") <= tags) & ((F.col("what") == "tag") | (F.col("r") == 1)))
    return top.groupBy("qid").agg(
        F.max(F.when(F.col("what") == "category", F.col("v"))).alias("category"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == "tag", F.struct("r", "v")))), lambda x: x["v"]).alias("tags"),
    )


def backlinks(matches: DataFrame) -> DataFrame:
    """The best match of each document, in order of rank."""
    w = Window.partitionBy("qid", "doc_id").orderBy("rank")
    return matches.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


#: Characters of glossary keys that one automaton holds; more keys go to several, each of which reads the texts once.
AUTOMATON = 2 << 20


def _inner(c: str) -> bool:
    """Whether a character belongs to a word: a letter, a decimal digit or an underscore."""
    return c == "_" or c.isalpha() or c.isdecimal()


def _stands(text: str, a: int, z: int, key: str, plain: bool) -> bool:
    """Whether text[a:z], equal to the key, stands at word boundaries; those of a plain key are between ASCII letters."""
    before, after = text[a - 1 : a], text[z : z + 1]
    if plain:
        return not (before.isascii() and _inner(before)) and not (after.isascii() and _inner(after))
    return (bool(before) and _inner(before)) != _inner(key[0]) and (bool(after) and _inner(after)) != _inner(key[-1])


def _automaton(keys: list[str]) -> ahocorasick.Automaton:
    """Of each key: itself, whether it is a phrase, whether it is of ASCII letters, digits and underscores alone."""
    a = ahocorasick.Automaton()
    for k in keys:
        a.add_word(k, (k, bool(_BLANK.search(k)), bool(_PLAIN.match(k))))
    a.make_automaton()
    return a


_BLANK, _PLAIN = re.compile(r"\s"), re.compile(r"\A[0-9A-Za-z_]+\Z")
_made: dict[str, ahocorasick.Automaton] = {}  # the automaton that a worker made last


def keys_in(keys: Broadcast):
    """A function of batches (qid, t) giving (qid, key): the keys found in each text, in one pass over it."""
    name = uuid.uuid4().hex

    def run(batches):
        if keys.value and name not in _made:
            _made.clear()
            _made[name] = _automaton(keys.value)
        automaton = _made.get(name)
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column("t").to_pylist()):
                found: set[str] = set()
                for end, (key, phrase, plain) in automaton.iter(text or "") if automaton else ():
                    if key not in found and (phrase or _stands(text, end + 1 - len(key), end + 1, key, plain)):
                        found.add(key)
                at += [i] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([b.column("qid").take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=["qid", "key"])

    return run


def glossary_hits(index: Index, texts: DataFrame) -> DataFrame:
    """(qid, key): glossary keys of two letters at least in each text (qid, content): phrases as substrings, words at word boundaries.

    An automaton of all keys finds those of a text in one pass: the cost is linear in the
    texts and in the keys. Keys are sent to the tasks in parts of AUTOMATON characters at
    most, dealt by a hash, and the texts are read once a part.
    """
    keys = index.glossary.select("key").distinct().where(F.length("key") >= 2)
    low = texts.select("qid", F.lower("content").alias("t"))
    size = keys.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
    parts = 1 + size // AUTOMATON
    found = None
    for k in range(parts):
        own = keys if parts == 1 else keys.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)
        sent = index.spark.sparkContext.broadcast([r["key"] for r in own.collect()])  # about AUTOMATON characters
        one = low.mapInArrow(keys_in(sent), f"qid {low.schema['qid'].dataType.simpleString()}, key string")
        found = one if found is None else found.unionByName(one)
    return found


def draft(index: Index, topic: str, raw_content: str, suggested_path: str | None = None, source_url: str | None = None,
          duplicate_threshold: float = DUPLICATE_THRESHOLD, root: str = "/entries") -> dict:
    """A draft entry: path (one suggested must do as a path below root), frontmatter scaffold, glossary hits, backlinks, duplicate warning (W02). Small results only are collected."""
    spark = index.spark
    if suggested_path:
        try:
            suggested_path = os.path.relpath(validate_path(root, suggested_path), os.path.abspath(root))
        except CuratorError as e:
            raise CuratorError("PATH_INVALID", f"the suggested path won't do: {e}") from e
    matches = find_similar(index, raw_content, duplicate_threshold=duplicate_threshold).persist()
    try:
        one = spark.createDataFrame([(topic, suggested_path or "")], "topic string, path string")
        slugged = F.concat(T.slug(F.col("topic")), F.lit(".md"))
        path = F.when(F.col("path") != "", F.col("path")).otherwise(slugged)
        p = one.select(path.alias("path"), T.type_of_path(path).alias("type"), T.title_of_topic(F.col("topic")).alias("title")).first()
        vote = facet_vote(index, matches).first()
        links = backlinks(matches).orderBy("rank").select("node_id", "doc_id", "title", "score").collect()
        best = matches.orderBy("rank").select("doc_id", "overlap").first()
        hits = [r["key"] for r in glossary_hits(index, spark.createDataFrame([("0", raw_content)], "qid string, content string")).select("key").distinct().orderBy("key").collect()]
    finally:
        matches.unpersist()
    meta: dict = {"title": p["title"]}
    if p["type"]:
        meta["type"] = p["type"]
    if vote and vote["category"]:
        meta["category"] = vote["category"]
    if vote and vote["tags"]:
        meta["tags"] = list(vote["tags"])
    if source_url:
        meta["source_url"] = source_url
        meta["captured_at"] = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    warning = {"doc_id": best["doc_id"], "overlap": best["overlap"]} if best and best["overlap"] >= duplicate_threshold else None
    return {
        "suggested_path": p["path"], "frontmatter": meta, "glossary_hits": hits,
        "backlinks": [{**r.asDict(), "reason": "bm25"} for r in links], "duplicate_warning": warning,
    }


def validate_path(root: str, path: str) -> str:
    """The absolute path of a relative .md path inside root."""
    if not path or not path.strip():
        raise CuratorError("PATH_INVALID", "the path is empty")
    if posixpath.isabs(path) or re.match(r"^[A-Za-z]:[\\/]", path):
        raise CuratorError("PATH_INVALID", "the path must be relative")
    if not path.endswith(".md"):
        raise CuratorError("PATH_INVALID", "the path must end in .md")
    base = os.path.abspath(root)
    full = os.path.normpath(os.path.join(base, path))
    if not full.startswith(base + os.sep):
        raise CuratorError("PATH_ESCAPE", "the path would escape the root")
    return full


def validate_frontmatter(meta: object) -> None:
    """Plain keys; strings, numbers, booleans or lists of strings and numbers; no line breaks; None is skipped."""
    if not isinstance(meta, dict):
        raise CuratorError("FRONTMATTER_INVALID", "frontmatter must be an object")

    def scalar(v: object, more: tuple) -> bool:
        return isinstance(v, (str, int, float, *more)) and not (isinstance(v, str) and re.search(r"[\r\n]", v))

    for k, v in meta.items():
        if not isinstance(k, str) or not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", k):
            raise CuratorError("FRONTMATTER_INVALID", f"bad key {k!r}")
        if v is None:
            continue
        if isinstance(v, list):
            if not all(scalar(x, ()) and not isinstance(x, bool) for x in v):
                raise CuratorError("FRONTMATTER_INVALID", f"bad list at {k}")
        elif not scalar(v, (bool,)):
            raise CuratorError("FRONTMATTER_INVALID", f"bad value at {k}")


def _text(v: object) -> str:
    return str(v).lower() if isinstance(v, bool) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def _value(v: object) -> str:
    s = _text(v)
    return '"' + s.replace('"', '\\"') + '"' if isinstance(v, str) and re.search("^[\\[\\]]|[\"'#]", s) else s


def serialize(meta: dict, content: str) -> str:
    """Frontmatter lines and the body, right-trimmed, with one line break at the end (W08). Items of a list are trimmed, never quoted."""
    lines = [f"{k}: [{', '.join(_text(x).strip() for x in v)}]" if isinstance(v, list) else f"{k}: {_value(v)}" for k, v in meta.items() if v is not None]
    return "\n".join(["---", *lines, "---", "", content.rstrip(), ""])


def write_entry(index: Index, root: str, collection: str, path: str, meta: dict, content: str, dry_run: bool = False, allow_duplicate: bool = False,
                overwrite: bool = False, enabled: bool = False, duplicate_threshold: float = DUPLICATE_THRESHOLD) -> tuple[dict, Index]:
    """Validate, check for duplicates, write the file and index it (W03); returns the report and the new index.

    Writing is off unless enabled says otherwise. The file is written under a temporary name and renamed, so readers never see half of it.
    """
    if not enabled:
        raise CuratorError("WRITE_FAILED", "writing is not enabled")
    full = validate_path(root, path)
    exists = os.path.exists(full)
    if exists and not overwrite:
        raise CuratorError("EXISTS", f"{path} exists")
    validate_frontmatter(meta)
    warning = None
    if not overwrite:
        best = find_similar(index, content, duplicate_threshold=duplicate_threshold).orderBy("rank").select("doc_id", "overlap").first()
        if best and best["overlap"] >= duplicate_threshold:
            warning = {"doc_id": best["doc_id"], "overlap": best["overlap"]}
            if not allow_duplicate:
                raise CuratorError("DUPLICATE", f"like {best['doc_id']} ({best['overlap']:.2f})")
    text = serialize(meta, content)
    report = {"path": path, "bytes": len(text.encode()), "dry_run": dry_run, "duplicate_warning": warning}
    if dry_run:
        return report | {"content": text}, index
    try:
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full + ".tmp", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(full + ".tmp", full)
    except OSError as e:
        raise CuratorError("WRITE_FAILED", str(e)) from e
    spark = index.spark
    last = index.documents.agg(F.coalesce(F.max("doc_ord"), F.lit(-1))).first()[0]
    files = spark.createDataFrame([(path, text, collection, datetime.now(timezone.utc), last + 1)], "file_path string, text string, collection string, modified timestamp, doc_ord long")
    docs, nodes = markdown.index_markdown(files)
    return report | {"doc_id": docs.select("doc_id").first()[0]}, index.upsert(docs, nodes)
