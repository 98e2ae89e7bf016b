"""Trees as tables: parents by window, ancestors, outlines, subtrees, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from papyra.operators.indexing import Index


def with_parents(nodes: DataFrame, levels: range = range(0, 7)) -> DataFrame:
    """parent_id: the nearest node before, of a smaller level; path: the node and its ancestors, the nearest first.

    Nodes have doc_id, ord, level, node_id. Of each level the last node before is known from
    one window; it is an ancestor if no node of a smaller level has come since.
    """
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.struct("ord", "node_id")), ignorenulls=True).over(before) for k in levels}
    cols = nodes.select("*", *(c.alias(f"__l{k}") for k, c in last.items()))
    nearest = F.greatest(*(F.when(F.col("level") > k, F.col(f"__l{k}")) for k in levels))

    def open_at(k: int):
        closed = [F.coalesce(F.col(f"__l{j}.ord") > F.col(f"__l{k}.ord"), F.lit(False)) for j in levels if j < k]
        return F.when((F.col("level") > k) & ~reduce(lambda a, c: a | c, closed, F.lit(False)), F.col(f"__l{k}.node_id"))

    path = F.array_compact(F.array(F.col("node_id"), *(open_at(k) for k in reversed(levels))))
    return cols.withColumns({"parent_id": nearest["node_id"], "path": path}).drop(*(f"__l{k}" for k in levels))


def children(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, children) in document order, for nodes that have any."""
    kids = nodes.where("parent_id IS NOT NULL").groupBy("doc_id", "parent_id").agg(F.sort_array(F.collect_list(F.struct("ord", "node_id"))).alias("k"))
    return kids.select("doc_id", F.col("parent_id").alias("node_id"), F.transform("k", lambda x: x["node_id"]).alias("children"))


def with_children(nodes: DataFrame) -> DataFrame:
    return nodes.join(children(nodes), ["doc_id", "node_id"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, ancestor, depth) pairs, a node its own ancestor at depth 0.

    Nodes with a path have them there; for others one chain of equality joins; a parent's level is smaller than its child's, so the
    span of levels (six at most) says how many joins reach every root.
    """
    if "path" in nodes.columns:
        return nodes.select("doc_id", "node_id", F.posexplode("path").alias("depth", "ancestor")).select("doc_id", "node_id", "ancestor", "depth")
    most = nodes.agg(F.max("level") - F.min("level")).first()[0] or 0
    base = nodes.select("doc_id", "node_id", "parent_id")
    up = base.select(F.col("doc_id").alias("__d"), F.col("node_id").alias("__n"), F.col("parent_id").alias("__p"))
    rows = base.select("doc_id", "node_id", F.array("node_id").alias("chain"), F.col("parent_id").alias("__up"))
    for _ in range(most - 1):
        rows = rows.join(up, (F.col("doc_id") == F.col("__d")) & (F.col("__up") == F.col("__n")), "left").select(
            "doc_id", "node_id", F.when(F.col("__up").isNotNull(), F.concat("chain", F.array("__up"))).otherwise(F.col("chain")).alias("chain"), F.col("__p").alias("__up")
        )
    whole = F.when(F.col("__up").isNotNull(), F.concat("chain", F.array("__up"))).otherwise(F.col("chain"))
    return rows.select("doc_id", "node_id", F.posexplode(whole).alias("depth", "ancestor")).select("doc_id", "node_id", "ancestor", "depth")


def outline(index: Index, doc_id: str) -> DataFrame:
    """Nodes of a document without their content (T07); the scan doesn't read content."""
    return index.nodes.where(F.col("doc_id") == doc_id).select("doc_id", "ord", "node_id", "title", "level", "parent_id", "summary", "word_count", "line_start", "line_end").orderBy("ord")


def roots(nodes: DataFrame) -> DataFrame:
    """(doc_id, root_nodes) in order."""
    r = nodes.where("parent_id IS NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "node_id"))).alias("r"))
    return r.select("doc_id", F.transform("r", lambda x: x["node_id"]).alias("root_nodes"))


def node_content(index: Index, doc_id: str, node_ids: list[str]) -> DataFrame:
    """Contents in the order asked for; unknown ids are left out, repeated ones stay (T08). One to ten ids."""
    if not 1 <= len(node_ids) <= 10:
        raise ValueError("one to ten node ids")
    asked = index.spark.createDataFrame(list(enumerate(node_ids)), "pos int, node_id string")
    own = index.nodes.where(F.col("doc_id") == doc_id)
    return own.join(F.broadcast(asked), "node_id").orderBy("pos").select("pos", "node_id", "title", "level", "content", "word_count", "line_start", "line_end")


def subtrees(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Breadth-first subtrees of many roots (doc_id, root): rows with depth, in order of (depth, ord)."""
    down = wanted.select("doc_id", F.col("root").alias("node_id"), "root").withColumn("depth", F.lit(0))
    if "path" in nodes.columns:  # each node meets the roots it stands under, by equality
        rows = nodes.select("*", F.posexplode("path").alias("depth", "root"))
        return rows.join(wanted.select("doc_id", "root").distinct(), ["doc_id", "root"], "left_semi")
    docs = nodes.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = ancestors(docs).withColumnRenamed("ancestor", "root").join(down.select("doc_id", "root"), ["doc_id", "root"], "left_semi")
    return pairs.join(docs, ["doc_id", "node_id"])


def subtree(index: Index, doc_id: str, node_id: str) -> DataFrame:
    """The subtree of one node, in order of (depth, ord): a predicate on the written paths."""
    own = index.nodes.where(F.col("doc_id") == doc_id)
    if "path" in own.columns:
        rows = own.where(F.array_contains("path", node_id)).withColumns({"root": F.lit(node_id), "depth": (F.array_position("path", node_id) - 1).cast("int")})
    else:
        rows = subtrees(own, index.spark.createDataFrame([(doc_id, node_id)], "doc_id string, root string"))
    return rows.orderBy("depth", "ord")


def title_slug(title):
    """Slug of a heading as links use it."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def resolve_refs(index: Index, refs: DataFrame) -> DataFrame:
    """For refs (ref_id, ref): doc_id by base name, node_id by fragment (slug of a title or a node id, the first); unknown files are left out."""
    parts = F.split("ref", "#", 2)
    r = refs.select("ref_id", "ref", F.element_at(F.split(parts[0], "/"), -1).alias("basename"), F.get(parts, F.lit(1)).alias("fragment"))
    docs = r.join(index.refs, "basename").withColumn("want", title_slug(F.col("fragment")))
    node = index.nodes.select(F.col("doc_id").alias("d"), F.col("node_id").alias("n"), "ord", title_slug(F.col("title")).alias("slug"))
    hit = docs.join(node, (F.col("doc_id") == F.col("d")) & ((F.col("slug") == F.col("want")) | (F.col("n") == F.col("fragment"))), "left")
    return hit.groupBy("ref_id", "ref", "doc_id").agg(F.min_by("n", "ord").alias("node_id"))
