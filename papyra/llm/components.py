"""Connected components of an edge table, by alternating large and small stars.

Every round is two shuffles with partial minima; its edges are written to the shared
folder, so lost executors cost a round at most and no plan grows. Where edges fill more
than a file, a node with a large share of them gets its minimum by broadcast, so no hub
is one task's work. Nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import beside_hot
from papyra.session import write_table

#: A round's table has a file for so many edges: few files for few edges.
EDGES_A_FILE = 250_000


def _with_low(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    return beside_hot(rows, low, "a", total) if total > EDGES_A_FILE else rows.join(low.drop("n"), "a")


def _low(rows: DataFrame) -> DataFrame:
    return rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))


def _large(e: DataFrame, total: int) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _low(both).select("a", F.least("a", "m").alias("m"), "n")
    return _with_low(both.where("b > a"), low, total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(e: DataFrame, total: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = _low(down)
    other = _with_low(down, low, total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return other.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    edges: columns a and b, whole numbers without nulls; order and repeats don't matter.
    """
    e = write_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last = None
    while True:
        total = last[0] if last else e.count()  # rounds don't add edges
        files = 1 + total // EDGES_A_FILE
        turned = _large(e, total)
        if total > EDGES_A_FILE:
            turned = write_table(turned.coalesce(files), "edges")
        e = write_table(_small(turned, total).coalesce(files), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
