"""What several operators share: tables, fold tests, bounded label samples."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.session import attach


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, whole."""
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers that may be broadcast, about 32 bytes each.
BROADCAST = 1_000_000


def beside(keys: DataFrame, most: int = BROADCAST) -> DataFrame:
    """A side of keys to join a large table with: broadcast if it has most rows at most, counted first."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


#: A key is hot if over this share of all rows (one in so many) has it.
SHARE = 1000


def beside_hot(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with keyed (one row a key, n: its rows) without a hot key in one task.

    total: at least half the sum of n, so that 2 * SHARE keys at most are hot. Those are
    broadcast to where their rows lie; the others are dealt by key. n is dropped.
    """
    is_hot = F.col("n") * SHARE > total
    hot, rest = F.broadcast(keyed.where(is_hot).drop("n")), keyed.where(~is_hot).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def trim() -> None:
    """Give memory that is free back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


_resident: dict[str, object] = {}


def resident(key: str, make: Callable[[], object]):
    """The one large object that a worker process keeps between tasks; another key takes its place."""
    if key not in _resident:
        _resident.clear()
        trim()
        _resident[key] = make()
    return _resident[key]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y, h) of the training fold, about per_class distinct rows a class at most.

    Rows whose crc32(doc_id) mod 4 is 2 are left out. Where a class has more labels
    than per_class, a hash of the id picks about that many; repeated labels of one id
    count once (the largest). Where ids repeat among the documents, rows count once each
    by id and text (h is a hash of both), and if those are more than per_class, the hash
    picks again. So rows, too, are bounded by the parameter, however often an id or a row
    repeats. The labels picked are broadcast to the scan of the documents; no text is
    shuffled but those of repeated ids. Also returns the labels of each class before
    sampling, to put the prior right.
    """
    lab = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~fold(F.col("doc_id"), 4, 2))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .withColumn("y", (F.col("y") > 0).cast("int"))
    )
    sizes = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64("doc_id", "text").alias("h")
    if not sizes:
        return docs.select("doc_id", "text", F.lit(0).alias("y"), h).limit(0), {}
    picked = F.broadcast(lab.where(_share(F.xxhash64("doc_id", F.lit("sample")), sizes, per_class)))
    rows = docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "text", "y", h)
    found = docs.select("doc_id").join(picked, "doc_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if found["n"] > found["ids"]:
        distinct = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.approx_count_distinct("h", 0.01).alias("n")).collect()}
        rows = rows.where(_share(F.xxhash64("h"), distinct, per_class)).dropDuplicates(["h"])
    return rows, sizes


def _share(h: Column, sizes: dict[int, int], per_class: int) -> Column:
    """Whether a hash is among those that leave about per_class of each class y."""
    keep = F.lit(False)
    for y, n in sizes.items():
        keep = keep | ((F.col("y") == y) & (F.pmod(h, F.lit(1 << 40)) < int(min(1.0, per_class / n) * (1 << 40))))
    return keep


def prior_shift(y: np.ndarray, sizes: dict[int, int]) -> float:
    """What to add to the log odds learned on a sample with other shares of the classes."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return 0.0
    return float(np.log(sizes.get(1, n1) / sizes.get(0, n0)) - np.log(n1 / n0))
