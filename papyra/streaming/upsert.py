"""Continuous indexing: a stream of files, upserted batch by batch (I12 as a stream)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from papyra.operators.indexing import Index, changed
from papyra.operators.schema import Collection
from papyra.session import drop_path, recorded, write_table
from papyra.sources.files import documents_and_nodes, read_manifest


class LiveIndex:
    """Holds the newest index; each micro-batch replaces it as a whole, so readers see one state.

    When the tables have been written whole, those of the time before the last such write
    are dropped: whoever holds an older index has until the next one.
    """

    def __init__(self, index: Index):
        self.index = index.make()  # so that no batch makes, and later drops, a table that outlives it
        self.batches = 0
        self._last: int | None = None  # the greatest place in the load order, found once
        self._now: list[str] = []
        self._before: list[str] = []

    def apply(self, files: DataFrame, batch_id: int) -> None:
        """Index the files of a batch whose content changed; of a path's versions the latest counts."""
        latest = files.groupBy("file_path", "collection", "kind").agg(F.max_by("text", "modified").alias("text"), F.max("modified").alias("modified"))
        hashed = latest.withColumn("content_hash", F.lower(F.hex(F.xxhash64("text"))))
        self.put(changed(hashed, read_manifest(self.index)).drop("content_hash"))

    def put(self, new: DataFrame) -> None:
        """Index files (file_path, collection, kind, text, modified), one row a path, all of them changed."""
        with recorded() as paths:
            new = write_table(new, "changed")  # once: a batch's state is read and written by one run of it
            n = new.count()
            if n:
                self._upsert(new, n)
        if not n:
            for path in paths:
                drop_path(self.index.spark, path)
            return
        if self.index.changes == 0:
            for path in self._before:
                drop_path(self.index.spark, path)
            self._now, self._before = [], self._now
        self._now += paths
        self.batches += 1

    def _upsert(self, new: DataFrame, n: int) -> None:
        if self._last is None:
            self._last = self.index.documents.agg(F.coalesce(F.max("doc_ord"), F.lit(-1))).first()[0]
        last, self._last = self._last, self._last + n
        # the paths of one batch alone are numbered in one task, so no two files share a place
        places = new.select(F.col("file_path").alias("p"), F.col("collection").alias("c")).withColumn("doc_ord", F.lit(last) + F.row_number().over(Window.orderBy("c", "p")))
        placed = new.join(places, (F.col("file_path") == F.col("p")) & F.col("collection").eqNullSafe(F.col("c"))).drop("p", "c")
        self.index = self.index.upsert(*documents_and_nodes(placed))


STATE, CHANGED = "hash string", "file_path string, collection string, kind string, text string, modified timestamp"


def _if_changed(key: tuple, versions: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The latest version of a path in a batch, if its text isn't the one seen last."""
    latest = pd.concat(versions).sort_values("modified", kind="stable").tail(1)
    own = hashlib.sha256((latest["text"].iloc[0] or "").encode()).hexdigest()
    if not (state.exists and state.get[0] == own):
        state.update((own,))
        yield latest[["file_path", "collection", "kind", "text", "modified"]]


def changed_files(files: DataFrame) -> DataFrame:
    """Of a stream of files those whose text changed: the hash of each path's last text is kept as keyed state.

    So what a batch costs doesn't depend on how many files there are, and a restarted stream
    goes on from its checkpoint.
    """
    return files.groupBy("collection", "file_path").applyInPandasWithState(_if_changed, CHANGED, STATE, "append", GroupStateTimeout.NoTimeout)


def read_files(spark: SparkSession, c: Collection) -> DataFrame:
    """A stream of new files of a folder."""
    raw = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md" if c.kind == "md" else "*").load(c.root)
    )
    root = c.root.split("://")[-1].rstrip("/") + "/"
    at = F.instr(F.col("path"), F.lit(root))
    rel = F.when(at > 0, F.substring(F.col("path"), at + len(root), F.lit(1 << 20))).otherwise(F.col("path"))
    return raw.select(rel.alias("file_path"), F.decode("content", "UTF-8").alias("text"), F.lit(c.name).alias("collection"), F.col("modificationTime").alias("modified"), F.lit(c.kind).alias("kind"))


def follow(live: LiveIndex, c: Collection, checkpoint: str, once: bool = True, after: Callable[[Index], None] | None = None, keyed: bool = False):
    """Start following a folder; with once, take what is there and stop.

    keyed: what has changed is told from the stream's own state; the documents of the index
    are compared with in the first batch alone. Else each batch is compared with them.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if keyed and batch_id:
            live.put(batch)
        else:
            live.apply(batch, batch_id)
        if after:
            after(live.index)

    files = read_files(live.index.spark, c)
    w = (changed_files(files) if keyed else files).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()
