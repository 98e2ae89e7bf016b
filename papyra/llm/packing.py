"""Best-fit packing by hierarchical residual packing.

A document's ids (with an end id) are cut into pieces only if they exceed a sequence:
the first piece takes the remainder, the others are full and stand alone. All other
pieces are packed: partitions pack locally by best fit in order of falling length and
emit nearly full bins; underfull bins become items of a smaller number of partitions,
which pack again with a looser rule of what is nearly full, and so on up a tree. The
last round, or a round that no longer saves bins, emits all.

A task packs ITEMS items at a time and carries underfull bins over, so its memory does
not grow with the partition. A bin has SEQUENCE members at most. Each round's bins are
written to the shared folder, so lost executors repeat one round at most.

Defined cases: a null text is empty and gives one piece of one id; repeated rows are
packed as often as they occur, and dealt evenly; a null doc_id stays null; an empty table gives no rows;
other columns are ignored. Sequence ids are unique, odd for packed bins and even for
full pieces.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import table
from papyra.llm.tokens import encoder
from papyra.session import write_table

SEQUENCE = 1024
END = 2
ITEMS = 50_000
#: Free ids up to which a bin counts as nearly full, by round; beyond the list the last holds.
SLACK = (4, 16, 64)
FAN_IN = 8
#: Bytes of texts that a task encodes and cuts at once; ids, places and copies of them take some twenty times that.
TEXTS = 2 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BINS = (
    "fill int, members array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>, done boolean"
)


def _cutter(vocabulary: str, end: int, size: int):
    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            keys = b.column("doc_id")
            for i, got, n in enc.groups(b.column("text"), TEXTS):
                ends = np.cumsum(n)
                whole = np.insert(got, ends, end).astype("<u4")
                n = n + 1
                parts = (n + size - 1) // size
                doc = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                first = n - (parts - 1) * size
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * size)
                length = np.where(piece == 0, first[doc], size)
                base = (np.cumsum(n) - n)[doc] + start
                view = memoryview(whole).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(base.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(doc + i)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def cut(docs: DataFrame, vocabulary: str, end: int = END, size: int = SEQUENCE) -> DataFrame:
    """Pieces of every document (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_cutter(vocabulary, end, size), PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items per bin: in falling order of size, each into the fullest bin that holds it."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        above = mask >> s
        if above:
            f = s + (above & -above).bit_length() - 1
            k = free[f].pop()
            if not free[f]:
                mask &= ~(1 << f)
            bins[k].append(i)
        else:
            f, k = capacity, len(bins)
            bins.append([i])
        free[f - s].append(k)
        mask |= 1 << (f - s)
    return bins


def _merge(fill: np.ndarray, members: pa.ListArray, capacity: int) -> tuple[np.ndarray, pa.ListArray]:
    """Pack items (with their members) into bins."""
    bins = best_fit(fill, capacity)
    order = np.array([i for b in bins for i in b], np.int64)
    per = np.array([len(b) for b in bins], np.int64)
    total = np.cumsum(fill[order])
    before = total - fill[order]
    first = np.cumsum(per) - per
    shift = before - np.repeat(before[first], per) if len(per) else before
    taken = members.take(pa.array(order))
    counts = np.diff(taken.offsets.to_numpy())
    flat = taken.flatten()
    moved = flat.field("offset").to_numpy() + np.repeat(shift, counts)
    fields = [flat.field(f.name) if f.name != "offset" else pa.array(moved) for f in MEMBER]
    cuts = np.append(0, np.cumsum(np.add.reduceat(counts, first) if len(per) else per)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(fields, fields=list(MEMBER)))
    return np.add.reduceat(fill[order], first) if len(per) else per, lists


def _packer(capacity: int, slack: int, items: int):
    def run(batches):
        fills, lists, held = [], [], 0

        def emit(last: bool):
            nonlocal fills, lists, held
            fill, members = _merge(np.concatenate(fills), pa.concat_arrays(lists), capacity)
            full = fill >= capacity - slack
            stay = np.flatnonzero(~full)
            if not last and len(stay) > items // 2:
                stay = stay[np.argsort(fill[stay], kind="stable")][: items // 2]  # the emptiest wait for more
                full = np.ones(len(fill), bool)
                full[stay] = False
            out = np.arange(len(fill)) if last else np.flatnonzero(full)
            done = fill[out] >= capacity - slack
            if not last:
                fills, lists, held = [fill[stay]], [members.take(pa.array(stay))], len(stay)
            for lo in range(0, len(out), 10_000):
                part = out[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fill[part].astype(np.int32)), members.take(pa.array(part)), pa.array(done[lo : lo + 10_000])], names=["fill", "members", "done"]
                )

        for b in batches:
            if not b.num_rows:
                continue
            fills.append(b.column("fill").to_numpy().astype(np.int64))
            lists.append(b.column("members").cast(pa.list_(MEMBER)))
            held += b.num_rows
            if held >= items:
                yield from emit(False)
        if held:
            yield from emit(True)

    return run


def pack(pieces: DataFrame, capacity: int = SEQUENCE, items: int = ITEMS) -> DataFrame:
    """Place pieces (as of cut, written as a table) into sequences."""
    spark = pieces.sparkSession
    place = "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    full = pieces.where(F.col("length") == capacity).select(
        "*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    part = pieces.where(F.col("length") < capacity)
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    bins = part.select(F.col("length").cast("int").alias("fill"), F.array(member).alias("members"), F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()).alias("k"))
    count = part.count()
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / items)))
    done, level = [], 0
    while count:
        slack = SLACK[min(level, len(SLACK) - 1)]
        dealt = bins.repartition(n, "k").select("fill", "members")
        made = write_table(dealt.mapInArrow(_packer(capacity, slack, items), BINS), "bins")
        open_bins = made.where("NOT done")
        left = open_bins.count()
        if n == 1 or left > 0.98 * count or not left:
            done.append(made.select("members"))
            break
        done.append(made.where("done").select("members"))
        bins = open_bins.select("fill", "members", F.xxhash64("fill", F.col("members")[0]).alias("k"))
        count, n, level = left, max(1, min(n - 1, max(n // FAN_IN, math.ceil(left / items)))), level + 1
    out = full.select(*place)
    for k, d in enumerate(done):
        # numbered before the members are spread: a project above the generator would number members
        numbered = d.withColumn("s", (F.monotonically_increasing_id() * len(done) + k) * 2 + 1).select("s", F.explode("members").alias("m"))
        out = out.unionByName(numbered.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", F.col("s").alias("sequence_id"), "m.offset"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Encode, cut and pack (doc_id, text) with the byte-level vocabulary."""
    return pack(write_table(cut(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))
