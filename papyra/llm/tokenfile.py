"""Token ids in binary files: frequency-ranked, byte-aligned variable length, control bytes apart.

A file is a sequence of blocks, each readable alone: a header, the ids in order of
falling frequency in all documents (rank to id, up to the last rank of the block), document ids, counts, then for each id's
rank two control bits (bytes less one; four ranks a control byte) and, apart from
them, one to four data bytes. Frequent ids take one byte. Decoding looks up lengths
by control byte in a table and gathers the data bytes with numpy.

Documents are dealt to files by ranges of doc_id and sorted, so files in order of
their first id hold all documents in ascending order. Texts are shuffled and tokenised
once; a task streams its range and holds a block (BLOCK_IDS ids) at a time. That gives
drafts of plain ids; these are counted over all files (a row an id and task) and the
drafts are written anew as ranks of the whole, then dropped. A file is written under
a temporary name and then renamed; only files in the manifest count, so a task that
runs twice does no harm. Files go to a shared folder that pyarrow.fs opens by URI.

Defined cases: a null text is empty and gives the end id alone; a null doc_id sorts
first; equal doc_ids are ordered by text; an empty table gives an empty manifest and
no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.common import table
from papyra.llm.tokens import encoder
from papyra.session import drop_path, scratch_path, write_table

MAGIC, DRAFT = b"PTB1", b"PTD1"
HEADER = struct.Struct("<4sQQQQQ")  # magic, documents, ids, ranks, control bytes, data bytes
BLOCK_IDS = 4 << 20
END = 1

_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of uint32 ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.ones((len(ranks) + 3) // 4 * 4, np.uint8)
    padded[: len(ranks)] = size
    four = (padded - 1).reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8), data


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The way back, by table lookup."""
    size = _LENGTHS[control].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def by_count(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ids in order of falling counts, equal ones by id."""
    return ids[np.lexsort((ids, -counts))].astype("<u4")


def _documents(doc_ids: list[int | None], sizes: np.ndarray) -> bytes:
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([known.tobytes(), null.tobytes(), sizes.astype("<u8").tobytes()])


def encode_block(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, order: np.ndarray) -> bytes:
    """order: all ids by rank."""
    rank = np.zeros(int(order.max()) + 1 if len(order) else 0, np.uint32)
    rank[order] = np.arange(len(order))
    ranks = rank[ids]
    order = order[: int(ranks.max()) + 1 if len(ranks) else 0]
    control, data = encode_ranks(ranks)
    head = HEADER.pack(MAGIC, len(doc_ids), len(ids), len(order), len(control), len(data))
    return b"".join([head, order.tobytes(), _documents(doc_ids, sizes), control.tobytes(), data.tobytes()])


def read_blocks(f):
    """(doc ids, sizes, ids) of each block of an open file."""
    while head := f.read(HEADER.size):
        magic, docs, n, ranks, nc, nd = HEADER.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a block")
        order = np.frombuffer(f.read(4 * ranks), "<u4")
        known = np.frombuffer(f.read(8 * docs), "<i8").tolist()
        null = f.read(docs)
        sizes = np.frombuffer(f.read(8 * docs), "<u8").astype(np.int64)
        control, data = np.frombuffer(f.read(nc), np.uint8), np.frombuffer(f.read(nd), np.uint8)
        yield [None if z else d for d, z in zip(known, null)], sizes, order[decode_ranks(control, data, n)]


def encode_draft(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A block of plain ids, two bytes each if they fit."""
    wide = "<u4" if ids.max(initial=0) >> 16 else "<u2"
    head = HEADER.pack(DRAFT, len(doc_ids), len(ids), int(wide[-1]), 0, 0)
    return b"".join([head, _documents(doc_ids, sizes), ids.astype(wide).tobytes()])


def read_drafts(f):
    """(doc ids, sizes, ids) of each block of an open draft."""
    while head := f.read(HEADER.size):
        magic, docs, n, wide, _, _ = HEADER.unpack(head)
        if magic != DRAFT:
            raise ValueError("not a draft")
        known, null = np.frombuffer(f.read(8 * docs), "<i8").tolist(), f.read(docs)
        sizes = np.frombuffer(f.read(8 * docs), "<u8").astype(np.int64)
        yield [None if z else d for d, z in zip(known, null)], sizes, np.frombuffer(f.read(wide * n), f"<u{wide}")


MANIFEST = "path string, first_id long, n_docs long, n_ids long"


def _writer(folder: str, vocabulary: str, end: int):
    def run(batches):
        enc, out, name, first = encoder(vocabulary), None, None, None
        fs, base = pafs.FileSystem.from_uri(folder)
        docs, sizes, ids, held, n_docs, n_ids = [], [], [], 0, 0, 0

        def flush():
            nonlocal docs, sizes, ids, held, out, name
            if not docs:
                return
            if out is None:
                fs.create_dir(base, recursive=True)
                name = uuid.uuid4().hex
                out = fs.open_output_stream(f"{base}/_{name}.tmp")
            out.write(encode_draft(docs, np.concatenate(sizes), np.concatenate(ids)))
            docs, sizes, ids, held = [], [], [], 0

        for b in batches:
            keys = b.column("doc_id").to_pylist()
            for i, got, n in enc.groups(b.column("text")):
                mine = keys[i : i + len(n)]
                whole = np.insert(got, np.cumsum(n), end)
                if n_docs == 0 and mine:
                    first = mine[0]
                docs += mine
                sizes.append(n + 1)
                ids.append(whole)
                held += len(whole)
                n_docs += len(mine)
                n_ids += len(whole)
                if held >= BLOCK_IDS:
                    flush()
        flush()
        if out is not None:
            out.close()
            fs.move(f"{base}/_{name}.tmp", f"{base}/{name}.bin")
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}.bin"]), pa.array([first], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())],
                names=["path", "first_id", "n_docs", "n_ids"],
            )

    return run


def _counter(batches):
    total = np.zeros(0, np.int64)
    for b in batches:
        for path in b.column("path").to_pylist():
            fs, name = pafs.FileSystem.from_uri(path)
            with fs.open_input_stream(name) as f:
                for _, _, ids in read_drafts(f):
                    n = np.bincount(ids, minlength=len(total))
                    n[: len(total)] += total
                    total = n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


def _ranker(folder: str, sent):
    def run(batches):
        target, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            out = []
            for path in b.column("path").to_pylist():
                fs, draft = pafs.FileSystem.from_uri(path)
                target.create_dir(base, recursive=True)
                name = uuid.uuid4().hex
                with fs.open_input_stream(draft) as f, target.open_output_stream(f"{base}/_{name}.tmp") as to:
                    for docs, sizes, ids in read_drafts(f):
                        to.write(encode_block(docs, sizes, ids, sent.value))
                target.move(f"{base}/_{name}.tmp", f"{base}/{name}.bin")
                out.append(f"{folder}/{name}.bin")
            yield b.set_column(b.schema.get_field_index("path"), "path", pa.array(out, pa.string()))

    return run


def _by_file(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end: int = END) -> DataFrame:
    """Write (doc_id, text) to files under folder; returns the manifest, written as a table."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    at = scratch_path(spark, "drafts")
    drafts = write_table(dealt.mapInArrow(_writer(at, vocabulary, end), MANIFEST), "drafts")
    counts = _by_file(drafts.select("path")).mapInArrow(_counter, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    order = by_count(counts["id"].to_numpy(), counts["n"].to_numpy())
    manifest = write_table(_by_file(drafts).mapInArrow(_ranker(folder, spark.sparkContext.broadcast(order)), MANIFEST), "manifest")
    drop_path(spark, at)
    return manifest


RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _reader(batches):
    for b in batches:
        for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
            fs, name = pafs.FileSystem.from_uri(path)
            with fs.open_input_stream(name) as f:
                for docs, sizes, ids in read_blocks(f):
                    ends = np.cumsum(sizes)
                    view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    crc = [zlib.crc32(view[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    start += int(ends[-1])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents of the files: id, first position over all files, number of ids, their CRC-32."""
    w = Window.orderBy(F.asc_nulls_first("first_id"), "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("start"))
    return _by_file(placed).mapInArrow(_reader, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs, scratch_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")))
