"""Document fingerprints by one-permutation MinHash.

Each five-word shingle (folded words; a shorter text is one shingle) is hashed once;
the upper bits choose one of BINS bins and a bin keeps its least hash. Empty bins are
filled by optimal densification: bin j tries the bins of a fixed sequence of hashes
h(j, 1), h(j, 2), ... and copies the first that wasn't empty. The low BITS bits of
each bin are packed. The share m of equal bins overstates likeness by chance matches,
so likeness is (m - c) / (1 - c) with c = 2^-BITS, at least 0.

The neighbour of a document in order of ids is found without a global sort: ids are
cut at quantiles into buckets, and the last document of a bucket is sent to the next
bucket as well. Texts are shuffled once; a task streams its bucket in order.

Defined cases: null texts count as empty; a text without words has a fingerprint of
zeros (likeness 1 to another such text); a null doc_id sorts before all others; equal
ids are ordered by text; a single document is its own neighbour; an empty table gives
an empty result; very long texts are a group of their own, in memory in proportion to
the longest; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.bytetools import buffers, fold_map, mix, span_hashes, words
from papyra.llm.common import table
from papyra.llm.features import groups

SHINGLE = 5
BIN_BITS = 9
BINS = 1 << BIN_BITS
BITS = 4
FOLD = fold_map()
#: Texts go in groups of about this many bytes; a group fills and packs its bins at once.
GROUP = 2 << 20
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle."""
    s, e, rows = words(data, offsets, FOLD)
    h = span_hashes(data, s, e, FOLD)
    sizes = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(sizes) - sizes

    def chain(at: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(at), k, np.uint64)
        for j in range(k):
            out = out * _STEP + h[at + j]
        return mix(out)

    out_r, out_h = [], []
    if len(h) >= SHINGLE:
        at = np.flatnonzero(rows[SHINGLE - 1 :] == rows[: len(rows) - SHINGLE + 1])
        out_r.append(rows[at])
        out_h.append(chain(at, SHINGLE))
    for k in range(1, SHINGLE):
        short = np.flatnonzero(sizes == k)
        out_r.append(short)
        out_h.append(chain(first[short], k))
    return np.concatenate(out_r), np.concatenate(out_h)


def densify(least: np.ndarray) -> np.ndarray:
    """Fill empty bins of each row; rows without any full bin stay empty."""
    full = least != EMPTY
    rows, bins = np.nonzero(~full & full.any(1)[:, None])
    out = least.copy()
    t = 0
    while len(rows):
        t += 1
        source = (mix(bins.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(t * int(_STEP) % (1 << 64))) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        hit = full[rows, source]
        out[rows[hit], bins[hit]] = least[rows[hit], source[hit]]
        rows, bins = rows[~hit], bins[~hit]
    return out


def lanes(texts: pa.Array) -> np.ndarray:
    """Low bits of each bin: (row, bin) of small numbers."""
    data, offsets = buffers(texts)
    out = np.zeros((len(offsets) - 1, BINS), np.uint8)
    for i, j in groups(offsets, GROUP):
        rows, h = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for a in range(i, j, 4096):  # at most 4096 rows of bins at once
            b = min(a + 4096, j)
            here = (rows >= a - i) & (rows < b - i)
            least = np.full((b - a) * BINS, EMPTY, np.uint64)
            hh = h[here]
            np.minimum.at(least, (rows[here] - (a - i)) * BINS + (hh >> np.uint64(64 - BIN_BITS)).astype(np.int64), hh)
            least = densify(least.reshape(-1, BINS))
            out[a:b] = np.where(least == EMPTY, 0, least & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return out


def pack(x: np.ndarray) -> list[str]:
    """Two bins a byte, as hex."""
    both = x[:, 0::2] | (x[:, 1::2] << 4)
    return [r.tobytes().hex() for r in both]


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated resemblance of rows, chance matches taken out."""
    c = 1 / (1 << BITS)
    return np.maximum(0.0, ((x == y).mean(1) - c) / (1 - c))


def _placer(bounds: np.ndarray, carry: dict[int, int]):
    """Arrow function from id to its places: twice the bucket; plus one as a neighbour only."""
    ids = np.array(sorted(carry), np.int64)
    to = np.array([carry[k] for k in sorted(carry)], np.int64)

    def place(x: pa.Array) -> pa.Array:
        v = x.to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.searchsorted(bounds, v, side="right")
        k = np.minimum(np.searchsorted(ids, v), max(len(ids) - 1, 0))
        also = ids[k] == v if len(ids) else np.zeros(len(v), bool)
        cuts = np.zeros(len(v) + 1, np.int64)
        np.cumsum(1 + also, out=cuts[1:])
        out = np.repeat(own * 2, 1 + also)
        if also.any():
            out[cuts[1:][also] - 1] = to[k[also]] * 2 + 1
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(out.astype(np.int32)))

    place.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(place, "array<int>")


_LOWEST = -(1 << 63)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _stream(batches):
    """Rows sorted by bucket, neighbours first, then id; the row before is the next in descending order."""
    bucket, text, lane = None, "", None
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        if not texts:
            continue
        own = lanes(b.column("text"))
        before_text, before_lane = [], np.empty_like(own)
        for i, (k, t) in enumerate(zip(b.column("bucket").to_pylist(), texts)):
            if k != bucket or lane is None:
                bucket, text, lane = k, t, own[i]
            before_text.append(text)
            before_lane[i] = lane
            text, lane = t, own[i]
        keep = np.flatnonzero(b.column("neighbour").to_numpy(zero_copy_only=False) == 0)
        edited = []
        for i in keep:
            t = texts[i]
            third = len(t) // 3
            edited.append(t[: len(t) - third] + before_text[i][:third])
        e = lanes(pa.array(edited, pa.large_string()))
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id").take(pa.array(keep)),
                pa.array([len(texts[i]) for i in keep], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array(pack(own[keep]), pa.string()),
                pa.array(pack(e), pa.string()),
                pa.array(likeness(own[keep], e)),
                pa.array(likeness(own[keep], before_lane[keep])),
            ],
            names=[x.split()[0] for x in RESULT.split(", ")],
        )


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of texts, of edited texts, and their likeness; docs: (doc_id, text)."""
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = F.coalesce("doc_id", F.lit(_LOWEST))
    ids = rows.select(key.alias("k"))
    cuts = ids.approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    bounds = np.unique(np.array(cuts, np.float64).astype(np.int64))
    own = _placer(bounds, {})(F.col("k"))[0]
    last = {r["b"] // 2: r["m"] for r in ids.select("k", own.alias("b")).groupBy("b").agg(F.max("k").alias("m")).collect()}
    used = sorted(last)
    carry = {last[b]: used[(i + 1) % len(used)] for i, b in enumerate(used)}
    placed = rows.withColumn("place", F.explode(_placer(bounds, carry)(key))).select(
        "doc_id", "text", (F.col("place") / 2).cast("int").alias("bucket"), (F.col("place") % 2).alias("neighbour")
    )
    dealt = placed.repartitionById(len(bounds) + 1, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", F.desc("neighbour"), "doc_id", "text").mapInArrow(_stream, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
