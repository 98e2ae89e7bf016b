"""Hashed indicator features of texts: (row, bucket) pairs, each once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyra.llm.bytetools import SPACES, buffers, fold_map, mix, span_hashes, words

BITS = 19
BUCKETS = 1 << BITS
FOLD = fold_map()
RAW = fold_map(keep_case=True, separators=SPACES)
PREFIX = 6
#: Rows go in groups of about this many bytes, so that memory stays bounded.
GROUP = 1 << 18


def _classes() -> np.ndarray:
    """Six classes of bytes: lower case, upper case, digit, stop or comma, other ASCII, beyond ASCII."""
    m = np.full(256, 4, np.int64)
    m[97:123] = 0
    m[65:91] = 1
    m[48:58] = 2
    m[[44, 46]] = 3
    m[128:] = 5
    return m


CLASS = _classes()


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h ^ np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int64)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded words, and the six-byte beginnings of longer ones."""
    s, e, rows = words(data, offsets, FOLD)
    long = e - s > PREFIX
    whole = _bucket(span_hashes(data, s, e, FOLD), 1)
    begin = _bucket(span_hashes(data, s[long], s[long] + PREFIX, FOLD), 2)
    return np.concatenate([rows, rows[long]]), np.concatenate([whole, begin])


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word uni- and bigrams, and uni- to trigrams of token shapes.

    A shape is the class of a token's first, second and last byte, and whether the
    token equals the one before it.
    """
    s, e, rows = words(data, offsets, FOLD)
    h = span_hashes(data, s, e, FOLD)
    two = rows[1:] == rows[:-1]
    out_r, out_b = [rows, rows[1:][two]], [_bucket(h, 3), _bucket(h[1:] * np.uint64(31) + h[:-1], 4)[two]]
    s, e, rows = words(data, offsets, RAW)
    if len(s):
        h = span_hashes(data, s, e, RAW)
        same = np.zeros(len(s), np.int64)
        same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        second = np.minimum(s + 1, e - 1)
        shape = ((CLASS[data[s]] * 6 + CLASS[data[second]]) * 6 + CLASS[data[e - 1]]) * 2 + same + 1
        u = shape.astype(np.uint64)
        two, three = rows[1:] == rows[:-1], rows[2:] == rows[:-2]
        pair = u[:-1] * np.uint64(512) + u[1:]
        out_r += [rows, rows[1:][two], rows[2:][three]]
        out_b += [_bucket(u, 5), _bucket(pair, 6)[two], _bucket(pair[:-1] * np.uint64(512) + u[2:], 7)[three]]
    return np.concatenate(out_r), np.concatenate(out_b)


Extract = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def groups(offsets: np.ndarray, size: int = GROUP):
    """Runs of rows of about size bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pairs(data: np.ndarray, offsets: np.ndarray, extract: Extract, keep: np.ndarray | None = None):
    """Sorted distinct (row, bucket); keep: an array over buckets, where false the pair is left out."""
    for i, j in groups(offsets):
        part = data[offsets[i] : offsets[j]]
        rows, buckets = extract(part, offsets[i : j + 1] - offsets[i])
        if keep is not None:
            here = keep[buckets]
            rows, buckets = rows[here], buckets[here]
        key = np.unique((rows.astype(np.int64) << BITS) | buckets)
        yield i, j, (key >> BITS) + i, key & (BUCKETS - 1)


def collect_features(sample: DataFrame, extract: Extract) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature lists and labels of a bounded sample (doc_id, h, text, y), in order of id and hash.

    The lists are views of one array, filled batch by batch, so that little more than
    the features themselves is held.
    """

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column("text"))
            lists: list[np.ndarray] = []
            for i, j, rows, buckets in pairs(data, offsets, extract):
                cuts = np.searchsorted(rows, np.arange(i, j + 1))
                lists += [buckets[a:z].astype(np.int32) for a, z in zip(cuts[:-1], cuts[1:])]
            sizes = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=sizes[1:])
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("h"), b.column("y").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))],
                names=["doc_id", "h", "y", "f"],
            )

    batches = sample.select("doc_id", "h", "text", "y").mapInArrow(run, "doc_id long, h long, y int, f array<int>").toArrow().to_batches()
    column = lambda name: np.concatenate([b.column(name).to_numpy() for b in batches] or [np.zeros(0, np.int64)])
    ids, h, y = column("doc_id"), column("h"), column("y").astype(np.int64)
    sizes = np.concatenate([np.diff(b.column("f").offsets.to_numpy()) for b in batches] or [np.zeros(0, np.int64)]).astype(np.int64)
    order = np.lexsort((h, ids))
    ends = np.cumsum(sizes[order])
    start = np.empty(len(order), np.int64)
    start[order] = ends - sizes[order]
    flat, row = np.empty(int(sizes.sum()), np.int32), len(order)
    while batches:
        f = batches.pop().column("f")
        values, cuts = f.values.to_numpy(), f.offsets.to_numpy()
        row -= len(f)
        for k in range(len(f)):
            flat[start[row + k] : start[row + k] + cuts[k + 1] - cuts[k]] = values[cuts[k] : cuts[k + 1]]
    return [flat[e - n : e] for e, n in zip(ends.tolist(), sizes[order].tolist())], y[order]


def counts(lists: list[np.ndarray]) -> np.ndarray:
    """In how many lists each bucket is; some hundred lists at a time."""
    out = np.zeros(BUCKETS, np.float64)
    for i in range(0, len(lists), 256):
        out += np.bincount(np.concatenate(lists[i : i + 256]), minlength=BUCKETS)
    return out
