"""Vectorised byte-level helpers over Arrow string buffers (no per-row Python)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(SEGMENT * 2 + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if name not in _tables:
        _tables[name] = _powers(_MUL if name == "mul" else _INV)
    return _tables[name]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def fold_map(keep_case: bool = False, separators: bytes | None = None) -> np.ndarray:
    """Byte map: 0 for separators, else the (folded) byte.

    Default: words are runs of ASCII letters and digits and of bytes from 0x80.
    """
    m = np.arange(256, dtype=np.uint8)
    if separators is None:
        word = (m >= 0x80) | ((m >= 48) & (m <= 57)) | ((m >= 65) & (m <= 90)) | ((m >= 97) & (m <= 122))
    else:
        word = ~np.isin(m, np.frombuffer(separators, np.uint8))
    out = np.where(word, m, 0).astype(np.uint8)
    if not keep_case:
        out[65:91] = np.where(out[65:91] > 0, out[65:91] + 32, 0)
    return out


SPACES = bytes([0x20, 9, 10, 11, 12, 13, 0])


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and its row. A word never crosses rows."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[data] != 0
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's mapped bytes: polynomial prefix sums, then a finalizer.

    Spans are sorted by start. Work goes in segments of about a megabyte; a span
    longer than that is hashed on its own, so memory stays bounded.
    """
    out = np.zeros(len(starts), np.uint64)
    mul, inv = _table("mul"), _table("inv")
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(starts, base + SEGMENT, side="left"))
        stop = int(ends[i:j].max())
        if stop - base > 2 * SEGMENT:
            long = np.flatnonzero(ends[i:j] - base > 2 * SEGMENT)
            j = i + int(long[0])
            if j == i:
                h = 0
                for k in range(int(starts[i]), int(ends[i]), SEGMENT):
                    part = table[data[k : min(k + SEGMENT, int(ends[i]))]].astype(np.uint64)
                    h = (int(np.sum(part * mul[: len(part)])) * pow(int(_MUL), k - int(starts[i]), 1 << 64) + h) % (1 << 64)
                out[i] = h
                i += 1
                continue
            stop = int(ends[i:j].max())
        part = table[data[base:stop]].astype(np.uint64)
        part *= mul[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inv[s]
        i = j
    return mix(out)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of true places, and its row. A run never crosses rows."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(len(inside) + 1, bool)
    first[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each span as an array of binary values."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    values = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])] if len(sizes) else np.zeros(0, np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
