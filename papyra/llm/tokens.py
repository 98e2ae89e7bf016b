"""Fast exact encoding with a public tokenizer: texts are cut where it always cuts, and
each distinct piece is encoded once.

A piece begins before a single space or line break that stands between other
characters, after such a line break, and at ASCII punctuation after an ASCII letter.
At these places the pre-tokenizers of both vocabularies always cut, so the ids of a
text are the ids of its pieces. Texts with a special token's string are encoded whole.
"""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402

from papyra.llm.bytetools import buffers  # noqa: E402
from papyra.llm.common import resident  # noqa: E402

#: Pieces a worker remembers; the rest is encoded again when met, so memory stays bounded.
CACHE = 400_000
#: Pieces the tokenizer is given at once: what it returns for one takes about a kilobyte until its ids are read.
PLAIN = 4_000
#: Texts go in groups of about this many bytes.
GROUP = 8 << 20

_BYTE = np.arange(256)
_SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
#: Bytes that surely begin a character that isn't white space.
_SOLID = ((_BYTE > 32) & (_BYTE < 127)) | ((_BYTE >= 0xC3) & ~np.isin(_BYTE, [0xE1, 0xE2, 0xE3]))
_LETTER = ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
_PUNCT = (_BYTE > 32) & (_BYTE < 127) & ~_LETTER & ~((_BYTE >= 48) & (_BYTE <= 57))


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of the pieces; every row begins one."""
    n = len(data)
    if n == 0:
        return np.zeros(1, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if n > 2:
        mid = data[1:-1]
        alone = ~_SPACE[data[:-2]] & _SOLID[data[2:]]
        cut[1 : n - 1] |= alone & ((mid == 32) | (mid == 10))
        cut[2:n] |= alone & (mid == 10)
        cut[1:n] |= _LETTER[data[:-1]] & _PUNCT[data[1:]]
    return np.flatnonzero(cut)


class Encoder:
    """Encodes Arrow strings to (flat ids, ids per row); one a worker process and vocabulary."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.limit = cache
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _plain(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(texts), PLAIN):
            out += [e.ids for e in self.tok.encode_batch_fast(texts[i : i + PLAIN], add_special_tokens=False)]
        return out

    def _remember(self, words: list[str], ids: list[list[int]]) -> None:
        n, need = len(self.known), self.used + sum(map(len, ids))
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        for w, x in zip(words, ids):
            self.flat[self.used : self.used + len(x)] = x
            self.at[n], self.size[n] = self.used, len(x)
            self.known[w] = n
            self.used += len(x)
            n += 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = buffers(texts)
        raw = memoryview(data)
        if any(s in bytes(raw) for s in self.special) if len(data) else False:
            return self._with_special(texts)
        return self._encode(data, offsets)

    def _with_special(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for i in range(len(texts)):
            one = texts.slice(i, 1)
            t = one[0].as_py() or ""
            if any(s in t.encode() for s in self.special):
                ids = np.array(self._plain([t])[0], np.uint32)
                out.append((ids, np.array([len(ids)])))
            else:
                out.append(self._encode(*buffers(one)))
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        cuts = pieces(data, offsets)
        strings = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = strings.dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self.known
        where = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(where < 0)
        flat, at, size = self.flat, self.at, self.size
        if len(new):
            fresh = [words[i] for i in new]
            ids = self._plain(fresh)
            room = max(0, self.limit - len(known))
            kept = len(known)
            self._remember(fresh[:room], ids[:room])
            flat, at, size = self.flat, self.at, self.size
            where[new[:room]] = np.arange(kept, kept + min(room, len(new)))
            if len(new) > room:
                rest = ids[room:]
                lens = np.array([len(x) for x in rest], np.int64)
                base, k = self.used, len(known)
                flat = np.concatenate([flat[:base], np.array([t for x in rest for t in x], np.uint32)])
                at = np.concatenate([at[:k], base + np.cumsum(lens) - lens])
                size = np.concatenate([size[:k], lens])
                where[new[room:]] = np.arange(k, k + len(rest))
        piece = where[coded.indices.to_numpy()]
        lens = size[piece]
        total = np.zeros(len(piece) + 1, np.int64)
        np.cumsum(lens, out=total[1:])
        take = np.repeat(at[piece] - total[:-1], lens) + np.arange(total[-1])
        bounds = total[np.searchsorted(cuts, offsets)]
        return flat[take], np.diff(bounds)

    def groups(self, texts: pa.Array, size: int = GROUP):
        """(first row, ids, ids per row) for runs of rows of about size bytes."""
        _, offsets = buffers(texts)
        i, n = 0, len(texts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
            ids, sizes = self.encode(texts.slice(i, j - i))
            yield i, ids, sizes
            i = j


def encoder(path: str) -> Encoder:
    """This process's encoder of a vocabulary file."""
    return resident(path, lambda: Encoder(path))
