"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints are 64-bit SimHashes of 4-word shingles. Fingerprints at a Hamming
distance of DISTANCE = 4 or less are linked: cut into three segments, at least one
segment differs by one bit at most, so of that segment's variants with one bit
deleted two linked fingerprints share one. The index holds every distinct fingerprint
under its 64 variants; an equality grouping on the variant finds the candidates, and
each pair is verified in one variant only (the first segment that differs by at most
one bit, at that bit, or at the segment's first bit if it is equal).

Scale: texts never move, only (id, fingerprint); equal fingerprints are one class
before anything else, so copies cost no pairs. A group links its members by a
spanning forest once it is larger than PAIRWISE, never by all pairs. Groups above
BLOCK members are cut into blocks, and each pair of blocks is a group of its own, so
no task holds more than two blocks of a group; no pair is lost. Rows of a large group
of copies get its component by broadcast.

Defined cases: null and empty texts have no words and fingerprint zero, linked like
any other. Repeated rows share a class. Rows with a null doc_id are fingerprinted and
linked, and join others to each other; only the smallest doc_id leaves them out (null if
a group has none). Very long texts are a group of their own in a task, hashed whole. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.bytetools import buffers, words
from papyra.llm.common import beside, beside_hot, table
from papyra.llm.components import components
from papyra.llm.features import groups
from papyra.session import write_table

SHINGLE = 4
DISTANCE = 4
WIDTHS = (22, 21, 21)
STARTS = (0, 22, 43)
PAIRWISE = 32
BLOCK = 8192
#: The table of classes has a file for so many documents at most.
CLASSES_A_FILE = 50_000
#: Texts go in groups of about this many bytes.
GROUP = 1 << 20
#: A shingle of more bytes is hashed on its own.
LONG = 4096
SEED = 42
_LANES = np.uint64(0x0101010101010101)
_WORD = (~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many spans of bytes, all at once: every step takes the spans that are long enough for it."""
    size = ends - starts
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(room) - 7,), "<u8", buffer=room, strides=(1,))
    four = np.ndarray((len(room) - 3,), "<u4", buffer=room, strides=(1,))
    s = np.uint64(seed)
    h = np.full(len(size), s + _P5, np.uint64)
    at = starts.copy()
    big = np.flatnonzero((size >= 32) & (size <= LONG))
    if len(big):
        with np.errstate(over="ignore"):
            acc = [np.full(len(big), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
        for k in range(int(size[big].max()) // 32):
            on = np.flatnonzero(size[big] >= 32 * (k + 1))
            for j in range(4):
                acc[j][on] = _round(acc[j][on], eight[starts[big[on]] + 32 * k + 8 * j])
        mixed = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for a in acc:
            mixed = (mixed ^ _round(np.zeros_like(a), a)) * _P1 + _P4
        h[big] = mixed
        at[big] += size[big] // 32 * 32
    h += size.astype(np.uint64)
    for _ in range(3):
        on = np.flatnonzero(at + 8 <= ends)
        on = on[size[on] <= LONG]
        if not len(on):
            break
        h[on] = _turn(h[on] ^ _round(np.zeros(len(on), np.uint64), eight[at[on]]), 27) * _P1 + _P4
        at[on] += 8
    on = np.flatnonzero(at + 4 <= ends)
    on = on[size[on] <= LONG]
    h[on] = _turn(h[on] ^ (four[at[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[on] += 4
    for _ in range(3):
        on = np.flatnonzero(at < ends)
        on = on[size[on] <= LONG]
        if not len(on):
            break
        h[on] = _turn(h[on] ^ (room[at[on]].astype(np.uint64) * _P5), 11) * _P1
        at[on] += 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh64_intdigest(memoryview(data[starts[i] : ends[i]]), seed)
    return h


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of lower-cased texts, by row; of a shorter text the whole sequence."""
    s, e, rows = words(data, offsets, _WORD)
    if not len(s):
        return rows, np.zeros(0, np.uint64)
    word = _WORD[data] == 1
    keep = word.copy()
    keep[e[e < len(data)]] = True  # one separator after each word
    joined = np.where(word, _LOWER[data], 32)[keep].astype(np.uint8)
    place = np.cumsum(keep) - 1
    s, e = place[s], place[e - 1] + 1
    sizes = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(sizes) - sizes
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    from_word = np.flatnonzero(rows[SHINGLE - 1 :] == rows[: len(rows) - SHINGLE + 1]) if len(rows) >= SHINGLE else np.zeros(0, np.int64)
    begin = np.concatenate([from_word, first[short]])
    end = np.concatenate([from_word + SHINGLE - 1, first[short] + sizes[short] - 1])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    return rows[begin], xxh64(joined, s[begin], e[end])


def majority(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the bits set in over half its hashes; rows are in order."""
    out = np.zeros(n, np.uint64)
    if not len(rows):
        return out
    new = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    size = np.diff(np.append(new, len(rows)))
    own = np.arange(len(rows)) - np.repeat(new, size)
    cuts = np.flatnonzero(own % 255 == 0)  # a byte counts up to 255
    of_row = np.searchsorted(cuts, new)
    counts = np.empty((len(new), 8, 8), np.int64)  # [row][byte][shift]
    for j in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, cuts)
        counts[:, :, j] = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), of_row, axis=0)
    bits = (counts * 2 > size[:, None, None]).reshape(len(new), 64)  # bit 8 * byte + shift
    out[rows[new]] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _fingerprints(texts: pa.Array) -> pa.Array:
    data, offsets = buffers(texts)
    out = np.zeros(len(texts), np.uint64)
    for i, j in groups(offsets, GROUP):
        part = data[offsets[i] : offsets[j]]
        out[i:j] = majority(*shingle_hashes(part, offsets[i : j + 1] - offsets[i]), j - i)
    return pa.array(out.view(np.int64))


_fingerprints.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def fingerprint(text):
    """Column of the SimHash of a text column, as a signed long."""
    return F.arrow_udf(_fingerprints, "long")(text)


_MASKS = [np.uint64(((1 << w) - 1) << s) for w, s in zip(WIDTHS, STARTS)]
_SEGMENT = np.repeat(np.arange(3), WIDTHS)


def _wanted(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether pairs with these differing bits are linked, and first found in the variant without bit p."""
    near = np.bitwise_count(x) <= DISTANCE
    diff = [np.bitwise_count(x & m) for m in _MASKS]
    first = np.where(diff[0] <= 1, 0, np.where(diff[1] <= 1, 1, 2))
    own = np.choose(first, diff)
    at = (x >> p.astype(np.uint64)) & np.uint64(1) == 1
    return near & (first == _SEGMENT[p]) & np.where(own == 1, at, p == np.array(STARTS)[first])


def _forest(fp: np.ndarray, rep: np.ndarray, p: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what this group's links connect; one less than the members at most."""
    out, left = [], np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            x = fp[left] ^ fp[u]
            hit = np.bitwise_count(x) <= DISTANCE
            if hit.any():
                hit[hit] = _wanted(x[hit], np.full(int(hit.sum()), p))
                new = left[hit]
                if len(new):
                    out.append((np.full(len(new), rep[u]), rep[new]))
                    queue += new.tolist()
                    left = left[~hit]
    return out


def _verify(key: np.ndarray, cell: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    """Links of whole groups, sorted by (key, cell)."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key)))
    group = np.repeat(np.arange(len(start)), size)
    p = (key >> 22).astype(np.int64)
    a, b = [], []
    keep = np.flatnonzero((size[group] > 1) & (size[group] <= PAIRWISE))
    g, f, r, q = group[keep], fp[keep], rep[keep], p[keep]
    for lag in range(1, PAIRWISE):
        i = np.flatnonzero(g[lag:] == g[:-lag]) if len(g) > lag else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[_wanted(f[i] ^ f[i + lag], q[i])]
        a.append(r[i])
        b.append(r[i + lag])
    for k in np.flatnonzero(size > PAIRWISE):
        s = slice(start[k], start[k] + size[k])
        bit = (fp[s] >> np.uint64(p[start[k]])) & np.uint64(1)
        if p[start[k]] not in STARTS and bit.min() == bit.max():
            continue
        for x, y in _forest(fp[s], rep[s], int(p[start[k]])):
            a.append(x)
            b.append(y)
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(join(a)), pa.array(join(b))], names=["a", "b"])


def _links(batches):
    """Stream of (key, cell, fp, rep), sorted by key and cell, to links; a group may span batches."""
    rest = None
    for batch in batches:
        cols = [batch.column(n).to_numpy() for n in ("key", "cell", "fp", "rep")]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        key, cell = cols[0], cols[1]
        if not len(key):
            continue
        last = (key == key[-1]) & (cell == cell[-1])
        cut = len(key) - int(np.argmin(last[::-1])) if not last.all() else 0
        rest = [x[cut:] for x in cols]
        if cut:
            yield _verify(key[:cut], cell[:cut], cols[2][:cut].view(np.uint64), cols[3][:cut])
    if rest is not None and len(rest[0]):
        yield _verify(rest[0], rest[1], rest[2].view(np.uint64), rest[3])


def _segment_start(p):
    return F.when(p < STARTS[1], STARTS[0]).when(p < STARTS[2], STARTS[1]).otherwise(STARTS[2])


def variants(classes: DataFrame) -> DataFrame:
    """(key, fp, rep): 64 rows a class. A key is the deleted bit's place and the segment without that bit."""
    value = (
        "CASE WHEN p < 22 THEN fp & 4194303L WHEN p < 43 THEN shiftrightunsigned(fp, 22) & 2097151L ELSE shiftrightunsigned(fp, 43) END"
    )
    return (
        classes.select("fp", "rep", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
        .withColumn("o", _segment_start(F.col("p")))
        .selectExpr("fp", "rep", f"shiftleft(CAST(p AS BIGINT), 22) | (({value}) & ~shiftleft(1L, p - o)) AS key")
    )


def hot_keys(classes: DataFrame, block: int) -> DataFrame:
    """Keys with more than block classes, with the number of blocks; found from exact segment values."""
    value = F.expr("stack(3, 0, fp & 4194303L, 1, shiftrightunsigned(fp, 22) & 2097151L, 2, shiftrightunsigned(fp, 43)) AS (seg, v)")
    sizes = classes.select(value).groupBy("seg", "v").agg(F.count("*").alias("n")).where(F.col("n") > block // 2)
    each = sizes.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(F.col("seg") == 0, 21).otherwise(20)))).withColumn(
        "p", F.col("j") + F.when(F.col("seg") == 0, 0).when(F.col("seg") == 1, 22).otherwise(43)
    )
    return (
        each.selectExpr("shiftleft(CAST(p AS BIGINT), 22) | (v & ~shiftleft(1L, j)) AS key", "n")
        .groupBy("key").agg(F.ceil(F.sum(F.col("n") + block // 2) / block).cast("int").alias("blocks"))
    )


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): representatives of linked classes; enough links to connect what is connected."""
    rows = variants(classes)
    # a hot key takes block // 2 classes of one segment value, so there are few
    hot = write_table(hot_keys(classes, block).coalesce(8), "hot")
    small = hot.limit(100_001).count() <= 100_000
    marked = rows.join(F.broadcast(hot) if small else hot, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = F.when(
        F.col("blocks") > 1,
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks").cast("long") + F.greatest(own, j)
        ),
    ).otherwise(F.array(F.lit(0).cast("long")))
    placed = marked.select("key", F.explode(cells).alias("cell"), "fp", "rep")
    return placed.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, fp, group_id, component_id) of every row of docs (doc_id, text).

    th: a hash of the text; group_id: the least fingerprint of the linked ones, which
    names the group even where doc_ids are null or repeat.
    """
    prints = write_table(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), fingerprint(F.col("text")).alias("fp")), "fingerprints"
    )
    total = prints.count()
    files = 1 + total // CLASSES_A_FILE
    classes = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).coalesce(files), "classes")
    found = components(links(classes.select("fp", F.col("fp").alias("rep")), block))
    linked = classes.join(found, F.col("fp") == F.col("node")).select("fp", "least", F.col("component").alias("group_id"))
    smallest = linked.groupBy("group_id").agg(F.min("least").alias("of_group"))
    linked = linked.select(F.col("fp").alias("of"), "group_id").join(beside(smallest), "group_id")
    named = classes.join(linked, F.col("fp") == F.col("of"), "left").select(
        "fp", "n", F.coalesce("group_id", "fp").alias("group_id"), F.when(F.col("of").isNull(), F.col("least")).otherwise(F.col("of_group")).alias("component_id")
    )
    named = write_table(named.coalesce(files), "named")
    return beside_hot(prints, named, "fp", total).select("doc_id", "th", "fp", "group_id", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
