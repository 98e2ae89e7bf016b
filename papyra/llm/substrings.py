"""Exact removal of repeated passages: windows of words, dealt in super-k-mers by minimiser.

A window is WINDOW consecutive words of one document. The least hash of the GRAM-word grams
in it is its minimiser, so equal windows have equal minimisers; grams that are frequent in the
corpus stand last in that order, so a passage that very many documents hold doesn't draw the
differing text around it into one bucket. Consecutive windows that share a minimiser travel as
one packed string (their words, joined by one space) to the minimiser's bucket. There each
word gets a number, pairs of numbers get numbers until a window is one, and sorting those
finds equal windows and the least doc_id of each, without any hashing.

Strings whose minimiser only one document has are never sent: their windows occur in no other.
Which minimisers several documents have is found first, from (minimiser, least and greatest
doc_id), and comes to the tasks as a bitmap of at most 2^MOST_BITS bits; what it lets through
by chance is sorted like the rest. Equal strings of a group of texts travel once, so a string
that very many documents have is a row a group; what a bucket finds goes back to all documents
with that string, named by its SHA-256, the most frequent ones by broadcast.

Defined cases: a null text has no words; a null doc_id counts as 2^63 - 1, greater than any
other; rows of one doc_id are one document, so they don't remove each other's words, and each
row gives a row; fewer words than a window: nothing is removed; windows may overlap and repeat
within a document, which alone removes nothing; other columns are ignored; an empty table
gives no rows. A task holds a text and some twenty times its bytes, and one bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.bytetools import buffers, mix, runs, span_hashes, spans
from papyra.llm.common import BROADCAST, beside_hot, table
from papyra.llm.features import groups
from papyra.session import write_table

WINDOW, GRAM = 50, 8
#: A gram is frequent if over one in SHARE of all grams is that one.
SHARE = 1 << 16
#: Bits of a bitmap of minimisers or grams at most, as a power of two.
MOST_BITS = 28
#: Windows of a packed string at most; bytes of text, and of a bucket's strings, looked at together.
MOST_WINDOWS, GROUP = 500, 4 << 20
NO_ID = (1 << 63) - 1

SEPARATOR = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
SAME = np.arange(256, dtype=np.uint8)
_LAST = np.uint64(1 << 63)


def _grams(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words, and a hash of the gram words from each on (63 bits); beyond the row's end anything."""
    starts, ends, rows = runs(~SEPARATOR[data], offsets)
    word = span_hashes(data, starts, ends, SAME)
    n = max(0, len(word) - gram + 1)
    total = np.zeros(n, np.uint64)
    for k in range(gram):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += word[k : k + n]
    return starts, ends, rows, mix(total) >> np.uint64(1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest and len(x) > rest else x[: max(0, len(x) - rest)]


def _has(bitmap: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """Whether the highest bits of x (unsigned) are marked in the bitmap."""
    if bitmap is None:
        return np.zeros(len(x), bool)
    at = x >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _runs_of_windows(hashes: np.ndarray, rows: np.ndarray, frequent: np.ndarray | None, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each run of windows that share one."""
    n = len(rows) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    order = hashes | (_has(frequent, hashes << np.uint64(1)).astype(np.uint64) << np.uint64(63))
    least = _sliding_min(order, window - gram + 1)[:n]
    whole = rows[window - 1 :] == rows[:n]
    begins = whole.copy()
    begins[1:] &= ~(whole[:-1] & (least[1:] == least[:-1]) & (rows[1:n] == rows[: n - 1]))
    first = np.flatnonzero(begins)
    # a run ends before the next one begins, or with its row
    stop = np.minimum(np.append(first[1:], n), np.searchsorted(rows, rows[first], side="right") - window + 1)
    size = stop - first
    cuts = -(-size // MOST_WINDOWS)
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = np.repeat(first, cuts) + nth * MOST_WINDOWS
    return begin, np.minimum(MOST_WINDOWS, np.repeat(stop, cuts) - begin), np.repeat(least[first], cuts)


def _bitmap(values: DataFrame, column: str, least_bits: int = 15) -> np.ndarray | None:
    """A bitmap with the highest bits of the values of a column (as unsigned), of at most 2^MOST_BITS bits."""
    n = values.count()
    if not n:
        return None
    bits = min(MOST_BITS, max(least_bits, (n * 64).bit_length()))
    place = F.shiftrightunsigned(column, 64 - bits)
    rows = values.select(F.shiftright(place, 15).alias("k"), (place.bitwiseAND(F.lit(32767))).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("b")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:  # 4 KB each, 2^(MOST_BITS - 15) at most
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(r["b"], np.uint8)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def frequent_grams(gram: int):
    """A function of batches giving (h, n) of grams that are frequent in a group of texts; h is null for the number of all."""

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for i, j in groups(offsets, GROUP):
                _, _, rows, h = _grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], gram)
                h = np.sort(h[rows[gram - 1 :] == rows[: len(h)]])
                begins = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(begins, len(h)))
                keep = (n > 1) & (n * 2 * SHARE > len(h))
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(h[begins[keep]].view(np.int64)), pa.nulls(1, pa.int64())]), pa.array(np.append(n[keep], len(h)))], names=["h", "n"]
                )

    return run


def minimisers(frequent, window: int, gram: int):
    """A function of batches giving (m, low, high): minimisers of a group of texts, with their least and greatest doc."""

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column("text"))
            doc = b.column("doc").to_numpy()
            for i, j in groups(offsets, GROUP):
                _, _, rows, h = _grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], gram)
                first, _, m = _runs_of_windows(h, rows, frequent.value, window, gram)
                own = doc[i:j][rows[first]]
                order = np.argsort(m, kind="stable")
                m, own = m[order], own[order]
                at = np.flatnonzero(np.append(True, m[1:] != m[:-1])) if len(m) else np.zeros(0, np.int64)
                low, high = (f.reduceat(own, at) if len(at) else own[:0] for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(m[at].view(np.int64)), pa.array(low), pa.array(high)], names=["m", "low", "high"])

    return run


def packed(frequent, shared, window: int, gram: int):
    """A function of batches giving (m, id, doc, th, at, s, low, high, n): packed strings of minimisers that are marked in shared.

    Of equal strings in a group of texts the first row alone has s, and the least and greatest doc and the number of all.
    """

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column("text"))
            doc, th = b.column("doc").to_numpy(), b.column("th").to_numpy()
            for i, j in groups(offsets, GROUP):
                part = data[offsets[i] : offsets[j]]
                starts, ends, rows, h = _grams(part, offsets[i : j + 1] - offsets[i], gram)
                first, size, m = _runs_of_windows(h, rows, frequent.value, window, gram)
                keep = _has(shared.value, m)
                first, size, m = first[keep], size[keep], m[keep]
                if not len(first):
                    continue
                own = rows[first] + i
                text, cuts = _joined(part, starts, ends)
                strings = spans(text, cuts[first], cuts[first + size + window - 1] - 1)
                coded = strings.dictionary_encode()
                code, names = coded.indices.to_numpy(), [hashlib.sha256(x).digest()[:16] for x in coded.dictionary.to_pylist()]
                at = (first - np.searchsorted(rows, rows[first])).astype(np.int32)
                order = np.argsort(code, kind="stable")
                lead = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
                once = order[lead]
                low, high, n = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
                low[once], high[once] = (f.reduceat(doc[own][order], lead) for f in (np.minimum, np.maximum))
                n[once] = np.diff(np.append(lead, len(code)))
                text = pc.if_else(pa.array(n > 0), strings.cast(pa.large_string()), pa.scalar(None, pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.view(np.int64)), pa.array(names, pa.binary()).take(pa.array(code)), pa.array(doc[own]), pa.array(th[own]), pa.array(at), text, pa.array(low), pa.array(high), pa.array(n)],
                    names=["m", "id", "doc", "th", "at", "s", "low", "high", "n"],
                )

    return run


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a space after each, and where each begins."""
    sizes = ends - starts
    cuts = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes + 1, out=cuts[1:])
    out = np.full(cuts[-1], 32, np.uint8)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(cuts[:-1], sizes) + within] = data[np.repeat(starts, sizes) + within]
    return out, cuts


def _equal_windows(strings: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each window, equal for equal windows, its string, and its place there."""
    data, offsets = buffers(strings)
    starts, ends, rows = runs(data != 32, offsets)
    number = pd.factorize(spans(data, starts, ends).dictionary_encode().indices.to_numpy())[0].astype(np.int64)
    size = 1
    paired = lambda a, b: pd.factorize(a * (int(b.max(initial=0)) + 1) + b)[0].astype(np.int64)
    while size * 2 <= window:
        number = paired(number[:-size], number[size:])
        size *= 2
    if rest := window - size:
        number = paired(number[:-rest], number[rest:])
    n = len(rows) - window + 1
    at = np.flatnonzero(rows[window - 1 :] == rows[:n])
    return number[at], rows[at], at - np.searchsorted(rows, rows[at])


def _together(rows: pa.Table) -> pa.Table:
    """Rows of equal strings as one."""
    code = rows.column("id").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(code, kind="stable")
    lead = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
    if len(lead) == len(rows):
        return rows.combine_chunks()
    once = np.sort(order[lead])
    merged = {c: f.reduceat(rows.column(c).to_numpy()[order], lead)[code[once]] for c, f in (("low", np.minimum), ("high", np.maximum), ("n", np.add))}
    out = rows.combine_chunks().take(pa.array(once))
    for c, values in merged.items():
        out = out.set_column(out.schema.get_field_index(c), c, pa.array(values))
    return out.combine_chunks()


def _sorted_windows(rows: pa.Table, window: int) -> pa.RecordBatch:
    """(id, n, a, b, least): runs of windows, from the a-th to the b-th of a string, that several documents have, the least of these."""
    rows = _together(rows)
    m, low, high = (rows.column(c).to_numpy() for c in ("m", "low", "high"))
    new = np.append(True, m[1:] != m[:-1])
    several = ~(new & np.append(new[1:], True))
    # windows of a string alone in its bucket are in the documents that have the string
    pick = np.flatnonzero(several | (low < high))
    strings = rows.column("s").combine_chunks().take(pa.array(pick))
    code, of, place = _equal_windows(strings, window)
    order = np.argsort(code, kind="stable")
    at = np.flatnonzero(np.append(True, np.diff(code[order]) != 0)) if len(code) else np.zeros(0, np.int64)
    least, most = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    if len(at):
        spread = np.diff(np.append(at, len(code)))
        least[order] = np.repeat(np.minimum.reduceat(low[pick][of[order]], at), spread)
        most[order] = np.repeat(np.maximum.reduceat(high[pick][of[order]], at), spread)
    shared = least < most
    begins = shared.copy()
    begins[1:] &= ~(shared[:-1] & (of[1:] == of[:-1]) & (least[1:] == least[:-1]))
    ends = shared.copy()
    ends[:-1] &= ~(shared[1:] & (of[1:] == of[:-1]) & (least[1:] == least[:-1]))
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    own = pa.array(pick[of[begins]])
    return pa.RecordBatch.from_arrays(
        [rows.column("id").combine_chunks().take(own), rows.column("n").combine_chunks().take(own), pa.array(place[begins].astype(np.int32)), pa.array(place[ends].astype(np.int32)), pa.array(least[begins])],
        names=["id", "n", "a", "b", "least"],
    )


def buckets(window: int):
    """A function of batches (m, s, low, high, n, id), sorted by m; whole buckets of about GROUP bytes are sorted together."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, last_size = 0, GROUP
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column("s").nbytes
            if size < GROUP:
                continue
            m = b.column("m").to_numpy()
            cut = int(np.searchsorted(m, m[-1]))  # the last bucket may go on
            if not cut and held[0].column("m")[0].as_py() == m[-1]:
                if size > 2 * last_size:  # one bucket: equal strings of many groups of texts are put together as they come
                    held = _together(pa.Table.from_batches(held)).to_batches()
                    size = last_size = sum(x.column("s").nbytes for x in held)
                continue
            last_size = GROUP
            whole = pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
            last = len(whole) - int(np.searchsorted(whole.column("m").to_numpy(), m[-1])) if not cut else 0
            yield _sorted_windows(whole.slice(0, len(whole) - last), window)
            held = [x for x in whole.slice(len(whole) - last).combine_chunks().to_batches() if x.num_rows] + [b.slice(cut)]
            size = sum(x.column("s").nbytes for x in held)
        if held:
            yield _sorted_windows(pa.Table.from_batches(held), window)

    return run


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, th, spans): for each document with words to remove the spans of these, as first word * 2^32 + word after the last."""
    spark = docs.sparkSession
    texts = _texts(docs)
    counted = write_table(texts.select("text").mapInArrow(frequent_grams(gram), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "grams")
    total = counted.where("h IS NULL").agg(F.max("n")).first()[0] or 0
    often = counted.where(F.col("h").isNotNull() & (F.col("n") * SHARE > total)).select(F.shiftleft("h", 1).alias("h"))
    frequent = spark.sparkContext.broadcast(_bitmap(often, "h", 20))
    found = texts.select("doc", "text").mapInArrow(minimisers(frequent, window, gram), "m long, low long, high long")
    found = found.groupBy("m").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("m")
    shared = spark.sparkContext.broadcast(_bitmap(write_table(found, "shared"), "m"))
    sent = write_table(texts.mapInArrow(packed(frequent, shared, window, gram), "m long, id binary, doc long, th long, at int, s string, low long, high long, n long"), "super-k-mers")
    dealt = sent.where("s IS NOT NULL").select("m", "s", "low", "high", "n", "id").repartition("m").sortWithinPartitions("m")
    least = write_table(dealt.mapInArrow(buckets(window), "id binary, n long, a int, b int, least long"), "least")
    back = beside_hot(sent.select("id", "doc", "th", "at"), least, "id", sent.count()).where("least < doc")
    span = F.shiftleft((F.col("at") + F.col("a")).cast("long"), 32) + F.col("at") + F.col("b") + window
    return back.groupBy("doc", "th").agg(F.collect_set(span).alias("spans"))


def _removed(batches):
    """Rows (doc_id, text, spans) to (doc_id, n_words, n_removed, kept_sha256)."""
    for b in batches:
        data, offsets = buffers(b.column("text"))
        marks = b.column("spans")
        out_n, out_r, out_h = [], [], []
        for i, j in groups(offsets, GROUP):
            part = data[offsets[i] : offsets[j]]
            starts, ends, rows = runs(~SEPARATOR[part], offsets[i : j + 1] - offsets[i])
            word = np.searchsorted(rows, np.arange(j - i + 1))
            steps = np.zeros(len(starts) + 1, np.int64)
            own = marks.slice(i, j - i)
            span = own.flatten().to_numpy(zero_copy_only=False)
            if len(span):
                sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
                base = np.repeat(word[:-1], sizes)
                np.add.at(steps, base + (span >> 32), 1)
                np.subtract.at(steps, base + (span & 0xFFFFFFFF), 1)
            kept = np.cumsum(steps)[:-1] == 0
            text, cuts = _joined(part, starts[kept], ends[kept])
            first = np.searchsorted(rows[kept], np.arange(j - i + 1))
            whole = memoryview(text)
            n = np.diff(word)
            out_n += n.tolist()
            out_r += (n - np.diff(first)).tolist()
            out_h += [hashlib.sha256(whole[cuts[x] : cuts[y] - 1] if y > x else b"").hexdigest() for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out_n, pa.int64()), pa.array(out_r, pa.int64()), pa.array(out_h, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _marked(docs: DataFrame, window: int, gram: int, *columns: str | Column) -> DataFrame:
    """Rows of docs, and their spans."""
    marks = write_table(repeats(docs, window, gram).select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("spans").alias("__spans")), "spans")
    size = marks.agg(F.coalesce(F.sum(F.size("__spans") + 4), F.lit(0))).first()[0]
    key = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col("__doc")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__th"))
    return docs.join(F.broadcast(marks) if size <= 4 * BROADCAST else marks, key, "left").select(*columns)


def _kept_texts(batches):
    for b in batches:
        texts = []
        for text, span in zip(b.column("__text").to_pylist(), b.column("__spans").to_pylist()):
            if text is not None and span:
                words = text.translate(_SPACES).split(" ")
                words = [w for w in words if w]
                gone = bytearray(len(words))
                for s in span:
                    a, z = s >> 32, s & 0xFFFFFFFF
                    gone[a:z] = b"\1" * (z - a)
                text = " ".join(w for w, g in zip(words, gone) if not g)
            texts.append(text)
        columns = {c: b.column(c) for c in b.schema.names if not c.startswith("__")}
        columns["text"] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_pydict(columns)


_SPACES = {c: " " for c in range(9, 14)}


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs, their texts without the words of repeated windows (joined by one space then); other texts stay as they are."""
    columns = [docs[c] for c in docs.columns]
    marked = _marked(docs, window, gram, *columns, docs["text"].alias("__text"), F.col("__spans"))
    return marked.mapInArrow(_kept_texts, docs.schema)


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    marked = _marked(docs, window, gram, docs["doc_id"], docs["text"].cast("string").alias("text"), F.col("__spans").alias("spans"))
    return marked.mapInArrow(_removed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT row, doc, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT row, doc, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), hit AS (
  SELECT row, i FROM (SELECT row, i, doc, min(doc) OVER (PARTITION BY s) AS least FROM windows) WHERE least < doc
), gone AS (
  SELECT DISTINCT row, unnest(range(i, i + 50)) AS k FROM hit
), kept AS (
  SELECT d.row, list(d.word ORDER BY d.k) AS w
  FROM (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) AS d ANTI JOIN gone USING (row, k) GROUP BY d.row
)
SELECT doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(len(kept.w), 0))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept.w, ' '), '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.row = kept.row
"""
