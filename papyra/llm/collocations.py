"""Collocations of words by Suffix-sigma: truncated suffixes, sorted, counted with one stack.

Every occurrence of a word gives one suffix: it and the words after it within its piece, max_n
at most. A task counts equal suffixes of a group of texts and packs those with one language and
first word into one string, which travels to that first word's bucket. There suffixes are put
in reverse lexicographic order, so that all with one beginning lie together, and counted with a
stack of max_n open beginnings: a beginning is closed, and its count final, where the next
suffix differs from it. The parts of each candidate are then joined to it by equality.

A first word with over PART suffixes is split by its second word into several buckets, and two
such words that are frequent together by the whole suffix; what buckets count in part of a
phrase is added up afterwards. So a bucket is bounded, whatever share of all rows a word has.

A key is the language and the words with "\\0" between; "\\0" and "\\1" within a word are written
as "\\1\\1" and "\\1\\2".

Defined cases: a null text is empty; a null language is `und`; texts without words give nothing;
repeated rows count each time; scores are exact (decimals of 38 digits); phrases that tie in
score and count go by their bytes; doc_id and other columns are ignored; an empty table gives no
rows. A very long text is cut where pieces end, so that memory stays bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from papyra.llm.bytetools import buffers, runs, span_hashes, spans
from papyra.llm.common import beside, beside_hot, table
from papyra.session import write_table

MAX_N, MIN_COUNT, CONTAINED, TOP = 3, 10, 50, 2000
UNKNOWN = "und"
#: Suffixes of a bucket at most, about; words and pairs of words with more are split. As many are counted at once.
PART = 500_000
#: Words that are split at most (one in so many of all words must be such a word).
SPLIT = 1_000_000
#: A word or pair is looked at if a group of texts has it so often.
SEEN = 4
#: Bytes of text that a task looks at together.
GROUP = 12 << 20

BREAKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _escaped(words: pa.Array) -> pa.Array:
    words = pc.replace_substring(words, "\1", "\1\2")
    return pc.replace_substring(words, "\0", "\1\1")


def _grouped(batches: Iterator[pa.RecordBatch], size: int = GROUP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(bytes, offsets, language of each text, languages) of about size bytes together; longer texts are cut where a piece ends."""
    held: list[tuple[np.ndarray, str]] = []
    total = 0

    def give():
        names = sorted({lang for _, lang in held})
        number = {lang: k for k, lang in enumerate(names)}
        offsets = np.zeros(len(held) + 1, np.int64)
        np.cumsum([len(t) for t, _ in held], out=offsets[1:])
        return np.concatenate([t for t, _ in held]), offsets, np.array([number[lang] for _, lang in held], np.int64), names

    for b in batches:
        data, offsets = buffers(b.column("text"))
        langs = b.column("lang").to_pylist()
        for lang, a, z in zip(langs, offsets[:-1].tolist(), offsets[1:].tolist()):
            lang = UNKNOWN if lang is None else lang
            while a < z:
                end = z
                if z - a > size:
                    ends = np.flatnonzero(BREAKS[data[a : a + size]])
                    if not len(ends):
                        ends = np.flatnonzero(BREAKS[data[a:z]])[:1]
                    end = a + int(ends[-1]) + 1 if len(ends) else z
                if total and total + end - a > size:
                    yield give()
                    held, total = [], 0
                held.append((data[a:end], lang))
                total += end - a
                a = end
    if held:
        yield give()


def _numbered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Numbers of the words in order, the distinct words, and of each word its text and its piece."""
    breaks = BREAKS[data]
    inside = ~(breaks | SPACE[data])
    starts, ends, rows = runs(inside, offsets)
    piece = np.cumsum(breaks, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    cuts = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=cuts[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(LOWER[data[inside]])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string()), rows, piece


def _tuples(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples of numbers, sorted, and how often each is there."""
    if math.prod(sizes) >= 1 << 62:
        found, n = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
        return list(found.T), n
    code = columns[0]
    for c, size in zip(columns[1:], sizes[1:]):
        code = code * size + c
    code = np.sort(code)
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    n, code = np.diff(np.append(at, len(code))), code[at]
    out = []
    for size in reversed(sizes[1:]):
        code, last = np.divmod(code, size)
        out.append(last)
    return [code, *reversed(out)], n


def _next(ids: np.ndarray, rows: np.ndarray, piece: np.ndarray, k: int, none: int) -> np.ndarray:
    """The k-th word after each one, none where its piece ends before."""
    out = np.full(len(ids), none, np.int64)
    if len(ids) > k:
        out[:-k] = np.where((rows[k:] == rows[:-k]) & (piece[k:] == piece[:-k]), ids[k:], none)
    return out


def first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, words, n): words and pairs of words that are frequent in a group of texts, and with null the number of all words."""
    for data, offsets, of, names in _grouped(batches):
        ids, words, rows, piece = _numbered(data, offsets)
        n_words, lang = len(words), of[rows]
        words = _escaped(words)
        n = np.bincount(lang * n_words + ids, minlength=len(names) * n_words)
        often = np.flatnonzero(n >= SEEN)
        # frequent pairs are of frequent words
        known = n * 2000 > len(ids)
        after = _next(ids, rows, piece, 1, -1)
        two = np.flatnonzero(known[lang * n_words + ids] & (after >= 0))
        two = two[known[(lang * n_words + after)[two]]]
        (l2, a, b), n2 = _tuples([lang[two], ids[two], after[two]], [len(names), n_words, n_words])
        l2, a, b, n2 = (x[n2 >= 16 * SEEN] for x in (l2, a, b, n2))
        tongue = pa.array(names, pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([tongue, tongue.take(pa.array(often // max(1, n_words))), tongue.take(pa.array(l2))]),
                pa.concat_arrays([pa.nulls(len(names), pa.string()), words.take(pa.array(often % max(1, n_words))), pc.binary_join_element_wise(words.take(pa.array(a)), words.take(pa.array(b)), "\0")]),
                pa.array(np.concatenate([np.bincount(lang, minlength=len(names)), n[often], n2])),
            ],
            names=["lang", "words", "n"],
        )


def suffixes(max_n: int, split: dict[tuple[str, str], int]):
    """A function of batches (lang, text) giving packed suffixes (bucket, items).

    split: into how many buckets the suffixes of a first word, or of a pair of words, go.
    bucket: language, first word and the number of words that several buckets may share,
    with a number. items: the other words of each suffix and its count, "\0" after each.
    """

    def run(batches):
        for data, offsets, of, names in _grouped(batches):
            ids, words, rows, piece = _numbered(data, offsets)
            if not len(ids):
                continue
            none = len(words)
            columns, n = _tuples([of[rows], ids, *(_next(ids, rows, piece, k, none) for k in range(1, max_n))], [len(names), none, *[none + 1] * (max_n - 1)])
            del ids, rows, piece
            words = _escaped(words)
            level, part = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.arange(len(n))
            if split and max_n > 1:
                text, cuts = buffers(words)
                own = np.append(span_hashes(text, cuts[:-1], cuts[1:], SAME) >> np.uint64(1), [np.uint64(0)]).astype(np.int64)
                for (lang, first), parts in split.items():  # words before pairs
                    first, _, second = first.partition("\0")
                    a, b = pc.index_in(pa.array([first, second or first]), words).to_pylist()
                    if lang not in names or a is None or b is None:
                        continue
                    s, e = np.searchsorted(columns[0] * none + columns[1], [names.index(lang) * none + a, names.index(lang) * none + a + 1])
                    at = np.arange(s, e)
                    if second:
                        at = at[columns[2][s:e] == b]
                        part[at] = (sum(own[c[at]] * (2 * k + 1) for k, c in enumerate(columns[2:])) & _POSITIVE) % parts
                    else:
                        part[at] = own[columns[2][at]] % parts
                    level[at] = 2 if second else 1
                hot = np.flatnonzero(level)
                order = np.concatenate([np.flatnonzero(level == 0), hot[np.lexsort((part[hot], level[hot], columns[1][hot], columns[0][hot]))]])
            columns, n, level, part = [c[order] for c in columns], n[order], level[order], part[order]
            more = pa.concat_arrays([words, pa.array([""])])
            begins = np.append(True, np.any([c[1:] != c[:-1] for c in (*columns[:2], level, part)], axis=0))
            at = np.flatnonzero(begins)
            tongue = _escaped(pa.array(names, pa.string()))
            step = 100_000
            for i in range(0, len(at), step):
                here, end = at[i : i + step], at[i + step] if i + step < len(at) else len(n)
                s = slice(here[0], end)
                items = pc.binary_join_element_wise(*(more.take(pa.array(c[s])) for c in columns[2:]), pa.array(n[s]).cast(pa.string()), pa.array([""] * (end - here[0])), "\0")
                text, cuts = buffers(items)
                cuts = np.append(cuts[here - here[0]], cuts[-1])
                packed = pa.LargeStringArray.from_buffers(len(here), pa.py_buffer(cuts), pa.py_buffer(text)).cast(pa.string())
                tag = pc.if_else(pa.array(level[here] > 0), pc.binary_join_element_wise(pa.array(level[here]).cast(pa.string()), pa.array(part[here]).cast(pa.string()), ":"), "")
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(tongue.take(pa.array(columns[0][here])), words.take(pa.array(columns[1][here])), tag, "\0"), packed], names=["bucket", "items"])

    return run


_POSITIVE = (1 << 63) - 1
SAME = np.arange(256, dtype=np.uint8)


def _ranks(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words as numbers in reverse lexicographic order of their bytes, and the word of each number; the empty one comes last."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary, sort_keys=[("", "descending")])
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def _counted(rows: pa.Table, max_n: int, least: int) -> Iterator[pa.RecordBatch]:
    """(key, n, partial) of every phrase that begins in these whole buckets."""
    bucket = rows.column("bucket").combine_chunks()
    new = np.append(True, pc.not_equal(bucket.slice(1), bucket.slice(0, len(bucket) - 1)).to_numpy(zero_copy_only=False)) if len(bucket) else np.zeros(0, bool)
    heads = [x.rpartition("\0") for x in bucket.filter(pa.array(new)).to_pylist()]
    keys, level = pa.array([h for h, _, _ in heads], pa.string()), np.array([int(t[:1] or 0) for _, _, t in heads], np.int64)
    data, offsets = buffers(rows.column("items"))
    ends = np.flatnonzero(data == 0).reshape(-1, max_n)  # words after the first, and the count
    starts = np.empty_like(ends)
    starts.ravel()[1:] = ends.ravel()[:-1] + 1
    starts[0, 0] = 0
    n = spans(data, starts[:, -1], ends[:, -1]).cast(pa.large_string()).cast(pa.int64()).to_numpy()
    own = (np.cumsum(new) - 1)[np.searchsorted(offsets, starts[:, 0], side="right") - 1]
    ranked = [_ranks(spans(data, starts[:, k], ends[:, k])) for k in range(max_n - 1)]
    order = np.lexsort([*(r for r, _ in reversed(ranked)), own])
    columns, n = [own[order], *(r[order] for r, _ in ranked)], n[order]
    closed = np.ones(len(n), bool)  # whether the beginning of so many words that was open before each suffix is closed by it
    whole = np.arange(len(n))  # the suffixes with so many words
    closed[1:] = columns[0][1:] != columns[0][:-1]
    for k in range(max_n):
        if k:
            last = len(ranked[k - 1][1]) - 1
            has_none = last >= 0 and len(ranked[k - 1][1][last].as_py()) == 0
            closed[1:] |= columns[k][1:] != columns[k][:-1]
            whole = whole[columns[k][whole] != last] if has_none else whole
        if not len(whole):
            break
        at = np.flatnonzero(closed[whole])
        counts = np.add.reduceat(n[whole], at)
        lead = whole[at]
        partial = level[columns[0][lead]] > k
        keep = np.flatnonzero(partial | (counts >= least))
        lead = lead[keep]
        parts = [keys.take(pa.array(columns[0][lead])), *(ranked[j][1].take(pa.array(columns[j + 1][lead])).cast(pa.string()) for j in range(k))]
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*parts, "\0"), pa.array(counts[keep]), pa.array(partial[keep])], names=["key", "n", "partial"])


def counter(max_n: int, least: int):
    """A function of batches (bucket, items), sorted by bucket, giving (key, n, partial) of every phrase of up to max_n words.

    Whole buckets are counted, several together while they are small. Counts under least
    are left out unless other buckets have a part of them (partial).
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column("items").nbytes
            if size < 20 * PART:
                continue
            bucket = b.column("bucket")
            cut = int(pc.index(bucket, bucket[-1]).as_py())  # the last bucket may go on
            if not cut and held[0].column("bucket")[0] == bucket[-1]:
                continue
            rows = pa.Table.from_batches([*held[:-1], b.slice(0, cut)]).combine_chunks()
            end = len(rows) if cut else int(pc.index(rows.column("bucket"), bucket[-1]).as_py())
            end = len(rows) if end < 0 else end
            yield from _counted(rows.slice(0, end), max_n, least)
            held = [*(x for x in rows.slice(end).to_batches() if x.num_rows), b.slice(cut)]
            size = sum(x.column("items").nbytes for x in held)
        if held:
            yield from _counted(pa.Table.from_batches(held), max_n, least)

    return run


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(key, n) of all phrases of up to max_n words that occur at least least times, and (lang, n) with the words of each language."""
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = write_table(texts.mapInArrow(first_words, "lang string, words string, n long").groupBy("lang", "words").agg(F.sum("n").alias("n")), "first-words")
    sizes = seen.where("words IS NULL").select("lang", "n")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    often = seen.where(F.col("words").isNotNull() & (F.col("n") > PART) & (F.col("n") * SPLIT > total)).collect()  # 2 * SPLIT rows at most
    split = {(r["lang"], r["words"]): -(-r["n"] // PART) for r in sorted(often, key=lambda r: ("\0" in r["words"], r["lang"], r["words"]))}
    dealt = texts.mapInArrow(suffixes(max_n, split), "bucket string, items string").repartition("bucket").sortWithinPartitions("bucket")
    counted = write_table(dealt.mapInArrow(counter(max_n, least), "key string, n long, partial boolean"), "phrases")
    added = counted.where("partial").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return counted.where("NOT partial").select("key", "n").unionByName(added), sizes


def _with(rows: DataFrame, counts: DataFrame, key: str, out: str, total: int) -> DataFrame:
    """rows with the count of what stands in their column key; a key that very many rows have is broadcast to them."""
    asked = rows.groupBy(key).agg(F.count("*").alias("n"))
    keyed = asked.join(counts.select(F.col("key").alias(key), F.col("n").alias(out)), key)
    return beside_hot(rows, write_table(keyed, "parts"), key, total)


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = MIN_COUNT, contained: int = CONTAINED, top: int | None = TOP) -> DataFrame:
    """Phrases of 2 to max_n words (lang, rank, phrase, a, l, r, n, score): the first top of each language, or all.

    score is floor(1000000 a a / (l r)) of the cut that scores lowest; a phrase goes if its
    words lie inside a longer one with at least contained hundredths of its count.
    """
    counts, sizes = phrase_counts(docs, max_n, least)
    counts = write_table(counts, "counts")
    parts = F.split("key", "\0", -1)
    words = F.size(parts) - 1
    found = counts.select("key", F.col("n").alias("a"), parts.alias("p"), words.alias("d")).where("d > 1")

    def joined(a, length):
        return F.array_join(F.concat(F.array(F.element_at("p", 1)), F.slice("p", a, length)), "\0")

    longer = found.where("d > 2").select("a", "d", "p", F.explode(F.sequence(F.lit(2), F.col("d") - 1)).alias("m"))
    longer = longer.select("a", "p", "m", F.explode(F.sequence(F.lit(2), F.col("d") - F.col("m") + 2)).alias("i"))
    inside = longer.select(joined(F.col("i"), F.col("m")).alias("key"), "a").groupBy("key").agg(F.max("a").alias("over"))
    kept = found.join(inside, "key", "left").where(F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * contained))
    cuts = kept.select("key", "a", "d", "p", F.explode(F.sequence(F.lit(1), F.col("d") - 1)).alias("k"))
    cuts = write_table(cuts.select("key", "a", "k", joined(F.lit(2), F.col("k")).alias("left"), joined(F.col("k") + 2, F.col("d") - F.col("k")).alias("right")), "cuts")
    total = cuts.count()
    both = _with(_with(cuts, counts, "left", "l", total), counts, "right", "r", total)
    big = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {big('a')} * {big('a')}) DIV ({big('l')} * {big('r')})").cast("long")
    best = both.select("key", "a", F.struct(score.alias("score"), "k", "l", "r").alias("s")).groupBy("key", "a").agg(F.min("s").alias("s"))
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("\0"), F.lit(" ")), F.lit("\1\1"), F.lit("\0")), F.lit("\1\2"), F.lit("\1"))
    lang = F.substring_index("key", "\0", 1)
    rows = best.select(plain(lang).alias("lang"), plain(F.expr("substring(key, length(substring_index(key, '\\0', 1)) + 2)")).alias("phrase"), "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), F.col("s.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    rows = rows.withColumn("rank", rank)
    if top is not None:
        rows = rows.where(F.col("rank") <= top)
    return rows.join(beside(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT doc, coalesce(lang, 'und') AS lang, p.i AS piece, regexp_extract_all(p.s, '[^\x20\x09]+') AS w
  FROM (SELECT row_number() OVER () AS doc, lang,
               unnest(list_transform(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'),
                                     lambda s, i: {'s': s, 'i': i})) AS p
        FROM documents)
), f AS (
  SELECT lang, ws, count(*) AS f FROM (
    SELECT lang, list_slice(w, i, i + d - 1) AS ws
    FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), (SELECT unnest([1, 2, 3]) AS d)
    WHERE i + d - 1 <= len(w)
  ) GROUP BY ALL
), sizes AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), c AS (
  SELECT lang, ws, f AS a FROM f WHERE len(ws) > 1 AND f >= 10
), gone AS (
  SELECT DISTINCT c.lang, c.ws
  FROM c JOIN (SELECT lang, ws[1:2] AS ws, a FROM c WHERE len(ws) = 3 UNION ALL SELECT lang, ws[2:3], a FROM c WHERE len(ws) = 3) AS t ON c.lang = t.lang AND c.ws = t.ws
  WHERE 100 * t.a >= 50 * c.a
), cuts AS (
  SELECT c.lang, c.ws, c.a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM c ANTI JOIN gone USING (lang, ws)) AS c
  JOIN f AS x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN f AS y ON y.lang = c.lang AND y.ws = c.ws[k + 1:]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
