"""Postings by term in blocks of nodes, and the scoring of a batch of queries block by block.

A node's number (nid) is its place in the written nodes table; its upper part names a block
of 2^bits nodes, its lower part the slot there; bits are chosen once an index, by its size. A row holds the postings of one term in
one block, with the greatest frequency, the least length and the weight classes among them, from
which follows the most that any of them can score under any ranking. Rows lie in
BUCKETS folders by the first three letters of the term, ordered by term: a search opens the
folders of its terms (and of their prefixes, which share the three letters) and no others.

A task scores one block after another for all queries at once: what a node scores for each
distinct query term is a matrix, summed for the queries by a matrix product. A query that has
found enough better nodes skips every block whose bound is below its worst.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.operators.schema import Ranking
from papyra.session import attach, scratch_path

SEGMENT_BITS = 53
#: Bits of a slot: few nodes have small blocks, so that there are blocks for all tasks.
LEAST_BITS, MOST_BITS = 8, 13
BUCKETS, FEW_NODES = 64, 4096  # fewer nodes have four
#: Distinct query terms whose scores are held at once.
TERMS = 128
#: What a row of the stream is that holds no postings: slots that may be found, that may not, that have a weight.
ALLOWED, DEAD, WEIGHT = -3, -2, -1
COLUMNS = "struct<slot:array<int>,tf:array<int>,length:array<int>,marks:array<int>>"
STREAM = "block long, t int, items array<int>, max_tf int, min_length int, marks int, bits binary, w double"


def numbered(nodes: DataFrame, segment: int) -> DataFrame:
    """Nodes with their number; to be written, so that it stays."""
    return nodes.drop("nid").withColumn("nid", F.lit(segment << SEGMENT_BITS) + F.monotonically_increasing_id())


def slot_bits(n_nodes: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (n_nodes >> 6).bit_length()))


def block_of(bits: int) -> Column:
    return F.shiftright("nid", bits)


def slot_of(bits: int) -> Column:
    return F.col("nid").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.left(term, F.lit(3))), F.lit(buckets)).cast("int")


def blocks_of(postings: DataFrame, bits: int, buckets: int) -> DataFrame:
    """Rows of blocks (bucket, term, block, items and their bounds), written by bucket; one exchange of the postings."""
    marks = F.col("has_title").cast("int") + F.col("has_desc").cast("int") * 2 + F.col("has_code").cast("int") * 4
    rows = postings.select(
        bucket_of(F.col("term"), buckets).alias("bucket"), F.shiftright(block_of(bits), 10).alias("part"), "term", block_of(bits).alias("block"),
        F.struct(slot_of(bits).alias("slot"), "tf", F.col("total_tokens").alias("length"), marks.alias("marks")).alias("item"),
    )
    # a part is 1024 blocks, so a bucket of a large store has several files; the aggregate needs no other exchange
    grouped = rows.repartition("bucket", "part").groupBy("bucket", "part", "term", "block").agg(
        F.collect_list("item").alias("items"), F.max("item.tf").alias("max_tf"), F.min("item.length").alias("min_length"), F.bit_or("item.marks").alias("marks"),
    )
    return _written(_by_column(grouped.drop("part")))


def _written(rows: DataFrame) -> DataFrame:
    path = scratch_path(rows.sparkSession, "blocks")
    rows.select("term", "block", "items", "max_tf", "min_length", "marks", "bucket").sortWithinPartitions("bucket", "term", "block").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    return rows.sparkSession.read.schema(f"term string, block long, items {COLUMNS}, max_tf int, min_length int, marks int, bucket int").parquet(path)


#: Where a term stands in a node, before descriptions are known: title, code, body.
TITLE, CODE, BODY = 1, 4, 8


def _lists(sizes: np.ndarray, **columns: np.ndarray) -> pa.StructArray:
    """Items column by column, sizes of them a row."""
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(columns[c].astype(np.int32))) for c in ("slot", "tf", "length", "marks")], ["slot", "tf", "length", "marks"])


def gathered(bits: int):
    """A function of batches (nid, length, title_len, stems, code) giving (term, block, items): the postings of a batch's nodes, a row for a term and a block.

    code: for each stem whether its token is one of the code, or null if the node has none.
    items: three numbers a posting, slot * 16 + marks, frequency and length; rare terms have a
    row each, so what a row takes beside its numbers counts.
    """

    def run(batches):
        for b in batches:
            nid, length, titles = (b.column(c).to_numpy() for c in ("nid", "length", "title_len"))
            stems, code = b.column("stems"), b.column("code")
            by = np.argsort(nid, kind="stable")
            place = np.empty(len(nid), np.int64)
            place[by] = np.arange(len(nid))
            n = np.diff(stems.offsets.to_numpy()).astype(np.int64)
            row, pos = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            mark = np.where(pos < titles[row], TITLE, BODY)
            has = code.is_valid().to_numpy(zero_copy_only=False)
            if has.any():
                mark[has[row] & (mark == BODY)] |= np.where(code.flatten().to_numpy(zero_copy_only=False), CODE, 0)[pos[has[row]] >= titles[row[has[row]]]]
            terms = stems.flatten().dictionary_encode()
            names = terms.dictionary
            t = terms.indices.to_numpy()
            long = pc.greater_equal(pc.utf8_length(names), 2).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(long[t]) if len(names) else np.zeros(0, np.int64)
            if not len(keep):
                continue
            key = t[keep].astype(np.int64) * len(n) + place[row[keep]]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            tf, marks = np.diff(np.append(first, len(key))), np.bitwise_or.reduceat(mark[keep][order], first)
            own, node = key[first] // len(n), by[key[first] % len(n)]
            block = nid[node] >> bits
            new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (block[1:] != block[:-1])))
            items = np.stack([(nid[node] & ((1 << bits) - 1)) << 4 | marks, tf, length[node]], 1).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(3 * np.append(new, len(own)).astype(np.int32)), pa.array(items.ravel()))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(own[new])), pa.array(block[new]), items], names=["term", "block", "items"])

    return run


def _merge(rows: pa.Table, bits: int) -> pa.RecordBatch:
    """One row for a term and a block of rows in that order; items with tf 0 say that the description of the node has the term."""
    rows = rows.combine_chunks()
    term, block, items = rows.column("term").combine_chunks().dictionary_encode(), rows.column("block").to_numpy(), rows.column("items").combine_chunks()
    t = term.indices.to_numpy()
    new = np.append(True, (t[1:] != t[:-1]) | (block[1:] != block[:-1]))
    group = np.cumsum(new) - 1
    slot, tf, length = items.flatten().to_numpy().reshape(-1, 3).T
    key, marks = (np.repeat(group, np.diff(items.offsets.to_numpy()) // 3) << bits) + (slot >> 4), slot & 15
    described = np.isin(key, key[tf == 0])
    order = np.argsort(key, kind="stable")
    order = order[tf[order] > 0]
    key, tf, length, marks, described = (x[order] for x in (key, tf, length, marks, described))
    marks = (marks & TITLE) | np.where(described, np.where(marks & BODY, 2, 0), marks & CODE)
    group = key >> bits
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(key) else np.zeros(0, np.int64)
    row = pa.array(np.flatnonzero(new)[group[first]])
    each = lambda f, x: pa.array(f.reduceat(x, first).astype(np.int32) if len(first) else np.zeros(0, np.int32))
    items = _lists(np.diff(np.append(first, len(key))), slot=key & ((1 << bits) - 1), tf=tf, length=length, marks=marks)
    names, bucket = (rows.column(c).combine_chunks().take(row) for c in ("term", "bucket"))
    return pa.RecordBatch.from_arrays(
        [names, pa.array(block).take(row), items, each(np.maximum, tf), each(np.minimum, length), each(np.bitwise_or, marks), bucket], names=["term", "block", "items", "max_tf", "min_length", "marks", "bucket"]
    )


def merged(bits: int):
    """A function of batches (bucket, term, block, items), sorted so, giving whole rows of blocks."""

    def run(batches):
        rest = None
        for b in batches:
            if not len(b):
                continue
            rows = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
            term, block = rows.column("term"), rows.column("block").to_numpy()
            last = np.flatnonzero(pc.equal(term, term[-1]).to_numpy() & (block == block[-1]))[0]  # rows of the last group lie together
            rest = rows.slice(last)
            if last:
                yield _merge(rows.slice(0, last), bits)
        if rest is not None:
            yield _merge(rest, bits)

    return run


def blocks_of_nodes(nodes: DataFrame, described: DataFrame, bits: int, buckets: int) -> DataFrame:
    """blocks_of() without postings: nodes (nid, length, title_len, stems, code) become rows of blocks where they lie, and those alone are exchanged.

    described: (nid, term) of descriptions.
    """
    side = described.select("term", block_of(bits).alias("block"), F.array(slot_of(bits) * 16, F.lit(0), F.lit(0)).alias("items"))
    attach(nodes.sparkSession)
    rows = nodes.mapInArrow(gathered(bits), "term string, block long, items array<int>").unionByName(side)
    bucket = bucket_of(F.col("term"), buckets)
    dealt = rows.repartition(bucket, F.shiftright("block", 10)).withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", "block")
    return _written(dealt.mapInArrow(merged(bits), f"term string, block long, items {COLUMNS}, max_tf int, min_length int, marks int, bucket int"))


def counted(blocks: DataFrame) -> DataFrame:
    """(term, df) of blocks that no change has touched."""
    return blocks.groupBy("term").agg(F.sum(F.size("items.slot")).alias("df"))


def bits_of(nodes: DataFrame, bits: int, *keys: str) -> DataFrame:
    """(keys, block, bits): which slots of a block these nodes (nid) have, for each of the keys."""
    return nodes.select(*keys, block_of(bits).alias("block"), slot_of(bits).alias("slot")).groupBy(*keys, "block").agg(F.bitmap_construct_agg("slot").alias("bits"))


@dataclass
class Batch:
    """Some queries and the indexed terms they want; sent to every task."""

    qids: list[str]
    n_terms: np.ndarray  # distinct terms of each query
    asked: np.ndarray  # queries x query terms, 0 or 1
    first: np.ndarray  # of each indexed term the first of its pairs
    qterm: np.ndarray  # of each pair the query term
    u: np.ndarray  # of each pair the weight of the indexed term for it
    ranking: Ranking
    average: float
    bonuses: bool
    limit: int
    filtered: bool
    most_weight: float
    bits: int
    n_nodes: int = 0  # for rows that bring their pairs and df

    def worth(self, tf: np.ndarray, length: np.ndarray, marks: np.ndarray) -> np.ndarray:
        r = self.ranking
        table = np.array([max(1.0, r.title_weight if m & 1 else 1.0, r.description_weight if m & 2 else 1.0, r.code_weight if m & 4 else 1.0) for m in range(8)])
        return tf * (r.k1 + 1) / (tf + r.k1 * (1 - r.b + r.b * length / self.average)) * table[marks]

    def with_bonuses(self, score: np.ndarray, matched: np.ndarray, n_terms: np.ndarray) -> np.ndarray:
        if not self.bonuses:
            return score
        r = self.ranking
        return score + np.maximum(matched - 1, 0) * r.term_proximity_bonus + np.where((matched == n_terms) & (n_terms > 1), r.full_coverage_bonus, 0.0)

    def bounded(self) -> bool:
        """Whether bounds hold: for rankings under which a score never falls with frequency or match."""
        r = self.ranking
        return r.k1 >= 0 and 0 <= r.b <= 1 and r.term_proximity_bonus >= 0 and r.full_coverage_bonus >= 0


class _Best:
    """The best nodes of each query so far, and all that tie with the last of them."""

    def __init__(self, b: Batch):
        self.b = b
        none = np.zeros(0)
        self.found = [(none, none.astype(np.int64), none)] * len(b.qids)
        self.floor = np.full(len(b.qids), -np.inf)

    def add(self, q: int, score: np.ndarray, nid: np.ndarray, matched: np.ndarray) -> None:
        rows = tuple(np.concatenate(x) for x in zip(self.found[q], (score, nid, matched)))
        if len(rows[0]) > self.b.limit:
            # scores that are equal to nine places tie, so those a little below stay too
            self.floor[q] = np.partition(rows[0], len(rows[0]) - self.b.limit)[-self.b.limit] - 2e-9
            keep = rows[0] >= self.floor[q]
            rows = tuple(x[keep] for x in rows)
        self.found[q] = rows

    def result(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _, _ in self.found]
        score, nid, matched = (np.concatenate(x) if sizes else np.zeros(0) for x in zip(*self.found))
        names = pa.array(self.b.qids, pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        return pa.RecordBatch.from_arrays([names, pa.array(nid.astype(np.int64)), pa.array(score), pa.array(matched.astype(np.int32))], names=["qid", "nid", "score", "n_matched"])


def _slots(bits: pa.Scalar, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), bitorder="little")[:n].astype(bool)


def _score(rows: pa.Table, b: Batch, best: _Best) -> bool:
    """Scores one block; false if the bounds of all queries are too low."""
    t = rows.column("t").to_numpy()
    allowed, weight = np.full(1 << b.bits, not b.filtered), np.ones(1 << b.bits)
    for k in np.flatnonzero(t < 0):
        own = _slots(rows.column("bits")[k], 1 << b.bits)
        if t[k] == ALLOWED:
            allowed |= own
        elif t[k] == DEAD:
            allowed &= ~own
        else:
            weight[own] = rows.column("w")[k].as_py()
    own = "pairs" in rows.column_names
    rows, t = rows.slice(int((t < 0).sum())), t[t >= 0]
    if not len(t) or not allowed.any():
        return False
    # pairs of a row and a query term, in order of the query term
    if own:
        pairs, df = rows.column("pairs").combine_chunks(), rows.column("df").to_numpy().astype(float)
        many, codes = np.diff(pairs.offsets.to_numpy()), pairs.flatten().to_numpy()
        row, qterm = np.repeat(np.arange(len(t)), many), codes >> 1
        u = np.log((b.n_nodes - df + 0.5) / (df + 0.5) + 1.0)[row] * np.where(codes & 1, 1.0, b.ranking.prefix_penalty)
    else:
        many = b.first[t + 1] - b.first[t]
        pair = np.repeat(b.first[t] - np.cumsum(many) + many, many) + np.arange(many.sum())
        row, qterm, u = np.repeat(np.arange(len(t)), many), b.qterm[pair], b.u[pair]
    order = np.argsort(qterm, kind="stable")
    row, qterm, u = row[order], qterm[order], u[order]
    terms, start = np.unique(qterm, return_index=True)
    active = np.arange(len(b.qids))
    if b.bounded():
        top = b.worth(*(rows.column(c).to_numpy() for c in ("max_tf", "min_length", "marks")))
        bound = np.add.reduceat(u * top[row], start)
        asked = b.asked[:, terms].astype(np.float64)
        active = np.flatnonzero(b.with_bonuses(asked @ bound, asked.sum(1), b.n_terms) * b.most_weight + 1e-6 >= best.floor)
        if not len(active):
            return False
    items = rows.column("items").combine_chunks()
    sizes = np.diff(items.offsets.to_numpy()).astype(np.int64)
    if pa.types.is_struct(items.type.value_type):
        slot, tf, length, marks = (items.flatten().field(c).to_numpy() for c in ("slot", "tf", "length", "marks"))
    else:  # of each row all slots, then all frequencies, lengths and marks
        numbers, at, sizes = items.flatten().to_numpy(), np.cumsum(sizes) - sizes, sizes // 4
        at = np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        slot, tf, length, marks = (numbers[at + k * np.repeat(sizes, sizes)] for k in range(4))
    v, begin = b.worth(tf, length, marks), np.cumsum(sizes) - sizes
    width = int(slot.max()) + 1
    score, matched = np.zeros((len(active), width)), np.zeros((len(active), width))
    start = np.append(start, len(row))
    for i in range(0, len(terms), TERMS):
        own = terms[i : i + TERMS]
        asked = b.asked[np.ix_(active, own)].astype(np.float64)
        s = slice(start[i], start[min(i + TERMS, len(terms))])
        n = sizes[row[s]]
        item = np.repeat(begin[row[s]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = np.repeat((np.searchsorted(own, qterm[s])) * width, n) + slot[item]
        part = np.bincount(cell, weights=np.repeat(u[s], n) * v[item], minlength=len(own) * width).reshape(len(own), width)
        score += asked @ part
        matched += asked @ (part > 0)
    final = b.with_bonuses(score, matched, b.n_terms[active][:, None]) * weight[:width]
    here = (matched > 0) & allowed[:width]
    base = int(rows.column("block")[0].as_py()) << b.bits
    for k, q in enumerate(active):
        at = np.flatnonzero(here[k] & (final[k] >= best.floor[q]))
        if len(at):
            best.add(int(q), final[k][at], base + at, matched[k][at])
    return True


def scorer(batch: Broadcast):
    """A function of batches of STREAM, sorted by block and t, giving the best (qid, nid, score, n_matched) of a task."""

    def run(batches):
        b = batch.value
        best = _Best(b)
        held: list[pa.RecordBatch] = []
        for rows in batches:
            at = rows.column("block").to_numpy()
            cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
            for k, a in enumerate(cuts):
                if held and (k or held[-1].column("block")[0].as_py() != at[0]):
                    _score(pa.Table.from_batches(held), b, best)
                    held = []
                held.append(rows.slice(a, (cuts[k + 1] if k + 1 < len(cuts) else len(at)) - a))
        if held:
            _score(pa.Table.from_batches(held), b, best)
        yield best.result()

    return run


def read_blocks(blocks: DataFrame, terms: DataFrame, buckets: list[int]) -> DataFrame:
    """Rows of STREAM of the wanted terms (term, t), from their buckets alone."""
    return _stream(_in_turn(blocks.where(F.col("bucket").isin(buckets))).join(F.broadcast(terms), "term"))


def read_many(blocks: DataFrame, wanted: DataFrame, buckets: list[int], few: bool) -> DataFrame:
    """As read_blocks(), for any number of terms (term, df, pairs): rows bring their own pairs and df; few terms are broadcast, else both sides are dealt by term."""
    rows = _in_turn(blocks.where(F.col("bucket").isin(buckets))).join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "term")
    return _stream(rows.withColumn("t", F.lit(0)), "pairs", "df")


def _by_column(rows: DataFrame) -> DataFrame:
    """Items column by column."""
    return rows.withColumn("items", F.struct(*(F.col(f"items.{c}").alias(c) for c in ("slot", "tf", "length", "marks"))))


def _in_turn(rows: DataFrame) -> DataFrame:
    """Items as one list, column after column: rows of rare terms hold a few numbers, and four lists of them take many times that."""
    return rows.withColumn("items", F.concat("items.slot", "items.tf", "items.length", "items.marks"))


def _stream(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("block", "t", "items", "max_tf", "min_length", "marks", F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("double").alias("w"), *more)


def side_rows(bits: DataFrame, kind: int, w: Column | None = None) -> DataFrame:
    """Rows of STREAM for slots (block, bits)."""
    return bits.select(
        "block", F.lit(kind).alias("t"), F.lit(None).cast("array<int>").alias("items"), *(F.lit(None).cast("int").alias(c) for c in ("max_tf", "min_length", "marks")), "bits",
        (F.lit(None).cast("double") if w is None else w).alias("w"),
    )
