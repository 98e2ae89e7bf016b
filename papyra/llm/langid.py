"""Language identification by prediction by partial matching (PPM).

Per language, a byte context tree of order 2 is counted on a bounded labelled
sample and then frozen. Probabilities follow PPM with escape method C: a symbol
seen n times after a context with N symbols of T kinds has n / (N + T); the escape
T / (N + T) leads to the next shorter context, at last to a uniform code. Since the
statistics are frozen, the code length of a symbol after its two predecessors is a
constant, so the trees are flattened into lookup tables and a text is scored over
all its bytes by gathers and sums. The language with the shortest exact code wins.

Symbols are bytes with A-Z folded to a-z, digits and ASCII punctuation each one
class, and control characters and blanks one class (rule-based, independent of data).

Defined cases: a null text or one without any letter gives `und` with score 0; an
empty training set gives `und` for all; ties go to the language first in order.
Repeated rows are scored alike; other columns are ignored. Very long texts are
processed in blocks, so memory does not depend on their length.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.bytetools import buffers
from papyra.llm.common import fold, resident, table, trim

A = 157
BLOCK = 1 << 20
PER_LANGUAGE = 3000
#: Bits a byte that a code without any statistics takes; a longer code is of none of the languages.
UNIFORM = float(np.log2(A))


def _symbols() -> np.ndarray:
    m = np.full(256, 28, np.uint8)
    m[:33] = 0
    m[127] = 0
    m[48:58] = 27
    m[97:123] = np.arange(1, 27)
    m[65:91] = np.arange(1, 27)
    m[128:] = np.arange(29, 157)
    return m


SYMBOLS = _symbols()


def codes(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Context code (two predecessors and the symbol) of bytes lo to hi; each row starts after blanks."""
    a = max(0, lo - 2)
    s = SYMBOLS[data[a:hi]].astype(np.int32)
    c1 = np.zeros_like(s)
    c1[1:] = s[:-1]
    c2 = np.zeros_like(s)
    c2[2:] = s[:-2]
    first = offsets[(offsets >= a) & (offsets < hi)] - a
    c1[first] = 0
    c2[first] = 0
    second = first + 1
    c2[second[second < len(s)]] = 0
    return ((c2 * A + c1) * A + s)[lo - a :]


def _count(batches):
    for b in batches:
        lang, texts = b.column("lang"), b.column("text")
        for name in lang.unique().to_pylist():
            data, offsets = buffers(texts.filter(pc.equal(lang, name)))
            out: dict[int, int] = {}
            for lo in range(0, len(data), BLOCK):
                c, n = np.unique(codes(data, offsets, lo, min(lo + BLOCK, len(data))), return_counts=True)
                for k, v in zip(c.tolist(), n.tolist()):
                    out[k] = out.get(k, 0) + v
            if out:
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([name] * len(out)), "code": pa.array(list(out), pa.int32()), "n": pa.array(list(out.values()), pa.int64())}
                )


class Model:
    """Frozen statistics: bits[code row, language], with escapes for unseen codes."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]], docs: list[int]):
        self.langs, self.uid = langs, uuid.uuid4().hex
        n_lang = len(langs)
        seen = np.unique(np.concatenate([c for c, _ in counts])) if counts else np.zeros(0, np.int64)
        self.seen = seen.astype(np.int32)
        rows = np.zeros((len(seen) + 1, n_lang), np.float32)
        self.esc2 = np.zeros((A * A, n_lang), np.float32)
        self.cost1 = np.zeros((A * A, n_lang), np.float32)
        ab, bc = seen // A, seen % (A * A)
        for k, (code, n) in enumerate(counts):
            n2 = np.bincount(code % (A * A), n, A * A).reshape(A, A)
            n1 = n2.sum(0)
            total, kinds = n1.sum(), (n1 > 0).sum()
            p0 = np.where(n1 > 0, n1, kinds / A) / (total + kinds)
            total, kinds = n2.sum(1), (n2 > 0).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                esc1 = np.where(total > 0, kinds / (total + kinds), 1.0)
                p1 = np.where(n2 > 0, n2 / (total + kinds)[:, None], esc1[:, None] * p0[None, :])
                total, kinds = np.bincount(code // A, n, A * A), np.bincount(code // A, minlength=A * A)
                esc2 = np.where(total > 0, kinds / (total + kinds), 1.0)
            self.esc2[:, k] = -np.log2(esc2)
            self.cost1[:, k] = -np.log2(p1).ravel()
            mine = np.zeros(len(seen))
            mine[np.searchsorted(seen, code)] = n
            with np.errstate(divide="ignore"):
                direct = -np.log2(mine / np.maximum(total + kinds, 1)[ab])
            rows[1:, k] = np.where(mine > 0, direct, self.esc2[ab, k] + self.cost1[bc, k])
        self.rows = rows
        share = np.array(docs, np.float64) + 1
        self.prior = -np.log2(share / share.sum())

    def index(self) -> np.ndarray:
        out = np.zeros(A * A * A, np.int32)
        out[self.seen] = np.arange(1, len(self.seen) + 1)
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Code length of each row under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)), np.float64)
        for lo in range(0, len(data), BLOCK):
            hi = min(lo + BLOCK, len(data))
            c = codes(data, offsets, lo, hi)
            r = index[c]
            cost = self.rows[r]
            new = np.flatnonzero(r == 0)
            if len(new):
                cost[new] = self.esc2[c[new] // A] + self.cost1[c[new] % (A * A)]
            i = int(np.searchsorted(offsets, lo, side="right")) - 1
            j = int(np.searchsorted(offsets, hi, side="left"))
            at = np.maximum(offsets[i:j], lo) - lo
            full = np.flatnonzero(np.diff(np.append(at, hi - lo)) > 0)
            if len(full):
                out[i + full] += np.add.reduceat(cost, at[full], axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from text and non-null lang of documents outside the held-out fold.

    About per_language distinct rows a language are used, picked by a hash of id and text,
    so a repeated id or row doesn't add to them; counting runs on the executors, the counts
    of at most A^3 contexts a language come to the driver.
    """
    h = F.xxhash64("doc_id", "text")
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~fold(F.col("doc_id"), 5, 0)
    )
    sizes = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(h, 0.02).alias("distinct")).collect()}
    keep = F.lit(False)
    for name, r in sizes.items():
        keep = keep | ((F.col("lang") == name) & (F.pmod(F.xxhash64(h), F.lit(1 << 40)) < int(min(1.0, per_language / r["distinct"]) * (1 << 40))))
    got = (
        rows.where(keep).dropDuplicates(["doc_id", "text", "lang"]).select("lang", "text").mapInArrow(_count, "lang string, code int, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    )
    lang, code, n = got.column("lang"), got.column("code").to_numpy(), got.column("n").to_numpy()
    langs = sorted(lang.unique().to_pylist())
    counts = []
    for name in langs:
        own = pc.equal(lang, name).to_numpy(zero_copy_only=False) if isinstance(lang, pa.Array) else pc.equal(lang, name).to_numpy()
        order = np.argsort(code[own])
        counts.append((code[own][order].astype(np.int64), n[own][order].astype(np.float64)))
    model = Model(langs, counts, [sizes[x]["n"] for x in langs])
    del got, lang, code, n, counts
    trim()
    return model


def scorer(spark: SparkSession, model: Model):
    """An Arrow function from text to struct<lang, score, bits>."""
    sent = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        m = sent.value
        data, offsets = buffers(texts)
        bits = m.bits(data, offsets, resident(m.uid, m.index)) + m.prior
        best = bits.argmin(1)
        low = bits.min(1)
        score = 1 / np.exp2(-np.minimum(bits - low[:, None], 1000.0)).sum(1)
        size = np.maximum(np.diff(offsets), 1)
        names = pa.array(m.langs).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(score), pa.array(low / size)], ["lang", "score", "bits"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "lang string, score double, bits double")


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "lang_id") -> DataFrame:
    """Add a column of struct<lang, score, bits_per_byte>."""
    c = F.col(text)
    if not model.langs:
        return docs.withColumn(out, F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte")))
    none = c.isNull() | ~c.rlike(r"\p{L}")
    raw = docs.withColumn(out, scorer(docs.sparkSession, model)(c))

    def pick(a: Column, b: Column, name: str) -> Column:
        return F.when(none, a).otherwise(b).alias(name)

    return raw.withColumn(
        out,
        F.struct(
            pick(F.lit("und"), F.col(f"{out}.lang"), "lang"),
            pick(F.lit(0.0), F.col(f"{out}.score"), "score"),
            pick(F.lit(0.0), F.col(f"{out}.bits"), "bits_per_byte"),
        ),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = identify(docs.select("doc_id", "text"), train(docs))
    return got.select(
        "doc_id",
        fold(F.col("doc_id"), 5, 0).alias("held_out"),
        F.col("lang_id.lang").alias("lang_pred"),
        F.col("lang_id.score").alias("score"),
        F.col("lang_id.bits_per_byte").alias("bits_per_byte"),
    )
