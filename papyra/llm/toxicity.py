"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>) over the terms a text has:
linear weights and pairwise interactions through factors of a low rank, so a pair
such as an insult with the mention of a group can count more than its parts. Terms
are folded words and the beginnings of longer words, hashed into buckets; the
buckets most associated with the label (chi-square, ACTIVE of them) are learned by
AdaGrad with weight decay on a bounded labelled sample (about PER_CLASS distinct rows a class).

Defined cases: an empty table gives no rows; null and empty texts get the score of no terms at all; without
labels of both classes the score is the share of label 1 (0.0 without any labels).
Repeated rows score alike; other columns are ignored; whole texts are read, in groups
of rows, so memory depends on the longest text alone.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import features
from papyra.llm.bytetools import buffers
from papyra.llm.common import fold, labelled_sample, prior_shift, resident, table, trim

PER_CLASS = 12000
ACTIVE = 4096
RANK = 8
THRESHOLD = 0.3


class FM:
    """A trained machine; active maps buckets to rows of w and v (-1: not learned)."""

    def __init__(self, lists: list[np.ndarray], y: np.ndarray, shift: float = 0.0, epochs: int = 15, rate: float = 0.1, decay: float = 3e-4, seed: int = 7):
        self.uid = uuid.uuid4().hex
        n, n1 = len(y), int(y.sum())
        self.bias = 0.0 if n == 0 else float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
        self.constant = None if 0 < n1 < n else (n1 / n if n else 0.0)
        self.buckets, self.w, self.v = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, RANK))
        if self.constant is not None:
            return
        a = features.counts([x for x, k in zip(lists, y) if k == 1])
        df = features.counts(lists)
        want = df * n1 / n
        chi = np.where(df >= 3, (a - want) ** 2 / np.maximum(want * (1 - df / n) * (1 - n1 / n), 1e-9), 0.0)
        top = np.argsort(-chi, kind="stable")[:ACTIVE]
        self.buckets = np.sort(top[chi[top] > 3.84])
        self._fit(lists, y, epochs, rate, decay, seed)
        self.bias += shift

    def table(self) -> np.ndarray:
        out = np.full(features.BUCKETS, -1, np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out

    def _fit(self, lists, y, epochs, rate, decay, seed) -> None:
        rng, m = np.random.default_rng(seed), len(self.buckets)
        active = self.table()
        rows = [(r := active[x])[r >= 0] for x in lists]
        w, v, b = np.zeros(m), rng.normal(0, 0.01, (m, RANK)), self.bias
        gw, gv, gb = np.full(m, 1e-6), np.full((m, RANK), 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), 64):
                batch = order[lo : lo + 64]
                flat = np.concatenate([rows[i] for i in batch])
                here, at = np.unique(flat, return_inverse=True)
                x = np.zeros((len(batch), len(here)))
                x[np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch]), at] = 1
                wh, vh = w[here], v[here]
                s = x @ vh
                z = b + x @ wh + 0.5 * ((s * s).sum(1) - x @ (vh * vh).sum(1))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
                xg = x.T @ g
                dw = xg + decay * wh
                dv = x.T @ (g[:, None] * s) - xg[:, None] * vh + decay * vh
                db = g.sum()
                gw[here] += dw * dw
                gv[here] += dv * dv
                gb += db * db
                w[here] -= rate * dw / np.sqrt(gw[here])
                v[here] -= rate * dv / np.sqrt(gv[here])
                b -= rate * db / np.sqrt(gb)
        self.w, self.v, self.bias = w, v, float(b)

    def score(self, data: np.ndarray, offsets: np.ndarray, active: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        z = np.full(n, self.bias)
        own = (self.v * self.v).sum(1)
        for i, j, rows, buckets in features.pairs(data, offsets, features.terms, active >= 0):
            a, r, k = active[buckets], rows - i, j - i
            z[i:j] += np.bincount(r, self.w[a] - 0.5 * own[a], k)
            for f in range(RANK):
                z[i:j] += 0.5 * np.bincount(r, self.v[a, f], k) ** 2
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> FM:
    sample, sizes = labelled_sample(docs, labels, "toxic", per_class)
    model = FM(*(got := features.collect_features(sample, features.terms)), prior_shift(got[1], sizes))
    del got
    trim()
    return model


def scorer(spark: SparkSession, model: FM):
    """An Arrow function from text to a score of 0 to 1."""
    sent = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        m = sent.value
        return pa.array(m.score(*buffers(texts), resident(m.uid, m.table)))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    got = docs.select("doc_id", scorer(spark, model)(F.col("text")).alias("score"))
    return got.select(
        "doc_id", fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
