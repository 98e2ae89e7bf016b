"""Quality by naive Bayes support vectors (NBSVM).

N-gram indicators (word uni- and bigrams, and n-grams of token shapes) are scaled by
the log-count ratio of the two classes; on the scaled, length-normalised vectors a
linear model with hinge loss is fit by dual coordinate descent. A logistic curve,
fit on rows kept out of the descent, turns margins into scores of 0 to 1. It learns
from a bounded labelled sample (about PER_CLASS distinct rows a class).

Defined cases: an empty table gives no rows; null and empty texts get the score of no n-grams at all (the margin is
the bias); without labels of both classes the score is the share of label 1 (0.0
without labels). Repeated rows score alike; other columns are ignored; whole texts
are read, in groups of rows, so memory depends on the longest text alone.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import features
from papyra.llm.bytetools import buffers
from papyra.llm.common import fold, labelled_sample, prior_shift, table, trim

PER_CLASS = 6000
THRESHOLD = 0.7


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float, epochs: int = 40, seed: int = 3) -> np.ndarray:
    """Dual coordinate descent for the hinge loss: min |w|^2/2 + sum_i cost_i * max(0, 1 - y_i w.x_i); y is +1 or -1."""
    w, alpha = np.zeros(size), np.zeros(len(y))
    share = np.array([(y == -1).sum(), (y == 1).sum()], float)
    upper = cost * np.where(y > 0, len(y) / (2 * share[1]), len(y) / (2 * share[0]))
    norm = np.array([float(v @ v) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            if norm[i] == 0:
                continue
            g = y[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), upper[i])
            step = new - alpha[i]
            if step:
                w[rows[i]] += step * y[i] * values[i]
                alpha[i] = new
                most = max(most, abs(step) * norm[i])
        if most < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y=1 | margin), by Newton steps with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-7:
            break
    return float(a), float(b)


class NBSVM:
    """Weights per bucket (already times the ratio), squared ratios, bias and curve."""

    def __init__(self, lists: list[np.ndarray], y: np.ndarray, shift: float = 0.0, cost: float = 1.0, least: int = 3):
        self.uid = uuid.uuid4().hex
        n, n1 = len(y), int(y.sum())
        self.constant = None if 0 < n1 < n else (n1 / n if n else 0.0)
        self.keep = np.zeros(features.BUCKETS, bool)
        if self.constant is not None:
            return
        p = features.counts([x for x, k in zip(lists, y) if k == 1])
        q = features.counts([x for x, k in zip(lists, y) if k == 0])
        self.keep = p + q >= least
        ratio = np.where(self.keep, np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum()), 0.0)
        del p, q
        rows, values = [], []
        for x in lists:
            k = x[self.keep[x]]
            v = ratio[k]
            size = np.sqrt(v @ v)
            rows.append(np.append(k, np.int32(features.BUCKETS)))
            values.append(np.append(v / size if size else v, 1.0).astype(np.float32))
        sign = np.where(y > 0, 1, -1)
        part = np.random.default_rng(11).permutation(n) % 5 == 0
        if not 0 < y[part].sum() < part.sum() or not 0 < y[~part].sum() < (~part).sum():
            part = np.zeros(n, bool)
        fit = np.flatnonzero(~part)
        w = descend([rows[i] for i in fit], [values[i] for i in fit], sign[fit], features.BUCKETS + 1, cost)
        held = np.flatnonzero(part) if part.any() else fit
        margin = np.array([float(w[rows[i]] @ values[i]) for i in held])
        self.slope, self.offset = logistic(margin, y[held])
        self.offset += shift
        self.weight, self.square, self.bias = (w[:-1] * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), float(w[-1])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        z = np.zeros(n)
        for i, j, rows, buckets in features.pairs(data, offsets, features.ngrams, self.keep):
            k = j - i
            size = np.sqrt(np.bincount(rows - i, self.square[buckets], k))
            z[i:j] = np.bincount(rows - i, self.weight[buckets], k) / np.maximum(size, 1e-12)
        return 1 / (1 + np.exp(-np.clip(self.slope * (z + self.bias) + self.offset, -700, 700)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> NBSVM:
    sample, sizes = labelled_sample(docs, labels, "quality", per_class)
    model = NBSVM(*(got := features.collect_features(sample, features.ngrams)), prior_shift(got[1], sizes))
    del got
    trim()
    return model


def scorer(spark: SparkSession, model: NBSVM):
    """An Arrow function from text to a score of 0 to 1."""
    sent = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(*buffers(texts)))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    got = docs.select("doc_id", scorer(spark, model)(F.col("text")).alias("score"))
    return got.select(
        "doc_id", fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
