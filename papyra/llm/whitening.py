"""Whitening of embeddings; the covariance is exact, by products of small digits.

Entries become integers x. With n vectors and sums S, each is centred as y = n x - S, an
integer, and cut into signed limbs of LIMB bits. Products of limbs over CHUNK rows stay
below 2^53, so a float64 matrix product of BLAS gives them exactly. A task puts the limb
products together as large integers; sums over tasks go through Spark as digits of 32 bits.
The covariance, sum(y y')/n^3, is rounded once, and its eigenvectors are found from that on
the driver (a matrix of the dimensions, however many vectors there are), with one step of
refinement in extended precision.

Defined cases: a vector that is null or holds a null, NaN or infinite entry is dropped; a
vector shorter than the longest counts as continued with entries 0 (x = 1000000); floor(64 c)
is held within 2^62; a null vec_id is kept; repeated rows count each time; an empty table, or
one of empty vectors, gives no rows. A component without variance (one vector, equal vectors)
has whitened 0, and identity_error is 1 then; explained is 0 if no component has any.
deviation is null beyond 2^63. Components beyond the dimensions don't exist.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import table

COMPONENTS = 32
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 62
LIMB, CHUNK = 20, 2048
#: Up to so many dimensions the eigenvectors are refined.
REFINED = 1024


def _matrix(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Integers x of the vectors that count, continued to dims entries, and their rows."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    rows = np.flatnonzero((bad[starts + sizes] == bad[starts]) & lists.is_valid().to_numpy(zero_copy_only=False))
    sizes = sizes[rows]
    x = np.full((len(rows), dims), SHIFT, np.int64)
    cell = np.repeat(np.arange(len(rows)), sizes)
    column = np.arange(len(cell)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    entry = np.floor(np.clip(values[np.repeat(starts[rows], sizes) + column] * SCALE, -float(MOST), float(MOST)))
    x[cell, column] = entry.astype(np.int64) + SHIFT
    return x, rows


def _digits(value: int, count: int) -> list[int]:
    """Digits of 32 bits, the lowest first; the last has the sign."""
    out = [(value >> (32 * k)) & 0xFFFFFFFF for k in range(count - 1)]
    return [*out, value >> (32 * (count - 1))]


def _whole(digits) -> int:
    return sum(int(d) << (32 * k) for k, d in enumerate(digits))


def _sums(batches):
    """(dim, low, high, n, most): sums of x of each dimension; at dim -1 the vectors, and the largest size of an entry."""
    held: dict[int, list[int]] = {}
    n, most = 0, 0
    for b in batches:
        lists = b.column("embedding")
        longest = pc.max(pc.list_value_length(lists)).as_py() or 0
        x, rows = _matrix(lists, longest)
        n += len(rows)
        if not x.size:
            continue
        most = max(most, int(x.max()), -int(x.min()))
        low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
        for j in range(longest):
            own = held.setdefault(j, [0, 0])
            own[0] += _whole((low[j], high[j]))
            own[1] += len(rows)
    rows = [(-1, 0, 0, n, most), *((j, *_digits(s, 2), c, most) for j, (s, c) in held.items())]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["dim", "low", "high", "n", "most"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S: of longs where they hold it, else of Python integers."""
    around = np.array([s // n for s in sums], object)
    rest = [s - n * int(m) for s, m in zip(sums, around)]
    size = max((abs(int(a) - int(m)) for part in (x.max(0, initial=0), x.min(0, initial=0)) for a, m in zip(part, around)), default=0)
    if (size + 1) * n < 1 << 62:
        return (x - around.astype(np.int64)) * n - np.array(rest, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as signed limbs of LIMB bits, float64, the lowest first: sum of limb k times 2^(LIMB k)."""
    half, out = 1 << (LIMB - 1), []
    while y.any():
        low = ((y + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
    return out


def products(n: int, sums: list[int], count: int):
    """A function of batches giving the upper half of sum(y y') as (i, j, digits)."""

    def run(batches):
        dims = len(sums)
        whole = np.zeros((dims, dims), object)
        by_weight: dict[int, np.ndarray] = {}
        done = 0

        def fold():
            nonlocal whole
            for k, part in by_weight.items():
                whole = whole + part.astype(object) * (1 << (LIMB * k))
            by_weight.clear()

        for b in batches:
            x, _ = _matrix(b.column("embedding"), dims)
            for i in range(0, len(x), CHUNK):
                parts = limbs(centred(x[i : i + CHUNK], n, sums))
                for a, left in enumerate(parts):
                    for c in range(a, len(parts)):
                        part = (left.T @ parts[c]).astype(np.int64)
                        part = part if a == c else part + part.T
                        by_weight[a + c] = by_weight[a + c] + part if a + c in by_weight else part
                done += 1
                if done % 512 == 0:
                    fold()
        fold()
        for i in range(dims):
            rows = [_digits(int(v), count) for v in whole[i, i:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(rows), pa.int32()), pa.array(range(i, dims), pa.int32()), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["i", "j", *(f"d{k}" for k in range(count))]
            )

    return run


@dataclass
class Fit:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance, falling
    vectors: np.ndarray  # unit eigenvectors in columns, in that order
    trace: float

    def scaled(self, components: int) -> np.ndarray:
        """What x - S/n is multiplied by: eigenvectors over the roots of their eigenvalues, zero where there is no variance."""
        e = self.values[:components]
        real = e > len(self.sums) * np.finfo(float).eps * self.trace * 1e-3
        return self.vectors[:, :components] * np.where(real, 1 / np.sqrt(np.where(real, e, 1.0)), 0.0)


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix (of extended precision)."""
    _, v = np.linalg.eigh(cov.astype(np.float64))
    v = v[:, ::-1]
    if len(cov) <= REFINED:
        x = v.astype(np.longdouble)
        off = np.eye(len(cov)) - x.T @ x
        s = x.T @ cov @ x
        e = np.diag(s) / (1 - np.diag(off))
        gap = e[None, :] - e[:, None]
        close = np.abs(gap) <= 1e-15 * np.abs(e).max(initial=0)
        x = x + x @ np.where(close, off / 2, (s + e[None, :] * off) / np.where(close, 1, gap))
        x = x / np.sqrt((x * x).sum(0))
    else:
        x = v
    e = ((cov @ x) * x).sum(0).astype(np.float64)
    order = np.argsort(-e, kind="stable")
    return e[order], x[:, order].astype(np.float64)


def _ratio(value: int, by: int) -> np.longdouble:
    """value / by in extended precision."""
    first = value / by
    num, den = first.as_integer_ratio()
    return np.longdouble(first) + np.longdouble((value * den - num * by) / (by * den))


def fit(vectors: DataFrame) -> Fit | None:
    """n, S and the eigenvectors of the covariance of all vectors of the column embedding; None if there are none."""
    lists = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"))
    found = lists.mapInArrow(_sums, "dim long, low long, high long, n long, most long").groupBy("dim").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("n").alias("n"), F.max("most").alias("most"))
    rows = {r["dim"]: r for r in found.collect()}  # one a dimension
    n = rows.pop(-1)["n"] if rows else 0
    if not n or not rows:
        return None
    sums = [_whole((r["low"], r["high"])) + (n - r["n"]) * SHIFT for _, r in sorted(rows.items())]
    bits = 2 * (2 * n * (max(r["most"] for r in rows.values()) + SHIFT)).bit_length() + n.bit_length()
    count = bits // 32 + 1
    digits = [f"d{k}" for k in range(count)]
    made = lists.mapInArrow(products(n, sums, count), ", ".join(["i int", "j int", *(f"{d} long" for d in digits)]))
    total = made.groupBy("i", "j").agg(*(F.sum(d).alias(d) for d in digits)).collect()  # dims^2 / 2
    cov, trace = np.zeros((len(sums), len(sums)), np.longdouble), 0
    for r in total:
        value = _whole(r[d] for d in digits)
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = _ratio(value, n**3)
        trace += value if r["i"] == r["j"] else 0
    e, v = eigen(cov)
    return Fit(n, sums, e, v, trace / n**3)


def _squares(y: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows; None where a long doesn't hold it."""
    if y.dtype != object:
        most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
        if most * most * max(1, y.shape[1]) < 1 << 63:
            return (y * y).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in y)]


def _projected(lists: pa.Array, f: Fit, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, rows = _matrix(lists, len(f.sums))
    y = centred(x, f.n, f.sums) if len(x) else x
    return y, rows, (y.astype(np.float64) / f.n) @ scaled


def identity_error(vectors: DataFrame, f: Fit, components: int = COMPONENTS) -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity, over all of them."""
    scaled = f.scaled(components)
    k = scaled.shape[1]

    def run(batches):
        total, products_ = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = _projected(b.column("embedding"), f, scaled)[2]
            total += w.sum(0)
            products_ += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        at = [pa.array(np.concatenate([c, more]).astype(np.int32)) for c, more in ((i, np.arange(k)), (j, np.full(k, -1)))]
        yield pa.RecordBatch.from_arrays([*at, pa.array(np.concatenate([products_.ravel(), total]))], names=["i", "j", "s"])

    lists = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"))
    rows = lists.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg((F.sum("s") / f.n).alias("s")).collect()
    cov, mean = np.zeros((k, k)), np.zeros(k)
    for r in rows:
        if r["j"] < 0:
            mean[r["i"]] = r["s"]
        else:
            cov[r["i"], r["j"]] = r["s"]
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector that counts."""
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = f"vec_id {own.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    f = fit(vectors)
    if f is None:
        return own.sparkSession.createDataFrame([], schema)
    scaled, error = f.scaled(components), identity_error(vectors, f, components)
    k = scaled.shape[1]
    explained = f.values[:k] / f.trace if f.trace else np.zeros(k)

    def run(batches):
        for b in batches:
            y, rows, w = _projected(b.column("embedding"), f, scaled)
            m = len(rows)
            if m:
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("vec_id").take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n)),
                        pa.array(_squares(y), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return own.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
