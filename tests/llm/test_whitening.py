"""Whitening against exact arithmetic of fractions and an eigendecomposition of its own."""

from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
import pytest

from papyra.llm import whitening as W

KIND = "vec_id long, embedding array<float>, label int, n long, component string"


def exact(rows):
    """n, sums and covariance of the vectors as fractions, from the definition."""
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in good), default=0)
    xs = [(i, [floor(64 * c) + 1000000 for c in v + [0.0] * (dims - len(v))]) for i, v in good]
    n = len(xs)
    sums = [sum(x[j] for _, x in xs) for j in range(dims)]
    dev = [(i, [Fraction(n * a - s, n) for a, s in zip(x, sums)]) for i, x in xs]
    cov = [[sum(d[i] * d[j] for _, d in dev) / n for j in range(dims)] for i in range(dims)]
    return n, dev, cov


def check(rows, got, components=32, tolerance=1e-9):
    n, dev, cov = exact(rows)
    v = np.array([[float(c) for c in r] for r in cov])
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    k = min(components, len(e))
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    # the same values however the rows are ordered: every row's squares are the squares of its projections
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    trace = float(sum(cov[i][i] for i in range(len(cov))))
    order = lambda r: (r["vec_id"], r["deviation"])
    w = np.array([[r["whitened"] for r in sorted(by[c], key=order)] for c in range(1, k + 1)]).T
    d = sorted(((i, int(sum((n * x) ** 2 for x in y)), y) for i, y in dev), key=lambda t: t[:2])
    assert [(i, s) for i, s, _ in d] == [order(r) for r in sorted(by[1], key=order)]
    y = np.array([[float(x) for x in row] for _, _, row in d])
    assert np.allclose([by[c][0]["explained"] for c in range(1, k + 1)], e[:k] / trace, rtol=1e-8)
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-4 and got[0]["identity_error"] < 1e-4
    # rows are projections on unit eigenvectors, the same for all rows
    axes = np.linalg.lstsq(y, w, rcond=None)[0] * np.sqrt(e[:k])
    assert np.allclose((axes * axes).sum(0), 1, atol=1e-6) and np.allclose(v @ axes, axes * e[:k], atol=1e-6 * e[0])
    assert np.allclose(y @ axes / np.sqrt(e[:k]), w, atol=1e-6)


def test_matches_exact_arithmetic(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(90, 6)) * [5, 3, 1, 1, 0.5, 40]
    rows = [(i, base[i].tolist()) for i in range(80)] + [(i, base[0].tolist()) for i in (200, 201, 201)]
    rows += [(300, None), (301, [None] * 6), (302, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (303, [float("inf")] + [0.0] * 5), (304, [0.5, 1.5]), (305, [])]
    df = spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows], KIND).repartition(3)
    check(rows, W.whiten(df).collect())
    assert {r["component"] for r in W.whiten(df, 2).collect()} == {1, 2}


def test_close_and_tiny_eigenvalues(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 5)).astype(np.float32)
    base[:, 1] = base[:, 0] + rng.integers(-1, 2, 400).astype(np.float32) / 64  # nearly the same direction
    base[:, 0] *= 2000
    base[:, 1] = base[:, 0] + rng.integers(-1, 2, 400).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(base.tolist())]
    got = W.whiten(spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows], KIND)).collect()
    assert len(got) == 2000 and got[0]["identity_error"] < 1e-6


def test_limb_products_are_exact():
    rng = np.random.default_rng(5)
    for top in (3, 1 << 25, 1 << 61):
        y = rng.integers(-top, top, (50, 4))
        parts = W.limbs(y)
        assert (sum(np.vectorize(int, otypes=[object])(p) * (1 << (W.LIMB * k)) for k, p in enumerate(parts)) == y.astype(object)).all()
        x = rng.integers(-(1 << 30), 1 << 30, (50, 4))
        sums = [int(s) for s in x.astype(object).sum(0)]
        lists = pa.RecordBatch.from_arrays([pa.array(((x - W.SHIFT) / 64).tolist())], names=["embedding"])
        want = (x.astype(object) * 50 - np.array(sums, object))
        want = want.T @ want
        for b in W.products(50, sums, 6)(iter([lists, lists.slice(0, 0)])):
            for r in b.to_pylist():
                assert W._whole(r[f"d{k}"] for k in range(6)) == want[r["i"], r["j"]]


def test_huge_entries_and_no_variance(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows], KIND)
    huge = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0]), (None, [1.0, 5.0])]
    got = W.whiten(frame(huge)).collect()
    assert len(got) == 8 and all(np.isfinite(r["whitened"]) for r in got) and any(r["deviation"] is None for r in got)
    same = W.whiten(frame([(1, [0.25, 0.5]), (2, [0.25, 0.5])])).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(0, 0.0, 0.0, 1.0)] * 4


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, []), (2, [])]])
def test_query_without_vectors(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows], KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = W.query(spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(120).collect()]
    check(rows, W.whiten(spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows], KIND)).collect())
