"""Whitening against numpy's own eigenvectors and exact Python sums."""

import math
import random

import numpy as np
import pytest
from llm_cases import with_clashes, workers  # noqa: F401  (workers: a fixture)

from vsframe.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def numbers(vectors):
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], object)


def check(got, rows, most=8):
    """Every column of the result against plain Python and numpy."""
    x = numbers([v for _, v in rows])
    n, d = x.shape
    sums = x.sum(0)
    far = n * x - sums
    exact = far.T @ far  # n^3 times the covariance
    values, vectors = np.linalg.eigh((exact / n**3).astype(float))
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    k = int((values > 1e-9 * values[0]).sum())
    assert len(got) == n * k
    by = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert math.isclose(r.explained, values[r.component - 1] / (int(exact.trace()) / n**3), rel_tol=1e-9)
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    want = far.astype(float) / n @ vectors[:, :k] / np.sqrt(values[:k])
    sign = np.zeros(k)
    for (i, _), row, w in zip(rows, far, want):
        found = by[i, int((row * row).sum())]
        for c in range(k):
            value = found[c + 1][0]
            if not sign[c] and abs(w[c]) > 1e-3:
                sign[c] = np.sign(value * w[c])
            assert abs(value - sign[c] * w[c]) < 1e-6


def test_whitening(spark):
    rnd = np.random.default_rng(3)
    mixed = rnd.normal(size=(300, 12)) @ rnd.normal(size=(12, 12)) * 0.1 + rnd.normal(size=12)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]
    rows += [rows[7], rows[7], (900, rows[9][1]), (None, rows[11][1])]
    bad = [(901, None), (902, [0.5, None] * 6), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, []), (906, [1.0] * 5)]
    got = wh.whiten_embeddings(with_clashes(spark.createDataFrame(rows + bad, SCHEMA)).repartition(7))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), rows)


def test_low_rank_and_narrow(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(50):
        a, b = rnd.randrange(-4000, 4000), rnd.randrange(-9000, 9000)
        rows.append((i, [a / 1024, b / 1024, (a + b) / 1024, 7.0, -a / 1024]))
    check(wh.whiten_embeddings(spark.createDataFrame(rows, SCHEMA)).collect(), rows)
    one = [(i, [float(i * i)]) for i in range(9)]
    check(wh.whiten_embeddings(spark.createDataFrame(one, SCHEMA)).collect(), one)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(i, [0.25, 8.0]) for i in range(9)], [(1, None), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    assert wh.whiten_embeddings(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_large_entries(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rnd.normal(size=(40, 4)) * 1e12)]
    got = wh.whiten_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 160 and all(r.deviation is None and r.identity_error < 1e-9 for r in got)
    with pytest.raises(Exception, match="beyond"):
        wh.whiten_embeddings(spark.createDataFrame([(1, [1e30, 0.0])], SCHEMA)).collect()


def test_decomposition():
    rnd = np.random.default_rng(8)
    for d, r in ((1, 1), (2, 2), (9, 9), (30, 30), (30, 11), (41, 41)):
        half = rnd.normal(size=(d, r)) * 10.0 ** rnd.integers(-3, 4, r)
        v = half @ half.T
        factor, order = wh.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v[np.ix_(order, order)], rtol=0, atol=1e-12 * v.max())
        assert np.allclose(factor, np.tril(factor))
        values, vectors = wh.decompose(v)
        want = np.linalg.eigvalsh(v)[::-1][: len(values)]
        assert np.allclose(values, want, rtol=1e-9, atol=1e-13 * want[0])
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-10)
        assert np.allclose(v @ vectors.T, vectors.T * values, atol=1e-11 * want[0])
    assert len(wh.decompose(np.zeros((3, 3)))[0]) == 0


def test_exact_products():
    rnd = np.random.default_rng(1)
    for most in (5, 10**6, 1 << 25, 1 << 40):
        y = rnd.integers(-most, most, (50, 3))
        wide = y.astype(object)
        assert (wh._gram(y) == wide.T @ wide).all()
        assert (wh._exact(y, most) == wide.sum(0)).all()
