import math

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string, whitened string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in vectors], SCHEMA).repartition(3)


def brute(vectors):
    """From exact integers: n, deviations, eigenvalues and vectors of numpy."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    y = n * x - sums
    v = np.array([[int((y[:, i] * y[:, j]).sum()) / n**3 for j in range(x.shape[1])] for i in range(x.shape[1])])
    values, basis = np.linalg.eigh(v)
    return n, (y**2).sum(axis=1), values[::-1], basis[:, ::-1], (y / n).astype(float), v


def check(spark, vectors, good, components=32):
    rows = whitening.whiten(frame(spark, vectors), components).collect()
    n, deviations, values, basis, y, v = brute(good)
    k = min(components, int((values > len(values) * 2.3e-16 * values[0]).sum()))
    assert len(rows) == n * k
    got = np.zeros((n, k))
    at = {i: r for r, (i, _) in enumerate(good)}
    for r in rows:
        got[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and int(r["deviation"]) == deviations[at[r["vec_id"]]]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-6)
        assert r["identity_error"] < 1e-6
    want = y @ basis[:, :k] / np.sqrt(values[:k])
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * signs, atol=1e-6)
    assert np.allclose(got.T @ got / n, np.eye(k), atol=1e-6)


def test_matches_numpy_and_drops_bad_vectors(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(9, 9)) * 3.0 ** -np.arange(9)
    good = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 9)) @ mix * 50)]
    bad = [(900, None), (901, [None] + [1.0] * 8), (902, [float("nan")] * 9), (903, [float("inf")] + [0.0] * 8), (904, []), (905, [1.0, 2.0]), (906, [1e300] + [0.0] * 8)]
    check(spark, good + bad, good)
    check(spark, good + bad, good, components=4)


def test_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(3)
    base = np.round(rng.normal(size=(120, 4)) * 640) / 64
    full = np.c_[base, base[:, 0] + base[:, 1], np.full(120, 3.0)]
    rows = [(i, v.tolist()) for i, v in enumerate(full)]
    check(spark, rows, rows)


def test_large_entries_have_exact_deviations(spark):
    rows = [(i, [float(2**33 + i), float(-(2**35) * (i % 3)), 0.5 * i]) for i in range(50)]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(frame(spark, rows)).collect()}
    assert got == {i: d for (i, _), d in zip(rows, brute(rows)[1])}


def test_degenerate_tables(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    repeated = whitening.whiten(frame(spark, [(None, [0.0]), (1, [2.0]), (1, [2.0]), (None, [0.0])])).collect()
    assert sorted(abs(r["whitened"]) for r in repeated) == pytest.approx([1.0] * 4)


def test_jacobi_is_accurate_for_small_eigenvalues():
    """A graded matrix, whose smallest eigenvalue is known from its inverse, which is exact in integers."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        q, _ = np.linalg.qr(rng.normal(size=(n, n)))
        values = 10.0 ** -np.linspace(0, 4, n)
        matrix = q @ np.diag(values) @ q.T
        found, vectors = whitening.jacobi((matrix + matrix.T) / 2)
        assert np.allclose(found, values, rtol=1e-10)
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13)
    scales = 10.0 ** -np.arange(0, 12, 2)
    core = np.eye(6) + 0.1
    graded = core * scales[:, None] * scales
    found, _ = whitening.jacobi(graded)
    assert np.prod(found) == pytest.approx(np.linalg.det(core) * np.prod(scales**2), rel=1e-9)
    assert 0 < found[-1] < scales[-1] ** 2 * 1.2
