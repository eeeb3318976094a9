"""Whitening against numpy's eigenvalues and exact whole numbers, and its cases."""

import math

import numpy as np
import pytest

from trawlwork.llm.whitening import leading_components, negative_pivots, products, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string, i long"


def table(spark, rows):
    return spark.createDataFrame([(k, v, 1, "c", "n", 5) for k, v in rows], SCHEMA)


def random_rows(n=200, d=12, seed=1):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(0, 0.2, (n, d)) @ rng.normal(0, 1, (d, d))
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(mixed)]


def check(out, rows, k):
    """Against plain Python sums and numpy's own eigenvalues."""
    fit = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows]
    x = np.array([v for _, v in fit], dtype=object)
    n, s = len(x), x.sum(axis=0)
    v = np.array((x - s / n), dtype=float)
    values, vectors = np.linalg.eigh(v.T @ v / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    assert len(out) == n * k and {r.n for r in out} == {n}
    deviation = {(i, int(((n * row - s) ** 2).sum())) for (i, _), row in zip(fit, x, strict=True)}
    assert {(r.vec_id, r.deviation) for r in out} == deviation
    for c in range(k):
        own = [r for r in out if r.component == c + 1]
        assert own[0].explained == pytest.approx(values[c] / np.trace(v.T @ v / n), rel=1e-9)
        got = {-1 if r.vec_id is None else r.vec_id: r.whitened for r in own}
        want = dict(zip([-1 if i is None else i for i, _ in fit], v @ vectors[:, c] / values[c] ** 0.5, strict=True))
        assert got.keys() == want.keys()
        got, want = (np.array([y[i] for i in want]) for y in (got, want))
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
    assert {r.identity_error for r in out}.pop() < 1e-9


def test_whiten_equals_numpy(spark):
    rows = random_rows()
    bad = [(900, None), (901, [float("nan")] + [0.0] * 11), (902, [float("inf")] * 12), (903, [None] + [0.1] * 11)]
    check(whiten(table(spark, rows + bad).repartition(5)).collect(), rows, 8)
    rows = random_rows(60, 3, 2)
    rows.append((None, rows[0][1]))
    check(whiten(table(spark, rows)).collect(), rows, 3)


def test_whiten_cases(spark):
    assert whiten(table(spark, [])).count() == 0
    assert whiten(table(spark, [(1, None)])).count() == 0
    assert whiten(table(spark, [(1, [0.5, 0.1])] * 3)).count() == 0  # no variance, no component
    assert whiten(table(spark, [(1, [0.5, 0.1]), (2, [])])).count() == 2  # one direction, the short vector ends in zeros
    assert whiten(table(spark, [(1, []), (2, [])])).count() == 0
    few = random_rows(5, 12, 3)
    out = whiten(table(spark, few)).collect()
    assert {r.component for r in out} == {1, 2, 3, 4}
    wide = whiten(table(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 1.0])])).collect()
    assert {r.deviation for r in wide if r.vec_id == 1} == {None} and {r.n for r in wide} == {3}


def test_inertia_and_clusters():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 8, 30):
        for _ in range(20):
            a = rng.integers(-3, 4, (n, n)).astype(float)
            a = a + a.T + 1e-3 * np.diag(rng.normal(size=n))
            assert negative_pivots(a) == (np.linalg.eigvalsh(a) < 0).sum()
    assert negative_pivots(np.zeros((3, 3))) == 0
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    for spectrum in ([5, 5, 5, 1] + [0.5] * 16, [3, 3 - 1e-9, 1] + [1e-3] * 17, [1e6] + [1.0] * 19, [2, 1] + [0] * 18):
        a = q @ np.diag(np.array(spectrum, dtype=float)) @ q.T
        values, vectors = leading_components((a + a.T) / 2, 8)
        k = min(8, sum(s > 0 for s in spectrum))
        assert len(values) == k and np.allclose(values, spectrum[:k], rtol=1e-9)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-9
        assert np.abs(a @ vectors - vectors * values).max() < 1e-8 * spectrum[0]


def test_products_are_exact():
    y = np.array([[1 << 40, -3], [5, 1 << 30]], dtype=np.int64)
    assert products(y)[0, 0] == (1 << 80) + 25 and products(y)[0, 1] == -3 * (1 << 40) + 5 * (1 << 30)
    assert products(y % 1000).tolist() == ((y % 1000).T @ (y % 1000)).tolist()
