"""Eigenpairs against numpy, with equal and nearly equal eigenvalues."""

import numpy as np

from plumbline.functions.eigen import with_eigenpairs

NAMES = ["m11", "m12", "m13", "m22", "m23", "m33"]


def test_eigenpairs_equal_numpy(spark):
    rng = np.random.default_rng(7)
    given = [rng.normal(size=(3, 3)) for _ in range(150)] + [np.diag(d) for d in ([0, 0, 0], [1, 1, 1], [2, 2, 1], [1, 3, 1], [0, 0, 5], [-4, 2, 2])]
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    given += [turn @ np.diag(d) @ turn.T for d in ([1, 1, 0], [1, 0, 0], [1, 1 - 1e-9, 0], [1, 1e-9, 0], [1e-12, 0, 0], [3e8, 3e8, 1])]
    matrices = [(a + a.T) / 2 for a in given]
    rows = [(k, *(float(a[i, j]) for i in range(3) for j in range(i, 3))) for k, a in enumerate(matrices)]
    got = with_eigenpairs(spark.createDataFrame(rows, ["k", *NAMES]).repartition(2), NAMES, "e").collect()
    assert len(got) == len(matrices)
    for r in got:
        a = matrices[r.k]
        size = max(np.abs(a).max(), 1e-300)
        values = np.array([r.e1, r.e2, r.e3])
        vectors = np.array([[r[f"e{x}{n}"] for x in "xyz"] for n in (1, 2, 3)])
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=3e-8 * size), a
        assert np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-7), a
        assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-7 * size, a
        assert all(v[np.abs(v).argmax()] > 0 for v in vectors)


def test_nulls_stay(spark):
    rows = spark.createDataFrame([(None, 0.0, 0.0, 1.0, 0.0, 1.0)], "m11 double, m12 double, m13 double, m22 double, m23 double, m33 double")
    (r,) = with_eigenpairs(rows, NAMES, "e").collect()
    assert r.e1 is None and r.ex1 is None and r.m22 == 1.0
