"""Nearest neighbours in many dimensions against all pairs."""

import numpy as np
import pytest

from plumbline.operators import metric


def brute(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return d.min(axis=1)


@pytest.mark.parametrize("most", [4096, 17])
def test_nearest_neighbours_equal_all_pairs(spark, most):
    rng = np.random.default_rng(8)
    #: Clusters, a crowd of equal points, a line and some far ones.
    x = np.vstack([rng.normal(size=(120, 9)), rng.normal(size=(150, 9)) * 0.01 + 3, np.tile(rng.normal(size=9), (60, 1)), np.arange(40)[:, None] * np.ones(9), 1e3 * rng.normal(size=(10, 9))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(4)
    got = metric.nearest_neighbours(rows, "k", most).collect()
    assert len(got) == len(x)
    expected = brute(x)
    assert all(np.isclose(r.distance, expected[r.k], rtol=1e-12, atol=0) for r in got)
    if most == 17:
        assert sum(r.compared for r in got) < 0.6 * len(x) ** 2


def test_normalised_columns(spark):
    rows = spark.createDataFrame([(1, 0.0, 5.0), (2, 10.0, 5.0), (3, 1.0, 5.0)], "k int, a double, b double")
    got = {r.k: (r.distance, r.separated) for r in metric.separated(rows, "k", ["a", "b"]).collect()}
    assert got == {1: (0.1, False), 2: (0.9, True), 3: (0.1, False)}


def test_few_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "k int, v array<double>")
    assert [(r.k, r.distance) for r in metric.nearest_neighbours(rows, "k").collect()] == [(1, None)]
    assert metric.nearest_neighbours(rows.limit(0), "k").count() == 0
    assert metric.separated(spark.createDataFrame([], "k int, a double"), "k", ["a"]).count() == 0
