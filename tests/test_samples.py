"""Random columns, exact samples, stencils and packed tensors against plain Python."""

import hashlib
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.functions import samples as R
from plumbline.functions import tensors as T
from plumbline.operators import sampling, stencils


def test_uniform_numbers_depend_on_seed_key_and_draw_only(spark):
    rows = spark.range(300).withColumn("u", R.uniform(5, "a", F.col("id")))
    got = {r.id: r.u for r in rows.collect()}
    assert got == {r.id: r.u for r in spark.range(300).repartition(7).withColumn("u", R.uniform(5, "a", F.col("id"))).collect()}
    assert all(got[i] == (int(hashlib.md5(f"5:a:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in got)
    others = [spark.range(300).select(R.uniform(s, d, F.col("id")).alias("u")).collect() for s, d in ((6, "a"), (5, "b"))]
    assert all(not {r.u for r in o} & set(got.values()) for o in others) and abs(np.mean(list(got.values())) - 0.5) < 0.06


def test_normal_quantiles(spark):
    us = [1e-15, 1e-12, 1e-6, 0.001, 0.02425, 0.075, 0.0750001, 0.3, 0.5, 0.6, 0.925, 0.9250001, 0.99, 1 - 1e-6, 1 - 1e-12]
    got = [r.z for r in spark.createDataFrame([(i, u) for i, u in enumerate(us)], "i int, u double").select("i", R.normal_quantile(F.col("u")).alias("z")).orderBy("i").collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(u) for u in us], rtol=1e-12, atol=1e-15)


def test_truncated_normals_stay_inside(spark):
    rows = spark.range(4000).withColumn("x", R.truncated_normal(R.uniform(1, "x", F.col("id")), 2.0, 1.5, 1.0, 4.0))
    x = np.array([r.x for r in rows.collect()])
    whole = NormalDist(2.0, 1.5)
    assert x.min() >= 1.0 and x.max() <= 4.0
    for at in (1.5, 2.0, 3.0):
        share = (whole.cdf(at) - whole.cdf(1.0)) / (whole.cdf(4.0) - whole.cdf(1.0))
        assert abs((x < at).mean() - share) < 0.03


def test_seeds_differ(spark):
    got = [r.s for r in spark.range(50).select(R.derived_seeds(3, F.col("id"), 20).alias("s")).collect()]
    assert all(len(set(s)) == 20 and min(s) >= 0 and max(s) < 2**32 for s in got) and len({tuple(s) for s in got}) == 50


def test_noise_is_symmetric_and_of_its_share(spark):
    rng = np.random.default_rng(3)
    given = [rng.normal(size=36).tolist() for _ in range(5)] + [[0.0] * 36]
    rows = spark.createDataFrame(list(enumerate(given)), "id int, c array<double>")
    for r in rows.select("c", R.noise(F.col("c"), 0.005, 1, F.col("id")).alias("n"), R.with_noise(F.col("c"), 0.005, 1, F.col("id")).alias("both")).collect():
        n = np.array(r.n).reshape(6, 6)
        assert (n == n.T).all() and np.isclose(np.linalg.norm(n), 0.005 * np.linalg.norm(r.c)) and np.allclose(np.array(r.both) - r.c, r.n, atol=1e-15)


def test_packed_tensors(spark):
    rng = np.random.default_rng(4)
    c = rng.normal(size=(6, 6))
    even, x = (c + c.T) / 2, rng.normal(size=6)
    row = spark.createDataFrame([(c.ravel().tolist(), even.ravel().tolist(), x.tolist())], "c array<double>, e array<double>, x array<double>")
    (r,) = row.select(T.weighted_vector(F.col("c")).alias("w"), T.packed(F.col("e")).alias("p"), T.unpacked(T.packed(F.col("e"))).alias("u"), T.packed_product(T.packed(F.col("e")), F.col("x")).alias("y")).collect()
    assert np.isclose(np.linalg.norm(r.w), np.linalg.norm(even)) and np.allclose(r.w[:6], np.diag(even)) and np.isclose(r.w[6], 2**0.5 * even[0, 1])
    assert np.allclose(r.p, even[np.triu_indices(6)]) and np.allclose(r.u, even.ravel()) and np.allclose(r.y, even @ x)


@pytest.mark.parametrize("wanted", [0, 1, 7, 500, 999, 1000, 5000])
def test_samples_have_their_size(spark, wanted):
    rows = spark.range(1000).withColumnRenamed("id", "k").repartition(5)
    got = [r.k for r in sampling.exact_sample(rows, "k", wanted, 2, "scale").collect()]
    assert len(got) == len(set(got)) == min(wanted, 1000)
    more = {r.k for r in sampling.exact_sample(rows, "k", wanted + 100, 2).collect()}
    assert set(got) <= more
    if wanted == 500:
        assert {r.scale for r in sampling.exact_sample(rows, "k", 500, 2, "scale").collect()} == {2**0.5}
        assert set(got) != {r.k for r in sampling.exact_sample(rows, "k", 500, 3).collect()} and abs(np.mean(got) - 500) < 60


def test_samples_with_ties_nulls_and_clashing_names(spark):
    rows = spark.createDataFrame([(None if i % 3 else i // 300, i, i, i) for i in range(900)], "k long, h long, part long, row long").repartition(4)
    for wanted in (1, 250, 599, 600, 601, 899):
        got = [r.part for r in sampling.exact_sample(rows, "k", wanted).collect()]
        assert len(got) == len(set(got)) == wanted
    assert sampling.exact_sample(rows.limit(0), "k", 3, scale="s").count() == 0
    with pytest.raises(ValueError):
        sampling.exact_sample(rows, "k", -1)


BOUNDS = {"x": (0.0, 10.0), "y": (1.0, 3.0)}


def slopes(spark, rows, scheme, bounds=BOUNDS, rel=1e-3):
    points = stencils.stencils(spark.createDataFrame(rows, "k int, x double, y double"), ["x", "y"], rel, bounds, scheme)
    results = points.withColumn("f", F.col("x") * F.col("x") * F.col("y") + F.exp("y"))
    return {(r.k, r.name): r for r in stencils.differences(results, ["k", "name", "direction", "step"], ["f"]).collect()}, points


def test_derivatives_of_second_order_at_the_edges(spark):
    rows = [(0, 5.0, 2.0), (1, 0.0, 1.0), (2, 10.0, 3.0), (3, 0.0001, 2.9999)]
    found, points = slopes(spark, rows, "edge-auto")
    assert {k: r.direction for k, r in found.items()} == {(0, "x"): "centered", (0, "y"): "centered", (1, "x"): "forward", (1, "y"): "forward", (2, "x"): "backward", (2, "y"): "backward", (3, "x"): "forward", (3, "y"): "backward"}
    for k, x, y in rows:
        assert abs(found[k, "x"].f - 2 * x * y) < 1e-5 and abs(found[k, "y"].f - (x * x + np.exp(y))) < 1e-3
    assert all(BOUNDS[n][0] <= r[n] <= BOUNDS[n][1] for r in points.collect() for n in BOUNDS)
    central, points = slopes(spark, rows[:1] + rows[3:], "central")
    assert {r.direction for r in central.values()} == {"centered"} and np.isclose(central[3, "x"].step, 0.45 * 0.0001) and np.isclose(central[0, "x"].step, 0.005)
    free, _ = slopes(spark, rows, "central", None)
    assert all(np.isclose(r.step, 1e-3 * max(abs(rows[k][1 if n == "x" else 2]), 1)) for (k, n), r in free.items())
    with pytest.raises(ValueError):
        slopes(spark, rows, "sideways")
    with pytest.raises(PySparkException, match="no room to move x"):
        slopes(spark, rows, "edge-auto", {"x": (5.0, 5.0), "y": (1.0, 3.0)})[0]


def test_error_table(spark):
    a = spark.createDataFrame([(1, "p", 3.0, 4.0), (1, "q", 1.0, 0.0), (2, "p", 1.0, 1.0)], "k int, name string, s double, t double")
    b = spark.createDataFrame([(1, "p", 3.0, 3.0), (1, "q", 0.0, 0.0)], "k int, name string, s double, t double")
    got = {r.name: r for r in stencils.error_table(a, b, ["k", "name"], ["s", "t"]).collect()}
    assert (got["p"].norm, got["p"].reference_norm, got["p"].absolute_error, got["p"].relative_error) == (5.0, 18**0.5, 1.0, 1 / 18**0.5)
    assert got["q"].relative_error > 1e15 and len(got) == 2
