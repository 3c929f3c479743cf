"""Operators against plain Python on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.jobs import fields, reduced_model
from plumbline.operators import campaign, linalg, ordered, quantiles, relational, spatial, statistics
from plumbline.sources.scratch import materialize, scratch_root
from plumbline.streaming import online


def test_running_before(spark):
    values = [(i * 37 % 101, i % 5) for i in range(101)]
    rows = spark.createDataFrame(values, "k long, v long").repartition(4)
    got = {r.k: (r.before, r.n) for r in ordered.running_before(rows, ["k"], {"before": F.col("v"), "n": F.lit(1).cast("long")}, "t").collect()}
    assert got == {k: (sum(v for other, v in values if other < k), k) for k, _ in values}
    assert ordered.running_before(rows.limit(0), ["k"], {"n": F.lit(1).cast("long")}, "t").count() == 0


def test_scratch_is_in_the_shared_folder(spark):
    assert scratch_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    df = spark.range(5).filter("id > 1")
    assert materialize(df, "t").dtypes == df.dtypes and materialize(df, "t").count() == 3


def test_completed_from(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, 5, None), (3, None, None)], "k int, x int, y string")
    design = spark.createDataFrame([(1, 9, "z1"), (2, 8, "z2")], "k int, x int, z string")
    got = relational.completed_from(rows, design, ["k"])
    assert got.columns == ["k", "x", "z", "y"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, 9, "z1", "a"), (2, 5, "z2", None), (3, None, None, None)]
    with pytest.raises(ValueError):
        relational.completed_from(rows.unionByName(rows), design, ["k"])


def test_missing_lookups_fail(spark):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError):
        relational.in_order_of(rows, "k", spark.createDataFrame([(0, 2)], "pos int, k int"), "pos")


def test_ties_are_decided(spark):
    rows = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 1.0), ("b", 3, None)], "g string, k int, e double")
    assert sorted((r.g, r.k) for r in relational.least_of_group(rows, ["g"], [F.col("e"), F.col("k")]).collect()) == [("a", 1), ("b", 3)]


def test_constant_columns_have_no_correlation(spark):
    rows = spark.createDataFrame([(1, 1.0, float(i), i % 3 - 1.0 if i else None) for i in range(6)], "g int, c double, x double, y double")
    (flat,) = statistics.correlations(rows, ["g"], "c", "x").collect()
    assert flat.n == 6 and flat.pearson is None and flat.spearman is None
    (some,) = statistics.correlations(rows, ["g"], "x", "y").collect()
    assert some.n == 5 and np.isclose(some.pearson, np.corrcoef(range(1, 6), [(i % 3) - 1 for i in range(1, 6)])[0, 1])


def test_rank_correlations_do_not_deal_rows_by_value(spark):
    """Against all ranks, with ties, nulls and a null group; no join shuffles the rows by their values."""
    rng = np.random.default_rng(4)
    data = [(("a", None)[i % 2], float(rng.integers(9)) if i % 7 else None, float(rng.integers(30))) for i in range(400)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for told in ("-1", before):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", told)
            out = statistics.correlations(spark.createDataFrame(data, "g string, x double, y double"), ["g"], "x", "y")
            got = {r.g: r for r in out.collect()}
            for g in ("a", None):
                x, y = (np.array(v) for v in zip(*((a, b) for k, a, b in data if k == g and a is not None)))
                rank = lambda v: (v[:, None] > v).sum(1) + ((v[:, None] == v).sum(1) + 1) / 2
                assert got[g].n == len(x) and got[g].censored == 200 - len(x)
                assert np.isclose(got[g].spearman, np.corrcoef(rank(x), rank(y))[0, 1]) and np.isclose(got[g].pearson, np.corrcoef(x, y)[0, 1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    written = []
    keep = statistics.materialize
    statistics.materialize = lambda df, tag: written.append((tag, keep(df, tag))) or written[-1][1]
    try:
        statistics.correlations(spark.createDataFrame(data, "g string, x double, y double"), ["g"], "x", "y")
    finally:
        statistics.materialize = keep
    full = [(g, a, b) for g, a, b in data if a is not None]
    assert {tag: df.count() for tag, df in written} == {"x-ranks": len({(g, a) for g, a, _ in full}), "rank-sums": len({(g, b) for g, _, b in full})}


def test_required_ranks(spark):
    curve = spark.createDataFrame([(1, r, e) for r, e in ((1, 0.5), (2, 0.05), (3, 0.2), (4, 0.04), (5, 0.01))] + [(2, 1, 0.9)], "g int, rank int, error double")
    got = {r.g: (r.first_rank, r.stable_rank, r.achieved) for r in statistics.required_ranks(curve, ["g"], "rank", "error", 0.1).collect()}
    assert got == {1: (2, 4, True), 2: (None, None, False)}


def test_pairs_against_all_distances(spark):
    rng = random.Random(1)
    pts = [(i, *(rng.random() * 10 for _ in range(3))) for i in range(150)]
    got = {(r.i, r.j): r.d2 for r in spatial.periodic_pairs(spark.createDataFrame(pts, "id long, x double, y double, z double"), 10.0, 2.5).collect()}
    expected = {}
    for i, a in enumerate(pts):
        for b in pts[i + 1 :]:
            d2 = sum(min(abs(p - q), 10 - abs(p - q)) ** 2 for p, q in zip(a[1:], b[1:], strict=True))
            if d2 <= 6.25:
                expected[a[0], b[0]] = d2
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], rel_tol=1e-9) for k in got)
    with pytest.raises(ValueError):
        spatial.periodic_pairs(spark.createDataFrame(pts, "id long, x double, y double, z double"), 10.0, 4.0)


def test_interface_of_a_slab(spark):
    slab = [(x, y, z, 1) for x in range(2) for y in range(4) for z in range(4)]
    row = spatial.interface_density(spark.createDataFrame(slab, "ix int, iy int, iz int, phase int"), 4).first()
    assert row.crossings == 32 and math.isclose(row.interface_density, 32 / 192)
    row = spatial.block_variation(spark.createDataFrame(slab, "ix int, iy int, iz int, phase int"), 4, 2).first()
    assert math.isclose(row.mean_fraction, 0.5) and math.isclose(row.variation, 1.0)


def vectors(spark, n=60, d=5):
    x = np.random.default_rng(2).normal(size=(n, d)) * np.arange(1, d + 1)
    return x, spark.createDataFrame([(i, i % 7, [float(v) for v in r]) for i, r in enumerate(x)], "id long, label int, v array<double>").repartition(3)


def test_modes_are_the_singular_vectors(spark):
    x, rows = vectors(spark)
    energies, basis = linalg.modes(rows, "v")
    _, s, vt = np.linalg.svd(x)
    assert np.allclose(energies, s**2) and np.allclose(np.abs(np.sum(basis * vt, axis=1)), 1)
    errors = {(r.id, r["rank"]): r.error for r in linalg.projection_errors(rows, "id", "v", basis, [0, 2, 5]).collect()}
    assert all(math.isclose(errors[i, 0], 1.0) and errors[i, 5] < 1e-6 for i in range(60))
    kept = x @ basis[:2].T @ basis[:2]
    assert np.allclose([errors[i, 2] for i in range(60)], np.linalg.norm(x - kept, axis=1) / np.linalg.norm(x, axis=1))


def test_farthest_points(spark):
    x, _ = vectors(spark, 40, 2)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = [(r.position, r.id, r.distance) for r in linalg.farthest_points(rows, "id", ["a", "b"], 3, 12).orderBy("position").collect()]
    chosen = [3]
    for position, key, distance in got[1:]:
        d = np.min(np.linalg.norm(x[:, None] - x[chosen], axis=2), axis=1)
        assert key == d.argmax() and math.isclose(distance, d.max(), rel_tol=1e-9) and position == len(chosen)
        chosen.append(key)


def test_reduced_model_answers(spark):
    _, rows = vectors(spark, 80, 12)
    roots = np.random.default_rng(6).normal(size=(7, 12, 12))
    whole = roots @ roots.swapaxes(1, 2) / 12 + np.eye(12) / 12
    model = reduced_model.ReducedModel(whole[:, 6:, 6:], whole[:, 6:, :6], whole[:, :6, :6])
    q = np.random.default_rng(5).random((9, 7)) + 0.1
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "id long, " + ", ".join(f"q{k} double" for k in range(7)))
    names = [f"q{k}" for k in range(7)]
    got = {r.id: r for r in reduced_model.answer(table, "id", names, model).collect()}
    for i, r in got.items():
        k, b, d = (np.tensordot(q[i], m, axes=1) for m in (model.stiffness, model.loads, model.constants))
        assert np.isclose(r.c12, (d - b.T @ np.linalg.inv(k) @ b)[0, 1]) and r.residual < 1e-10 and r.least_eigenvalue > 0
    curve = {r["rank"]: r for r in reduced_model.rank_curve(table, "id", names, model, [0, 3, 6]).collect()}
    assert curve[0].error_max >= curve[3].error_max >= curve[6].error_max and curve[6].error_max < 1e-12
    bounds = reduced_model.certified(table, "id", names, model, 3).collect()
    assert not any(r.violated for r in bounds) and all(r.bound >= r.error > 0 for r in bounds)
    slopes = {(r.id, r.term): r.s12 for r in reduced_model.sensitivities(table, "id", names, model).collect()}
    for k in range(7):
        up, down = q.copy(), q.copy()
        up[:, k] += 1e-6
        down[:, k] -= 1e-6
        step = (model.solve(up)[0] - model.solve(down)[0])[:, 0, 1] / 2e-6
        assert np.allclose([slopes[i, k] for i in range(9)], step, rtol=1e-5, atol=1e-8)
    answers = reduced_model.answer(table, "id", names, model)
    found = reduced_model.identify(answers, "id", [f"c{i}{j}" for i in range(1, 7) for j in range(1, 7)], model, [0.05] * 7, [1.2] * 7)
    assert all(r.misfit < 1e-6 and np.allclose([r[n] for n in names], q[r.id], rtol=1e-3, atol=1e-3) for r in found.collect())
    picked = reduced_model.adaptive_selection(rows, "id", "v", 3, 10, 1e-8).orderBy("position").collect()
    assert len(picked) == len({r.id for r in picked}) == 12
    assert picked[0].id == int(np.argmax([np.linalg.norm(r.v) for r in rows.orderBy("id").collect()]))


def test_stream_in_batches_equals_one_pass(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"g{i % 3}", rng.gauss(10, 1 + i % 3)) for i in range(240)]
    for k in range(3):
        spark.createDataFrame(rows[80 * k : 80 * k + 80], "i long, g string, v double").coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema("i long, g string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = online.run_available(online.online_convergence(stream, "g", "i", "v", 0.05, 1.96, 5, 3), "stream-test")
    last = {r.g: r for r in out.groupBy("g").agg(F.max_by(F.struct("n", "mean", "std", "converged"), F.struct("n", "converged")).alias("s")).select("g", "s.*").collect()}
    for g in ("g0", "g1", "g2"):
        values, stable, stop = [v for _, h, v in rows if h == g], 0, None
        for n in range(1, len(values) + 1):
            part = np.array(values[:n])
            error = 1.96 * part.std(ddof=1) / n**0.5 / abs(part.mean()) if n >= 5 else math.inf
            stable = stable + 1 if error <= 0.05 else 0
            if stable == 3:
                stop = n
                break
        end = stop or len(values)
        assert last[g].n == end and last[g].converged == (stop is not None)
        assert math.isclose(last[g].mean, np.mean(values[:end]), rel_tol=1e-9) and math.isclose(last[g].std, np.std(values[:end], ddof=1), rel_tol=1e-9)


def test_stream_with_one_hot_group(spark, tmp_path):
    rng = np.random.default_rng(12)
    n = 27_000
    group = np.where(np.arange(n) % 3 == 0, 0, np.arange(n) % 500 + 1)
    value = 1e7 + 4e7 * rng.normal(size=n)
    rows = [(int(i), int(g), None if i % 101 == 0 else float(v)) for i, g, v in zip(range(n), group, value)]
    for k in range(2):
        spark.createDataFrame(rows[k * n // 2 : (k + 1) * n // 2], "i long, g int, v double").repartition(3).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema("i long, g int, v double").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in/*"))
    out = online.run_available(online.online_convergence(stream, "g", "i", "v", 0.09, 1.96, 100, 40), "hot-stream")
    last = {r.g: r for r in out.groupBy("g").agg(F.max_by(F.struct("n", "mean", "std", "converged"), F.struct("n", "converged")).alias("s")).select("g", "s.*").collect()}
    for g in (0, 1, 77):
        values, stable, end = np.array([v for _, h, v in rows if h == g and v is not None]), 0, None
        for m in range(1, len(values) + 1):
            if m >= 100:
                part = values[:m]
                stable = stable + 1 if 1.96 * part.std(ddof=1) / m**0.5 / abs(part.mean()) <= 0.09 else 0
                if stable == 40:
                    end = m
                    break
        stop = end or len(values)
        assert (last[g].n, last[g].converged) == (stop, end is not None) and math.isclose(last[g].mean, values[:stop].mean(), rel_tol=1e-9) and math.isclose(last[g].std, values[:stop].std(ddof=1), rel_tol=1e-9)
    assert last[0].converged and last[0].n > 4096


def test_quantiles_with_one_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 10 else None if i % 20 else "b", rng.choice([1e9 + rng.random(), 5.0, -2.0]), rng.randrange(5)) for i in range(600)] + [("c", 1.0, 0), ("c", None, 0)]
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(5)
    levels = {"q0": 0.0, "q10": 0.1, "half": 0.5, "q95": 0.95, "q1": 1.0}
    got = {r.g: r for r in quantiles.quantiles(df, ["g"], "v", levels).collect()}
    for g in {g for g, _, _ in rows}:
        values = [v for h, v, _ in rows if h == g and v is not None]
        assert all(math.isclose(got[g][n], np.quantile(values, q), rel_tol=1e-12) for n, q in levels.items())
    ranks = quantiles.with_average_rank(df.filter("v is not null"), ["g"], "v", "r").collect()
    for g in ("hot", None):
        own = sorted(r.v for r in ranks if r.g == g)
        assert all(r.r == np.mean([i + 1 for i, v in enumerate(own) if v == r.v]) for r in ranks if r.g == g)
    assert quantiles.quantiles(df.limit(0), ["g"], "v", levels).count() == 0
    #: One value, values of no finite range, no group, many groups.
    odd = spark.createDataFrame([("one", 3.0)] * 5 + [("far", x) for x in (float("-inf"), 1.0, 2.0, float("inf"), 1e300)], "g string, v double")
    assert {r.g: (r.half, r.q95) for r in quantiles.quantiles(odd, ["g"], "v", {"half": 0.5, "q95": 0.75}).collect()} == {"one": (3.0, 3.0), "far": (2.0, 1e300)}
    (all_,) = quantiles.quantiles(df, [], "v", levels).collect()
    assert math.isclose(all_.q10, np.quantile([v for _, v, _ in rows if v is not None], 0.1), rel_tol=1e-12)
    many = spark.range(30_000).selectExpr("id % 6000 AS g", "id * 1.0 AS v")
    assert {(r.half - r.g) for r in quantiles.quantiles(many, ["g"], "v", {"half": 0.5}).collect()} == {12_000.0}


def test_large_means_do_not_cancel(spark):
    rng = np.random.default_rng(1)
    x = 1e9 + rng.normal(size=2000)
    y = x + rng.normal(size=2000) / 2
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "g int, i long, x double, y double").repartition(4)
    (row,) = statistics.correlations(df, ["g"], "x", "y").collect()
    assert math.isclose(row.pearson, np.corrcoef(x, y)[0, 1], rel_tol=1e-6) and row.censored == 0
    got = statistics.prefix_statistics(df, "i", "x", [100, 1000, 3000, 5000]).orderBy("n").collect()
    assert [r.n for r in got] == [100, 1000, 2000] and (got[-1].mean_gap, got[-1].std_gap, got[-1].q05_gap, got[-1].q95_gap) == (0, 0, 0, 0)
    assert [r.n for r in statistics.prefix_statistics(df, "i", "x", [100]).collect()] == [100] and statistics.prefix_statistics(df.limit(0), "i", "x", [100]).count() == 0
    for r in got:
        assert np.allclose([r.q05, r.q95], np.quantile(x[: r["n"]], [0.05, 0.95]), rtol=1e-15)
        assert math.isclose(r["std"], x[: r["n"]].std(ddof=1), rel_tol=1e-5) and math.isclose(r["mean"], x[: r["n"]].mean(), rel_tol=1e-12)
        assert math.isclose(r.std_gap, abs(x[: r["n"]].std(ddof=1) / x.std(ddof=1) - 1), abs_tol=1e-5)


def test_scans_of_a_hot_group(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 9 else "cold", i, 1e6 + float(rng.normal())) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(4)
    moments = {r.i: r for r in statistics.running_moments(df, "g", "i", "v").collect()}
    tails = {r.i: r.top for r in statistics.suffix_max(df, ["g"], "i", "v", "top").collect()}
    steps = {r.i: r.step for r in statistics.lag_difference(df, ["g"], ["i"], "v", "step").collect()}
    for g in ("hot", "cold"):
        own = [(i, v) for h, i, v in rows if h == g]
        for k, (i, v) in enumerate(own):
            part = np.array([w for _, w in own[: k + 1]])
            assert moments[i].n == k + 1 and math.isclose(moments[i]["mean"], part.mean(), rel_tol=1e-12)
            assert math.isclose(moments[i]["std"], part.std(ddof=1) if k else 0.0, rel_tol=1e-6, abs_tol=1e-9)
            assert tails[i] == max(w for _, w in own[k:]) and (steps[i] is None if k == 0 else steps[i] == v - own[k - 1][1])


def test_campaign_checks(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "b", None)], "k int, s string, x double")
    assert campaign.require_columns(rows, ["k", "x"]) is rows
    with pytest.raises(ValueError, match="missing columns: a, z"):
        campaign.require_columns(rows, ["z", "k", "a"])
    found = campaign.table_digest(rows, ["k", "s", "x"]).first()
    again = campaign.table_digest(rows.orderBy(F.desc("k")).repartition(3), ["k", "s", "x"]).first()
    assert found == again and found["n"] == 2
    manifest = {"frozen": True, "n": 2, "digest": found["digest"]}
    assert campaign.require_frozen(rows, ["k", "s", "x"], manifest) is rows
    changed = rows.withColumn("x", F.coalesce("x", F.lit(0.0)))
    for bad in ((changed, manifest), (rows, manifest | {"frozen": "yes"}), (rows, {})):
        with pytest.raises(ValueError):
            campaign.require_frozen(bad[0], ["k", "s", "x"], bad[1])
    with pytest.raises(ValueError):
        campaign.zipped(rows, ["k"], rows.limit(1), ["s"], "i")


def test_nearest_points_however_far(spark):
    rng = random.Random(4)
    pts = [(i, *(rng.random() * 2 for _ in range(3))) for i in range(60)] + [(100, 9.0, 9.0, 9.0), (101, 5.0, 5.0, 5.0), (102, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double, z double")
    got = {r.id: (r.nearest, r.distance) for r in spatial.nearest(df, 10.0).collect()}
    for a in pts:
        d = {b[0]: math.sqrt(sum(min(abs(p - q), 10 - abs(p - q)) ** 2 for p, q in zip(a[1:], b[1:], strict=True))) for b in pts if b[0] != a[0]}
        best = min(d, key=lambda k: (d[k], k))
        assert math.isclose(got[a[0]][1], d[best], rel_tol=1e-9, abs_tol=1e-12) and math.isclose(d[got[a[0]][0]], d[best], rel_tol=1e-9, abs_tol=1e-12)
    assert spatial.nearest(df.limit(0), 10.0).count() == 0 and spatial.nearest(df.filter("id = 100"), 10.0).first().nearest is None
    two = spatial.nearest(df.filter("id in (100, 101)"), 10.0).collect()
    assert {(r.id, r.nearest) for r in two} == {(100, 101), (101, 100)}


def test_nearest_points_in_a_cluster(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([50 + 0.01 * rng.random((1200, 3)), 100 * rng.random((60, 3)), np.tile([[50.005, 50.005, 50.005]], (40, 1)), [[99.99, 50, 50], [0.01, 50, 50]]])
    got = {r.id: (r.nearest, r.distance) for r in spatial.nearest(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double, z double").repartition(4), 100.0).collect()}
    assert len(got) == len(x)
    for i, p in enumerate(x):
        gap = x - p
        d2 = ((gap - 100 * np.rint(gap / 100)) ** 2).sum(axis=1)
        d2[i] = np.inf
        assert math.isclose(got[i][1], d2.min() ** 0.5, rel_tol=1e-9) and math.isclose(d2[got[i][0]], d2.min(), rel_tol=1e-9)
    assert got[1260][0] == 1261 and {got[i][0] for i in range(1261, 1300)} == {1260} and got[1300][0] == 1301


def test_segments_against_many_points(spark):
    rng = np.random.default_rng(7)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.normal(size=3))
    pts = [(i, *map(float, rng.random(3) * 6), *map(float, unit())) for i in range(60)]
    pts += [(100, 3.0, 3.0, 3.0, 1.0, 0.0, 0.0), (101, 3.0, 3.2, 3.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double, z double, ux double, uy double, uz double")
    got = {(r.i, r.j): r.overlap for r in spatial.segment_overlaps(df, 6.0, 1.0, 0.5).collect()}
    s = np.linspace(-0.5, 0.5, 201)
    for m, a in enumerate(pts):
        for b in pts[m + 1 :]:
            gap = np.array(b[1:4]) - np.array(a[1:4])
            gap -= 6 * np.round(gap / 6)
            p, q = s[:, None] * np.array(a[4:]), gap + s[:, None] * np.array(b[4:])
            d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2)).min()
            found = got.get((a[0], b[0]), 0.0)
            assert (0.5 - d <= found + 1e-9 and found <= 0.5 - d + 6e-3) or (found == 0.0 and d >= 0.5 - 1e-9) or (found > 0 and found <= 0.5 - d + 6e-3)
    assert math.isclose(got[100, 101], 0.3)


def test_operators_from_fields(spark):
    rng = np.random.default_rng(5)
    n, r = 40, 3
    v, phase = rng.normal(size=(n, r, 6)), rng.integers(0, 2, n)
    axes = rng.normal(size=(n, 3))
    axes /= np.linalg.norm(axes, axis=1, keepdims=True)
    rows = [(int(p), *map(float, a), [float(x) for x in w.ravel()]) for p, a, w in zip(phase, axes, v, strict=True)] + [(0, 1.0, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "phase int, ux double, uy double, uz double, v array<double>").repartition(4)
    model = fields.reduced_model(df, "v", r)
    k, b, d = np.zeros((7, r, r)), np.zeros((7, r, 6)), np.zeros((7, 6, 6))
    for p, a, w in zip(phase, axes, v, strict=True):
        turn = fields.mandel_rotations(a[None])[0]
        for q in range(7):
            if (q < 2) == (p == 0):
                c = fields.matrix_atoms()[q] if p == 0 else turn @ fields.fibre_atoms()[q - 2] @ turn.T
                k[q] += w @ c @ w.T / n
                b[q] += w @ c / n
                d[q] += c / n
    assert np.allclose(model.stiffness, k) and np.allclose(model.loads, b) and np.allclose(model.constants, d)
    gram = linalg.collected_matrix(fields.snapshot_gram(df, "v", r))
    flat = v.transpose(1, 0, 2).reshape(r, -1)
    assert np.allclose(gram, flat @ flat.T / (6 * n))
    energies, weights = fields.snapshot_modes(gram)
    modes = weights @ flat
    assert np.allclose(modes @ modes.T / (6 * n), np.eye(r)) and np.allclose(energies, np.linalg.svd(flat, compute_uv=False) ** 2 / (6 * n))


def test_probes_in_blocks(spark):
    x, rows = vectors(spark)
    got = {(r.id, r.probe): r.value for r in linalg.gram_entries(rows, "id", "v", rows.filter("id % 5 = 0"), block=5).collect()}
    assert len(got) == 60 * 12 and all(math.isclose(got[i, j], x[i] @ x[j], rel_tol=1e-9, abs_tol=1e-12) for i, j in got)
    assert linalg.gram_entries(rows, "id", "v", rows.limit(0)).count() == 0


def test_empty_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("i long, g string, v double").parquet(str(tmp_path / "in"))
    assert online.run_available(online.online_convergence(stream, "g", "i", "v", 0.05, 1.96, 5, 3), "empty").count() == 0


def test_missing_values_have_reasons(spark):
    from plumbline.functions import materials as M
    from plumbline.functions import orientation as O

    names = list(M.BOX)
    rows = [(*([1.0] * 7),), (*([None] * 7),), (float("nan"), *([1.0] * 6))]
    got = [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(M.reject_reason()).collect()]
    assert got[0] != "" and got[1:] == ["Em_missing", "Em_missing"]
    flat = spark.createDataFrame([(None, 0.2), (0.3, float("nan")), (0.3, 0.2)], "u double, v double").select(*(c.alias(n) for n, c in O.folded_triangle(F.col("u"), F.col("v")).items()))
    assert [r[0] for r in flat.select(O.reject_reason()).collect()] == ["a11_missing", "a11_missing", ""]
