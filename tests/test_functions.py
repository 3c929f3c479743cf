"""Column expressions against numpy."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import materials as M
from plumbline.functions import orientation as O
from plumbline.functions import tensors as T


def box_rows(spark, n=200):
    rng = np.random.default_rng(3)
    values = [low + rng.random(n) * (high - low) for low, high in M.BOX.values()]
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(*values, strict=True))], "id long, " + ", ".join(f"{k} double" for k in M.BOX))


def compliance(r):
    s = np.zeros((6, 6))
    s[:3, :3] = [[1 / r.Ef_L, -r.nu_LT / r.Ef_L, -r.nu_LT / r.Ef_L], [-r.nu_LT / r.Ef_L, 1 / r.Ef_T, -r.nu_TT / r.Ef_T], [-r.nu_LT / r.Ef_L, -r.nu_TT / r.Ef_T, 1 / r.Ef_T]]
    s[3, 3] = (1 + r.nu_TT) / r.Ef_T
    s[4, 4] = s[5, 5] = 0.5 / r.G_LT
    return s


def test_stiffness_is_the_inverse_compliance(spark):
    for r in M.coefficients(box_rows(spark)).withColumn("flat", T.fibre_stiffness()).collect():
        assert np.allclose(np.array(r.flat).reshape(6, 6), np.linalg.inv(compliance(r)), rtol=1e-12)
        assert np.isclose(r.mu_m, r.Em / 2 / (1 + r.nu_m)) and np.isclose(r.lambda_m + 2 / 3 * r.mu_m, r.Em / 3 / (1 - 2 * r.nu_m))


def test_valid_box_has_no_reason(spark):
    assert {r[0] for r in box_rows(spark).select(M.reject_reason()).collect()} == {""}


def test_units_round_trip(spark):
    out = box_rows(spark).select(*(F.abs(M.from_unit(M.to_unit(F.col(k), k), k) - F.col(k)).alias(k) for k in M.BOX)).agg(*(F.max(k) for k in M.BOX)).first()
    assert max(out) < 1e-12


def test_voigt_and_mandel(spark):
    flat = [float(i) for i in range(36)]
    row = spark.createDataFrame([(flat,)], "c array<double>").select(T.shear_scale(F.col("c")).alias("m"), T.shear_scale(T.shear_scale(F.col("c")), False).alias("back")).first()
    scale = np.diag([1, 1, 1, *[2**0.5] * 3])
    assert np.allclose(row.m, (scale @ np.array(flat).reshape(6, 6) @ scale).ravel())
    assert np.allclose(row.back, flat)


def test_rotation(spark):
    axes = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.6, 0.0, 0.8], [0.95, 0.0, (1 - 0.95**2) ** 0.5]]
    rows = M.coefficients(box_rows(spark, 4)).withColumn("flat", T.fibre_stiffness()).withColumn("axis", F.element_at(F.array(*(F.array(*map(F.lit, a)) for a in axes)), (F.col("id") + 1).cast("int")))
    before = {r.id: np.array(r.flat).reshape(6, 6) for r in rows.collect()}
    after = {r.id: np.array(r.flat).reshape(6, 6) for r in T.rotated(rows, "flat", "axis", "id").collect()}
    assert np.allclose(after[0], before[0])
    order = [1, 2, 0, 4, 5, 3]
    assert np.isclose(after[1][1, 1], before[1][0, 0]) and np.isclose(after[1][0, 0], before[1][1, 1])
    assert len(order) == 6
    for i in range(4):
        assert np.allclose(np.linalg.eigvalsh(after[i]), np.linalg.eigvalsh(before[i]))
        u = np.array(axes[i])
        mandel = np.array([*(u * u), 2**0.5 * u[1] * u[2], 2**0.5 * u[0] * u[2], 2**0.5 * u[0] * u[1]])
        assert np.isclose(mandel @ after[i] @ mandel, before[i][0, 0])


def test_orientation_reasons(spark):
    rows = [(-0.1, 0.5, 0.6), (0.5, -0.1, 0.6), (0.5, 0.6, -0.1), (1.2, 0.0, 0.0), (0.6, 0.6, 0.0), (0.2, 0.2, 0.2), (0.2, 0.3, 0.5)]
    got = [r[0] for r in spark.createDataFrame(rows, "a11 double, a22 double, a33 double").select(O.reject_reason()).collect()]
    assert got == ["a11_negative", "a22_negative", "a33_negative", "a11_greater_than_one", "a11_plus_a22_greater_than_one", "orientation_trace_not_one", ""]


def test_bounds_hold_their_order(spark):
    rows = box_rows(spark)
    b = M.hashin_shtrikman(M.bulk("Em", "nu_m"), M.shear("Em", "nu_m"), M.bulk("Ef_L", "nu_LT"), M.shear("Ef_L", "nu_LT"), F.lit(0.3))
    out = rows.select(*(c.alias(n) for n, c in b.items()), M.bulk("Em", "nu_m").alias("k1"), M.bulk("Ef_L", "nu_LT").alias("k2")).collect()
    assert all(r.k1 < r.K_low < r.K_high < r.k2 and r.G_low < r.G_high for r in out)


def test_sobol_points(spark):
    from plumbline.functions import sequences as S

    n, dimensions = 256, 11
    rows = spark.range(n).select(*(S.sobol(F.col("id"), d).alias(f"d{d}") for d in range(dimensions))).collect()
    points = np.array([list(r) for r in rows])
    assert points[0].tolist() == [0.0] * dimensions and points[1].tolist() == [0.5] * dimensions
    assert points[2, :3].tolist() == [0.75, 0.25, 0.25] and points[3, :3].tolist() == [0.25, 0.75, 0.75]
    for d in range(dimensions):
        assert sorted(points[:, d]) == [k / n for k in range(n)]
    shifted = spark.range(n).select(S.sobol(F.col("id"), 1, 12345).alias("x"), S.ceil_to_multiple(F.col("id").cast("double"), 8).alias("m")).collect()
    assert len({r.x for r in shifted}) == n and all(0 <= r.x < 1 for r in shifted)
    assert [r.m for r in shifted[:10]] == [0, 8, 8, 8, 8, 8, 8, 8, 8, 16]
