"""Orthonormal bases and operator extension against numpy."""

import numpy as np
import pytest

from plumbline.jobs import fields
from plumbline.operators import bases


def voxel_table(spark, values, parts=5):
    """values: (fields, 6, voxels)."""
    rng = np.random.default_rng(1)
    n = values.shape[2]
    axis = rng.normal(size=(n, 3))
    axis /= np.linalg.norm(axis, axis=1, keepdims=True)
    rows = [(i, int(i % 3 == 0), *axis[i].tolist(), values[:, :, i].ravel().tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "k long, phase int, ux double, uy double, uz double, v array<double>").repartition(parts)


def back(rows, column, count):
    """(count, 6 x voxels) in the order of the voxels."""
    found = sorted((r.k, r[column]) for r in rows.select("k", column).collect())
    return np.array([v for _, v in found]).reshape(len(found), -1, 6)[:, :count].transpose(1, 2, 0).reshape(count, -1)


def scalar_basis(values, tolerance):
    """Twice-done Gram-Schmidt, field by field."""
    kept, out = [], []
    for f, field in enumerate(values.reshape(len(values), -1)):
        left = field.copy()
        for _ in range(2):
            for b in out:
                left -= np.mean(b * left) * b
        size = np.sqrt(np.mean(left * left))
        if size > tolerance:
            out.append(left / size)
            kept.append(f)
    return np.array(out), kept


@pytest.mark.parametrize("monkey", [(2048, 32), (7, 2)])
def test_orthonormal_fields_equal_gram_schmidt(spark, monkeypatch, monkey):
    monkeypatch.setattr(bases, "BLOCK", monkey[0])
    monkeypatch.setattr(bases, "FAN", monkey[1])
    rng = np.random.default_rng(20)
    values = rng.normal(size=(7, 6, 90))
    values[2] = values[0] - 3 * values[1]
    values[4] = values[3] + 1e-7 * values[4]
    values[5] *= 1e4
    expected, kept = scalar_basis(values, 1e-10)
    table, found = bases.orthonormalised(voxel_table(spark, values), "v", 7, 6, 1e-10)
    assert found == kept == [0, 1, 3, 4, 5, 6]
    got = back(table, "v", len(found))
    assert np.abs(got @ got.T / got.shape[1] - np.eye(len(found))).max() < 1e-12
    assert np.allclose(got, expected, atol=1e-6)


def test_appending_adds_what_is_new_and_only_once(spark):
    rng = np.random.default_rng(21)
    values = rng.normal(size=(9, 6, 60))
    values[7] = values[1] + 2 * values[2]
    first, kept = bases.orthonormalised(voxel_table(spark, values[:5]), "v", 5, 6)
    old = back(first, "v", 5)
    fresh = voxel_table(spark, values[5:]).selectExpr("k", "v AS fresh")
    both, added = bases.appended(first.join(fresh, "k"), "v", "fresh", (5, 4), 6)
    assert kept == [0, 1, 2, 3, 4] and added == [0, 1, 3]
    got = back(both, "v", 8)
    assert (got[:5] == old).all() and np.abs(got @ got.T / got.shape[1] - np.eye(8)).max() < 1e-12
    span = np.linalg.svd(scalar_basis(values, 1e-11)[0] @ got.T / got.shape[1], compute_uv=False)
    assert np.allclose(span, 1.0, rtol=2e-12)
    again, none = bases.appended(both.join(fresh, "k"), "v", "fresh", (8, 4), 6)
    assert none == [] and np.allclose(back(again, "v", 8), got)
    with pytest.raises(ValueError):
        bases.orthonormalised(first.limit(0), "v", 5, 6)


def test_extended_operators_equal_full_ones_and_keep_the_old(spark):
    rng = np.random.default_rng(22)
    table = voxel_table(spark, rng.normal(size=(8, 6, 70)))
    keyed = lambda df: {(r.part, r.q, r.i, r.j): r.value for r in df.collect()}
    full = keyed(fields.operators(table, "v", 8))
    stored = fields.operators(table, "v", 5)
    new = keyed(fields.operators(table, "v", 8, 5))
    assert not any(part == "D" or part == "B" and i < 5 or part == "K" and max(i, j) < 5 for part, _, i, j in new)
    assert len(new) == 7 * (8 * 8 - 5 * 5 + 3 * 6)
    #: Stored rows are passed on as they are, whatever they hold.
    marked = fields.extended(stored.selectExpr("part", "q", "i", "j", "value + 1 AS value"), table, "v", 8, 5)
    old = keyed(stored)
    got = keyed(marked)
    assert got.keys() == full.keys()
    assert all(abs(got[k] - (k in old) - full[k]) < 3e-13 for k in full)
    for rank, start in ((5, 5), (8, 0), (8, 4)):
        with pytest.raises(ValueError):
            fields.extended(stored, table, "v", rank, start)


def test_fields_are_chosen_by_what_the_chosen_miss(spark):
    rng = np.random.default_rng(23)
    values = rng.normal(size=(9, 6, 60)) * np.array([1, 5, 2, 0.1, 4, 3, 1, 1, 1])[:, None, None]
    values[6] = values[1] - values[4]
    values[7], values[8] = 2 * values[1], 0
    got = [(r.position, r.field, r.score) for r in fields.adaptive_fields(voxel_table(spark, values), "k", "v", 9, 2, 10, 1e-6).orderBy("position").collect()]
    flat, expected, basis = values.reshape(9, -1), [], np.zeros((0, 360))
    while True:
        left = flat - (flat @ basis.T / 360) @ basis
        scores = np.sqrt((left**2).mean(axis=1))
        new = [f for f in sorted(range(9), key=lambda f: (-round(scores[f], 9), f))[:2] if scores[f] > 1e-6]
        if not new:
            break
        expected += [(len(expected) + k, f, scores[f]) for k, f in enumerate(new)]
        basis = np.linalg.qr(np.vstack([basis, flat[new]]).T)[0].T[: np.linalg.matrix_rank(np.vstack([basis, flat[new]]))] * 360**0.5
    assert [g[:2] for g in got] == [e[:2] for e in expected] and np.allclose([g[2] for g in got], [e[2] for e in expected], atol=1e-6)
