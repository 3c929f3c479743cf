"""Rasterised fibres and composite voxels against plain numpy on small grids."""

import numpy as np
import pytest

from plumbline.functions.tensors import mandel_rotations
from plumbline.jobs.fields import fibre_atoms, matrix_atoms
from plumbline.operators import rasters

NAMES = "id long, cx_um double, cy_um double, cz_um double, ux double, uy double, uz double, L_um double, d_um double"


def some_fibres(n, seed=3, box=4.0):
    rng = np.random.default_rng(seed)
    way = rng.normal(size=(n, 3))
    return [(i, *rng.uniform(-box, 2 * box, 3).tolist(), *way[i].tolist(), 2.0, 0.5) for i in range(n)]


def plain_raster(rows, box, resolution, target):
    """One fibre after the other on a whole grid."""
    n = int(round(box * resolution))
    owner, used, count, counts = np.full((n, n, n), -1), 0, 0, {}
    grid = np.stack(np.meshgrid(*[np.arange(-2 * n, 3 * n)] * 3, indexing="ij"), axis=-1) if n <= 8 else None
    for i, cx, cy, cz, *u, length, d in rows:
        u = np.array(u) / np.linalg.norm(u)
        centre = np.mod([cx, cy, cz], box) * resolution
        start, size, radius = centre - 0.5 * length * resolution * u, length * resolution, 0.5 * d * resolution
        low, high = (f(g(start, start + size * u)) for f, g in ((lambda x: np.floor(x - radius - 1), np.minimum), (lambda x: np.ceil(x + radius + 1), np.maximum)))
        points = np.stack(np.meshgrid(*[np.arange(a, b + 1) for a, b in zip(low, high)], indexing="ij"), axis=-1).reshape(-1, 3)
        along = np.clip((points - start) @ u, 0, size)
        hit = points[((points - start - along[:, None] * u) ** 2).sum(axis=1) <= radius**2]
        cells = {tuple(int(c) % n for c in p) for p in hit}
        if not cells:
            continue
        new = sum(owner[c] < 0 for c in cells)
        if used and count < target <= count + new and target - count <= count + new - target:
            break
        count, used = count + new, used + 1
        counts[i] = (new, count)
        for c in cells:
            owner[c] = i
        if count >= target:
            break
    return owner, counts


@pytest.mark.parametrize("target", [1e9, 150, 400.5, 0, 33])
def test_raster_equals_a_plain_loop(spark, target):
    given = some_fibres(60)
    rows = spark.createDataFrame(given, NAMES).repartition(3)
    fibres, n, length, radius = rasters.checked_fibres(rows, "id", 4.0, 4.0)
    assert (n, length, radius) == (16, 8.0, 1.0)
    voxels, counts = rasters.raster_until(fibres, "id", n, length, radius, target)
    owner, expected = plain_raster(given, 4.0, 4.0, np.ceil(target))
    assert {(r.ix, r.iy, r.iz): r.id for r in voxels.collect()} == {tuple(map(int, c)): int(owner[tuple(c)]) for c in np.argwhere(owner >= 0)}
    assert {r.id: (r.new, r.total) for r in counts.filter("used").collect()} == expected


def test_every_master_fibre_is_used(spark):
    rows = spark.createDataFrame([(0, 1.0, 2.0, 2.0, 1.0, 0.0, 0.0, 2.0, 0.5), (1, 3.0, 2.5, 3.0, 0.0, 1.0, 0.0, 2.0, 0.5)], NAMES)
    fibres, n, length, radius = rasters.checked_fibres(rows, "id", 4.0, 4.0)
    voxels, counts = rasters.raster_until(fibres, "id", n, length, radius, n**3 + 1)
    (summary,) = rasters.raster_summary(voxels, n).collect()
    assert counts.filter("used").count() == 2 and summary.voxels == counts.agg({"new": "sum"}).first()[0] > 0
    assert abs(summary.a11 + summary.a22 - 1) < 1e-12 and summary.fraction == summary.voxels / 16**3


@pytest.mark.parametrize("change", [{2: 3.0}, {3: None}, {7: 2.5}, {8: 0.6}, {4: 0.0, 5: 0.0, 6: 0.0}])
def test_bad_masters_are_refused(spark, change):
    bad = [change.get(k, v) for k, v in enumerate((1, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 2.0, 0.5))]
    rows = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 2.0, 0.5), tuple(bad)], NAMES)
    if 2 in change:
        rows = rows.drop("cx_um")
    with pytest.raises(ValueError):
        rasters.checked_fibres(rows, "id", 4.0, 4.0)
    with pytest.raises(ValueError):
        rasters.checked_fibres(rows.limit(0).withColumn("cx_um", rows.ux), "id", 4.0, 4.0)


def plain_laminate(cm, cf, f, normal):
    """Six loads, each with the jump that makes tractions equal, jy fourth-order tensors."""
    pairs, scale = ((0, 0), (1, 1), (2, 2), (1, 2), (0, 2), (0, 1)), [1, 1, 1, 2**0.5, 2**0.5, 2**0.5]

    def full(c):
        out = np.zeros((3, 3, 3, 3))
        for a, (i, j) in enumerate(pairs):
            for b, (k, m) in enumerate(pairs):
                for x, y in ((i, j), (j, i)):
                    for z, w in ((k, m), (m, k)):
                        out[x, y, z, w] = c[a, b] / scale[a] / scale[b]
        return out

    m4, f4 = full(cm), full(cf)
    out = np.zeros((6, 6))
    for b, (k, m) in enumerate(pairs):
        strain = np.zeros((3, 3))
        strain[k, m] = strain[m, k] = 1 / scale[b]
        jumps = [0.5 * (np.outer(e, normal) + np.outer(normal, e)) for e in np.eye(3)]
        mixed = (1 - f) * f4 + f * m4
        traction = np.array([[normal @ np.einsum("ijmn,mn->ij", mixed, j)[:, i] for j in jumps] for i in range(3)])
        pull = normal @ np.einsum("ijmn,mn->ij", f4 - m4, strain)
        jump = sum(x * j for x, j in zip(np.linalg.solve(traction, -pull), jumps))
        stress = np.einsum("ijmn,mn->ij", (1 - f) * m4 + f * f4, strain) + f * (1 - f) * np.einsum("ijmn,mn->ij", f4 - m4, jump)
        out[:, b] = [scale[a] * stress[i, j] for a, (i, j) in enumerate(pairs)]
    return (out + out.T) / 2


def test_blocks_and_their_stiffness_equal_plain_ones(spark):
    rng = np.random.default_rng(5)
    way = rng.normal(size=(8, 8, 8, 3))
    way /= np.linalg.norm(way, axis=-1, keepdims=True)
    phase = rng.random((8, 8, 8)) < rng.random((2, 2, 2)).repeat(4, 0).repeat(4, 1).repeat(4, 2)
    phase[:4, :4, :4], phase[4:, 4:, 4:], phase[:4, 4:, :4] = True, False, False
    phase[0, 4, 0] = True
    voxels = spark.createDataFrame([(*map(int, c), *way[tuple(c)].tolist()) for c in np.argwhere(phase)], "ix int, iy int, iz int, ux double, uy double, uz double").repartition(3)
    blocks = rasters.coarse_blocks(voxels, 8, 4)
    cm, cf = np.tensordot([3.0, 1.2], matrix_atoms(), 1), np.tensordot([18.0, 8, 7, 230, 20], fibre_atoms(), 1)
    stiff = {(r.jx, r.jy, r.jz): r for r in rasters.composite_stiffness(blocks, cm, cf).collect()}
    mean = {(r.jx, r.jy, r.jz): r for r in rasters.composite_stiffness(blocks, cm, cf, "voigt").collect()}
    got = blocks.collect()
    assert len(got) == 7
    for r in got:
        part = np.s_[4 * r.jx : 4 * r.jx + 4, 4 * r.jy : 4 * r.jy + 4, 4 * r.jz : 4 * r.jz + 4]
        mask, own = phase[part], way[part][phase[part]]
        assert r.fraction == mask.mean() and r.phase == (mask.mean() >= 0.5)
        axis, normal = np.array([r.ax, r.ay, r.az]), np.array([r.nx, r.ny, r.nz])
        values, vectors = np.linalg.eigh(own.T @ own / len(own))
        assert abs(abs(axis @ vectors[:, 2]) - 1) < 1e-9 and axis[np.abs(axis).argmax()] > 0
        step = np.argwhere(mask).mean(axis=0) - np.argwhere(~mask).mean(axis=0) if not mask.all() else np.array([1.0, 0, 0])
        assert abs(abs(normal @ step) - np.linalg.norm(step)) < 1e-9 and normal[np.abs(normal).argmax()] > 0
        turn = mandel_rotations(axis[None])[0]
        fibre = turn @ cf @ turn.T
        expected = fibre if mask.all() else plain_laminate(cm, fibre, r.fraction, normal)
        names = [(i, j) for i in range(6) for j in range(i, 6)]
        assert np.allclose([stiff[r.jx, r.jy, r.jz][f"c{i + 1}{j + 1}"] for i, j in names], [expected[i, j] for i, j in names])
        straight = (1 - r.fraction) * cm + r.fraction * fibre
        assert np.allclose([mean[r.jx, r.jy, r.jz][f"c{i + 1}{j + 1}"] for i, j in names], [straight[i, j] for i, j in names])
    with pytest.raises(ValueError):
        rasters.coarse_blocks(voxels, 8, 3)
    with pytest.raises(ValueError):
        rasters.composite_stiffness(blocks, cm, cf, "reuss")


@pytest.mark.parametrize("most", [1 << 18, 40])
def test_voxels_of_many_fibres_equal_all_places_tried(monkeypatch, most):
    """Also fibres along an axis or in a plane of the grid, and lines of voxels that are looked at in parts."""
    monkeypatch.setattr(rasters, "CANDIDATES", most)
    rng = np.random.default_rng(11)
    way = np.concatenate([rng.normal(size=(20, 3)), np.eye(3), -np.eye(3), [[1, 1, 0], [0, -1, 1], [1, 1e-12, 0], [1e-300, 1, 0]]])
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    start = np.concatenate([rng.uniform(-3, 3, (20, 3)), rng.integers(-3, 3, (10, 3)).astype(float)])
    got = {(int(f), *map(int, p)) for own, at in rasters._voxels(start, way, 6.0, 1.0) for f, *p in zip(own, *at)}
    places = np.stack(np.meshgrid(*[np.arange(-12, 13)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    expected = set()
    for f, (p, u) in enumerate(zip(start, way)):
        gap = [places[:, k] - p[k] for k in range(3)]
        along = np.clip(gap[0] * u[0] + gap[1] * u[1] + gap[2] * u[2], 0.0, 6.0)
        off = [gap[k] - along * u[k] for k in range(3)]
        expected |= {(f, *map(int, q)) for q in places[off[0] * off[0] + off[1] * off[1] + off[2] * off[2] <= 1.0]}
    assert got == expected


def test_touches_are_made_many_at_a_time_and_not_sorted(spark):
    rows = spark.createDataFrame(some_fibres(20), NAMES)
    fibres, n, length, radius = rasters.checked_fibres(rows, "id", 4.0, 4.0)
    touches = rasters.fibre_touches(fibres, "id", n, length, radius)
    plan = rasters.rasterised(touches, fibres, "id")._jdf.queryExecution().executedPlan().toString()
    #: An explode for each axis and place runs an expression too long to be compiled, once for each place.
    assert "MapInArrow" in plan and "Generate" not in plan and "SortAggregate" not in plan
