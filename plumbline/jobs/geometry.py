"""Queries of rasterised fibres, composite voxels and orientation tensors, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import orientation as O
from plumbline.jobs.catalog import _BOX, _FIBRES, fibres, query, rounded, snapshots
from plumbline.jobs.fields import fibre_atoms, matrix_atoms
from plumbline.operators import rasters, spatial

# Fibres around the orders' points on a grid of 64^3 voxels, with 0.64 voxels a unit.

_RESOLUTION, _LENGTH, _DIAMETER, _TARGET = 0.64, 10.0, 2.8, 30_000
_SIDE, _FACTOR = int(_BOX * _RESOLUTION), 4


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fibres as a master table."""
    named = {"x": "cx_um", "y": "cy_um", "z": "cz_um"}
    return fibres(spark, sf_dir).withColumnsRenamed(named).withColumns({"L_um": F.lit(_LENGTH), "d_um": F.lit(_DIAMETER)})


def _raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, n, length, radius = rasters.checked_fibres(master(spark, sf_dir), "id", _BOX, _RESOLUTION)
    return rasters.raster_until(rows, "id", n, length, radius, _TARGET)


_L, _R = _LENGTH * _RESOLUTION, 0.5 * _DIAMETER * _RESOLUTION
_S = f"least(greatest((fx - px) * ux + (fy - py) * uy + (fz - pz) * uz, 0), {_L}::DOUBLE)"
_TOUCHES = (
    f"WITH f AS ({_FIBRES}), c AS (SELECT id, ux, uy, uz, {', '.join(f'({a} - {_BOX} * floor({a} / {_BOX})) * {_RESOLUTION}::DOUBLE - {_L / 2}::DOUBLE * u{a} AS p{a}' for a in 'xyz')} FROM f),"
    f" x AS (SELECT *, unnest(range(floor(least(px, px + {_L} * ux) - 2)::INT, ceil(greatest(px, px + {_L} * ux) + 2)::INT + 1)) AS fx FROM c),"
    f" y AS (SELECT *, unnest(range(floor(least(py, py + {_L} * uy) - 2)::INT, ceil(greatest(py, py + {_L} * uy) + 2)::INT + 1)) AS fy FROM x),"
    f" z AS (SELECT *, unnest(range(floor(least(pz, pz + {_L} * uz) - 2)::INT, ceil(greatest(pz, pz + {_L} * uz) + 2)::INT + 1)) AS fz FROM y), s AS (SELECT *, {_S} AS s FROM z),"
    f" t AS (SELECT DISTINCT id, ux, uy, uz, {', '.join(f'((f{a} % {_SIDE} + {_SIDE}) % {_SIDE})::INT AS i{a}' for a in 'xyz')} FROM s WHERE (fx - px - s * ux) ** 2 + (fy - py - s * uy) ** 2 + (fz - pz - s * uz) ** 2 <= {_R}::DOUBLE ** 2),"
    " n AS (SELECT id, count(*) FILTER (first) AS new FROM (SELECT id, id = min(id) OVER (PARTITION BY ix, iy, iz) AS first FROM t) GROUP BY id),"
    " r AS (SELECT *, sum(new) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING)::BIGINT AS total, row_number() OVER (ORDER BY id) AS place FROM n),"
    f" e AS (SELECT min(place) AS place, arg_min(r.total, r.place) AS total, arg_min(r.new, r.place) AS new FROM r WHERE total >= {_TARGET}),"
    f" u AS (SELECT id, r.new, r.total, coalesce(r.place <= e.place - (e.place > 1 AND {_TARGET} - (e.total - e.new) <= e.total - {_TARGET})::INT, true) AS used FROM r, e),"
    " v AS (SELECT ix, iy, iz, max(id) AS id, arg_max(ux, id) AS ux, arg_max(uy, id) AS uy, arg_max(uz, id) AS uz FROM t WHERE id IN (SELECT id FROM u WHERE used) GROUP BY ALL)"
)


@query(_TOUCHES + " SELECT id, new, total, used FROM u")
def raster_fibre_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels that each fibre is the first to touch, the running total, and whether it is used up to the target."""
    return _raster(spark, sf_dir)[1]


@query(_TOUCHES + " SELECT ix, iy, iz, id, round(ux, 6) AS ux, round(uy, 6) AS uy, round(uz, 6) AS uz FROM v")
def raster_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of the used fibres, each with its last fibre's direction."""
    return rounded(_raster(spark, sf_dir)[0], 6, *rasters.U)


@query(
    _TOUCHES
    + f", a AS (SELECT unnest([[1,0,0],[0,1,0],[0,0,1],[-1,0,0],[0,-1,0],[0,0,-1]]) AS s), m AS (SELECT (ix + s[1] + {_SIDE}) % {_SIDE} AS ix, (iy + s[2] + {_SIDE}) % {_SIDE} AS iy, (iz + s[3] + {_SIDE}) % {_SIDE} AS iz FROM v, a),"
    + f" i AS (SELECT count(*) AS crossings, round(count(*) / {3.0 * _SIDE**3}, 8) AS interface_density FROM m ANTI JOIN v USING (ix, iy, iz))"
    + f" SELECT (SELECT count(*) FROM u WHERE used) AS fibres, count(*) AS voxels, round(count(*) / {_SIDE**3}.0::DOUBLE, 8) AS fraction, "
    + ", ".join(f"round(avg(u{'xyz'[i]} * u{'xyz'[j]}), 6) AS a{i + 1}{j + 1}" for i in range(3) for j in range(i, 3))
    + ", any_value(crossings) AS crossings, any_value(interface_density) AS interface_density FROM v, i"
)
def raster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a raster's manifest says: fibres, voxels, fraction, orientation tensor, interface density."""
    voxels, counts = _raster(spark, sf_dir)
    summary = rasters.raster_summary(voxels, _SIDE)
    summary = rounded(rounded(summary, 8, "fraction"), 6, *(c for c in summary.columns if c[0] == "a"))
    faces = rounded(spatial.interface_density(voxels.withColumn("phase", F.lit(1)), _SIDE), 8, "interface_density")
    return counts.filter("used").agg(F.count("*").alias("fibres")).crossJoin(summary).crossJoin(faces)  # one row each


#: Coefficients of the blocks' material, in the order of fields.matrix_atoms and fields.fibre_atoms.
_MATRIX, _FIBRE = (3.0, 1.25), (18.0, 8.0, 7.0, 230.0, 20.0)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 4^3 voxels."""
    return rasters.coarse_blocks(_raster(spark, sf_dir)[0], _SIDE, _FACTOR)


def _leading_sql(x: str, y: str, z: str) -> str:
    main = f"CASE WHEN abs({x}) >= abs({y}) AND abs({x}) >= abs({z}) THEN {x} WHEN abs({y}) >= abs({z}) THEN {y} ELSE {z} END"
    return f"CASE WHEN {main} < 0 THEN -1 ELSE 1 END / sqrt({x} * {x} + {y} * {y} + {z} * {z})"


def _eigenvalues_sql(source: str, keep: str) -> str:
    """CTEs e1, e2, e3: source (m11, m12, m13, m22, m23, m33) with eigenvalues l1 >= l2 >= l3."""
    return (
        f"e1 AS (SELECT {keep}, m11, m12, m13, m22, m23, m33, (m11 + m22 + m33) / 3 AS q FROM {source}),"
        " e2 AS (SELECT *, sqrt(((m11 - q) ** 2 + (m22 - q) ** 2 + (m33 - q) ** 2 + 2 * (m12 ** 2 + m13 ** 2 + m23 ** 2)) / 6) AS p FROM e1),"
        " e3 AS (SELECT *, q + 2 * p * cos(w) AS l1, q + 2 * p * cos(w + 2 * pi() / 3) AS l3, 3 * q - (q + 2 * p * cos(w)) - (q + 2 * p * cos(w + 2 * pi() / 3)) AS l2 FROM (SELECT *,"
        " acos(least(1, greatest(-1, ((m11 - q) * ((m22 - q) * (m33 - q) - m23 * m23) - m12 * (m12 * (m33 - q) - m23 * m13) + m13 * (m12 * m23 - (m22 - q) * m13)) / (2 * p * p * p)))) / 3 AS w FROM e2))"
    )


def _product_sql(a: str, b: str) -> list[str]:
    """Columns of (M - a)(M - b), whose columns lie along the third eigenvector: nine expressions, jy column."""
    m = {(0, 0): "m11", (0, 1): "m12", (0, 2): "m13", (1, 1): "m22", (1, 2): "m23", (2, 2): "m33"}
    at = lambda i, j, l: f"({m[min(i, j), max(i, j)]}{f' - {l}' if i == j else ''})"
    return ["(" + " + ".join(f"{at(i, k, a)} * {at(k, j, b)}" for k in range(3)) + ")" for j in range(3) for i in range(3)]


_COLUMNS = _product_sql("l2", "l3")
_LONGEST = [f"CASE WHEN n0 >= n1 AND n0 >= n2 THEN x{i}0 WHEN n1 >= n2 THEN x{i}1 ELSE x{i}2 END" for i in range(3)]
_BLOCKS = (
    _TOUCHES
    + f", b AS (SELECT ix // {_FACTOR} AS jx, iy // {_FACTOR} AS jy, iz // {_FACTOR} AS jz, count(*) AS n, {', '.join(f'sum(2 * (i{a} % {_FACTOR}) - {_FACTOR - 1})::DOUBLE AS g{a}' for a in 'xyz')},"
    + ", ".join(f"avg(u{'xyz'[i]} * u{'xyz'[j]}) AS m{i + 1}{j + 1}" for i in range(3) for j in range(i, 3))
    + " FROM v GROUP BY 1, 2, 3), "
    + _eigenvalues_sql("b", "jx, jy, jz, n, gx, gy, gz")
    + ", e4 AS (SELECT *, "
    + ", ".join(f"{c} AS x{k % 3}{k // 3}" for k, c in enumerate(_COLUMNS))
    + " FROM e3), e5 AS (SELECT *, "
    + ", ".join(f"x0{j} ** 2 + x1{j} ** 2 + x2{j} ** 2 AS n{j}" for j in range(3))
    + " FROM e4), e6 AS (SELECT *, "
    + ", ".join(f"{c} AS d{a}" for c, a in zip(_LONGEST, "xyz", strict=True))
    + f" FROM e5), k AS (SELECT jx, jy, jz, n / {_FACTOR**3}.0::DOUBLE AS fraction, (2 * n >= {_FACTOR**3})::INT AS phase, "
    + ", ".join(f"d{a} * {_leading_sql('dx', 'dy', 'dz')} AS a{a}" for a in "xyz")
    + ", "
    + ", ".join(f"CASE WHEN n = {_FACTOR**3} OR gx = 0 AND gy = 0 AND gz = 0 THEN {float(a == 'x')}::DOUBLE ELSE g{a} * {_leading_sql('gx', 'gy', 'gz')} END AS n{a}" for a in "xyz")
    + " FROM e6)"
)
_VECTORS = ("ax", "ay", "az", "nx", "ny", "nz")


@query(_BLOCKS + f" SELECT jx, jy, jz, fraction, phase, {', '.join(f'round({c}, 5) + 0.0::DOUBLE AS {c}' for c in _VECTORS)} FROM k")
def composite_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fraction, phase, fibre axis and interface normal of every block with fibre voxels."""
    return rounded(blocks(spark, sf_dir), 5, *_VECTORS)


_ROOT = 2.0**0.5
#: Symmetric tensors of the Mandel unit vectors, and jumps across a normal, as lists jy row.
_UNITS_SQL = f"[[1,0,0,0,0,0,0,0,0],[0,0,0,0,1,0,0,0,0],[0,0,0,0,0,0,0,0,1],[0,0,0,0,0,{1 / _ROOT},0,{1 / _ROOT},0],[0,0,{1 / _ROOT},0,0,0,{1 / _ROOT},0,0],[0,{1 / _ROOT},0,{1 / _ROOT},0,0,0,0,0]]::DOUBLE[][]"
_LAMINATE = (
    _BLOCKS
    + f", q AS (SELECT i, ({_UNITS_SQL})[i] AS e FROM (SELECT unnest(range(1, 7)) AS i)),"
    + " sa AS (SELECT jx, jy, jz, fraction AS f, nx, ny, nz, i, e, e[1] + e[5] + e[9] AS t, e[1] * ax + e[2] * ay + e[3] * az AS p1, e[4] * ax + e[5] * ay + e[6] * az AS p2, e[7] * ax + e[8] * ay + e[9] * az AS p3, ax, ay, az FROM k, q),"
    + " w AS (SELECT *, ax * p1 + ay * p2 + az * p3 AS n FROM sa),"
    + " ca AS (SELECT a.jx, a.jy, a.jz, a.f, a.nx, a.ny, a.nz, a.i, b.i AS j, a.t AS ta, b.t AS tb, a.n AS na, b.n AS nb, (a.i = b.i)::INT AS dot, a.p1 * b.p1 + a.p2 * b.p2 + a.p3 * b.p3 - a.n * b.n AS sh FROM w a JOIN w b USING (jx, jy, jz)),"
    + f" st AS (SELECT jx, jy, jz, f, nx, ny, nz, i, j, {_MATRIX[0]} * ta * tb + {2 * _MATRIX[1]} * dot AS cm,"
    + f" {_FIBRE[0]} * (dot - na * nb - 2 * sh) + {_FIBRE[1]} * ((ta - na) * (tb - nb) - (dot - na * nb - 2 * sh)) + {_FIBRE[2]} * (na * (tb - nb) + (ta - na) * nb) + {_FIBRE[3]} * na * nb + {4 * _FIBRE[4]} * sh AS cf FROM ca),"
    + f" pj AS (SELECT i, j, [[nx,0,0],[0,ny,0],[0,0,nz],[0,nz/{_ROOT},ny/{_ROOT}],[nz/{_ROOT},0,nx/{_ROOT}],[ny/{_ROOT},nx/{_ROOT},0]]::DOUBLE[][] AS pr, jx, jy, jz, f, cm, cf FROM st),"
    + " wk AS (SELECT jx, jy, jz, f, i, k, sum((cf - cm) * pr[j][k]) AS w, sum(((1 - f) * cf + f * cm) * pr[j][k]) AS h, any_value(pr[i]) AS pi FROM pj, (SELECT unnest([1, 2, 3]) AS k) GROUP BY ALL),"
    + " tt AS (SELECT jx, jy, jz, l, k, sum(pi[l] * h) AS t FROM wk, (SELECT unnest([1, 2, 3]) AS l) GROUP BY ALL),"
    + " ti AS (SELECT jx, jy, jz, " + ", ".join(f"max(t) FILTER (l = {a} AND k = {b}) AS t{a}{b}" for a in (1, 2, 3) for b in (1, 2, 3)) + " FROM tt GROUP BY ALL),"
    + " inv AS (SELECT jx, jy, jz, (t11 * (t22 * t33 - t23 * t32) - t12 * (t21 * t33 - t23 * t31) + t13 * (t21 * t32 - t22 * t31)) AS det,"
    + " [[t22 * t33 - t23 * t32, t13 * t32 - t12 * t33, t12 * t23 - t13 * t22], [t23 * t31 - t21 * t33, t11 * t33 - t13 * t31, t13 * t21 - t11 * t23], [t21 * t32 - t22 * t31, t12 * t31 - t11 * t32, t11 * t22 - t12 * t21]] AS adj FROM ti),"
    + " wr AS (SELECT jx, jy, jz, i, [max(w) FILTER (k = 1), max(w) FILTER (k = 2), max(w) FILTER (k = 3)] AS w FROM wk GROUP BY ALL),"
    + " lam AS (SELECT s.jx, s.jy, s.jz, s.i, s.j, CASE WHEN f >= 1 THEN cf ELSE (1 - f) * cm + f * cf - f * (1 - f) * ("
    + " + ".join(f"a.w[{x}] * adj[{x}][{y}] * b.w[{y}]" for x in (1, 2, 3) for y in (1, 2, 3))
    + ") / det END AS c FROM st s JOIN wr a ON (a.jx, a.jy, a.jz, a.i) = (s.jx, s.jy, s.jz, s.i) JOIN wr b ON (b.jx, b.jy, b.jz, b.i) = (s.jx, s.jy, s.jz, s.j) JOIN inv ON (inv.jx, inv.jy, inv.jz) = (s.jx, s.jy, s.jz))"
)
_UPPER = [(i, j) for i in range(1, 7) for j in range(i, 7)]


@query(_LAMINATE + f" SELECT jx, jy, jz, {', '.join(f'round(max(c) FILTER (i = {i} AND j = {j}), 4) + 0.0::DOUBLE AS c{i}{j}' for i, j in _UPPER)} FROM lam GROUP BY jx, jy, jz")
def composite_stiffness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 21 numbers of each block's stiffness as a laminate."""
    matrix, fibre = (np.tensordot(c, atoms, 1) for c, atoms in ((_MATRIX, matrix_atoms()), (_FIBRE, fibre_atoms())))
    out = rasters.composite_stiffness(blocks(spark, sf_dir), matrix, fibre)
    return rounded(out, 4, *(f"c{i}{j}" for i, j in _UPPER))


# Orientation tensors: an embedding's first six numbers are a symmetric matrix, mostly of mixed signs.

_ENTRIES = ("m11", "m12", "m13", "m22", "m23", "m33")


def _projector(first: str, others: tuple[str, str], weight: str) -> list[str]:
    return [f"{weight} * {c} / (({first} - {others[0]}) * ({first} - {others[1]}))" for c in _product_sql(*others)]


_PARTS = list(zip(*(_projector(f"l{k}", o, f"greatest(l{k}, {O.LEAST_EIGENVALUE!r}::DOUBLE)") for k, o in ((1, ("l2", "l3")), (2, ("l1", "l3")), (3, ("l1", "l2"))))))
_SANITISED = (
    f"WITH s AS (SELECT vec_id, {', '.join(f'embedding[{i}]::DOUBLE AS {n}' for i, n in enumerate(_ENTRIES, 1))} FROM embeddings), {_eigenvalues_sql('s', 'vec_id')}, z AS (SELECT vec_id, "
    + ", ".join(f"({' + '.join(_PARTS[3 * j + i])}) / ({' + '.join(f'greatest(l{k}, {O.LEAST_EIGENVALUE!r}::DOUBLE)' for k in (1, 2, 3))}) AS a{i + 1}{j + 1}" for i in range(3) for j in range(i, 3))
    + " FROM e3)"
)


def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and a11.. a33: each matrix made an orientation tensor."""
    rows = snapshots(spark, sf_dir).select("vec_id", *(F.get("v", F.lit(i)).alias(n) for i, n in enumerate(_ENTRIES)))
    return O.sanitised(rows, _ENTRIES).select("vec_id", *O.TENSOR)


@query(_SANITISED + f" SELECT vec_id, {', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in O.TENSOR)} FROM z")
def sanitised_orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric matrices with their eigenvalues cut at a least one, of trace 1."""
    return rounded(sanitised(spark, sf_dir), 6, *O.TENSOR)


@query(_SANITISED + f" SELECT vec_id, {', '.join(f'round({a} * {b}, 6) + 0.0::DOUBLE AS a{a[1:]}{b[1:]}' for i, a in enumerate(O.TENSOR) for b in O.TENSOR[i:])} FROM z")
def orthotropic_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourth-order tensors closed from the second-order ones (21 numbers)."""
    closed = O.orthotropic_closure(sanitised(spark, sf_dir), O.TENSOR)
    return rounded(closed.drop(*O.TENSOR), 6, *(c for c in closed.columns if len(c) == 5))
