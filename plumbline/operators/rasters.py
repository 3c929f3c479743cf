"""Fibres on a periodic voxel grid: capsules to voxels, the last writer, first touches and a stopping rule; coarse blocks.

A fibre becomes rows in its task, many fibres at a time: the planes along x that its capsule reaches, the lines along y
in these near the part of the fibre that is near the plane, then the voxels of these lines. No task holds a grid: what
is kept of a voxel is an aggregation over the fibres that touch it, and the count at which fibres stop is a running sum
in two phases.

A voxel that a fibre reaches on both sides of the box counts once. Fibres of (almost) no length have no voxels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.eigen import leading, with_eigenpairs
from plumbline.functions.tensors import PAIRS, mandel_rotations
from plumbline.operators.campaign import require_columns
from plumbline.operators.ordered import running_before, spread
from plumbline.sources.scratch import materialize, release

#: Places of voxels that a task looks at at a time.
CANDIDATES = 1 << 18
AXES = ("x", "y", "z")
CELL = ("ix", "iy", "iz")
U = ("ux", "uy", "uz")
FIBRE_COLUMNS = ("cx_um", "cy_um", "cz_um", "ux", "uy", "uz", "L_um", "d_um")


def checked_fibres(fibres: DataFrame, order: str, box: float, resolution: float) -> tuple[DataFrame, int, float, float]:
    """Fibres in voxel units (order, x, y, z and a unit direction), the grid's side, the fibres' length and radius.

    fibres: the columns FIBRE_COLUMNS and an order. An error if a column is missing, a value is null, there is no
    fibre, lengths or diameters differ, a direction is zero, or the grid has less than two voxels a side.
    """
    require_columns(fibres, [order, *FIBRE_COLUMNS])
    n = int(round(box * resolution))
    if n < 2:
        raise ValueError("the resolution gives no grid")
    size = F.sqrt(sum((F.col(u) * F.col(u) for u in U), F.lit(0.0)))
    null = F.greatest(*(F.col(c).isNull().cast("int") for c in (order, *FIBRE_COLUMNS)))
    found = fibres.agg(
        F.count("*").alias("n"), F.sum(null).alias("nulls"), F.min(size).alias("size"), *(f(c).alias(f"{name}_{c}") for c in ("L_um", "d_um") for name, f in (("low", F.min), ("high", F.max)))
    ).first()
    if not found["n"] or found["nulls"]:
        raise ValueError("there are no fibres" if not found["n"] else f"{found['nulls']} fibres miss a value")
    for c in ("L_um", "d_um"):
        if found[f"high_{c}"] - found[f"low_{c}"] > 1e-12:
            raise ValueError(f"fibres differ in {c}")
    if not found["size"] > 0:
        raise ValueError("a direction is zero")
    centre = [(F.pmod(F.col(f"c{a}_um").cast("double"), F.lit(float(box))) * resolution).alias(a) for a in AXES]
    return fibres.select(order, *centre, *((F.col(u) / size).alias(u) for u in U)), n, found["low_L_um"] * resolution, 0.5 * found["low_d_um"] * resolution


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row its number once for each whole number from low to high, and these numbers."""
    low = np.ceil(low).astype(np.int64)
    counts = np.maximum(np.floor(high).astype(np.int64) - low + 1, 0)
    rows = np.repeat(np.arange(len(low)), counts)
    return rows, low[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def _planes(start: np.ndarray, way: np.ndarray, axis: int, rows: np.ndarray, span: Sequence[np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Rows of an earlier axis once for each plane along this axis that their part of the fibre reaches, and its place.

    span: where this part begins and ends along the fibre; it comes back as the part that is within reach of the plane.
    """
    p, u = start[rows, axis], way[rows, axis]
    ends = [p + s * u for s in span]
    again, at = _ranges(np.minimum(*ends) - reach, np.maximum(*ends) + reach)
    p, u, (first, last) = p[again], u[again], (s[again] for s in span)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        cuts = [np.where(u == 0, side, (at + d - p) / u) for d, side in ((-reach, -np.inf), (reach, np.inf))]
    first, last = np.maximum(first, np.minimum(*cuts)), np.minimum(last, np.maximum(*cuts))
    kept = first <= last
    return again[kept], at[kept], (first[kept], last[kept])


def _voxels(start: np.ndarray, way: np.ndarray, length: float, radius: float) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows of fibres and whole places x, y, z of all voxel centres within ``radius`` of their axes, CANDIDATES looked at at a time."""
    reach = radius + 1e-6
    x_rows, x, span = _planes(start, way, 0, np.arange(len(start)), (np.zeros(len(start)), np.full(len(start), length)), reach)
    again, y, span = _planes(start, way, 1, x_rows, span, reach)
    rows, x = x_rows[again], x[again]
    ends = [start[rows, 2] + s * way[rows, 2] for s in span]
    low, high = np.minimum(*ends) - reach, np.maximum(*ends) + reach
    parts = np.cumsum(high - low + 1) // CANDIDATES
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(parts)) + 1):
        again, z = _ranges(low[part], high[part])
        again = part[again]
        own, at = rows[again], [x[again], y[again], z]
        p, u = start[own], way[own]
        gap = [at[k] - p[:, k] for k in range(3)]
        along = np.minimum(np.maximum(gap[0] * u[:, 0] + gap[1] * u[:, 1] + gap[2] * u[:, 2], 0.0), length)
        off = [gap[k] - along * u[:, k] for k in range(3)]
        inside = off[0] * off[0] + off[1] * off[1] + off[2] * off[2] <= radius * radius
        yield own[inside], [a[inside] for a in at]


def fibre_touches(fibres: DataFrame, order: str, n: int, length: float, radius: float) -> DataFrame:
    """order, ix, iy, iz of every voxel centre of the periodic grid within ``radius`` of a fibre's axis.

    fibres: order, x, y, z in voxels and a unit direction.
    """
    rows = fibres.select(order, *((F.col(a) - 0.5 * length * F.col(u)).alias(f"p0{a}") for a, u in zip(AXES, U, strict=True)), *U)
    if length * length <= 1e-12:
        rows = rows.limit(0)
    #: Fibres at a time, by the columns of voxels that one may reach.
    step = max(1, int(CANDIDATES / (length + 2 * radius + 2) ** 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                table = np.stack([some.column(k).to_numpy(zero_copy_only=False) for k in range(1, 7)], axis=1)
                good = np.flatnonzero(np.isfinite(table).all(axis=1))
                for own, places in _voxels(table[good, :3], table[good, 3:], length, radius):
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(good[own])), *(pa.array((a % n).astype(np.int32)) for a in places)], [order, *CELL])

    kind = fibres.schema[order].dataType.simpleString()
    return rows.mapInArrow(run, f"{order} {kind}, " + ", ".join(f"{c} int" for c in CELL))


def fibre_counts(touches: DataFrame, order: str, target: float) -> DataFrame:
    """order, new (voxels that no fibre before it touches), total (with it) and used of every fibre with voxels.

    Fibres are taken in order until the total reaches the target (rounded up); the fibre that reaches it is left out
    if the total without it is as near to the target, unless it is the first.
    """
    goal = F.ceil(F.lit(float(target)))
    firsts = touches.groupBy(*CELL).agg(F.min(order).alias(order)).groupBy(order).agg(F.count("*").alias("new"))
    all_ = touches.select(order).distinct().join(firsts, order, "left").select(order, F.coalesce("new", F.lit(0)).alias("new"))
    summed = running_before(all_, [order], {"before": F.col("new"), "place": F.lit(1).cast("long")}, "raster-counts")
    summed = materialize(summed.withColumn("total", F.col("before") + F.col("new")), "raster-counts")
    reached = summed.filter(F.col("total") >= goal).agg(F.min(F.struct("place", "before", "total")).alias("s"))
    last = reached.select(F.when((F.col("s.place") > 0) & (goal - F.col("s.before") <= F.col("s.total") - goal), F.col("s.place") - 1).otherwise(F.col("s.place")).alias("last"))
    (end,) = last.first()  # one number
    return summed.select(order, "new", "total", (F.lit(True) if end is None else F.col("place") <= end).alias("used"))


def rasterised(touches: DataFrame, fibres: DataFrame, order: str) -> DataFrame:
    """ix, iy, iz with the order and direction of the last fibre that touches the voxel."""
    last = touches.groupBy(*CELL).agg(F.max(order).alias(order))
    return last.join(fibres.select(order, *U).dropDuplicates([order]), order).select(*CELL, order, *U)


def raster_until(fibres: DataFrame, order: str, n: int, length: float, radius: float, target: float) -> tuple[DataFrame, DataFrame]:
    """The voxels of the fibres that are used up to a target (see ``rasterised``), and ``fibre_counts``."""
    #: Each fibre becomes many rows in its task. What is counted takes a voxel that comes twice as once.
    fibres = spread(fibres)
    touches = materialize(fibre_touches(fibres, order, n, length, radius), "raster-touches")
    counts = materialize(fibre_counts(touches, order, target), "raster-used")
    left_out = counts.filter(~F.col("used")).agg(F.min(order)).first()[0]
    used = F.lit(True) if left_out is None else F.col(order) < left_out
    voxels = materialize(rasterised(touches.filter(used), fibres.filter(used), order), "raster-voxels")
    release(touches)
    return voxels, counts


def raster_summary(voxels: DataFrame, n: int) -> DataFrame:
    """One row: voxels, fraction, and a11.. a33, the mean of the voxels' direction products."""
    moments = [F.coalesce(F.avg(F.col(U[i]) * F.col(U[j])), F.lit(0.0)).alias(f"a{i + 1}{j + 1}") for i in range(3) for j in range(i, 3)]
    return voxels.agg(F.count("*").alias("voxels"), (F.count("*") / float(n**3)).alias("fraction"), *moments)


def coarse_blocks(voxels: DataFrame, n: int, factor: int) -> DataFrame:
    """jx, jy, jz with fraction, phase (1 from one half on), principal axis ax.. and interface normal nx.. of its fibre voxels.

    voxels: the grid's fibre voxels (ix, iy, iz and a direction), each once. Blocks without one do not appear: all
    matrix. The axis belongs to the largest eigenvalue of the mean direction product; the normal points from the
    matrix' centroid to the fibre's. Both have a positive leading component; without direction they are axis 1.
    """
    if n % factor:
        raise ValueError("the grid is not divisible jy the factor")
    block = [F.floor(F.col(c) / factor).cast("int").alias(f"j{a}") for c, a in zip(CELL, AXES, strict=True)]
    inside = [F.sum(F.col(c) % factor).alias(f"s{a}") for c, a in zip(CELL, AXES, strict=True)]
    moments = [F.avg(F.col(U[i]) * F.col(U[j])).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)]
    sums = voxels.groupBy(*block).agg(F.count("*").alias("n"), *inside, *moments)
    whole = factor**3
    #: Whole numbers along the step from the others' centroid to the fibre voxels' one, so that ties are ties.
    gap = [F.when(F.col("n") < whole, 2.0 * F.col(f"s{a}") - (factor - 1.0) * F.col("n")).otherwise(0.0) for a in AXES]
    rows = sums.select("jx", "jy", "jz", (F.col("n") / float(whole)).alias("fraction"), *(g.alias(f"g{a}") for g, a in zip(gap, AXES, strict=True)), *(f"m{i}{j}" for i in range(3) for j in range(i, 3)))
    rows = with_eigenpairs(rows, [f"m{i}{j}" for i in range(3) for j in range(i, 3)], "e")
    #: Blocks whose voxels have no direction have an axis all the same.
    axis = [F.when(F.col("e1") > 0, F.col(f"e{a}1")).otherwise(F.lit(1.0 if a == "x" else 0.0)).alias(f"a{a}") for a in AXES]
    normal = [c.alias(f"n{a}") for c, a in zip(leading([F.col(f"g{a}") for a in AXES]), AXES, strict=True)]
    return rows.select("jx", "jy", "jz", "fraction", (F.col("fraction") >= 0.5).cast("int").alias("phase"), *axis, *normal)


def laminate(matrix: np.ndarray, fibre: np.ndarray, fraction: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """(n, 6, 6): Mandel stiffness of layers across ``normal`` (n, 3), with fractions (n) of fibre (n, 6, 6) in the matrix.

    Strains differ between layers jy the symmetric product of a jump and the normal; the jump makes tractions equal.
    """
    jump = np.zeros((len(normal), 6, 3))
    for row, (i, j) in enumerate(PAIRS):
        for a, b in ((i, j), (j, i)):
            jump[:, row, a] += 0.5 * normal[:, b] * (1.0 if i == j else 2.0**0.5)
    f = fraction[:, None, None]
    gap, stiff = fibre - matrix, (1.0 - f) * fibre + f * matrix
    traction = jump.swapaxes(1, 2) @ stiff @ jump
    pull = gap @ jump
    out = (1.0 - f) * matrix + f * fibre - f * (1.0 - f) * pull @ np.linalg.solve(traction, pull.swapaxes(1, 2))
    return (out + out.swapaxes(1, 2)) / 2


def composite_stiffness(blocks: DataFrame, matrix: np.ndarray, fibre: np.ndarray, rule: str = "laminate") -> DataFrame:
    """jx, jy, jz and c11, c12, .. c66 (21 numbers): each block's Mandel stiffness.

    blocks: see ``coarse_blocks``. matrix, fibre: 6x6 Mandel stiffnesses, the fibre's along axis 1. rule: ``voigt``
    (mean jy fraction) or ``laminate`` (layers across the block's normal); pure blocks have their own stiffness.
    """
    if rule not in ("voigt", "laminate"):
        raise ValueError(f"unknown rule {rule}")
    names = [f"c{i + 1}{j + 1}" for i in range(6) for j in range(i, 6)]
    upper = np.triu_indices(6)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            fraction = np.clip(frame["fraction"].to_numpy(), 0.0, 1.0)
            turn = mandel_rotations(frame[["ax", "ay", "az"]].to_numpy())
            own = turn @ fibre @ turn.swapaxes(1, 2)
            if rule == "laminate":
                out = laminate(matrix, own, fraction, frame[["nx", "ny", "nz"]].to_numpy())
            else:
                out = (1.0 - fraction)[:, None, None] * matrix + fraction[:, None, None] * own
            pure = fraction >= 1.0 - 1e-12
            out[pure], out[fraction <= 1e-12] = own[pure], matrix
            yield pd.concat([frame[["jx", "jy", "jz"]], pd.DataFrame(out[:, upper[0], upper[1]], columns=names, index=frame.index)], axis=1)

    schema = "jx int, jy int, jz int, " + ", ".join(f"{n} double" for n in names)
    return blocks.select("jx", "jy", "jz", "fraction", "ax", "ay", "az", "nx", "ny", "nz").mapInPandas(run, schema)
