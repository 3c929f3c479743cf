"""Exact nearest neighbours in many dimensions, by pivots and the triangle inequality.

Some points are pivots, PIVOTS of them at most. Each point belongs to its nearest pivot's cell; a
cell's points are cut by their distance to the pivot into shells of at most ``most`` points, so a crowded cell is many
groups. A point's nearest one in its own shell bounds its distance from above. Then it visits the shells that may hold
a nearer one: a shell with distances from low to high to its pivot is no nearer than d - high or low - d, for d the
point's distance to that pivot, and no nearer than half of what d is more than the distance to the own pivot. Visitors
of a shell are dealt to several tasks, each with the shell's points. Nothing is capped, all bounds are certain.

Shells are told to all tasks: PIVOTS and 2^18 of them at most, since ``most`` grows with the rows beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import running_before
from plumbline.operators.sampling import exact_sample
from plumbline.sources.scratch import materialize, release

PIVOTS, SHELLS = 256, 1 << 18
#: Points that are compared with a shell at a time.
BLOCK = 256


def normalised(rows: DataFrame, key: str, columns: Sequence[str], least: float = 1e-14) -> DataFrame:
    """key and v, the columns as an array, each less its least value and divided by its range (by 1 if that is nothing)."""
    found = rows.agg(*(F.min(F.col(c).cast("double")).alias(f"low_{c}") for c in columns), *(F.max(F.col(c).cast("double")).alias(f"high_{c}") for c in columns)).first()
    cells = []
    for c in columns:
        low, high = found[f"low_{c}"], found[f"high_{c}"]
        cells.append((F.col(c).cast("double") - F.lit(low)) / (F.lit(1.0) if low is None or high - low <= least else F.lit(high - low)))
    return rows.select(key, F.array(*cells).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances of the rows of x to those of y, by differences (not by products, which cancel)."""
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))


def _nearest(x: np.ndarray, y: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distance and place of the nearest row of y; own: the places in y of the rows themselves, which do not count."""
    best, place = np.full(len(x), np.inf), np.full(len(x), -1)
    for a in range(0, len(x), BLOCK):
        for b in range(0, len(y), 4096):
            d = _distances(x[a : a + BLOCK], y[b : b + 4096])
            if own is not None:
                i = own[a : a + BLOCK] - b
                hit = np.flatnonzero((i >= 0) & (i < d.shape[1]))
                d[hit, i[hit]] = np.inf
            j = d.argmin(axis=1)
            low = d[np.arange(len(d)), j]
            better = low < best[a : a + BLOCK]
            best[a : a + BLOCK][better], place[a : a + BLOCK][better] = low[better], j[better] + b
    return best, place


def _celled(rows: DataFrame, key: str, kind: str, pivots: np.ndarray) -> DataFrame:
    """key, v, cell and r, the distance to the cell's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r, cell = _nearest(_matrix(batch.column("v")), pivots)
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(r)], [key, "v", "cell", "r"])

    return rows.mapInArrow(run, f"{key} {kind}, v array<double>, cell int, r double")


def nearest_neighbours(points: DataFrame, key: str, most: int = 4096, seed: int = 0) -> DataFrame:
    """key, distance to the nearest other row and compared (rows it was compared with) of points (key, v).

    v: arrays of one length without nulls; rows with a null v are left out. Rows with equal v are at distance 0. A
    single row has no distance (null).
    """
    kind = points.schema[key].dataType.simpleString()
    rows = points.filter(F.col("v").isNotNull()).select(key, "v")
    n = rows.count()
    if n < 2:
        return rows.select(key, F.lit(None).cast("double").alias("distance"), F.lit(0).cast("long").alias("compared"))
    most = max(most, n // SHELLS)
    #: Some cells for each shell's worth of points: more would tell no more apart, and a point visits each one by one.
    wanted = min(PIVOTS, n, max(8, 4 * n // most))
    pivots = np.array([r["v"] for r in exact_sample(rows, key, wanted, seed).collect()], dtype=float)
    placed = running_before(_celled(rows, key, kind, pivots), ["cell", "r", key], {"at": F.lit(1).cast("long")}, "metric-order")
    placed = materialize(placed.withColumn("shell", F.floor(F.col("at") / most)).drop("at"), "metric-shells")
    shells = placed.groupBy("cell", "shell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).toArrow()
    cell, shell, low, high = (shells.column(c).to_numpy() for c in ("cell", "shell", "low", "high"))

    def inside(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v"))
        best, _ = _nearest(x, x, np.arange(len(x)))
        return pa.table({key: table.column(key), "v": table.column("v"), "cell": table.column("cell"), "shell": table.column("shell"), "r": table.column("r"), "best": pa.array(best), "compared": pa.array(np.full(len(x), len(x) - 1))})

    schema = f"{key} {kind}, v array<double>, cell int, shell long, r double, best double, compared long"
    known = materialize(placed.groupBy("cell", "shell").applyInArrow(inside, schema), "metric-known")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                d, best = _distances(_matrix(part.column("v")), pivots), part.column("best").to_numpy()
                own = part.column("r").to_numpy()
                to = d[:, cell]
                bound = np.maximum(np.maximum(to - high, low - to), (to - own[:, None]) / 2)
                #: Rounding of the distances must not hide a shell.
                open_ = bound * (1 - 1e-12) - 1e-300 < best[:, None]
                open_ &= ~((part.column("cell").to_numpy()[:, None] == cell) & (part.column("shell").to_numpy()[:, None] == shell))
                i, g = np.nonzero(open_)
                rows = pa.array(i)
                yield pa.RecordBatch.from_arrays([part.column(key).take(rows), part.column("v").take(rows), pa.array(cell[g]), pa.array(shell[g]), part.column("best").take(rows)], [key, "v", "cell", "shell", "best"])

    visiting = materialize(known.mapInArrow(visits, f"{key} {kind}, v array<double>, cell int, shell long, best double"), "metric-visits")
    parts = visiting.groupBy("cell", "shell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    chunk = F.pmod(F.xxhash64(key), F.col("parts")).cast("int")
    guests = visiting.join(parts, ["cell", "shell"]).select(key, "v", "cell", "shell", chunk.alias("part"), "best", F.lit(False).alias("home"))
    hosts = placed.join(parts, ["cell", "shell"]).select(key, "v", "cell", "shell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("double").alias("best"), F.lit(True).alias("home"))

    def across(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy()
        guest = table.filter(pa.array(~home))
        y = _matrix(table.column("v").filter(pa.array(home)))
        best, _ = _nearest(_matrix(guest.column("v")), y) if guest.num_rows else (np.empty(0), None)
        return pa.table({key: guest.column(key), "best": pa.array(best), "compared": pa.array(np.full(guest.num_rows, len(y), dtype=np.int64))})

    met = guests.unionByName(hosts).groupBy("cell", "shell", "part").applyInArrow(across, f"{key} {kind}, best double, compared long")
    both = known.select(key, "best", "compared").unionByName(met).groupBy(key).agg(F.min("best").alias("distance"), F.sum("compared").alias("compared"))
    done = materialize(both, "metric-nearest")
    release(placed, known, visiting)
    return done


def separated(points: DataFrame, key: str, columns: Sequence[str], least: float = 0.15) -> DataFrame:
    """key, distance to the nearest other row in normalised columns, compared, and separated: over ``least``."""
    found = nearest_neighbours(normalised(points, key, columns), key)
    return found.withColumn("separated", F.col("distance") > least)
