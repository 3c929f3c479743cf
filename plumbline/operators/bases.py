"""Orthonormal bases of long fields that stay in a table of voxels.

A field table has one row a voxel with an array of ``count`` fields of ``width`` components each. As a matrix it is
tall: a row for each voxel and component, a column for each field. Its QR factors come from blocks of voxels: each
task reduces its rows to a triangle of count x count numbers, triangles are merged by a tree of groups of FAN, and the
one that is left says how fields combine to a basis, which every task then applies to its own voxels. What meets on
the driver is one triangle, whatever a field's length is.

Inner products are means over voxels and components, so that a basis field has mean square 1. Both steps are done
twice, so that rounding of nearly dependent fields leaves the basis orthonormal. Fields whose remainder has a root
mean square within the tolerance are dropped, in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.scratch import materialize, release

#: Voxels that a task works on at a time, and triangles that are merged by one group.
BLOCK, FAN = 2048, 32


def tall(column: pd.Series, width: int) -> np.ndarray:
    """(voxels, fields, width) of a column of arrays."""
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1, width)


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), BLOCK):
            yield frame.iloc[at : at + BLOCK]


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The upper triangle of a QR factorisation, with a diagonal of no negative number."""
    r = np.linalg.qr(rows, mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def triangle(fields: DataFrame, column: str, count: int, width: int) -> tuple[np.ndarray, int]:
    """The triangle R with R^T R the fields' inner products times components times voxels, and the number of voxels."""

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, n = np.zeros((count, count)), 0
        for part in _blocks(frames):
            rows = tall(part[column], width)[:, :count].transpose(0, 2, 1).reshape(-1, count)
            r, n = np.linalg.qr(np.vstack([r, rows]), mode="r"), n + len(part)
        yield pd.DataFrame({"r": [r.ravel().tolist()], "n": [n]})

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.vstack([np.array(x).reshape(count, count) for x in frame["r"]]), mode="r")
        return pd.DataFrame({"level": [frame["level"].iloc[0] // FAN], "r": [r.ravel().tolist()], "n": [int(frame["n"].sum())]})

    used = fields.filter(F.col(column).isNotNull()).select(column)
    found = materialize(used.mapInPandas(reduced, "r array<double>, n long").filter("n > 0").withColumn("at", F.spark_partition_id()), "triangles")
    left = found.agg(F.max("at")).first()[0]
    if left is None:
        return np.zeros((count, count)), 0
    rows = found.select(F.floor(F.col("at") / FAN).cast("int").alias("level"), "r", "n")
    while True:
        merged_rows = rows.groupBy("level").applyInPandas(merged, "level int, r array<double>, n long")
        left //= FAN
        if left == 0:
            break
        rows = materialize(merged_rows, "triangles")
    (last,) = merged_rows.collect()
    release(found)
    return _triangle(np.array(last["r"]).reshape(count, count)), last["n"]


def combinations(r: np.ndarray, scale: float, tolerance: float) -> tuple[np.ndarray, list[int]]:
    """(fields, basis): how fields combine to an orthonormal basis, and which fields are kept. scale: of R's columns."""
    kept, basis = [], np.zeros((len(r), 0))
    for j, column in enumerate((r / scale).T):
        left = column.copy()
        for _ in range(2):
            left -= basis @ (basis.T @ left)
        size = np.linalg.norm(left)
        if size > tolerance:
            basis = np.column_stack([basis, left / size])
            kept.append(j)
    out = np.zeros((len(r), len(kept)))
    if kept:
        out[kept] = np.linalg.solve(basis.T @ (r / scale)[:, kept], np.eye(len(kept)))
    return out, kept


def combined(fields: DataFrame, column: str, weights: np.ndarray, width: int) -> DataFrame:
    """fields with the column's fields combined: (fields, new fields) weights, applied by blocks of voxels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _blocks(frames):
            values = np.einsum("nfw,fb->nbw", tall(part[column], width)[:, : len(weights)], weights).reshape(len(part), -1)
            yield part.assign(**{column: list(values)})

    return fields.filter(F.col(column).isNotNull()).mapInPandas(run, fields.schema)


def orthonormalised(fields: DataFrame, column: str, count: int, width: int, tolerance: float = 1e-11) -> tuple[DataFrame, list[int]]:
    """fields with an orthonormal basis of the column's fields in their place, and the numbers of the fields kept.

    Each basis field adds what its field has beyond those before it. Voxels whose values are null are left out.
    """
    r, n = triangle(fields, column, count, width)
    weights, kept = combinations(r, max(n * width, 1) ** 0.5, tolerance)
    if not kept:
        raise ValueError("no field is left")
    once = materialize(combined(fields, column, weights, width), "basis-fields")
    again, _ = triangle(once, column, len(kept), width)
    weights, same = combinations(again, max(n * width, 1) ** 0.5, 0.0)
    done = materialize(combined(once, column, weights, width), "basis-fields")
    release(once)
    return done, [kept[i] for i in same]


def products(fields: DataFrame, left: str, right: str, counts: tuple[int, int], width: int) -> np.ndarray:
    """Inner products of the left fields with the right ones: counts[0] x counts[1] numbers, from sums by task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(counts), 0
        for part in _blocks(frames):
            total += np.tensordot(tall(part[left], width)[:, : counts[0]], tall(part[right], width)[:, : counts[1]], axes=([0, 2], [0, 2]))
            n += len(part)
        i, j = np.indices(counts)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": total.ravel(), "n": n})

    out = np.zeros(counts)
    used = fields.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*dict.fromkeys((left, right)))
    for r in used.mapInPandas(run, "i int, j int, value double, n long").groupBy("i", "j").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = r["value"] / max(r["n"] * width, 1)
    return out


def appended(fields: DataFrame, basis: str, fresh: str, counts: tuple[int, int], width: int, tolerance: float = 1e-11) -> tuple[DataFrame, list[int]]:
    """fields with the basis extended by what the fresh fields have beyond it, and the numbers of those that add something.

    counts: how many fields the basis has and how many are fresh. The basis' own fields are not changed; the fresh
    column is dropped.
    """
    rows, used = fields, []
    for _ in range(2):
        cross = products(rows, basis, fresh, counts, width)

        def run(frames: Iterator[pd.DataFrame], cross: np.ndarray = cross) -> Iterator[pd.DataFrame]:
            for part in _blocks(frames):
                values = tall(part[fresh], width)[:, : counts[1]] - np.einsum("nfw,fb->nbw", tall(part[basis], width)[:, : counts[0]], cross)
                yield part.assign(**{fresh: list(values.reshape(len(part), -1))})

        rows = materialize(rows.filter(F.col(basis).isNotNull() & F.col(fresh).isNotNull()).mapInPandas(run, fields.schema), "basis-rest")
        used.append(rows)
    try:
        rest, kept = orthonormalised(rows, fresh, counts[1], width, tolerance)
    except ValueError:
        return rows.drop(fresh), []
    done = materialize(rest.withColumn(basis, F.concat(F.slice(basis, 1, counts[0] * width), fresh)).drop(fresh), "basis-appended")
    release(*used, rest)
    return done, kept
