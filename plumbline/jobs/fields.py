"""Reduced operators and modes from field tables, in one pass with partial sums.

A field table has one row a voxel: phase (0 matrix, else fibre), a fibre's axis, and the voxel's strains of r fields
as one array of 6 r numbers in Mandel form. A task adds up what its voxels give; Spark adds the tasks' sums, which
have a size that depends on r only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tensors import mandel_rotations
from plumbline.jobs.reduced_model import LOADS, TERMS, ReducedModel
from plumbline.operators import bases

#: Voxels that a task works on at a time.
BLOCK = 2048


def matrix_atoms() -> np.ndarray:
    """Stiffnesses of the matrix' two coefficients: the trace part and the shear part."""
    one = np.array([1.0, 1, 1, 0, 0, 0])
    return np.stack([np.outer(one, one), 2.0 * np.eye(6)])


def fibre_atoms() -> np.ndarray:
    """Stiffnesses of the fibre's coefficients C_TT, C_TTx, C_LT, C_LL, C_S for a fibre along axis 1."""
    out = np.zeros((5, 6, 6))
    for i in (1, 2, 3):
        out[0, i, i] = 1.0
    out[1, 1, 2] = out[1, 2, 1] = 1.0
    out[1, 3, 3] = -1.0
    for i in (1, 2):
        out[2, 0, i] = out[2, i, 0] = 1.0
    out[3, 0, 0] = 1.0
    out[4, 4, 4] = out[4, 5, 5] = 2.0
    return out


def operator_sums(fields: DataFrame, values: str, rank: int, start: int = 0) -> DataFrame:
    """part (K, B, D or n), q, i, j, value: sums over voxels of V^T C_q V, V^T C_q and C_q, and their number.

    fields: phase, ux, uy, uz and the values. Rows whose values are null are left out. With a start only the columns
    of K and the rows of B from there on are formed, and no D.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, b, d, n = np.zeros((TERMS, rank, rank - start)), np.zeros((TERMS, rank - start, LOADS)), np.zeros((TERMS, LOADS, LOADS)), 0
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                part = frame.iloc[at : at + BLOCK]
                v = np.array(part[values].tolist(), dtype=float).reshape(len(part), -1, LOADS)[:, :rank]
                solid = part["phase"].to_numpy() != 0
                n += len(part)
                stiff = [(q, atom, v[~solid], np.tile(atom, (int((~solid).sum()), 1, 1))) for q, atom in enumerate(matrix_atoms())]
                if solid.any():
                    turn = mandel_rotations(part.loc[solid, ["ux", "uy", "uz"]].to_numpy(dtype=float))
                    stiff += [(q, atom, v[solid], turn @ atom @ turn.swapaxes(1, 2)) for q, atom in enumerate(fibre_atoms(), start=2)]
                for q, _, own, c in stiff:
                    stress = own[:, start:] @ c
                    k[q] += np.tensordot(own, stress, axes=([0, 2], [0, 2]))
                    b[q] += stress.sum(axis=0)
                    d[q] += c.sum(axis=0)
        for name, sums, below, beside in (("K", k, 0, start), ("B", b, start, 0), ("D", d, 0, 0))[: 2 if start else 3]:
            q, i, j = np.indices(sums.shape)
            yield pd.DataFrame({"part": name, "q": q.ravel(), "i": i.ravel() + below, "j": j.ravel() + beside, "value": sums.ravel()})
        yield pd.DataFrame({"part": ["n"], "q": [0], "i": [0], "j": [0], "value": [float(n)]})

    used = fields.filter(F.col(values).isNotNull()).select("phase", "ux", "uy", "uz", values)
    return used.mapInPandas(run, "part string, q int, i int, j int, value double").groupBy("part", "q", "i", "j").agg(F.sum("value").alias("value"))


def operators(fields: DataFrame, values: str, rank: int, start: int = 0) -> DataFrame:
    """part (K, B or D), q, i, j, value: the sums over the number of voxels; K and D are made symmetric.

    With a start: only what the fields from there on add (see ``extended``).
    """
    sums = operator_sums(fields, values, rank, start)
    n = F.max(F.when(F.col("part") == "n", F.col("value"))).alias("n")
    both = sums.filter("part <> 'n'")
    swapped = both.filter("part <> 'B'").select("part", "q", F.col("j").alias("i"), F.col("i").alias("j"), "value")
    halved = both.unionByName(swapped).groupBy("part", "q", "i", "j").agg(F.avg("value").alias("value"))
    return halved.crossJoin(F.broadcast(sums.agg(n))).select("part", "q", "i", "j", F.try_divide("value", "n").alias("value"))  # one number


def extended(stored: DataFrame, fields: DataFrame, values: str, rank: int, old: int) -> DataFrame:
    """The operators of ``rank`` fields from the stored ones of the first ``old``: only new rows and columns are formed.

    stored: what ``operators`` gave for these voxels and the first fields; its rows are passed on as they are. An error
    if it is not of that rank.
    """
    if not 0 < old < rank:
        raise ValueError("there is nothing to extend, or nothing to add")
    (found,) = stored.filter("part = 'K'").agg(F.max("i")).first()
    if found != old - 1:
        raise ValueError("the stored operators have another rank")
    return stored.unionByName(operators(fields, values, rank, old))


def reduced_model(fields: DataFrame, values: str, rank: int) -> ReducedModel:
    """The operators as arrays: 7 (r^2 + 6 r + 36) numbers."""
    shapes = {"K": (TERMS, rank, rank), "B": (TERMS, rank, LOADS), "D": (TERMS, LOADS, LOADS)}
    out = {name: np.zeros(shape) for name, shape in shapes.items()}
    for r in operators(fields, values, rank).collect():
        out[r.part][r.q, r.i, r.j] = r.value
    return ReducedModel(out["K"], out["B"], out["D"])


def snapshot_gram(fields: DataFrame, values: str, count: int) -> DataFrame:
    """i, j, value: inner products of the fields, a mean over voxels and components (the method of snapshots).

    A task adds the products of blocks of voxels: count^2 numbers, whatever a field's length is.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((count, count)), 0
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                v = np.array(frame[values].iloc[at : at + BLOCK].tolist(), dtype=float).reshape(-1, frame[values].iloc[at].__len__() // LOADS, LOADS)[:, :count]
                total += np.tensordot(v, v, axes=([0, 2], [0, 2]))
                n += v.shape[0]
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": total.ravel(), "n": n})

    sums = fields.filter(F.col(values).isNotNull()).select(values).mapInPandas(run, "i int, j int, value double, n long")
    return sums.groupBy("i", "j").agg(F.try_divide(F.sum("value"), F.sum("n") * LOADS).alias("value"))


def snapshot_modes(gram: np.ndarray, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Energies, descending, of the modes above the tolerance, and each mode's weights of the fields (as rows).

    A mode is the sum of the fields with its weights; it has mean square 1.
    """
    energies, vectors = np.linalg.eigh((gram + gram.T) / 2)
    energies, vectors = np.maximum(energies[::-1], 0.0), vectors[:, ::-1].T
    kept = energies > max(tolerance * (energies[0] if len(energies) else 0.0), 1e-300)
    return energies[kept], vectors[kept] / np.sqrt(energies[kept])[:, None]


def adaptive_fields(fields: DataFrame, key: str, values: str, count: int, batch: int, rounds: int, tolerance: float) -> DataFrame:
    """position, field and score of fields chosen in batches, each the worst represented by those chosen before.

    fields: one row a voxel with ``count`` candidate fields; key: a column that stays. A score is the root mean square of
    what a candidate has beyond the basis of the chosen ones. The basis is a column of the voxels' table that each
    batch extends; the driver sees inner products only. It ends when no score is over the tolerance.
    """
    rows = fields.filter(F.col(values).isNotNull()).select(key, values)
    power = np.diag(bases.products(rows, values, values, (count, count), LOADS)).copy()
    chosen: list[tuple[int, int, float]] = []
    size, left = 0, power.copy()
    for _ in range(rounds):
        scores = np.sqrt(np.maximum(left, 0.0))
        scores[[f for _, f, _ in chosen]] = 0.0
        order = sorted(range(count), key=lambda f: (-scores[f], f))[:batch]
        new = [f for f in order if scores[f] > tolerance]
        if not new:
            break
        chosen += [(len(chosen) + k, f, float(scores[f])) for k, f in enumerate(new)]
        fresh = F.concat(*(F.slice(values, LOADS * f + 1, LOADS) for f in new))
        if size:
            rows, added = bases.appended(rows.withColumn("fresh", fresh), "basis", "fresh", (size, len(new)), LOADS)
        else:
            rows, added = bases.orthonormalised(rows.withColumn("basis", fresh), "basis", len(new), LOADS)
        size += len(added)
        left = power - (bases.products(rows, "basis", values, (size, count), LOADS) ** 2).sum(axis=0)
    return fields.sparkSession.createDataFrame(chosen, "position int, field int, score double")
