"""Small dense tensors: literal arrays, array expressions, and batched numpy tasks where an inverse is needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six pairs of Mandel order 11, 22, 33, 23, 13, 12.
PAIRS = ((0, 0), (1, 1), (2, 2), (1, 2), (0, 2), (0, 1))
CONSTANTS = ("E1", "E2", "E3", "G12", "G13", "G23", "nu12", "nu13", "nu23")


def shear_scale(flat: Column, to_mandel: bool = True) -> Column:
    """A flat 6x6 array scaled from engineering (Voigt) to Mandel form, or back."""
    root = 2.0**0.5 if to_mandel else 2.0**-0.5
    one = [1.0] * 3 + [root] * 3
    return F.zip_with(flat, F.array(*(F.lit(a * b) for a in one for b in one)), lambda c, s: c * s)


#: Places of a flat 6x6 array's upper triangle, by row; and with the diagonal first.
UPPER = tuple((i, j) for i in range(6) for j in range(i, 6))
DIAGONAL_FIRST = tuple((i, i) for i in range(6)) + tuple((i, j) for i, j in UPPER if i < j)


def packed(flat: Column) -> Column:
    """The 21 numbers of a symmetric flat 6x6 array's upper triangle, by row."""
    return F.array(*(flat[6 * i + j] for i, j in UPPER))


def unpacked(upper: Column) -> Column:
    """The flat 6x6 array of 21 packed numbers."""
    return F.array(*(upper[UPPER.index((min(i, j), max(i, j)))] for i in range(6) for j in range(6)))


def packed_product(upper: Column, vector: Column) -> Column:
    """The product of a packed symmetric 6x6 array with an array of six numbers."""
    row = lambda i: sum((upper[UPPER.index((min(i, j), max(i, j)))] * vector[j] for j in range(6)), F.lit(0.0))
    return F.array(*(row(i) for i in range(6)))


def weighted_vector(flat: Column) -> Column:
    """21 numbers of a flat 6x6 array's symmetric part, diagonal first, the others times sqrt(2): its norm is the array's."""
    even = lambda i, j: (flat[6 * i + j] + flat[6 * j + i]) / 2.0
    return F.array(*(even(i, j) * (1.0 if i == j else 2.0**0.5) for i, j in DIAGONAL_FIRST))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def relative_error(a: Column, b: Column, least: float = 1e-300) -> Column:
    """|a - b| / max(|b|, least) of flat arrays, in the Frobenius norm."""
    gap = F.zip_with(a, b, lambda x, y: x - y)
    return F.sqrt(dot(gap, gap)) / F.greatest(F.sqrt(dot(b, b)), F.lit(least))


def fibre_stiffness() -> Column:
    """Flat 6x6 Mandel stiffness of a fibre along axis 1 from the columns of materials.coefficients."""
    ll, lt, tt, x, s = "C_LL", "C_LT", "C_TT", "C_TTx", "C_S"
    rows = [[ll, lt, lt], [lt, tt, x], [lt, x, tt]]
    cells = [F.col(rows[i][j]) if i < 3 and j < 3 else F.lit(0.0) for i in range(6) for j in range(6)]
    cells[21] = F.col(tt) - F.col(x)
    cells[28] = cells[35] = 2.0 * F.col(s)
    return F.array(*cells)


def engineering_constants(rows: DataFrame, flat: str, key: str) -> DataFrame:
    """key with Young's moduli, shear moduli, Poisson ratios and the smallest eigenvalue of Mandel stiffnesses.

    flat: column of flat 6x6 arrays. Stiffnesses are inverted in batches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            c = np.array(frame[flat].tolist()).reshape(-1, 6, 6)
            s = np.linalg.inv(c)
            young = 1 / np.stack([s[:, i, i] for i in range(3)], axis=1)
            out = {key: frame[key], "E1": young[:, 0], "E2": young[:, 1], "E3": young[:, 2]}
            out |= {"G12": 0.5 / s[:, 5, 5], "G13": 0.5 / s[:, 4, 4], "G23": 0.5 / s[:, 3, 3]}
            out |= {f"nu{i + 1}{j + 1}": -s[:, i, j] * young[:, i] for i, j in ((0, 1), (0, 2), (1, 2))}
            yield pd.DataFrame(out | {"least_eigenvalue": np.linalg.eigvalsh((c + c.swapaxes(1, 2)) / 2)[:, 0]})

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in (*CONSTANTS, "least_eigenvalue"))
    return rows.select(key, flat).mapInPandas(run, schema)


def mandel_rotations(first: np.ndarray) -> np.ndarray:
    """(n, 6, 6): Mandel matrices of rotations that bring axis 1 to the unit vectors of first; they are orthogonal."""
    scale = np.sqrt([1, 1, 1, 2, 2, 2])
    helper = np.where(np.abs(first[:, :1]) > 0.9, [[0.0, 1.0, 0.0]], [[1.0, 0.0, 0.0]])
    second = helper - first * np.einsum("ni,ni->n", helper, first)[:, None]
    second /= np.linalg.norm(second, axis=1, keepdims=True)
    turn = np.stack([first, second, np.cross(first, second)], axis=2)
    q = np.empty((len(first), 6, 6))
    for a, (i, j) in enumerate(PAIRS):
        for b, (k, m) in enumerate(PAIRS):
            both = turn[:, i, k] * turn[:, j, m] + turn[:, i, m] * turn[:, j, k]
            q[:, a, b] = 0.5 * both * scale[a] * scale[b]
    return q


def rotated(rows: DataFrame, flat: str, axis: str, key: str) -> DataFrame:
    """key and the Mandel stiffness (flat) turned so that its axis 1 points along the unit array ``axis``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            q = mandel_rotations(np.array(frame[axis].tolist()))
            c = np.array(frame[flat].tolist()).reshape(-1, 6, 6)
            yield pd.DataFrame({key: frame[key], flat: list((q @ c @ q.swapaxes(1, 2)).reshape(-1, 36))})

    return rows.select(key, flat, axis).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {flat} array<double>")
