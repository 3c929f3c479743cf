"""Geometry designs as Column expressions: boxes from fibre counts, grids, estimates, named orientation states, features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.sequences import ceil_to_multiple

#: Diagonals of the named orientation states.
ORIENTATION_STATES = {"quasi-isotropic": (1.0 / 3.0, 1.0 / 3.0, 1.0 / 3.0), "aligned-x": (0.90, 0.05, 0.05), "planar-xy": (0.50, 0.50, 0.0)}
#: Columns that may hold a design's grid size, in the order in which they are asked.
GRID_COLUMNS = ("nvox", "NVOX", "nvox_ref")


def orientation_state(name: Column) -> list[Column]:
    """a11, a22 and a33 of a named state (any case, - or _); another name is an error."""
    key = F.regexp_replace(F.lower(F.trim(name)), "_", "-")
    unknown = F.raise_error(F.concat(F.lit("unknown orientation state "), F.coalesce(name, F.lit("null")))).cast("double")
    out = []
    for i in range(3):
        value = unknown
        for state, diagonal in ORIENTATION_STATES.items():
            value = F.when(key == state, F.lit(diagonal[i])).otherwise(value)
        out.append(value)
    return out


def fixed_geometry(diameter: Column, aspect: Column, fraction: Column, fibres: Column, per_diameter: float, multiple: int) -> dict[str, Column]:
    """L_um, caja_um, nvox, res, voxel_um, df_voxel and Lf_Ldom of a box that holds so many fibres at a volume fraction.

    The grid has at least per_diameter voxels a diameter, rounded up to a multiple. Values out of range give null.
    """
    sound = (aspect > 0) & (fraction > 0) & (fraction < 1) & (diameter > 0) & (fibres >= 1)
    length = F.when(sound, aspect * diameter)
    box = F.pow(fibres * (math.pi * diameter * diameter * length / 4.0) / fraction, F.lit(1.0 / 3.0))
    grid = ceil_to_multiple(per_diameter * box / diameter, multiple)
    return {"L_um": length, "caja_um": box, "nvox": grid, "res": grid / box, "voxel_um": box / grid, "df_voxel": diameter * grid / box, "Lf_Ldom": length / box}


def estimated_voxels(names: Sequence[str]) -> Column:
    """A design's grid size, 1 at least: the first of GRID_COLUMNS that is not null, else res times caja_um, rounded."""
    kept = [F.col(n).cast("double") for n in GRID_COLUMNS if n in names]
    if {"res", "caja_um"} <= set(names):
        kept.append(F.col("res") * F.col("caja_um"))
    if not kept:
        raise ValueError("neither a grid size nor res and caja_um are there")
    return F.greatest(F.lit(1), F.rint(F.coalesce(*kept))).cast("int")


def estimated_fibres(fraction: Column, box: Column, diameter: Column, length: Column) -> Column:
    """The whole number of fibres, 1 at least, that fill a fraction of a box; null for fibres without volume."""
    volume = math.pi * diameter * diameter * length / 4.0
    return F.when(volume > 0, F.greatest(F.lit(1), F.rint(fraction * box * box * box / volume)).cast("long"))


def design_features(fraction: Column, aspect: Column, diagonal: Sequence[Column], clusters: Column, fractions: tuple[float, float], aspects: tuple[float, float], most_clusters: float) -> Column:
    """A design as six numbers of about equal range, to measure distances of designs with."""
    scaled = [(fraction - fractions[0]) / (fractions[1] - fractions[0]), (aspect - aspects[0]) / (aspects[1] - aspects[0])]
    return F.array(*scaled, *(a * (3.0 / 2.0) ** 0.5 for a in diagonal), clusters / most_clusters)


def isotropic_stiffness(bulk: Column, shear: Column) -> Column:
    """Flat 6x6 Mandel stiffness from the bulk and the shear modulus; null unless both are positive."""
    first = bulk - 2.0 * shear / 3.0
    cells = [(first if i < 3 and j < 3 else F.lit(0.0)) + (2.0 * shear if i == j else F.lit(0.0)) for i in range(6) for j in range(6)]
    return F.when((bulk > 0) & (shear > 0), F.array(*cells))


def tensor_of(names: Sequence[str], prefix: str, missing: str = "raise") -> Column:
    """Flat 6x6 array of the columns prefix_11 .. prefix_66, made symmetric.

    missing: what an absent column does, ``raise`` an error or give ``null``. A null value gives null.
    """
    wanted = [f"{prefix}_{i}{j}" for i in range(1, 7) for j in range(1, 7)]
    absent = sorted(set(wanted) - set(names))
    if absent and missing == "raise":
        raise ValueError(f"missing columns: {', '.join(absent)}")
    if absent:
        return F.lit(None).cast("array<double>")
    whole = F.lit(True)
    for n in wanted:
        whole = whole & F.col(n).isNotNull()
    even = [(F.col(f"{prefix}_{i}{j}").cast("double") + F.col(f"{prefix}_{j}{i}").cast("double")) / 2.0 for i in range(1, 7) for j in range(1, 7)]
    return F.when(whole, F.array(*even))
