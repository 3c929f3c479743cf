"""Orientation states and morphology as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.eigen import with_eigenpairs

#: Names of the three axes.
AXES = ("x", "y", "z")
#: Parts of a label, each with the bounds of its first and second word; the third is between them.
DENSITY = (("dilute", 0.13), ("dense", 0.25), "mid-vf")
LENGTH = (("short", 10.0), ("long", 20.0), "medium-ar")
SPATIAL = (("uniform", 0.10), ("clustered", 0.50), "mild-cluster")
ALIGNED, PLANAR = 0.65, 0.10
#: Names of a symmetric tensor's six entries; fixed value: the least eigenvalue of one that is made valid.
TENSOR = ("a11", "a12", "a13", "a22", "a23", "a33")
LEAST_EIGENVALUE = 1e-8
#: Names of the rules of a valid diagonal, in the order in which they are tried.
REASONS = (
    "a11_missing",
    "a22_missing",
    "a33_missing",
    "a11_negative",
    "a22_negative",
    "a33_negative",
    "a11_greater_than_one",
    "a22_greater_than_one",
    "a33_greater_than_one",
    "a11_plus_a22_greater_than_one",
    "orientation_trace_not_one",
)


def folded_triangle(u: Column, v: Column, digits: int = 6) -> dict[str, Column]:
    """Diagonal of a second-order orientation tensor from two unit values: points beyond u + v = 1 are mirrored.

    A null or NaN gives nulls.
    """
    present = u.isNotNull() & v.isNotNull() & ~F.isnan(u) & ~F.isnan(v)
    inside = lambda c: F.when(present, F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    mirror = inside(u) + inside(v) > 1.0
    a11 = F.when(mirror, 1.0 - inside(u)).otherwise(inside(u))
    a22 = F.when(mirror, 1.0 - inside(v)).otherwise(inside(v))
    third = F.bround(1.0 - a11 - a22, digits)
    a33 = F.when((third < 0) & (third > -1e-8), F.lit(0.0)).otherwise(third)
    return {"a11": F.bround(a11, digits), "a22": F.bround(a22, digits), "a33": a33}


def reject_reason(a11: str = "a11", a22: str = "a22", a33: str = "a33") -> Column:
    """The first rule that a diagonal breaks, or empty."""
    first, second, third = (F.col(c).cast("double") for c in (a11, a22, a33))
    holds = (
        *(c.isNull() | F.isnan(c) for c in (first, second, third)),
        *(c < 0 for c in (first, second, third)),
        *(c > 1 for c in (first, second, third)),
        first + second > 1.0 + 1e-6,
        F.abs(first + second + third - 1.0) > 1e-6 + 1e-5,
    )
    return F.coalesce(*(F.when(rule, name) for rule, name in zip(holds, REASONS, strict=True)), F.lit(""))


def anisotropy(*diagonal: Column) -> Column:
    """sqrt(3/2) times the distance of the diagonal from isotropy; 1 if all fibres are parallel."""
    total = sum(((a - F.lit(1.0 / 3.0)) * (a - F.lit(1.0 / 3.0)) for a in diagonal[1:]), (diagonal[0] - F.lit(1.0 / 3.0)) * (diagonal[0] - F.lit(1.0 / 3.0)))
    return F.sqrt(1.5 * total)


def morphology_label(fraction: Column, aspect: Column, cluster: Column, *diagonal: Column) -> Column:
    """density_length_spatial_orientation, by fixed thresholds; the first axis wins a tie."""
    parts = []
    for value, ((low_word, low), (high_word, high), middle) in zip((fraction, aspect, cluster), (DENSITY, LENGTH, SPATIAL), strict=True):
        parts.append(F.when(value <= low, low_word).when(value >= high, high_word).otherwise(middle))
    axes, all_ = F.array(*map(F.lit, AXES)), F.array(*diagonal)
    axis = lambda c: F.element_at(axes, F.array_position(all_, c).cast("int"))
    most, least = F.greatest(*diagonal), F.least(*diagonal)
    orient = (
        F.when(most >= ALIGNED, F.concat(F.lit("aligned-"), axis(most)))
        .when(least <= PLANAR, F.concat(F.lit("planar-normal-"), axis(least)))
        .otherwise("triaxial")
    )
    return F.concat_ws("_", *parts, orient)


def sanitised(rows: DataFrame, entries: Sequence[str]) -> DataFrame:
    """rows with TENSOR: the symmetric matrix of entries (11, 12, 13, 22, 23, 33) made an orientation tensor.

    Its eigenvalues are raised to LEAST_EIGENVALUE at least and divided by their sum; its eigenvectors stay.
    """
    found = with_eigenpairs(rows, entries, "__a")
    cut = {f"__c{k}": F.greatest(F.col(f"__a{k}"), F.lit(LEAST_EIGENVALUE)) for k in (1, 2, 3)}
    cut["__sum"] = sum(cut.values(), F.lit(0.0))
    value = lambda i, j: sum((F.col(f"__c{k}") * F.col(f"__a{AXES[i]}{k}") * F.col(f"__a{AXES[j]}{k}") for k in (1, 2, 3)), F.lit(0.0)) / F.col("__sum")
    kept = [c for c in rows.columns if c not in TENSOR]
    #: Entries that were null stay null: greatest() passes over nulls.
    whole = F.col("__a1").isNotNull()
    out = [F.when(whole, value(i, j)).alias(f"a{i + 1}{j + 1}") for i in range(3) for j in range(i, 3)]
    return found.withColumns(cut).select(*kept, *out)


def orthotropic_closure(rows: DataFrame, entries: Sequence[str]) -> DataFrame:
    """rows with a1111, a1112, .. a3333 (21 numbers): the fourth-order tensor closed from a second-order one.

    In the frame of the tensor's axes it has the products of pairs of eigenvalues; turned back, that is the product of
    the tensor with itself. entries: 11, 12, 13, 22, 23, 33.
    """
    pairs = [f"{i + 1}{j + 1}" for i in range(3) for j in range(i, 3)]
    return rows.withColumns({f"a{a}{b}": F.col(entries[i]) * F.col(entries[j]) for i, a in enumerate(pairs) for j, b in enumerate(pairs) if i <= j})
