"""Material parameters of a two-phase composite as Column expressions.

A material row has Em, nu_m (matrix) and Ef_L, Ef_T, G_LT, nu_LT, nu_TT (transversely isotropic fibre), all in
GPa or without unit. Everything here is arithmetic on columns and stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower and upper bound of each sampled parameter.
BOX = {"Em": (1.1, 4.4), "nu_m": (0.35, 0.42), "Ef_L": (72.0, 395.0), "Ef_T": (6.0, 23.0), "G_LT": (8.0, 30.0), "nu_LT": (0.20, 0.26), "nu_TT": (0.35, 0.40)}

#: Names of the rules of a valid material, in the order in which they are tried.
REASONS = (
    "Em_non_positive",
    "nu_m_out_of_isotropic_range",
    "fiber_modulus_non_positive",
    "Ef_L_less_than_Ef_T",
    "nu_TT_out_of_ti_range",
    "fiber_compliance_not_positive_definite",
)


def from_unit(unit: Column, name: str) -> Column:
    """A unit value placed in the parameter's box."""
    low, high = BOX[name]
    return F.lit(low) + unit * F.lit(high - low)


def to_unit(value: Column, name: str) -> Column:
    """The place of a value in the parameter's box."""
    low, high = BOX[name]
    return (value - F.lit(low)) / F.lit(high - low)


def shear(young: str, poisson: str) -> Column:
    """E / 2(1 + nu)."""
    return F.col(young) / (2.0 * (1.0 + F.col(poisson)))


def bulk(young: str, poisson: str) -> Column:
    """E / 3(1 - 2 nu)."""
    return F.col(young) / (3.0 * (1.0 - 2.0 * F.col(poisson)))


def derived(materials: DataFrame) -> DataFrame:
    """Adds Gm, G_TT and the three fibre-to-matrix ratios."""
    with_shear = materials.withColumns({"Gm": shear("Em", "nu_m"), "G_TT": shear("Ef_T", "nu_TT")})
    return with_shear.withColumns(
        {"Ef_L_over_Em": F.col("Ef_L") / F.col("Em"), "Ef_T_over_Em": F.col("Ef_T") / F.col("Em"), "G_LT_over_Gm": F.col("G_LT") / F.col("Gm")}
    )


def coefficients(materials: DataFrame) -> DataFrame:
    """Adds the seven affine coefficients of the composite's stiffness.

    lambda_m and mu_m of the matrix; C_TT, C_TTx, C_LT, C_LL and G_LT of the fibre's stiffness in closed form,
    with k = nu_LT^2 Ef_T / Ef_L.
    """
    k = F.col("nu_LT") * F.col("nu_LT") * F.col("Ef_T") / F.col("Ef_L")
    gap = 1.0 - F.col("nu_TT") - 2.0 * F.col("k")
    base = materials.withColumn("k", k).withColumn("gap", gap)
    cross = F.col("Ef_T") / ((1.0 + F.col("nu_TT")) * F.col("gap"))
    return base.withColumns(
        {
            "lambda_m": F.col("Em") * F.col("nu_m") / ((1.0 + F.col("nu_m")) * (1.0 - 2.0 * F.col("nu_m"))),
            "mu_m": shear("Em", "nu_m"),
            "C_TT": cross * (1.0 - F.col("k")),
            "C_TTx": cross * (F.col("nu_TT") + F.col("k")),
            "C_LT": F.col("Ef_T") * F.col("nu_LT") / F.col("gap"),
            "C_LL": F.col("Ef_L") * (1.0 - F.col("nu_TT")) / F.col("gap"),
            "C_S": F.col("G_LT"),
        }
    ).drop("k", "gap")


def reject_reason() -> Column:
    """The first rule that a material breaks, or empty. A parameter that is null or NaN is ``<name>_missing``, before all.

    A compliance is positive definite if its shear terms are positive and its axial block's leading minors are;
    with positive moduli that leaves the block's determinant.
    """
    between = lambda c: (F.col(c) > -1.0) & (F.col(c) < 0.5)
    k = F.col("nu_LT") * F.col("nu_LT") * F.col("Ef_T") / F.col("Ef_L")
    definite = (k < 1.0) & (1.0 - F.col("nu_TT") - 2.0 * k > 0.0)
    broken = (
        F.col("Em") <= 0,
        ~between("nu_m"),
        F.least("Ef_L", "Ef_T", "G_LT") <= 0,
        F.col("Ef_L") < F.col("Ef_T"),
        ~between("nu_TT"),
        ~definite,
    )
    missing = [F.when(F.col(c).isNull() | F.isnan(c), f"{c}_missing") for c in BOX]
    return F.coalesce(*missing, *(F.when(rule, name) for rule, name in zip(broken, REASONS, strict=True)), F.lit(""))


def hashin_shtrikman(k1: Column, g1: Column, k2: Column, g2: Column, share2: Column) -> dict[str, Column]:
    """Bounds of bulk and shear modulus of a two-phase isotropic mixture; phase 2 is the stiffer one."""

    def bulk_bound(ka: Column, ga: Column, kb: Column, fa: Column, fb: Column) -> Column:
        return ka + fb / (1.0 / (kb - ka) + 3.0 * fa / (3.0 * ka + 4.0 * ga))

    def shear_bound(ka: Column, ga: Column, gb: Column, fa: Column, fb: Column) -> Column:
        return ga + fb / (1.0 / (gb - ga) + 6.0 * fa * (ka + 2.0 * ga) / (5.0 * ga * (3.0 * ka + 4.0 * ga)))

    share1 = 1.0 - share2
    return {
        "K_low": bulk_bound(k1, g1, k2, share1, share2),
        "K_high": bulk_bound(k2, g2, k1, share2, share1),
        "G_low": shear_bound(k1, g1, g2, share1, share2),
        "G_high": shear_bound(k2, g2, g1, share2, share1),
    }


def perturbed(materials: DataFrame, name: str, rel_step: float) -> DataFrame:
    """Two rows a material: name moved down and up by a relative step, at most 45 % of the room to its bounds."""
    low, high = BOX[name]
    value = F.col(name)
    room = F.greatest(F.lit(0.0), F.least(value - F.lit(low), F.lit(high) - value))
    step = F.least(F.abs(value) * F.lit(rel_step), F.lit(0.45) * room)
    sides = F.array(F.struct(F.lit("minus").alias("side"), (value - step).alias("moved")), F.struct(F.lit("plus").alias("side"), (value + step).alias("moved")))
    return materials.withColumn("__s", F.explode(sides)).select("*", "__s.side", "__s.moved").drop("__s")
