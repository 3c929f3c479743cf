"""Queries of the library's operators over the given tables, each with DuckDB SQL for the same rows where SQL
can express it. Values that come from sums of floats are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import materials as M
from plumbline.functions import orientation as O
from plumbline.functions import sequences as S
from plumbline.functions import tensors as T
from plumbline.jobs import fields, reduced_model
from plumbline.operators import bases, campaign, linalg, relational, spatial, statistics
from plumbline.operators.quantiles import with_quantiles
from plumbline.sources.scratch import materialize
from plumbline.sources.tables import table
from plumbline.streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with SQL for the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """df with these columns rounded."""
    return df.withColumns({n: F.round(n, digits) for n in names})


# Materials: every part is a material. Its key, size and price give unit values, which the box makes parameters.

_UNITS = {"Em": ("p_partkey", 97), "nu_m": ("p_partkey", 89), "Ef_L": ("p_size", 51), "Ef_T": ("p_partkey", 83), "G_LT": ("p_partkey", 79), "nu_LT": ("p_partkey", 73), "nu_TT": ("p_size", 47)}


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """material_id and the seven sampled parameters of every part."""
    parts = table(spark, sf_dir, "part")
    unit = lambda c, n: (F.col(c) % n) / F.lit(float(n))
    return parts.select(F.col("p_partkey").alias("material_id"), "p_brand", *(M.from_unit(unit(c, n), name).alias(name) for name, (c, n) in _UNITS.items()))


_MATERIALS = "WITH m AS (SELECT p_partkey AS material_id, p_brand, " + ", ".join(f"{M.BOX[k][0]} + (({c} % {n}) / {n}.0::DOUBLE) * ({M.BOX[k][1]} - {M.BOX[k][0]})::DOUBLE AS {k}" for k, (c, n) in _UNITS.items()) + " FROM part)"
_COEFFICIENTS = (
    _MATERIALS
    + """, k AS (SELECT *, nu_LT * nu_LT * Ef_T / Ef_L AS k FROM m), g AS (SELECT *, 1 - nu_TT - 2 * k AS gap FROM k),
 c AS (SELECT *, Em * nu_m / ((1 + nu_m) * (1 - 2 * nu_m)) AS lambda_m, Em / (2 * (1 + nu_m)) AS mu_m,
 Ef_T * (1 - k) / ((1 + nu_TT) * gap) AS C_TT, Ef_T * (nu_TT + k) / ((1 + nu_TT) * gap) AS C_TTx, Ef_T * nu_LT / gap AS C_LT,
 Ef_L * (1 - nu_TT) / gap AS C_LL, G_LT AS C_S FROM g)"""
)
COEFFICIENTS = ("lambda_m", "mu_m", "C_TT", "C_TTx", "C_LT", "C_LL", "C_S")


def _rounds(names: tuple[str, ...], digits: int) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


@query(_COEFFICIENTS + f" SELECT material_id, {_rounds(COEFFICIENTS, 6)} FROM c")
def material_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven affine coefficients of every material, in closed form."""
    return rounded(M.coefficients(materials(spark, sf_dir)).select("material_id", *COEFFICIENTS), 6, *COEFFICIENTS)


_DERIVED = ("Gm", "G_TT", "Ef_L_over_Em", "Ef_T_over_Em", "G_LT_over_Gm")


@query(
    _MATERIALS
    + f", d AS (SELECT *, Em / (2 * (1 + nu_m)) AS Gm, Ef_T / (2 * (1 + nu_TT)) AS G_TT, Ef_L / Em AS Ef_L_over_Em, Ef_T / Em AS Ef_T_over_Em FROM m) SELECT material_id, {_rounds(_DERIVED[:4], 6)}, round(G_LT / Gm, 6) AS G_LT_over_Gm FROM d"
)
def material_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shear moduli and ratios."""
    return rounded(M.derived(materials(spark, sf_dir)).select("material_id", *_DERIVED), 6, *_DERIVED)


@query("""WITH m AS (SELECT p_partkey AS material_id, CASE WHEN p_partkey % 29 <> 0 THEN p_size - 3.0 END AS Em, CASE WHEN p_partkey % 31 = 0 THEN 'nan'::DOUBLE ELSE p_size / 75.0 END AS nu_m, p_retailprice - 1000 AS Ef_L, p_size * 25.0 - 100 AS Ef_T,
 (p_partkey % 20) - 0.5 AS G_LT, (p_partkey % 11) / 2.0 AS nu_LT, (p_partkey % 13) / 20.0 AS nu_TT FROM part)
 SELECT reason, count(*) AS n FROM (SELECT CASE WHEN Em IS NULL THEN 'Em_missing' WHEN isnan(nu_m) THEN 'nu_m_missing' WHEN Em <= 0 THEN 'Em_non_positive' WHEN NOT (nu_m > -1 AND nu_m < 0.5) THEN 'nu_m_out_of_isotropic_range'
 WHEN least(Ef_L, Ef_T, G_LT) <= 0 THEN 'fiber_modulus_non_positive' WHEN Ef_L < Ef_T THEN 'Ef_L_less_than_Ef_T'
 WHEN NOT (nu_TT > -1 AND nu_TT < 0.5) THEN 'nu_TT_out_of_ti_range'
 WHEN NOT (nu_LT * nu_LT * Ef_T / Ef_L < 1 AND 1 - nu_TT - 2 * nu_LT * nu_LT * Ef_T / Ef_L > 0) THEN 'fiber_compliance_not_positive_definite' ELSE '' END AS reason FROM m) GROUP BY reason""")
def material_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many materials of a box wider than the valid one break which rule first."""
    parts = table(spark, sf_dir, "part")
    wide = parts.select(
        F.when(F.col("p_partkey") % 29 != 0, F.col("p_size") - 3.0).alias("Em"),
        F.when(F.col("p_partkey") % 31 == 0, F.lit(float("nan"))).otherwise(F.col("p_size") / 75.0).alias("nu_m"),
        (F.col("p_retailprice") - 1000).alias("Ef_L"),
        (F.col("p_size") * 25.0 - 100).alias("Ef_T"),
        ((F.col("p_partkey") % 20) - 0.5).alias("G_LT"),
        ((F.col("p_partkey") % 11) / 2.0).alias("nu_LT"),
        ((F.col("p_partkey") % 13) / 20.0).alias("nu_TT"),
    )
    return wide.groupBy(M.reject_reason().alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT p_partkey, (p_partkey % 101) / 101.0::DOUBLE AS u, (p_partkey % 53) / 53.0::DOUBLE AS v FROM part),
 f AS (SELECT p_partkey, CASE WHEN u + v > 1 THEN 1 - u ELSE u END AS a11, CASE WHEN u + v > 1 THEN 1 - v ELSE v END AS a22 FROM u)
 SELECT p_partkey, round_even(a11, 6) AS a11, round_even(a22, 6) AS a22,
 CASE WHEN round_even(1 - a11 - a22, 6) < 0 AND round_even(1 - a11 - a22, 6) > -1e-8 THEN 0 ELSE round_even(1 - a11 - a22, 6) END AS a33, '' AS reason FROM f""")
def orientation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orientation diagonals from unit values, folded into the triangle and judged."""
    unit = lambda n: (F.col("p_partkey") % n) / F.lit(float(n))
    states = table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in O.folded_triangle(unit(101), unit(53)).items()))
    return states.withColumn("reason", O.reject_reason())


@query("""WITH d AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 19 <> 0 THEN (p_partkey % 13) / 10.0::DOUBLE - 0.1::DOUBLE END AS a11, CASE WHEN p_partkey % 23 = 0 THEN 'nan'::DOUBLE ELSE (p_partkey % 11) / 10.0::DOUBLE - 0.1::DOUBLE END AS a22 FROM part),
 t AS (SELECT *, CASE WHEN k % 17 = 0 THEN 0.25::DOUBLE ELSE round_even(1 - a11 - a22, 6) END AS a33 FROM d)
 SELECT reason, count(*) AS n FROM (SELECT CASE WHEN a11 IS NULL THEN 'a11_missing' WHEN isnan(a22) THEN 'a22_missing' WHEN a33 IS NULL OR isnan(a33) THEN 'a33_missing' WHEN a11 < 0 THEN 'a11_negative' WHEN a22 < 0 THEN 'a22_negative' WHEN a33 < 0 THEN 'a33_negative'
 WHEN a11 > 1 THEN 'a11_greater_than_one' WHEN a22 > 1 THEN 'a22_greater_than_one' WHEN a33 > 1 THEN 'a33_greater_than_one' WHEN a11 + a22 > 1 + 1e-6 THEN 'a11_plus_a22_greater_than_one' WHEN abs(a11 + a22 + a33 - 1) > 1.1e-5 THEN 'orientation_trace_not_one' ELSE '' END AS reason FROM t) GROUP BY reason""")
def orientation_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many diagonals of a range wider than the valid one break which rule first."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(key, F.when(key % 19 != 0, (key % 13) / F.lit(10.0) - 0.1).alias("a11"), F.when(key % 23 == 0, F.lit(float("nan"))).otherwise((key % 11) / F.lit(10.0) - 0.1).alias("a22"))
    rows = rows.withColumn("a33", F.when(key % 17 == 0, F.lit(0.25)).otherwise(F.bround(1 - F.col("a11") - F.col("a22"), 6)))
    return rows.groupBy(O.reject_reason().alias("reason")).agg(F.count("*").alias("n"))


_SHAPE = """SELECT p_partkey, p_size / 150.0 AS vf, p_size / 2.0 AS ar, (p_partkey % 7) / 10.0 AS cl, (p_partkey % 10) / 10.0 AS a11, least((p_partkey % 4) / 10.0, 1 - (p_partkey % 10) / 10.0) AS a22 FROM part"""


@query(f"""WITH s AS (SELECT *, 1 - a11 - a22 AS a33 FROM ({_SHAPE})), t AS (SELECT *, greatest(a11, a22, a33) AS most, least(a11, a22, a33) AS least_ FROM s)
 SELECT p_partkey, (CASE WHEN vf <= 0.13 THEN 'dilute' WHEN vf >= 0.25 THEN 'dense' ELSE 'mid-vf' END) || '_' || (CASE WHEN ar <= 10 THEN 'short' WHEN ar >= 20 THEN 'long' ELSE 'medium-ar' END)
 || '_' || (CASE WHEN cl >= 0.5 THEN 'clustered' WHEN cl <= 0.1 THEN 'uniform' ELSE 'mild-cluster' END) || '_' ||
 (CASE WHEN most >= 0.65 THEN 'aligned-' || (CASE most WHEN a11 THEN 'x' WHEN a22 THEN 'y' ELSE 'z' END)
 WHEN least_ <= 0.10 THEN 'planar-normal-' || (CASE least_ WHEN a11 THEN 'x' WHEN a22 THEN 'y' ELSE 'z' END) ELSE 'triaxial' END) AS label,
 round(sqrt(1.5 * ((a11 - 1/3.0::DOUBLE) ** 2 + (a22 - 1/3.0::DOUBLE) ** 2 + (a33 - 1/3.0::DOUBLE) ** 2)), 6) AS anisotropy
 FROM (SELECT p_partkey, vf, ar, cl, a11::DOUBLE AS a11, a22::DOUBLE AS a22, (round(a33, 1))::DOUBLE AS a33, greatest(a11, a22, round(a33, 1))::DOUBLE AS most, least(a11, a22, round(a33, 1))::DOUBLE AS least_ FROM s)""")
def morphology_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and anisotropy of every part as a geometry."""
    tenth = lambda n: ((F.col("p_partkey") % n) / 10.0)
    shapes = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 150.0).alias("vf"), (F.col("p_size") / 2.0).alias("ar"), tenth(7).alias("cl"), tenth(10).alias("a11"), F.round(F.least(tenth(4), 1 - tenth(10)), 1).alias("a22"))
    shapes = shapes.withColumn("a33", F.round(1 - F.col("a11") - F.col("a22"), 1))
    diagonal = [F.col(c) for c in ("a11", "a22", "a33")]
    return shapes.select("p_partkey", O.morphology_label(F.col("vf"), F.col("ar"), F.col("cl"), *diagonal).alias("label"), F.round(O.anisotropy(*diagonal), 6).alias("anisotropy"))


_HS = ("K_low", "K_high", "G_low", "G_high")


@query(
    _MATERIALS
    + f""", p AS (SELECT material_id, Em / (3 * (1 - 2 * nu_m)) AS k1, Em / (2 * (1 + nu_m)) AS g1, Ef_L / (3 * (1 - 2 * nu_LT)) AS k2, Ef_L / (2 * (1 + nu_LT)) AS g2, 0.2::DOUBLE AS f2, 0.8::DOUBLE AS f1 FROM m),
 b AS (SELECT material_id, k1 + f2 / (1 / (k2 - k1) + 3 * f1 / (3 * k1 + 4 * g1)) AS K_low, k2 + f1 / (1 / (k1 - k2) + 3 * f2 / (3 * k2 + 4 * g2)) AS K_high,
 g1 + f2 / (1 / (g2 - g1) + 6 * f1 * (k1 + 2 * g1) / (5 * g1 * (3 * k1 + 4 * g1))) AS G_low, g2 + f1 / (1 / (g1 - g2) + 6 * f2 * (k2 + 2 * g2) / (5 * g2 * (3 * k2 + 4 * g2))) AS G_high FROM p)
 SELECT material_id, {_rounds(_HS, 6)} FROM b"""
)
def mixture_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of an isotropic mixture with a fifth of stiff inclusions, per material."""
    rows = materials(spark, sf_dir)
    bounds = M.hashin_shtrikman(M.bulk("Em", "nu_m"), M.shear("Em", "nu_m"), M.bulk("Ef_L", "nu_LT"), M.shear("Ef_L", "nu_LT"), F.lit(0.2))
    return rounded(rows.select("material_id", *(c.alias(n) for n, c in bounds.items())), 6, *_HS)


@query(
    _MATERIALS
    + """ SELECT material_id, round(Ef_L, 6) AS E1, round(Ef_T, 6) AS E2, round(Ef_T, 6) AS E3, round(G_LT, 6) AS G12, round(Ef_T / (2 * (1 + nu_TT)), 6) AS G23,
 round(nu_LT, 6) AS nu12, round(nu_TT, 6) AS nu23, true AS definite FROM m"""
)
def fibre_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engineering constants read back from every fibre's stiffness."""
    stiff = M.coefficients(materials(spark, sf_dir)).withColumn("flat", T.fibre_stiffness())
    out = T.engineering_constants(stiff, "flat", "material_id").withColumn("definite", F.col("least_eigenvalue") > 0)
    names = ("E1", "E2", "E3", "G12", "G23", "nu12", "nu23")
    return rounded(out.select("material_id", *names, "definite"), 6, *names)


@query(
    _MATERIALS
    + """, s AS (SELECT material_id, nu_m, least(abs(nu_m) * 0.05::DOUBLE, 0.45::DOUBLE * greatest(0, least(nu_m - 0.35::DOUBLE, 0.42::DOUBLE - nu_m))) AS step FROM m)
 SELECT material_id, 'minus' AS side, round(nu_m - step, 9) AS moved FROM s UNION ALL SELECT material_id, 'plus', round(nu_m + step, 9) FROM s"""
)
def perturbed_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows a material with nu_m moved."""
    return rounded(M.perturbed(materials(spark, sf_dir), "nu_m", 0.05).select("material_id", "side", "moved"), 9, "moved")


# Error tables: a line item is a query of a model, its discounted price an error.

_ERRORS = "SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS item, round(l_extendedprice * l_discount, 4) AS e, l_quantity FROM lineitem"


def line_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_returnflag, item (unique), e and l_quantity."""
    return table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.round(F.col("l_extendedprice") * F.col("l_discount"), 4).alias("e"), "l_quantity")


@query(f"""SELECT l_returnflag, round(avg(e), 4) AS error_mean, round(quantile_cont(e, 0.5), 4) AS error_median, round(quantile_cont(e, 0.95), 4) AS error_p95, max(e) AS error_max,
 (arg_min(item, (-e, item)))::BIGINT AS error_max_key FROM ({_ERRORS}) GROUP BY l_returnflag""")
def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error statistics by return flag."""
    return rounded(statistics.error_statistics(line_errors(spark, sf_dir), ["l_returnflag"], "e", "item"), 4, "error_mean", "error_median", "error_p95")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg((o_totalprice > 150000)::INT), 6) AS share_large, round(median(o_totalprice), 4) AS median_price,
 round(quantile_cont(o_totalprice, 0.95), 4) AS p95_price, max(o_totalprice) AS max_price FROM orders GROUP BY 1, 2""")
def grouped_multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several aggregates by two keys."""
    price, keys = F.col("o_totalprice"), ["o_orderstatus", "o_orderpriority"]
    orders = table(spark, sf_dir, "orders").select(*keys, "o_totalprice")
    out = orders.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((price > 150000).cast("int")).alias("share_large"), F.max(price).alias("max_price"))
    out = with_quantiles(out, orders, keys, "o_totalprice", {"median_price": 0.5, "p95_price": 0.95})
    return rounded(rounded(out, 6, "share_large"), 4, "median_price", "p95_price")


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part) WHERE k = 1")
def group_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest part of each brand, the smaller key on a tie."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return relational.least_of_group(parts, ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")])


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def global_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest part."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(1)


@query("""WITH f AS (SELECT o_custkey, o_orderstatus, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2),
 p AS (SELECT o_custkey, max(v) FILTER (o_orderstatus = 'F') AS F, max(v) FILTER (o_orderstatus = 'O') AS O, max(v) FILTER (o_orderstatus = 'P') AS P FROM f GROUP BY 1)
 SELECT o_custkey, F, O, P, round(F / O, 6) AS ratio FROM p""")
def pivot_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first price by order status, and a ratio of two columns."""
    wide = relational.pivoted_first(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ("F", "O", "P"), "o_totalprice", "o_orderkey")
    return wide.withColumn("ratio", F.round(F.try_divide("F", "O"), 6))


@query("SELECT p_type, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by type."""
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.countDistinct("p_brand").alias("brands"))


_SUMMARY = ("mean", "std", "least", "most", "q01", "q05", "q50", "q95", "q99")


@query(
    "WITH t AS (SELECT 'l_quantity' AS output, l_quantity::DOUBLE AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem) "
    "SELECT output, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS least, max(v) AS most, "
    + ", ".join(f"round(quantile_cont(v, {q}), 4) AS q{round(100 * q):02d}" for q in (0.01, 0.05, 0.5, 0.95, 0.99))
    + " FROM t GROUP BY output"
)
def output_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of three outputs."""
    out = statistics.summaries(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])
    return rounded(out, 4, "mean", "std", *_SUMMARY[4:])


@query("""WITH n AS (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS total FROM events),
 c AS (SELECT DISTINCT least(total, unnest([100, 300, 1000, 3000, 10000, 30000, 50000, 100000])) AS n FROM (SELECT any_value(total) AS total FROM n)),
 s AS (SELECT n, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.95) AS q95 FROM c JOIN n ON pos < n GROUP BY n),
 l AS (SELECT avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM n)
 SELECT n::BIGINT AS n, round(mean, 6) AS mean, round(std, 6) AS std, round(1.96 * std / sqrt(n), 6) AS half_width, round(q05, 6) AS q05, round(q95, 6) AS q95, round(abs(mean - m) / abs(m), 6) AS mean_gap, round(abs(std - l.s) / abs(l.s), 6) AS std_gap,
  round(abs(q05 - a) / abs(a), 6) AS q05_gap, round(abs(q95 - b) / abs(b), 6) AS q95_gap FROM s, l""")
def prefix_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, interval and outer quantiles over the first n events, and against all events."""
    out = statistics.prefix_statistics(table(spark, sf_dir, "events"), "event_id", "value", [100, 300, 1000, 3000, 10000, 30000, 50000, 100000])
    return rounded(out, 6, *(c for c in out.columns if c != "n"))


@query("""WITH l AS (SELECT * FROM lineitem WHERE l_orderkey % 13 <> 0), r AS (SELECT l_returnflag, l_linestatus, l_quantity::DOUBLE AS x, l_extendedprice AS y,
 rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_extendedprice) - 1) / 2.0::DOUBLE AS ry FROM l)
 SELECT l_returnflag, l_linestatus, count(*) AS n, any_value(censored) AS censored, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r JOIN (SELECT l_returnflag, l_linestatus, count(*) FILTER (l_orderkey % 13 = 0) AS censored FROM lineitem GROUP BY 1, 2) USING (l_returnflag, l_linestatus) GROUP BY 1, 2 HAVING count(*) >= 3""")
def rank_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson's and Spearman's correlation by two keys, where some quantities are missing (censored)."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.when(F.col("l_orderkey") % 13 != 0, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice")
    out = statistics.correlations(rows, ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return rounded(out, 6, "pearson", "spearman")


_CURVE = "SELECT user_id, event_id, value FROM events"


@query(f"""WITH s AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM ({_CURVE}))
 SELECT user_id, min(event_id) FILTER (value <= 40) AS first_rank, min(event_id) FILTER (later <= 40) AS stable_rank, min(event_id) FILTER (later <= 40) IS NOT NULL AS achieved FROM s GROUP BY 1""")
def required_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and stable event from which a user's values stay within a threshold."""
    return statistics.required_ranks(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 40.0)


@query(f"SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM ({_CURVE})")
def suffix_max_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest value from each event on."""
    return statistics.suffix_max(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", "envelope").drop("value")


@query("SELECT p_partkey, round(sum(p_retailprice) OVER (ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) / sum(p_retailprice) OVER (), 8) AS share FROM part")
def cumulative_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all prices reached with each part, dearest first."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", (-F.col("p_retailprice")).alias("order"))
    return rounded(statistics.cumulative_share(parts, ["order", "p_partkey"], "p_retailprice", "share"), 8, "share").select("p_partkey", "share")


@query("SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 4) AS step FROM orders")
def lag_nested_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's price less the customer's previous one."""
    return rounded(statistics.lag_difference(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "step").select("o_orderkey", "step"), 4, "step")


_RUNNING = "SELECT event_id, user_id, value, count(*) OVER w AS n, avg(value) OVER w AS mean, coalesce(stddev_samp(value) OVER w, 0) AS std FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT event_id, n, round(mean, 8) AS mean, round(std, 8) AS std FROM ({_RUNNING})")
def running_welford(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running mean and deviation of each user's values."""
    out = statistics.running_moments(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value")
    return rounded(out.select("event_id", "n", "mean", "std"), 8, "mean", "std")


@query(f"""WITH r AS (SELECT *, CASE WHEN n >= 10 AND abs(mean) > 1e-12 THEN 1.96 * std / (sqrt(n) * abs(mean)) END AS error FROM ({_RUNNING})),
 o AS (SELECT *, coalesce(error <= 0.25, false) AS ok FROM r),
 s AS (SELECT *, n - coalesce(max(CASE WHEN NOT ok THEN n END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS stable FROM o)
 SELECT user_id, min(n) FILTER (stable >= 3) AS n_stop, round(coalesce(arg_min(mean, n) FILTER (stable >= 3), arg_max(mean, n)), 6) AS mean,
 round(coalesce(arg_min(error, n) FILTER (stable >= 3), arg_max_null(error, n)), 6) AS error FROM s GROUP BY user_id""")
def online_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's mean is known well enough to stop."""
    out = statistics.online_stop(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 0.25, 1.96, 10, 3)
    return rounded(out, 6, "mean", "error")


# Relational operators.


@query("SELECT p_partkey, CASE WHEN p_size > 10 THEN (sum((p_size > 10)::INT) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) - 1)::BIGINT END AS design_id FROM part")
def valid_sequential_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0, 1, 2, ... over the valid parts."""
    return relational.numbered_where(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"], F.col("p_size") > 10, "design_id", "valid-id").select("p_partkey", "design_id")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM part")
def rank_first_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by size, descending, ties in the order of keys."""
    parts = table(spark, sf_dir, "part").select("p_partkey", (-F.col("p_size")).alias("order"))
    return relational.positions(parts, ["order", "p_partkey"], "place", "rank").select("p_partkey", (F.col("place") + 1).alias("place"))


@query("""WITH k AS (SELECT * FROM part ORDER BY p_size DESC, p_partkey LIMIT 100)
 SELECT p_partkey, p_size, p_retailprice AS score FROM k ORDER BY p_retailprice DESC, p_partkey LIMIT 10""")
def topk_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten dearest of the hundred largest parts."""
    return relational.prefiltered_top(table(spark, sf_dir, "part"), "p_partkey", F.col("p_size"), F.col("p_retailprice"), 100, 10).select("p_partkey", "p_size", "score")


@query("""WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS up, count(*) OVER () AS n FROM supplier)
 SELECT s_suppkey, least(2 * up, 2 * (n - 1 - up) + 1) AS turn FROM r""")
def interleave_low_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' turns when the poorest and the richest alternate."""
    return relational.interleaved(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"], "turn", "turns").select("s_suppkey", "turn")


@query("""WITH t AS (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS spent, count(*) AS n, max(o_orderpriority) AS c_mktsegment FROM orders GROUP BY 1)
 SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c.c_mktsegment END, t.c_mktsegment) AS c_mktsegment, round(spent, 2) AS spent, n, c_nationkey FROM customer c LEFT JOIN t USING (c_custkey)""")
def left_coalesce_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers completed from their orders' summary."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count("*").alias("n"), F.max("o_orderpriority").alias("c_mktsegment"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")
    return relational.completed_from(customers, orders, ["c_custkey"])


@query("SELECT n_nationkey AS key, s_name AS name_target, c_name AS name_realized FROM nation JOIN (SELECT s_nationkey, s_name FROM supplier) ON s_nationkey = n_nationkey JOIN (SELECT c_nationkey, min(c_name) AS c_name FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def join_with_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables that share a key and a column name."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name"))
    b = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.min("c_name").alias("name"))
    return relational.joined_with_suffixes(a, b, "key", ("_target", "_realized"))


@query("SELECT o_orderkey AS position, c_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the order in which orders ask for them."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("c_custkey"))
    return relational.in_order_of(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", wanted, "position")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a pending order."""
    pending = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").select("c_custkey").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a pending order."""
    pending = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").select("c_custkey").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def pool_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of suppliers that also have an indebted customer."""
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")).intersect(table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_nationkey"))


@query("SELECT o_orderkey, o_totalprice, NULL::VARCHAR AS o_orderpriority FROM orders WHERE o_orderstatus = 'F' UNION ALL BY NAME SELECT o_orderkey, o_orderpriority, NULL::DOUBLE AS o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames with different columns, one under the other."""
    orders = table(spark, sf_dir, "orders")
    return orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").unionByName(orders.filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority"), allowMissingColumns=True)


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a nested column."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_DONE = """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_custkey + (o_orderkey % 11 = 0)::INT AS box, CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE upper(o_orderpriority) END AS mode,
 CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1e-3 ELSE o_totalprice END AS rtol, CASE o_orderkey % 6 WHEN 0 THEN 'True' WHEN 1 THEN 'no' WHEN 2 THEN ' yes' WHEN 3 THEN '0' WHEN 4 THEN '1' ELSE 'maybe' END AS restart FROM orders"""


@query(f"""SELECT o_orderkey, coalesce(box = o_custkey AND lower(mode) = lower(o_orderpriority) AND abs(rtol - o_totalprice) <= 1e-4 AND
 CASE WHEN lower(trim(restart)) IN ('true', '1', 'yes') THEN true WHEN lower(trim(restart)) IN ('false', '0', 'no') THEN false END = (o_orderkey % 2 = 0), false) AS same FROM ({_DONE})""")
def resume_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a finished row has the settings that are asked for, for rows of which some differ or miss one."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    word = F.element_at(F.array(*map(F.lit, ("True", "no", " yes", "0", "1", "maybe"))), (key % 6 + 1).cast("int"))
    done = {
        "box": F.col("o_custkey") + (key % 11 == 0).cast("int"),
        "mode": F.when(key % 7 == 0, F.lit("other")).otherwise(F.upper("o_orderpriority")),
        "rtol": F.when(key % 8 != 0, F.when(key % 5 == 0, price + 1e-3).otherwise(price)),
        "restart": word,
    }
    asked = {"box": F.col("o_custkey"), "mode": F.col("o_orderpriority"), "rtol": price, "restart": key % 2 == 0}
    same = campaign.settings_match(done, asked, ["box"], ["mode"], ["rtol"], ["restart"], 1e-4)
    return table(spark, sf_dir, "orders").select("o_orderkey", same.alias("same"))


@query("SELECT o_orderkey AS run_id, o_custkey AS run_box_side, o_orderstatus AS run_box_solver_mode, '[' || o_custkey || ',' || o_orderkey || ']' AS run_grid, o_orderpriority AS label FROM orders")
def flattened_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested settings as columns named by their path, lists as JSON."""
    solver = F.struct(F.col("o_orderstatus").alias("mode"))
    nested = F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("side"), solver.alias("solver")).alias("box"), F.array("o_custkey", "o_orderkey").alias("grid"))
    return campaign.flattened(table(spark, sf_dir, "orders").select(nested.alias("run"), F.col("o_orderpriority").alias("label")))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000) WHERE k = 1""")
def latest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest finished order over 100,000."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    valid = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)
    return campaign.latest_valid(orders, ["o_custkey"], valid, ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice < 200000 AND o_orderkey % 3 <> 0")
def cached_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a record of the urgent profile that converged and has its fields."""
    records = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("result"))
    return campaign.valid_records(records, "o_custkey", F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") < 200000, ["result"])


@query("""WITH h AS (SELECT md5('{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '"}') AS h FROM part)
 SELECT count(*) AS n, format('{:012x}', (sum(('0x' || substr(h, 1, 12))::HUGEINT) % (1::HUGEINT << 48))::BIGINT) || format('{:012x}', (sum(('0x' || substr(h, 13, 12))::HUGEINT) % (1::HUGEINT << 48))::BIGINT) AS digest FROM h""")
def frozen_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest by which a frozen design is known again, in whatever order its rows come."""
    return campaign.table_digest(table(spark, sf_dir, "part"), ["p_partkey", "p_brand"])


@query("""SELECT i, s_suppkey, s_name FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS i FROM supplier) JOIN (SELECT s_name, row_number() OVER (ORDER BY s_name) - 1 AS i FROM supplier) USING (i)""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers from poor to rich beside suppliers' names in order."""
    suppliers = table(spark, sf_dir, "supplier")
    out = campaign.zipped(suppliers.select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"], suppliers.select("s_name"), ["s_name"], "i")
    return out.select("i", "s_suppkey", "s_name")


@query("SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS score_rank, p_partkey, p_retailprice FROM part")
def ranking_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by descending price, with those of the logged columns that there are."""
    return campaign.ranking_log(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_partkey", ["p_partkey", "p_retailprice", "beta"], "score_rank")


@query("""WITH v AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
 SELECT event_type, count(v) AS n, round(avg(v), 6) AS mean, round(sum(v), 4) AS total, min(v) AS least, max(v) AS most FROM v GROUP BY 1""")
def nan_aware_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates that skip NaN."""
    spoiled = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    clean = table(spark, sf_dir, "events").select("event_type", statistics.without_nan(spoiled).alias("v"))
    out = clean.groupBy("event_type").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))
    return rounded(rounded(out, 6, "mean"), 4, "total")


# Geometry: every line item is a point of a periodic box, every part of a grid a voxel.

_BOX = 100.0
_POINTS = f"SELECT o_orderkey AS id, (o_orderkey * 7919 % 9973) / 9973.0::DOUBLE * {_BOX} AS x, (o_custkey * 104729 % 9967) / 9967.0::DOUBLE * {_BOX} AS y, (o_orderkey * 31 % 9949) / 9949.0::DOUBLE * {_BOX} AS z FROM orders"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, z of every order in the box."""
    place = lambda c, a, n: ((F.col(c) * a % n) / F.lit(float(n)) * _BOX)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), place("o_orderkey", 7919, 9973).alias("x"), place("o_custkey", 104729, 9967).alias("y"), place("o_orderkey", 31, 9949).alias("z"))


def _gap(c: str) -> str:
    return f"((b.{c} - a.{c}) - {_BOX} * round_even((b.{c} - a.{c}) / {_BOX}, 0))"


_PAIRS = f"WITH p AS ({_POINTS}), q AS (SELECT a.id AS i, b.id AS j, {_gap('x')} ** 2 + {_gap('y')} ** 2 + {_gap('z')} ** 2 AS d2 FROM p a JOIN p b ON a.id < b.id AND abs({_gap('x')}) <= 3.0)"


@query(_PAIRS + " SELECT i, j, round(d2, 6) AS d2 FROM q WHERE d2 <= 9.0")
def periodic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of points within a radius."""
    return rounded(spatial.periodic_pairs(points(spark, sf_dir), _BOX, 3.0), 6, "d2")


@query(_PAIRS + ", n AS (SELECT i AS id, j, d2 FROM q WHERE d2 <= 9.0 UNION ALL SELECT j, i, d2 FROM q WHERE d2 <= 9.0) SELECT p.id, arg_min(j, (d2, j)) AS nearest, round(sqrt(min(d2)), 6) AS distance FROM p LEFT JOIN n ON n.id = p.id GROUP BY p.id")
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point, with its nearest one if that is within a radius."""
    return rounded(spatial.nearest_within(points(spark, sf_dir), _BOX, 3.0), 6, "distance")


@query(f"""WITH p AS ({_POINTS}), q AS (SELECT a.id, b.id AS j, {_gap('x')} ** 2 + {_gap('y')} ** 2 + {_gap('z')} ** 2 AS d2 FROM p a JOIN p b ON a.id <> b.id)
 SELECT id, arg_min(j, (d2, j)) AS nearest, round(sqrt(min(d2)), 6) AS distance FROM q GROUP BY id""")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point's nearest other one, however far."""
    return rounded(spatial.nearest(points(spark, sf_dir), _BOX), 6, "distance")


@query(_PAIRS + ", n AS (SELECT i, j FROM q WHERE d2 <= 9.0 UNION ALL SELECT j, i FROM q WHERE d2 <= 9.0) SELECT i, count(*) AS degree, array_to_string(list(j ORDER BY j), ',') AS neighbours FROM n GROUP BY i")
def pair_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each point."""
    return spatial.neighbours(points(spark, sf_dir), _BOX, 3.0).withColumn("neighbours", F.array_join("neighbours", ","))


@query(_PAIRS + f""", r AS (SELECT unnest([0.5, 1.0, 2.0, 3.0])::DOUBLE AS radius), n AS (SELECT count(*) AS n FROM p), c AS (SELECT radius, count(d2) AS pairs FROM r LEFT JOIN q ON d2 <= radius * radius GROUP BY 1)
 SELECT radius, pairs, round(2.0 * pairs * {_BOX**3} / (n * n), 6) AS ripley_k, round(cbrt(2.0 * pairs * {_BOX**3} / (n * n) * 3 / (4 * pi())) - radius, 6) AS l_minus_r FROM c, n""")
def ripley_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair counts within four radii against a random pattern."""
    return rounded(spatial.ripley_k(points(spark, sf_dir), _BOX, [0.5, 1.0, 2.0, 3.0]), 6, "ripley_k", "l_minus_r")


@query(_PAIRS + f""", n AS (SELECT count(*) AS n FROM p), c AS (SELECT least(floor(sqrt(d2) / 0.5), 5)::INT AS bin, count(*) AS pairs FROM q WHERE d2 <= 9.0 GROUP BY 1)
 SELECT bin, pairs, round(2.0 * pairs * {_BOX**3} / (n * n) / (4.0 / 3.0 * pi() * 0.125 * ((bin + 1.0) ** 3 - bin ** 3)), 4) AS g FROM c, n""")
def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g(r) in six shells."""
    return rounded(spatial.pair_correlation(points(spark, sf_dir), _BOX, 3.0, 0.5), 4, "g")


@query(f"SELECT floor(x / {_BOX} * 8)::INT AS cx, floor(y / {_BOX} * 8)::INT AS cy, floor(z / {_BOX} * 8)::INT AS cz, count(*) AS points FROM ({_POINTS}) GROUP BY 1, 2, 3")
def occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points per cell."""
    return spatial.occupancy(points(spark, sf_dir), _BOX, 8)


_GRID = 32
_VOXELS = f"SELECT DISTINCT (o_orderkey % {_GRID})::INT AS ix, ((o_orderkey // {_GRID}) % {_GRID})::INT AS iy, (o_custkey % {_GRID})::INT AS iz FROM orders WHERE o_orderstatus <> 'P'"


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solid voxels of a grid, from the orders that are not pending."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    at = lambda c: (c % _GRID).cast("int")
    return orders.select(at(F.col("o_orderkey")).alias("ix"), at(F.floor(F.col("o_orderkey") / _GRID)).alias("iy"), at(F.col("o_custkey")).alias("iz"), F.lit(1).alias("phase")).distinct()


@query(f"""WITH v AS ({_VOXELS}), a AS (SELECT unnest([[1,0,0],[0,1,0],[0,0,1],[-1,0,0],[0,-1,0],[0,0,-1]]) AS s), m AS (SELECT (ix + s[1] + {_GRID}) % {_GRID} AS ix, (iy + s[2] + {_GRID}) % {_GRID} AS iy, (iz + s[3] + {_GRID}) % {_GRID} AS iz FROM v, a)
 SELECT count(*) AS crossings, round(count(*) / {3.0 * _GRID**3}, 8) AS interface_density FROM m ANTI JOIN v USING (ix, iy, iz)""")
def interface_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of voxel faces between solid and void."""
    return rounded(spatial.interface_density(voxels(spark, sf_dir), _GRID), 8, "interface_density")


@query(f"""WITH v AS ({_VOXELS}), b AS (SELECT x.range AS x, y.range AS y, z.range AS z FROM range(8) x, range(8) y, range(8) z), c AS (SELECT ix // 4 AS x, iy // 4 AS y, iz // 4 AS z, count(*) AS c FROM v GROUP BY 1, 2, 3)
 SELECT round(avg(coalesce(c, 0) / 64.0), 8) AS mean_fraction, round(stddev_pop(coalesce(c, 0) / 64.0) / avg(coalesce(c, 0) / 64.0), 6) AS variation FROM b LEFT JOIN c USING (x, y, z)""")
def block_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variation of the solid fraction over blocks."""
    return rounded(rounded(spatial.block_variation(voxels(spark, sf_dir), _GRID, 8), 8, "mean_fraction"), 6, "variation")


# Vectors: an embedding's first three numbers, normalised, are a direction; all of it is a snapshot.

_DIRECTIONS = "SELECT vec_id, label, embedding[1]::DOUBLE / l AS ux, embedding[2]::DOUBLE / l AS uy, embedding[3]::DOUBLE / l AS uz FROM (SELECT *, sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2) AS l FROM embeddings)"
_U = ("ux", "uy", "uz")


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and a unit direction."""
    parts = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", *(p.alias(n) for p, n in zip(parts, _U, strict=True)))
    length = F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2)
    return rows.withColumn("l", length).select("vec_id", "label", *((F.col(n) / F.col("l")).alias(n) for n in _U))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and the embedding as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query("SELECT label, " + ", ".join(f"round(avg(u{'xyz'[i]} * u{'xyz'[j]}), 8) AS a{i + 1}{j + 1}" for i in range(3) for j in range(i, 3)) + f" FROM ({_DIRECTIONS}) GROUP BY label")
def second_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orientation tensor by label."""
    out = spatial.second_moment(directions(spark, sf_dir), _U, ["label"])
    return rounded(out, 8, *(c for c in out.columns if c != "label"))


@query("SELECT " + ", ".join(f"round(avg(u{'xyz'[i]} * u{'xyz'[j]} * u{'xyz'[k]} * u{'xyz'[m]}), 8) AS a{i + 1}{j + 1}{k + 1}{m + 1}" for i in range(3) for j in range(i, 3) for k in range(j, 3) for m in range(k, 3)) + f" FROM ({_DIRECTIONS})")
def fourth_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth-order orientation tensor."""
    out = spatial.fourth_moment(directions(spark, sf_dir), _U)
    return rounded(out, 8, *out.columns)


@query(f"""WITH k AS (SELECT round_even(ux * 4, 0)::BIGINT AS k0, round_even(uy * 4, 0)::BIGINT AS k1, round_even(uz * 4, 0)::BIGINT AS k2, count(*) AS n, avg(ux) AS x, avg(uy) AS y, avg(uz) AS z FROM ({_DIRECTIONS}) GROUP BY 1, 2, 3), l AS (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM k)
 SELECT k0, k1, k2, n, round(x / l, 6) AS ux, round(y / l, 6) AS uy, round(z / l, 6) AS uz FROM l""")
def orientation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions grouped by their rounded values, with a normalised mean."""
    return rounded(spatial.quantised_directions(directions(spark, sf_dir), _U, 4.0), 6, *_U)


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64))::INT AS i FROM embeddings)
 SELECT a.i, b.i AS j, round(sum(a.v * b.v), 4) AS value FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2""")
def moment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second moment of all snapshots."""
    return rounded(linalg.moment_matrix(snapshots(spark, sf_dir), "v"), 4, "value")


_PROBES = "SELECT vec_id AS probe, embedding AS p FROM embeddings WHERE vec_id % 20 = 0"


@query(f"""SELECT vec_id, probe, round(list_dot_product(embedding::DOUBLE[], p::DOUBLE[]), 6) AS value FROM embeddings, ({_PROBES})""")
def gram_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products of all snapshots with a stated set of probes, those whose id is divisible by 20."""
    rows = snapshots(spark, sf_dir)
    return rounded(linalg.gram_entries(rows, "vec_id", "v", rows.filter("vec_id % 20 = 0")), 6, "value")


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(sqrt(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS relative FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and relative error of each snapshot against the next one."""
    rows = snapshots(spark, sf_dir)
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    out = rows.join(after, "vec_id").select("vec_id", linalg.cosine(F.col("v"), F.col("w")).alias("cosine"), T.relative_error(F.col("v"), F.col("w")).alias("relative"))
    return rounded(out, 6, "cosine", "relative")


_STEPS = (1327, 2311, 3571)
_CORNERS = [tuple((i * a % 4001 + 1) / 4001 for a in _STEPS) for i in range(1, 4001)]


@query(f"""WITH p AS ({_POINTS}), c AS (SELECT {", ".join(f"((i * {a}) % 4001 + 1) / 4001.0::DOUBLE AS {n}" for n, a in zip("abc", _STEPS, strict=True))} FROM (SELECT unnest(range(1, 4001)) AS i)),
 s AS (SELECT a, b, c, avg((x / {_BOX} <= a AND y / {_BOX} <= b AND z / {_BOX} <= c)::INT) AS share FROM p, c GROUP BY 1, 2, 3) SELECT round(max(abs(share - a * b * c)), 8) AS discrepancy FROM s""")
def star_discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the points are from uniform, over 4,000 stated boxes."""
    return rounded(spatial.star_discrepancy(points(spark, sf_dir), _BOX, _CORNERS), 8, "discrepancy")


_FIBRES = f"SELECT p.*, ux, uy, uz FROM ({_POINTS}) p JOIN ({_DIRECTIONS}) ON vec_id = id % (SELECT count(*) FROM embeddings)"


def fibres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point with one of all directions in turn (their ids are 0, 1, 2, ...)."""
    way = directions(spark, sf_dir)
    return points(spark, sf_dir).withColumn("vec_id", F.col("id") % way.count()).join(way, "vec_id").select("id", "x", "y", "z", *_U)


@query(f"""SELECT count(*) AS fibres, sum((x - abs(ux) * 5 < 0 OR x + abs(ux) * 5 > {_BOX} OR y - abs(uy) * 5 < 0 OR y + abs(uy) * 5 > {_BOX} OR z - abs(uz) * 5 < 0 OR z + abs(uz) * 5 > {_BOX})::INT)::BIGINT AS crossing
 FROM ({_FIBRES})""")
def crossing_fibres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fibres of length 10 around the points that leave the box."""
    return spatial.crossing_count(fibres(spark, sf_dir), _BOX, 10.0)


_HALF, _WIDTH = 1.2, 0.6
#: Cells of the box along an axis in SQL: as wide as two fibres reach at least.
_CELLS = int(_BOX / (2 * _HALF + _WIDTH))


def _at(s: str, t: str) -> str:
    return f"(g2 + ({s}) ** 2 + ({t}) ** 2 - 2 * ({s}) * du + 2 * ({t}) * dv - 2 * ({s}) * ({t}) * b)"


def _clip(x: str) -> str:
    return f"least(greatest({x}, {-_HALF}::DOUBLE), {_HALF}::DOUBLE)"


_OVERLAPS = (
    f"WITH f AS ({_FIBRES}), c AS (SELECT *, {', '.join(f'least(floor({a} / {_BOX} * {_CELLS})::INT, {_CELLS - 1}) AS c{a}' for a in 'xyz')} FROM f), w AS (SELECT unnest([-1, 0, 1]) AS w),"
    f" d AS (SELECT id, x, y, z, ux, uy, uz, {', '.join(f'(c{a} + {a}{a}.w + {_CELLS}) % {_CELLS} AS c{a}' for a in 'xyz')} FROM c, w xx, w yy, w zz), e AS (SELECT * FROM c),"
    f" g AS (SELECT a.id AS i, b.id AS j, a.ux AS u1, a.uy AS u2, a.uz AS u3, b.ux AS v1, b.uy AS v2, b.uz AS v3, {_gap('x')} AS g1, {_gap('y')} AS gy, {_gap('z')} AS gz FROM d a JOIN e b ON a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz AND a.id < b.id),"
    " h AS (SELECT i, j, g1 * g1 + gy * gy + gz * gz AS g2, g1 * u1 + gy * u2 + gz * u3 AS du, g1 * v1 + gy * v2 + gz * v3 AS dv, u1 * v1 + u2 * v2 + u3 * v3 AS b FROM g),"
    f" k AS (SELECT i, j, least({', '.join([_at(_clip(f'du + b * {t}'), str(t)) for t in (-_HALF, _HALF)] + [_at(str(s), _clip(f'b * {s} - dv')) for s in (-_HALF, _HALF)])},"
    f" CASE WHEN 1 - b * b > 1e-12 AND abs((du - b * dv) / (1 - b * b)) <= {_HALF} AND abs((b * du - dv) / (1 - b * b)) <= {_HALF} THEN {_at('(du - b * dv) / (1 - b * b)', '(b * du - dv) / (1 - b * b)')} END) AS d2"
    f" FROM h WHERE g2 <= {2 * _HALF + _WIDTH}::DOUBLE ** 2), o AS (SELECT i, j, {_WIDTH}::DOUBLE - sqrt(greatest(d2, 0)) AS overlap FROM k)"
)


@query(_OVERLAPS + " SELECT i, j, round(overlap, 6) AS overlap FROM o WHERE overlap > 0")
def segment_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of fibres that overlap, by the distance of their axes."""
    return rounded(spatial.segment_overlaps(fibres(spark, sf_dir), _BOX, 2 * _HALF, _WIDTH), 6, "overlap")


@query(_OVERLAPS + " SELECT count(*) AS pairs, round(coalesce(max(overlap), 0), 6) AS overlap FROM o WHERE overlap > 0")
def max_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of overlapping pairs of fibres and the largest overlap."""
    return rounded(spatial.max_overlap(fibres(spark, sf_dir), _BOX, 2 * _HALF, _WIDTH), 6, "overlap")


# Designs: part k takes point k of a Sobol sequence.


def _sobol_sql(dimension: int) -> str:
    out = "0"
    for k, v in enumerate(S.directions(dimension)):
        out = f"xor({out}, CASE WHEN g & {1 << k} <> 0 THEN {v} ELSE 0 END)"
    return f"{out} / {float(1 << S.BITS)}::DOUBLE"


_NINE = (*M.BOX, "u", "v")


@query(
    "WITH g AS (SELECT p_partkey, xor(p_partkey, p_partkey >> 1) AS g FROM part) SELECT p_partkey, "
    + ", ".join(f"{M.BOX[n][0]}::DOUBLE + ({_sobol_sql(d)}) * {M.BOX[n][1] - M.BOX[n][0]!r}::DOUBLE AS {n}" if n in M.BOX else f"{_sobol_sql(d)} AS {n}" for d, n in enumerate(_NINE))
    + " FROM g"
)
def sobol_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of materials and two orientation coordinates from a Sobol sequence."""
    unit = {n: S.sobol(F.col("p_partkey"), d) for d, n in enumerate(_NINE)}
    columns = [M.from_unit(c, n).alias(n) if n in M.BOX else c.alias(n) for n, c in unit.items()]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey")).select("p_partkey", *columns)


@query(
    "WITH g AS (SELECT p_partkey, xor(p_partkey, p_partkey >> 1) AS g FROM part), s AS (SELECT p_partkey, "
    + ", ".join(f"{M.BOX[n][0]}::DOUBLE + ({_sobol_sql(d)}) * {M.BOX[n][1] - M.BOX[n][0]!r}::DOUBLE AS {n}" if n in M.BOX else f"{_sobol_sql(d)} AS {n}" for d, n in enumerate(_NINE))
    + " FROM g), f AS (SELECT *, CASE WHEN u + v > 1 THEN 1 - u ELSE u END AS b11, CASE WHEN u + v > 1 THEN 1 - v ELSE v END AS b22 FROM s), d AS (SELECT *, nu_LT * nu_LT * Ef_T / Ef_L AS k FROM f),"
    + " r AS (SELECT *, CASE WHEN Ef_L < Ef_T THEN 'Ef_L_less_than_Ef_T' WHEN NOT (k < 1 AND 1 - nu_TT - 2 * k > 0) THEN 'fiber_compliance_not_positive_definite' ELSE '' END AS reject_reason FROM d)"
    + f" SELECT p_partkey, {', '.join(M.BOX)}, round_even(b11, 6) AS a11, round_even(b22, 6) AS a22, greatest(round_even(1 - b11 - b22, 6), 0) AS a33, (ceil(2.0 * (5.0 + 20.0 * u) * 6.0 / 8) * 8)::INT AS nvox, reject_reason,"
    + " CASE WHEN reject_reason = '' THEN (sum((reject_reason = '')::INT) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) - 1)::BIGINT END AS design_id FROM r"
)
def sobol_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool as designs: folded orientation, grid size, first broken rule, and ids of the operable ones."""
    pool = sobol_pool(spark, sf_dir)
    designs = pool.select("*", *(c.alias(n) for n, c in O.folded_triangle(F.col("u"), F.col("v")).items()))
    reason = O.reject_reason()
    designs = designs.withColumn("reject_reason", F.when(reason != "", reason).otherwise(M.reject_reason()))
    designs = designs.withColumn("nvox", S.ceil_to_multiple(F.lit(2.0) * (5.0 + 20.0 * F.col("u")) * 6.0, 8))
    numbered = relational.numbered_where(designs, ["p_partkey"], F.col("reject_reason") == "", "design_id", "designs")
    return numbered.select("p_partkey", *M.BOX, "a11", "a22", "a33", "nvox", "reject_reason", "design_id")


# Models, selections and streams. SQL cannot express these but for the first and the last.


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64))::INT AS i FROM embeddings), m AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS value FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2)
 SELECT round(sum(value) FILTER (i = j), 3) AS energy, round(sum(value * value) / (sum(value) FILTER (i = j)) ** 2, 8) AS concentration FROM m""")
def mode_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sums over the modes' energies that the second moment's entries give as well: of them, and of their squares."""
    energies, _ = linalg.modes(snapshots(spark, sf_dir), "v")
    rows = spark.createDataFrame([(i, float(e)) for i, e in enumerate(energies)], "mode int, energy double")
    total = F.sum("energy")
    return rows.agg(F.round(total, 3).alias("energy"), F.round(F.sum(F.col("energy") * F.col("energy")) / (total * total), 8).alias("concentration"))


@query()
def projection_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error statistics of projections on 0 to 64 modes."""
    rows = snapshots(spark, sf_dir)
    _, basis = linalg.modes(rows, "v")
    errors = linalg.projection_errors(rows, "vec_id", "v", basis, [0, 1, 2, 4, 8, 16, 32, 48, 64])
    return statistics.error_statistics(errors, ["rank"], "error", "vec_id")


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(64))::INT AS i FROM embeddings), m AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS value FROM e a JOIN e b USING (vec_id) WHERE a.label = 0 GROUP BY 1, 2),
 p AS (SELECT e.vec_id, m.j, sum(e.v * m.value) AS w FROM e JOIN m USING (i) WHERE label <> 0 GROUP BY 1, 2)
 SELECT p.vec_id, round(sum(p.w * e.v) / sum(e.v * e.v), 5) AS score FROM p JOIN e ON e.vec_id = p.vec_id AND e.i = p.j GROUP BY 1""")
def influence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of label 0's snapshots lies along each other snapshot."""
    rows = snapshots(spark, sf_dir)
    moment = linalg.collected_matrix(linalg.moment_matrix(rows.filter("label = 0"), "v"))
    return rounded(linalg.influence(rows.filter("label <> 0"), "vec_id", "v", moment), 5, "score")


@query()
def maximin_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten parts far from each other in size and price, from part 1 on."""
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("size"), (F.col("p_retailprice") / 2000.0).alias("price"))
    return linalg.farthest_points(parts, "p_partkey", ["size", "price"], 1, 10)


# Fields: every snapshot is a voxel with the strains of eleven fields (its 64 numbers and two zeros); labels from 5 on are
# fibres along the voxel's direction.

_RANK = 11


def field_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, phase, axis and the strains of eleven fields."""
    rows = snapshots(spark, sf_dir).select("vec_id", (F.col("label") >= 5).cast("int").alias("phase"), F.concat("v", F.array(F.lit(0.0), F.lit(0.0))).alias("v"))
    return rows.join(directions(spark, sf_dir).drop("label"), "vec_id")


_STRAINS = f"""WITH d AS ({_DIRECTIONS}), w AS (SELECT vec_id, label >= 5 AS fibre, ux, uy, uz, list_concat(embedding::DOUBLE[], [0.0, 0.0]::DOUBLE[]) AS v FROM embeddings JOIN d USING (vec_id, label)),
 k AS (SELECT vec_id, fibre, ux, uy, uz, k, v[6*k+1] AS e1, v[6*k+2] AS e2, v[6*k+3] AS e3, v[6*k+4] AS e4, v[6*k+5] AS e5, v[6*k+6] AS e6 FROM w, (SELECT unnest(range({_RANK}))::INT AS k)),
 s AS (SELECT *, e1 + e2 + e3 AS tr, ux*ux*e1 + uy*uy*e2 + uz*uz*e3 + sqrt(2.0::DOUBLE) * (uy*uz*e4 + ux*uz*e5 + ux*uy*e6) AS en,
  e1*ux + (e6*uy + e5*uz) / sqrt(2.0::DOUBLE) AS p1, e2*uy + (e6*ux + e4*uz) / sqrt(2.0::DOUBLE) AS p2, e3*uz + (e5*ux + e4*uy) / sqrt(2.0::DOUBLE) AS p3 FROM k)"""


_FORMS = ("ta*tb", "2*dot", "dot - na*nb - 2*shear", "(ta-na)*(tb-nb) - (dot - na*nb - 2*shear)", "na*(tb-nb) + (ta-na)*nb", "na*nb", "4*shear")
#: Sums of all forms over fields and, from 100 on, unit strains: K is of two fields, B of a field and a unit, D of two units.
_OPERATORS = _STRAINS + f""", units AS (SELECT i AS u, {", ".join(f"(i = {c})::INT::DOUBLE AS e{c}" for c in range(1, 7))} FROM (SELECT unnest(range(1, 7)) AS i)),
 joint AS (SELECT vec_id, fibre, ux, uy, uz, k, e1, e2, e3, e4, e5, e6 FROM k UNION ALL SELECT vec_id, fibre, ux, uy, uz, 99 + u, e1, e2, e3, e4, e5, e6 FROM w, units),
 z AS (SELECT *, e1 + e2 + e3 AS tr, ux*ux*e1 + uy*uy*e2 + uz*uz*e3 + sqrt(2.0::DOUBLE) * (uy*uz*e4 + ux*uz*e5 + ux*uy*e6) AS en,
  e1*ux + (e6*uy + e5*uz) / sqrt(2.0::DOUBLE) AS p1, e2*uy + (e6*ux + e4*uz) / sqrt(2.0::DOUBLE) AS p2, e3*uz + (e5*ux + e4*uy) / sqrt(2.0::DOUBLE) AS p3 FROM joint),
 n AS (SELECT count(*) AS n FROM w), p AS (SELECT a.fibre, a.k AS i, b.k AS j, a.tr AS ta, b.tr AS tb, a.en AS na, b.en AS nb, a.e1*b.e1 + a.e2*b.e2 + a.e3*b.e3 + a.e4*b.e4 + a.e5*b.e5 + a.e6*b.e6 AS dot,
  a.p1*b.p1 + a.p2*b.p2 + a.p3*b.p3 - a.en*b.en AS shear FROM z a JOIN z b USING (vec_id)),
 t AS (SELECT i, j, {", ".join(f"sum(CASE WHEN {'fibre' if q > 1 else 'NOT fibre'} THEN {e} ELSE 0 END) AS q{q}" for q, e in enumerate(_FORMS))} FROM p GROUP BY 1, 2),
 o AS (SELECT CASE WHEN i < 100 AND j < 100 THEN 'K' WHEN i < 100 THEN 'B' WHEN j >= 100 THEN 'D' END AS part, q, i % 100 AS i, j % 100 AS j, round([q0, q1, q2, q3, q4, q5, q6][q + 1] / n, 6) + 0.0::DOUBLE AS value FROM t, n, (SELECT unnest(range(7))::INT AS q))"""


@query(_OPERATORS + " SELECT q, i, j, value FROM o WHERE part = 'K'")
def reduced_stiffness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven reduced stiffnesses of eleven fields, summed over all voxels."""
    found = fields.operators(field_voxels(spark, sf_dir), "v", _RANK)
    return rounded(found.filter("part = 'K'").drop("part"), 6, "value")


@query(_OPERATORS + " SELECT part, q, i, j, value FROM o WHERE part IN ('B', 'D')")
def reduced_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduced loads and constants of all seven coefficients."""
    found = fields.operators(field_voxels(spark, sf_dir), "v", _RANK)
    return rounded(found.filter("part <> 'K'"), 6, "value")


@query(_OPERATORS + " SELECT part, q, i, j, value FROM o WHERE part IS NOT NULL")
def extended_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operators of eleven fields, from those of the first six and what the other five add."""
    voxels = field_voxels(spark, sf_dir)
    stored = materialize(fields.operators(voxels, "v", 6), "operators")
    return rounded(fields.extended(stored, voxels, "v", _RANK, 6), 6, "value")


@query(_STRAINS + f""", f AS (SELECT vec_id, k, e1, e2, e3, e4, e5, e6 FROM k UNION ALL SELECT a.vec_id, {_RANK}, {", ".join(f"a.e{c} - 2 * b.e{c}" for c in range(1, 7))} FROM k a JOIN k b USING (vec_id) WHERE a.k = 0 AND b.k = 3),
 g AS (SELECT a.k AS i, b.k AS j, sum(a.e1*b.e1 + a.e2*b.e2 + a.e3*b.e3 + a.e4*b.e4 + a.e5*b.e5 + a.e6*b.e6) / (6 * count(*)) AS value FROM f a JOIN f b USING (vec_id) GROUP BY 1, 2)
 SELECT i, j, round(value, 8) AS product, CASE WHEN i < {_RANK} AND j < {_RANK} THEN (i = j)::INT::DOUBLE END AS overlap FROM g""")
def orthonormal_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve fields, one a combination of two others, by their parts along an orthonormal basis; and the basis' products.

    product: of two fields, by their parts along the basis, which is the fields' own product if it spans them. overlap:
    of two basis fields. Half of the basis is appended to the other half.
    """
    voxels, half = field_voxels(spark, sf_dir), 6
    component = lambda f, c: F.col("v")[6 * f + c]
    whole = voxels.withColumn("v", F.concat("v", F.array(*(component(0, c) - 2.0 * component(3, c) for c in range(6)))))
    split = whole.select("vec_id", "v", F.slice("v", 1, 6 * half).alias("basis"), F.slice("v", 6 * half + 1, 6 * (_RANK + 1 - half)).alias("fresh"))
    first, kept = bases.orthonormalised(split, "basis", half, 6)
    both, added = bases.appended(first, "basis", "fresh", (len(kept), _RANK + 1 - half), 6)
    n = len(kept) + len(added)
    parts, own = bases.products(both, "basis", "v", (n, _RANK + 1), 6), bases.products(both, "basis", "basis", (n, n), 6)
    product = parts.T @ parts
    rows = [(i, j, round(float(product[i, j]), 8) + 0.0, round(float(own[i, j]), 11) + 0.0 if max(i, j) < n else None) for i in range(_RANK + 1) for j in range(_RANK + 1)]
    return spark.createDataFrame(rows, "i int, j int, product double, overlap double")


@query(_STRAINS + " SELECT a.k AS i, b.k AS j, round(sum(a.e1*b.e1 + a.e2*b.e2 + a.e3*b.e3 + a.e4*b.e4 + a.e5*b.e5 + a.e6*b.e6) / (6 * count(*)), 8) AS value FROM s a JOIN s b USING (vec_id) GROUP BY 1, 2")
def snapshot_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products of eleven fields, by blocks of voxels."""
    return rounded(fields.snapshot_gram(field_voxels(spark, sf_dir), "v", _RANK), 8, "value")


@query(_STRAINS + """, g AS (SELECT a.k AS i, b.k AS j, sum(a.e1*b.e1 + a.e2*b.e2 + a.e3*b.e3 + a.e4*b.e4 + a.e5*b.e5 + a.e6*b.e6) / (6 * count(*)) AS value FROM s a JOIN s b USING (vec_id) GROUP BY 1, 2)
 SELECT round(sum(value) FILTER (i = j), 6) AS energy, round(sum(value * value) / (sum(value) FILTER (i = j)) ** 2, 8) AS concentration FROM g""")
def snapshot_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the energies of eleven fields' modes, and over their squares."""
    gram = linalg.collected_matrix(fields.snapshot_gram(field_voxels(spark, sf_dir), "v", _RANK))
    energies, _ = fields.snapshot_modes(gram)
    rows = spark.createDataFrame([(i, float(e)) for i, e in enumerate(energies)], "mode int, energy double")
    total = F.sum("energy")
    return rows.agg(F.round(total, 6).alias("energy"), F.round(F.sum(F.col("energy") * F.col("energy")) / (total * total), 8).alias("concentration"))


@query()
def reduced_model_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of three outputs of the reduced model over all materials."""
    model = fields.reduced_model(field_voxels(spark, sf_dir), "v", _RANK)
    answers = reduced_model.answer(M.coefficients(materials(spark, sf_dir)), "material_id", list(COEFFICIENTS), model)
    return reduced_model.uncertainty(answers, ["c11", "c22", "c44"])


@query()
def reduced_model_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error statistics of smaller models against the full one."""
    model = fields.reduced_model(field_voxels(spark, sf_dir), "v", _RANK)
    return reduced_model.rank_curve(M.coefficients(materials(spark, sf_dir)), "material_id", list(COEFFICIENTS), model, [0, 2, 4, 6, 8, 10, 11])


@query()
def reduced_model_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each material's error and its bound with a small model."""
    model = fields.reduced_model(field_voxels(spark, sf_dir), "v", _RANK)
    return reduced_model.certified(M.coefficients(materials(spark, sf_dir)), "material_id", list(COEFFICIENTS), model, 6)


@query()
def reduced_model_sensitivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest norm of the outputs' derivative by each coefficient."""
    model = fields.reduced_model(field_voxels(spark, sf_dir), "v", _RANK)
    slopes = reduced_model.sensitivities(M.coefficients(materials(spark, sf_dir)), "material_id", list(COEFFICIENTS), model)
    return slopes.groupBy("term").agg(F.avg("norm").alias("mean_norm"), F.max("norm").alias("max_norm"))


@query()
def inverse_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients found back from every material's answer."""
    model = fields.reduced_model(field_voxels(spark, sf_dir), "v", _RANK)
    rows = M.coefficients(materials(spark, sf_dir))
    answers = reduced_model.answer(rows, "material_id", list(COEFFICIENTS), model)
    bounds = rows.agg(*(F.min(c).alias(f"low_{c}") for c in COEFFICIENTS), *(F.max(c).alias(f"high_{c}") for c in COEFFICIENTS)).first()
    low, high = ([0.9 * bounds[f"low_{c}"] for c in COEFFICIENTS], [1.1 * bounds[f"high_{c}"] for c in COEFFICIENTS])
    names = [f"c{i}{j}" for i in range(1, 7) for j in range(1, 7)]
    return reduced_model.identify(answers, "material_id", names, model, low, high)


@query(_STRAINS + """, f AS (SELECT vec_id, k, [e1, e2, e3, e4, e5, e6] AS e FROM k), p AS (SELECT k, sqrt(sum(list_dot_product(e, e)) / (6 * count(*))) AS score FROM f GROUP BY k)
 SELECT (row_number() OVER (ORDER BY score DESC, k) - 1)::INT AS position, k::INT AS field, round(score, 8) AS score FROM p ORDER BY score DESC, k LIMIT 3""")
def first_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first batch of the fields' selection: the three largest."""
    found = fields.adaptive_fields(field_voxels(spark, sf_dir), "vec_id", "v", _RANK, 3, 1, 1e-6)
    return rounded(found, 8, "score")


@query()
def adaptive_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields chosen three at a time, each the worst represented so far."""
    return fields.adaptive_fields(field_voxels(spark, sf_dir), "vec_id", "v", _RANK, 3, 4, 1e-6)


@query()
def adaptive_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots chosen in batches, each the worst represented so far."""
    return reduced_model.adaptive_selection(snapshots(spark, sf_dir), "vec_id", "v", 4, 6, 1e-6)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files (a pattern, since a stream's source is no single file)."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"""WITH r AS (SELECT *, CASE WHEN n >= 10 AND abs(mean) > 1e-12 THEN 1.96 * std / (sqrt(n) * abs(mean)) END AS error FROM ({_RUNNING})),
 o AS (SELECT *, coalesce(error <= 0.25, false) AS ok FROM r),
 s AS (SELECT *, n - coalesce(max(CASE WHEN NOT ok THEN n END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS stable FROM o)
 SELECT user_id, coalesce(min(n) FILTER (stable >= 3), max(n)) AS n, round(coalesce(arg_min(mean, n) FILTER (stable >= 3), arg_max(mean, n)), 6) AS mean, coalesce(bool_or(stable >= 3), false) AS converged FROM s GROUP BY user_id""")
def online_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stopping rule over a stream of events, each user's last state."""
    stream = event_stream(spark, sf_dir)
    states = online.run_available(online.online_convergence(stream, "user_id", "event_id", "value", 0.25, 1.96, 10, 3), "online")
    last = states.groupBy("user_id").agg(F.max_by(F.struct("n", "mean", "converged"), F.struct("n", "converged")).alias("s"))
    return rounded(last.select("user_id", "s.*"), 6, "mean")


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and means of six-hour windows over a stream of events."""
    stream = event_stream(spark, sf_dir)
    rows = online.run_available(online.windowed_counts(stream, "ts", "event_type", "6 hours", "1 hour"), "windows")
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "mean"), "n").alias("s"))
    return rounded(last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "s.*"), 6, "mean")
