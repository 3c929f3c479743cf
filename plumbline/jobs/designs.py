"""Queries of designs, pools, settings and benchmark summaries, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import designs as D
from plumbline.functions import materials as M
from plumbline.functions import sequences as S
from plumbline.functions import tensors as T
from plumbline.jobs.catalog import _sobol_sql, query, rounded
from plumbline.operators import campaign, statistics
from plumbline.sources.tables import table

# Pools: part 0 is the middle of the box, the others are points of a shifted Sobol sequence.

_SHIFT = {n: (d + 1) * 118_731_537 % (1 << S.BITS) for d, n in enumerate(M.BOX)}


def _pool_sql(source: str, seed: int = 0) -> str:
    cells = []
    for d, (n, (low, high)) in enumerate(M.BOX.items()):
        bits = _sobol_sql(d).rsplit(" / ", 1)[0]
        cells.append(f"CASE WHEN id = 0 THEN {(low + high) / 2!r}::DOUBLE ELSE {low!r}::DOUBLE + (xor({bits}, {_SHIFT[n] ^ seed}) / {float(1 << S.BITS)}::DOUBLE) * {high - low!r}::DOUBLE END AS {n}")
    return f"SELECT id, {', '.join(cells)} FROM (SELECT id, xor(i, i >> 1) AS g FROM (SELECT id, greatest(id - 1, 0) AS i FROM {source}))"


def pool(ids: DataFrame, seed: int = 0) -> DataFrame:
    """id (long) with the seven parameters: the middle of the box for id 0, point id - 1 of a shifted sequence else."""
    index = F.greatest(F.col("id") - 1, F.lit(0).cast("long"))
    cells = [F.when(F.col("id") == 0, F.lit((low + high) / 2)).otherwise(F.lit(low) + S.sobol(index, d, _SHIFT[n] ^ seed) * F.lit(high - low)).alias(n) for d, (n, (low, high)) in enumerate(M.BOX.items())]
    return ids.select("id", *cells)


@query(f"WITH p AS ({_pool_sql('(SELECT p_partkey AS id FROM part)')}) SELECT id, printf('candidate_%05d', id) AS label, {', '.join(f'round(round_even({n}, 9), 6) AS {n}' for n in M.BOX)} FROM p")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled pool of candidates, one a part, with the middle of the box as the first."""
    rows = pool(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id")))
    return rounded(rounded(rows, 9, *M.BOX).withColumn("label", F.format_string("candidate_%05d", "id")), 6, *M.BOX)


@query(f"WITH v AS ({_pool_sql('(SELECT p_partkey AS id FROM part WHERE p_partkey % 4 = 1)', 12345)}) SELECT id, {', '.join(f'round(round_even({n}, 9), 6) AS {n}' for n in M.BOX)} FROM v")
def validation_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another pool that shares no point with the candidates, which is checked."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"))
    candidates, own = (rounded(rounded(x, 9, *M.BOX), 6, *M.BOX) for x in (pool(parts), pool(parts.filter("id % 4 = 1"), 12345)))
    return campaign.require_disjoint(own, candidates, list(M.BOX))


# Designs: a part's numbers as a fibre's diameter, aspect ratio and volume fraction.

_STATES = tuple(D.ORIENTATION_STATES)
_PER_DIAMETER, _MULTIPLE = 6.0, 8
_DESIGN = ("L_um", "caja_um", "nvox", "res", "voxel_um", "df_voxel", "Lf_Ldom")


@query(f"""WITH p AS (SELECT p_partkey, 5.0::DOUBLE + p_size / 10.0::DOUBLE AS d, 5.0::DOUBLE + p_partkey % 16 AS ar, 0.05::DOUBLE + (p_partkey % 11) / 50.0::DOUBLE AS vf, 20 + p_partkey % 80 AS k FROM part),
 b AS (SELECT *, ar * d AS l, pow(k * ({math.pi!r}::DOUBLE * d * d * (ar * d) / 4) / vf, 1.0 / 3.0::DOUBLE) AS box FROM p), g AS (SELECT *, (ceil({_PER_DIAMETER}::DOUBLE * box / d / {_MULTIPLE}) * {_MULTIPLE})::INT AS nvox FROM b)
 SELECT p_partkey, round(l, 6) AS L_um, round(box, 6) AS caja_um, nvox, round(nvox / box, 6) AS res, round(box / nvox, 6) AS voxel_um, round(d * nvox / box, 6) AS df_voxel, round(l / box, 6) AS Lf_Ldom,
  round([{', '.join(repr(D.ORIENTATION_STATES[s][0]) for s in _STATES)}][p_partkey % 3 + 1]::DOUBLE, 6) AS a11, round([{', '.join(repr(D.ORIENTATION_STATES[s][2]) for s in _STATES)}][p_partkey % 3 + 1]::DOUBLE, 6) AS a33,
  nvox AS estimated_voxels, k::BIGINT AS estimated_fibres FROM g""")
def fixed_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes for a stated number of fibres, and what the estimates give back from them."""
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", (5.0 + F.col("p_size") / 10.0).alias("d"), (5.0 + F.col("p_partkey") % 16).alias("ar"), (0.05 + (F.col("p_partkey") % 11) / 50.0).alias("vf"), (20 + F.col("p_partkey") % 80).alias("k"),
        F.element_at(F.array(*map(F.lit, _STATES)), (F.col("p_partkey") % 3 + 1).cast("int")).alias("state"),
    )
    made = rows.withColumns(D.fixed_geometry(F.col("d"), F.col("ar"), F.col("vf"), F.col("k"), _PER_DIAMETER, _MULTIPLE))
    a11, _, a33 = D.orientation_state(F.col("state"))
    estimates = {"a11": a11, "a33": a33, "estimated_voxels": D.estimated_voxels(["res", "caja_um"]), "estimated_fibres": D.estimated_fibres(F.col("vf"), F.col("caja_um"), F.col("d"), F.col("L_um"))}
    out = made.withColumns(estimates).select("p_partkey", *_DESIGN, *estimates)
    return rounded(out, 6, *(c for c in (*_DESIGN, "a11", "a33") if c != "nvox"))


@query("""SELECT event_type, count(*) AS query_count, round(sum(value), 6) AS total_s, round(1000 * quantile_cont(value, 0.5), 6) AS median_ms, round(1000 * quantile_cont(value, 0.95), 6) AS p95_ms, round(1000 * max(value), 6) AS max_ms,
 round(count(*) / sum(value), 6) AS queries_per_s, round(quantile_cont(w, 0.5), 9) AS width_median, round(quantile_cont(w, 0.95), 9) AS width_p95, round(max(w), 9) AS width_max,
 round(quantile_cont(w / (1 - w), 0.5), 9) AS implied_median, round(quantile_cont(w / (1 - w), 0.95), 9) AS implied_p95, round(max(w / (1 - w)), 9) AS implied_max, count(*) FILTER (w / (1 - w) <= 0.1) AS within_bound
 FROM (SELECT event_type, value, (event_id % 997) / 1994.0::DOUBLE AS w FROM events) GROUP BY event_type""")
def online_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies and widths of each type of event."""
    rows = table(spark, sf_dir, "events").select("event_type", "value", ((F.col("event_id") % 997) / 1994.0).alias("w"))
    out = statistics.online_summary(rows, ["event_type"], "value", "w", 0.1)
    wide = [c for c in out.columns if c.startswith(("width", "implied"))]
    return rounded(rounded(out, 9, *wide), 6, "total_s", "median_ms", "p95_ms", "max_ms", "queries_per_s")


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_nationkey > 12 AS far, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_custkey END AS gap FROM customer)
 SELECT c_custkey, unnest(['grid_segment', 'grid_size_nation', 'grid_size_far', 'gap', 'sides']) AS parameter, unnest([c_mktsegment, c_nationkey::VARCHAR, far::VARCHAR, coalesce(gap::VARCHAR, ''), '[' || c_nationkey || ',' || c_custkey || ']']) AS value,
 unnest(['str', 'int', 'bool', CASE WHEN gap IS NULL THEN 'NoneType' ELSE 'int' END, 'str']) AS value_type FROM r""")
def setting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested settings as one row a parameter."""
    nation = F.col("c_nationkey")
    size = F.struct(nation.alias("nation"), (nation > 12).alias("far"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_mktsegment").alias("segment"), size.alias("size")).alias("grid"), F.when(nation % 5 != 0, F.col("c_custkey")).alias("gap"), F.array(nation, "c_custkey").alias("sides"))
    return campaign.settings_rows(rows, ["c_custkey"])


_C = [f"Ceff_{i}{j}" for i in range(1, 7) for j in range(1, 7)]


@query("SELECT vec_id, round(embedding[1]::DOUBLE + embedding[8]::DOUBLE + embedding[15]::DOUBLE + embedding[22]::DOUBLE + embedding[29]::DOUBLE + embedding[36]::DOUBLE, 8) AS trace, round((embedding[2]::DOUBLE + embedding[7]::DOUBLE) / 2, 8) AS c12, round((embedding[12]::DOUBLE + embedding[32]::DOUBLE) / 2, 8) AS c26 FROM embeddings")
def result_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors from 36 columns, made symmetric."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(_C)))
    c = rows.select("vec_id", D.tensor_of(rows.columns, "Ceff").alias("c"))
    out = c.select("vec_id", sum((F.col("c")[7 * i] for i in range(6)), F.lit(0.0)).alias("trace"), F.col("c")[1].alias("c12"), F.col("c")[11].alias("c26"))
    return rounded(out, 8, "trace", "c12", "c26")


@query("SELECT p_partkey, round(p_retailprice::DOUBLE + 4.0 * p_size::DOUBLE / 3, 6) AS c11, round(p_retailprice::DOUBLE - 2.0 * p_size::DOUBLE / 3, 6) AS c12, 2.0::DOUBLE * p_size AS c44, round(sqrt(3 * (p_retailprice::DOUBLE + 4.0 * p_size::DOUBLE / 3) ** 2 + 6 * (p_retailprice::DOUBLE - 2.0 * p_size::DOUBLE / 3) ** 2 + 12 * p_size::DOUBLE ** 2), 5) AS norm FROM part")
def isotropic_stiffness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stiffnesses from bulk and shear moduli."""
    rows = table(spark, sf_dir, "part").select("p_partkey", D.isotropic_stiffness(F.col("p_retailprice").cast("double"), F.col("p_size").cast("double")).alias("c"))
    w = T.weighted_vector(F.col("c"))
    return rows.select("p_partkey", F.round(F.col("c")[0], 6).alias("c11"), F.round(F.col("c")[1], 6).alias("c12"), F.col("c")[21].alias("c44"), F.round(F.sqrt(T.dot(w, w)), 5).alias("norm"))
