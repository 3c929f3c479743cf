"""Queries of samples, noise, finite differences and packed tensors, with their SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import materials as M
from plumbline.functions import samples as R
from plumbline.functions import tensors as T
from plumbline.jobs import fields, reduced_model
from plumbline.jobs.catalog import _COEFFICIENTS, _MATERIALS, _RANK, COEFFICIENTS, field_voxels, materials, query, rounded
from plumbline.operators import metric, sampling, stencils
from plumbline.operators.ordered import spread
from plumbline.sources import arrays, logs
from plumbline.sources.scratch import scratch_path
from plumbline.sources.tables import table

_SEED = 19


def _uniform_sql(draw: str, key: str) -> str:
    return f"((('0x' || substr(md5('{_SEED}:' || {draw} || ':' || {key}), 1, {R.BITS // 4}))::BIGINT + 0.5::DOUBLE) / {float(1 << R.BITS)}::DOUBLE)"


def _ratio_sql(x: str, fraction: tuple) -> str:
    return " / ".join("(" + " + ".join(f"{c!r}::DOUBLE * pow({x}, {k})" for k, c in enumerate(side)) + ")" for side in fraction)


def _quantile_sql(u: str) -> str:
    tail = f"sqrt(-ln(least({u}, 1 - {u})))"
    far = f"CASE WHEN {tail} <= 5 THEN {_ratio_sql(f'({tail} - 1.6)', R.TAIL)} ELSE {_ratio_sql(f'({tail} - 5.0)', R.FAR)} END"
    return f"CASE WHEN abs({u} - 0.5) <= 0.425 THEN ({u} - 0.5) * {_ratio_sql(f'(0.180625 - ({u} - 0.5) * ({u} - 0.5))', R.MIDDLE)} ELSE sign({u} - 0.5) * ({far}) END"


# Samples: every part is a draw of the seven parameters.


@query("SELECT p_partkey, " + ", ".join(f"round({low} + {_uniform_sql(f"'{n}'", 'p_partkey')} * {high - low!r}::DOUBLE, 9) AS {n}" for n, (low, high) in M.BOX.items()) + " FROM part")
def uniform_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters drawn evenly from their box."""
    drawn = {n: F.lit(low) + R.uniform(_SEED, n, F.col("p_partkey")) * F.lit(high - low) for n, (low, high) in M.BOX.items()}
    return rounded(table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in drawn.items())), 9, *M.BOX)


#: Deviation of the local samples, as a share of a parameter's range.
_SPREAD = 0.3


def _local(n: str) -> tuple[float, float, float, float]:
    low, high = M.BOX[n]
    return (low + high) / 2, _SPREAD * (high - low), low, high


def _truncated_sql(n: str) -> str:
    mean, sd, low, high = _local(n)
    below, above = NormalDist(mean, sd).cdf(low), NormalDist(mean, sd).cdf(high)
    return f"round(least(greatest({mean!r} + {sd!r} * z_{n}, {low}), {high}), 7) AS {n}", f"{below!r}::DOUBLE + {_uniform_sql(f"'{n}'", 'p_partkey')} * {above - below!r}::DOUBLE AS u_{n}"


@query(
    f"WITH u AS (SELECT p_partkey, {', '.join(_truncated_sql(n)[1] for n in M.BOX)} FROM part), z AS (SELECT p_partkey, {', '.join(f'{_quantile_sql(f"u_{n}")} AS z_{n}' for n in M.BOX)} FROM u)"
    + f" SELECT p_partkey, {', '.join(_truncated_sql(n)[0] for n in M.BOX)} FROM z"
)
def truncated_normal_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters drawn around the middle of their box, never outside."""
    drawn = [R.truncated_normal(R.uniform(_SEED, n, F.col("p_partkey")), *_local(n)).alias(n) for n in M.BOX]
    return rounded(table(spark, sf_dir, "part").select("p_partkey", *drawn), 7, *M.BOX)


@query("SELECT p_partkey, " + ", ".join(f"('0x' || substr(md5('{_SEED}:{i}:' || p_partkey), 1, 8))::BIGINT AS s{i}" for i in range(4)) + " FROM part")
def derived_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four different seeds for every part."""
    seeds = R.derived_seeds(_SEED, F.col("p_partkey"), 4)
    rows = table(spark, sf_dir, "part").select("p_partkey", seeds.alias("s"))
    return rows.select("p_partkey", *(F.col("s")[i].alias(f"s{i}") for i in range(4)))


_SAMPLED = 700


@query(f"""WITH h AS (SELECT event_id, user_id, value, ('0x' || substr(md5('{_SEED}:sample:' || event_id), 1, 13))::BIGINT AS h, count(*) OVER () AS n FROM events)
 SELECT event_id, user_id, value, round(sqrt(n / least(n, {_SAMPLED})::DOUBLE), 9) AS scale FROM h ORDER BY h LIMIT {_SAMPLED}""")
def sampled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many events without replacement, with the scale of their sums."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return rounded(sampling.exact_sample(events, "event_id", _SAMPLED, _SEED, "scale"), 9, "scale")


# Tensors: the fibre's stiffness of every material.

_SHARE = 0.005
_CELLS = {0: "C_LL", 1: "C_LT", 2: "C_LT", 6: "C_LT", 7: "C_TT", 8: "C_TTx", 12: "C_LT", 13: "C_TTx", 14: "C_TT", 21: "C_TT - C_TTx", 28: "2 * C_S", 35: "2 * C_S"}
_FLAT = _COEFFICIENTS + f", f AS (SELECT material_id, [{', '.join(_CELLS.get(k, '0.0') for k in range(36))}]::DOUBLE[] AS c FROM c)"


def stiffnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """material_id and c, a flat 6x6 array."""
    return M.coefficients(materials(spark, sf_dir)).select("material_id", T.fibre_stiffness().alias("c"))


@query(
    _FLAT
    + f", d AS (SELECT material_id, i, {_uniform_sql('i', 'material_id')} AS u FROM f, (SELECT unnest(range(36)) AS i)), z AS (SELECT material_id, i, {_quantile_sql('u')} AS z FROM d),"
    + " s AS (SELECT a.material_id, a.i, (a.z + b.z) / 2 AS z FROM z a JOIN z b ON b.material_id = a.material_id AND b.i = (a.i % 6) * 6 + a.i // 6), w AS (SELECT material_id, sqrt(sum(z * z)) AS w FROM s GROUP BY 1)"
    + f" SELECT material_id, round({_SHARE}::DOUBLE, 9) AS share, {', '.join(f'round(max(z) FILTER (i = {6 * i + j}) * {_SHARE}::DOUBLE * any_value(sqrt(list_dot_product(c, c))) / any_value(w), 6) AS n{i + 1}{j + 1}' for i, j in T.UPPER)}"
    + " FROM s JOIN w USING (material_id) JOIN f USING (material_id) GROUP BY material_id"
)
def noisy_stiffness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric noise of a stated share of each stiffness, and the share it has."""
    rows = spread(stiffnesses(spark, sf_dir)).withColumn("n", R.noise(F.col("c"), _SHARE, _SEED, F.col("material_id")))
    share = F.sqrt(T.dot(F.col("n"), F.col("n"))) / F.sqrt(T.dot(F.col("c"), F.col("c")))
    out = rows.select("material_id", F.round(share, 9).alias("share"), T.packed(F.col("n")).alias("n"))
    return out.select("material_id", "share", *(F.round(F.col("n")[k], 6).alias(f"n{i + 1}{j + 1}") for k, (i, j) in enumerate(T.UPPER)))


_STRAIN = (1.0, -0.5, 0.25, 2.0, 0.125, -1.0)


@query(
    _FLAT
    + f" SELECT material_id, round(sqrt(list_dot_product(c, c)), 6) AS norm, {', '.join(f'round({" + ".join(f"c[{6 * i + j + 1}] * {e}::DOUBLE" for j, e in enumerate(_STRAIN))}, 6) AS s{i + 1}' for i in range(6))} FROM f"
)
def packed_stiffness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stiffnesses packed to 21 numbers: the norm of the weighted vector, and the stress of one strain."""
    rows = stiffnesses(spark, sf_dir).select("material_id", T.weighted_vector(F.col("c")).alias("w"), T.packed(F.col("c")).alias("p"))
    strain = F.array(*(F.lit(e) for e in _STRAIN))
    out = rows.select("material_id", F.sqrt(T.dot(F.col("w"), F.col("w"))).alias("norm"), T.packed_product(F.col("p"), strain).alias("s"))
    return out.select("material_id", F.round("norm", 6).alias("norm"), *(F.round(F.col("s")[i], 6).alias(f"s{i + 1}") for i in range(6)))


# Differences: derivatives of the seven coefficients by the seven parameters, inside the box.

_REL = 1e-2
_NAMES = tuple(M.BOX)


def _steps_sql() -> str:
    out = []
    for n in _NAMES:
        low, high = (f"{b}::DOUBLE" for b in M.BOX[n])
        out.append(f"SELECT *, '{n}' AS name, {n} AS v, {low} AS low, {high} AS high, {_REL}::DOUBLE * greatest(abs({n}), 1) AS want FROM m")
    return " UNION ALL ".join(out)


_POINTS_SQL = (
    _MATERIALS
    + f", a AS ({_steps_sql()}), b AS (SELECT *, CASE WHEN v - want >= low AND v + want <= high THEN 'centered' WHEN v - low >= high - v THEN 'backward' ELSE 'forward' END AS direction FROM a),"
    + " s AS (SELECT *, CASE direction WHEN 'centered' THEN want WHEN 'backward' THEN least(want, 0.45::DOUBLE * (v - low)) ELSE least(want, 0.45::DOUBLE * (high - v)) END AS step FROM b),"
    + " o AS (SELECT *, unnest(CASE direction WHEN 'centered' THEN [[1, 1], [-1, -1]] WHEN 'backward' THEN [[3, 0], [-4, -1], [1, -2]] ELSE [[-3, 0], [4, 1], [-1, 2]] END) AS p FROM s),"
    + f" pts AS (SELECT material_id, name, direction, step, p[1] / (2 * step) AS weight, {', '.join(f"CASE WHEN name = '{n}' THEN v + p[2] * step ELSE {n} END AS {n}" for n in _NAMES)} FROM o)"
)
_SLOPES = _POINTS_SQL + _COEFFICIENTS[len(_MATERIALS) :].replace("FROM m)", "FROM pts)", 1)


@query(_SLOPES + f" SELECT material_id, name, any_value(direction) AS direction, round(any_value(step), 9) AS step, {', '.join(f'round(sum(weight * {c}), 4) + 0.0::DOUBLE AS {c}' for c in COEFFICIENTS)} FROM c GROUP BY material_id, name")
def coefficient_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives of the coefficients by each parameter, one-sided at the box's edges."""
    points = stencils.stencils(materials(spark, sf_dir).select("material_id", *_NAMES), _NAMES, _REL, M.BOX, "edge-auto")
    found = stencils.differences(M.coefficients(points), ["material_id", "name", "direction", "step"], COEFFICIENTS)
    return rounded(rounded(found, 4, *COEFFICIENTS), 9, "step")


@query()
def sensitivity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reduced model's derivatives by each coefficient against central differences of its answers."""
    model = fields.reduced_model(field_voxels(spark, sf_dir), "v", _RANK)
    rows = M.coefficients(materials(spark, sf_dir)).select("material_id", *COEFFICIENTS)
    slopes = reduced_model.sensitivities(rows, "material_id", list(COEFFICIENTS), model)
    names = [f"{i}{j}" for i in range(1, 7) for j in range(1, 7)]
    term = F.element_at(F.array(*(F.lit(c) for c in COEFFICIENTS)), F.col("term") + 1)
    analytic = slopes.select("material_id", term.alias("name"), *(F.col(f"s{n}").alias(f"c{n}") for n in names))
    points = stencils.stencils(rows, COEFFICIENTS, 1e-4).withColumn("point", F.struct("material_id", "name", "weight"))
    answers = reduced_model.answer(points, "point", list(COEFFICIENTS), model).select("point.*", *(f"c{n}" for n in names))
    reference = stencils.differences(answers, ["material_id", "name"], [f"c{n}" for n in names])
    return stencils.error_table(analytic, reference, ["material_id", "name"], [f"c{n}" for n in names])


# Descriptors: an embedding's first nine numbers.

_NINE = tuple(f"d{i}" for i in range(9))


@query(
    f"WITH d AS (SELECT vec_id, {', '.join(f'embedding[{i + 1}]::DOUBLE AS d{i}' for i in range(9))} FROM embeddings), r AS (SELECT {', '.join(f'min({d}) AS l_{d}, max({d}) - min({d}) AS w_{d}' for d in _NINE)} FROM d),"
    + f" n AS (SELECT vec_id, {', '.join(f'({d} - l_{d}) / CASE WHEN w_{d} <= 1e-14 THEN 1 ELSE w_{d} END AS {d}' for d in _NINE)} FROM d, r),"
    + f" p AS (SELECT a.vec_id, min(sqrt({' + '.join(f'(a.{d} - b.{d}) ** 2' for d in _NINE)})) AS distance FROM n a JOIN n b ON a.vec_id <> b.vec_id GROUP BY 1)"
    + " SELECT vec_id, round(distance, 9) AS distance, distance > 0.15 AS separated FROM p"
)
def realised_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each descriptor to the nearest other one, and whether they are far enough apart."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(d) for i, d in enumerate(_NINE)))
    return rounded(metric.separated(rows, "vec_id", _NINE).drop("compared"), 9, "distance")


# Arrays and logs: written, and read back.


@query("SELECT vec_id, i::INT AS i, round(embedding[i + 1]::DOUBLE, 9) AS value FROM embeddings, (SELECT unnest(range(64)) AS i)")
def array_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, written as arrays and read back by ranges."""
    spark.dataSource.register(arrays.NpySource)
    folder = scratch_path(spark, "arrays")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("position"), F.col("embedding").cast("array<double>").alias("values"))
    rows.repartitionByRange("position").write.format("npy").mode("append").save(folder)
    back = arrays.written_rows(spark, folder)
    return back.select(F.col("position").alias("vec_id"), F.posexplode("values").alias("i", "value")).withColumn("value", F.round("value", 9))


_BATCHES = 8


@query(_COEFFICIENTS + f" SELECT material_id, {', '.join(f'round({c}, 6) AS {c}' for c in COEFFICIENTS)}, 'batch-' || lpad(((row_number() OVER (ORDER BY material_id) - 1) // (SELECT (count(*) + {_BATCHES - 1}) // {_BATCHES} FROM part))::VARCHAR, 6, '0') AS batch FROM c")
def resumed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficients of all materials by a log in batches whose run stops after three and is then taken up again."""
    rows = materials(spark, sf_dir).drop("p_brand")
    log = logs.Log(spark, scratch_path(spark, "log"), ["material_id"])
    size = -(-rows.count() // _BATCHES)
    for most in (3, None):
        log.run(rows, size, lambda own: M.coefficients(own).select("material_id", *COEFFICIENTS), most)
    return rounded(log.read(), 6, *COEFFICIENTS)
