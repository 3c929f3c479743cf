"""Designs, guards, settings and summaries on small rows."""

import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.functions import designs as D
from plumbline.operators import campaign, statistics


def test_fixed_geometry_holds_its_fibres(spark):
    rows = spark.createDataFrame([(1, 6.0, 15.0, 0.2, 57), (2, 6.0, -1.0, 0.2, 57), (3, 6.0, 15.0, 1.0, 57), (4, 6.0, 15.0, 0.2, 0)], "k int, d double, ar double, vf double, n int")
    got = {r.k: r for r in rows.withColumns(D.fixed_geometry(F.col("d"), F.col("ar"), F.col("vf"), F.col("n"), 5.0, 8)).collect()}
    box = (57 * math.pi * 36 * 90 / 4 / 0.2) ** (1 / 3)
    assert math.isclose(got[1].caja_um, box) and got[1].nvox % 8 == 0 and 0 <= got[1].nvox - 5 * box / 6 < 8 and math.isclose(got[1].df_voxel, 6 * got[1].nvox / box)
    assert all(got[k].caja_um is None and got[k].nvox is None for k in (2, 3, 4))
    one = rows.filter("k = 1").withColumn("caja_um", F.lit(box))
    assert one.select(D.estimated_fibres(F.col("vf"), F.col("caja_um"), F.col("d"), F.col("ar") * F.col("d"))).first()[0] == 57
    assert one.select(D.estimated_fibres(F.col("vf"), F.col("caja_um"), F.lit(0.0), F.lit(1.0))).first()[0] is None


def test_estimated_voxels(spark):
    rows = spark.createDataFrame([(None, 47.6, 2.0, 10.0), (31.5, None, 2.0, 10.0), (None, None, 2.04, 10.0), (0.2, None, None, None)], "nvox double, nvox_ref double, res double, caja_um double")
    assert [r[0] for r in rows.select(D.estimated_voxels(rows.columns)).collect()] == [48, 32, 20, 1]
    with pytest.raises(ValueError):
        D.estimated_voxels(["res"])


def test_orientation_states(spark):
    rows = spark.createDataFrame([("Aligned_X",), (" planar-xy",)], "s string")
    assert [tuple(r) for r in rows.select(*D.orientation_state(F.col("s"))).collect()] == [(0.9, 0.05, 0.05), (0.5, 0.5, 0.0)]
    with pytest.raises(PySparkException, match="unknown orientation state"):
        spark.createDataFrame([("round",)], "s string").select(*D.orientation_state(F.col("s"))).collect()


def test_features_have_equal_ranges(spark):
    row = spark.createDataFrame([(0.1, 30.0, 1.0, 0.0, 0.0, 0.35)], "v double, r double, a double, b double, c double, k double")
    (got,) = row.select(D.design_features(F.col("v"), F.col("r"), [F.col(x) for x in "abc"], F.col("k"), (0.1, 0.3), (10.0, 30.0), 0.7).alias("f")).collect()
    assert np.allclose(got.f, [0, 1, 1.5**0.5, 0, 0, 0.5])


def test_tensors_from_columns(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(6, 6))
    rows = spark.createDataFrame([(*c.ravel().tolist(),), (None, *c.ravel().tolist()[1:])], ", ".join(f"p_{i}{j} double" for i in range(1, 7) for j in range(1, 7)))
    got = [r[0] for r in rows.select(D.tensor_of(rows.columns, "p")).collect()]
    assert np.allclose(got[0], ((c + c.T) / 2).ravel()) and got[1] is None
    assert rows.drop("p_61").select(D.tensor_of(rows.drop("p_61").columns, "p", "null")).first()[0] is None
    with pytest.raises(ValueError, match="p_61"):
        D.tensor_of(rows.drop("p_61").columns, "p")


def test_isotropic_stiffness(spark):
    rows = spark.createDataFrame([(5.0, 3.0), (5.0, 0.0), (-1.0, 3.0)], "k double, g double")
    got = [r[0] for r in rows.select(D.isotropic_stiffness(F.col("k"), F.col("g"))).collect()]
    c = np.array(got[0]).reshape(6, 6)
    assert np.allclose(np.linalg.eigvalsh(c), [6, 6, 6, 6, 6, 15]) and got[1] is None and got[2] is None


def test_settings_and_json(spark):
    rows = spark.createDataFrame([(1, (2.5, (None, True)), [1.0, float("nan")], float("inf"))], "k int, a struct<x:double,y:struct<u:string,v:boolean>>, z array<double>, w double")
    got = {r.parameter: (r.value, r.value_type) for r in campaign.settings_rows(rows.drop("z", "w"), ["k"]).collect()}
    assert got == {"a_x": ("2.5", "float"), "a_y_u": ("", "NoneType"), "a_y_v": ("true", "bool")}
    line = campaign.json_lines(rows).first().value
    assert json.loads(line) == {"a": {"x": 2.5, "y": {"u": None, "v": True}}, "k": 1, "w": None, "z": [1.0, None]} and list(json.loads(line)) == ["a", "k", "w", "z"]


def test_guards(spark):
    rows = spark.createDataFrame([(1, None, False), (2, 0.5, False)], "k int, x double, flag boolean")
    with pytest.raises(ValueError, match="1 rows"):
        campaign.require_disjoint(rows, rows.filter("k = 1"), ["x"])
    assert campaign.require_disjoint(rows, rows.withColumn("k", F.col("k") + 5), ["k"]) is rows
    assert campaign.require_causal(rows, "flag") is rows
    for bad in (rows.withColumn("flag", F.col("k") == 2), rows.withColumn("flag", F.lit(None).cast("boolean")), rows.drop("flag")):
        with pytest.raises(ValueError):
            campaign.require_causal(bad, "flag")
    assert [r.k for r in campaign.require_rows(rows, "k", 1).collect()] == [1]
    with pytest.raises(ValueError):
        campaign.require_rows(rows, "k", 3)


def test_online_summary(spark):
    rng = np.random.default_rng(3)
    s, w = rng.random(200), rng.random(200) / 2
    rows = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(s, w)], "g string, s double, w double").repartition(3)
    (r,) = statistics.online_summary(rows, ["g"], "s", "w", 0.2).collect()
    e = w / (1 - w)
    assert r.query_count == 200 and math.isclose(r.queries_per_s, 200 / s.sum()) and math.isclose(r.p95_ms, 1000 * np.quantile(s, 0.95)) and math.isclose(r.median_ms, 1000 * np.median(s))
    assert math.isclose(r.implied_p95, np.quantile(e, 0.95)) and r.within_bound == (e <= 0.2).sum() and math.isclose(r.width_median, np.median(w))
