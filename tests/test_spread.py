"""Rows that are much work are dealt evenly first, and long tables are not broadcast."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import samples
from plumbline.jobs import reduced_model
from plumbline.operators import stencils


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantiles_of_an_array(spark):
    us = [1e-15, 1e-6, 0.01, 0.3, 0.5, 0.7, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(us,)], "us array<double>")
    (got,) = df.select(samples.normal_quantiles(F.col("us"))).first()
    each = [r[0] for r in df.select(F.explode("us").alias("u")).select(samples.normal_quantile(F.col("u"))).collect()]
    assert sorted(got) == sorted(each)


def test_answers_are_dealt_evenly(spark):
    rows = spark.createDataFrame([(1, *[1.0] * 7)], "k long, " + ", ".join(f"q{i} double" for i in range(7)))
    model = reduced_model.ReducedModel(np.tile(np.eye(2), (7, 1, 1)), np.zeros((7, 2, 6)), np.tile(np.eye(6), (7, 1, 1)))
    for df in (reduced_model.answer(rows, "k", [f"q{i}" for i in range(7)], model), reduced_model.sensitivities(rows, "k", [f"q{i}" for i in range(7)], model)):
        assert "RoundRobinPartitioning" in plan_of(df) and df.count()


def test_error_tables_are_not_broadcast(spark):
    df = spark.createDataFrame([(1, 2.0)], "k long, v double")
    assert "BroadcastExchange" not in plan_of(stencils.error_table(df, df.withColumn("v", F.col("v") + 1), ["k"], ["v"]))
    assert "RoundRobinPartitioning" in plan_of(stencils.stencils(df, ["v"], 0.1))
