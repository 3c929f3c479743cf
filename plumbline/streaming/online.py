"""Online statistics over a stream: keyed running moments with a stopping rule, and windowed counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.sources.scratch import scratch_path

OUTPUT = "n long, mean double, std double, error double, stable int, converged boolean"
#: Rows that are folded into a state at a time.
CHUNK = 4096
STATE = "n long, mean double, m2 double, stable int, converged boolean"


def online_convergence(stream: DataFrame, group: str, order: str, value: str, tolerance: float, factor: float, n_min: int, stable_steps: int) -> DataFrame:
    """Per micro-batch and group: n, mean, std, error, stable and converged after its rows, in order.

    A group's state is five numbers. Once it has converged, later rows are dropped. Of a micro-batch a group's rows are
    sorted in one task, so bound the micro-batch at the source (``maxFilesPerTrigger``) by what a task may hold if all
    of it is one group's. Runs of CHUNK rows are then folded into the state by array sums.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, stable, done = state.get if state.exists else (0, 0.0, 0.0, 0, False)
        error, values = math.nan, np.empty(0)
        if not done:
            parts = [f[[order, value]].dropna(subset=[value]) for f in frames]
            keys, values = (np.concatenate([p[c].to_numpy() for p in parts]) for c in (order, value))
            values = values[np.argsort(keys, kind="stable")].astype(float)
        for at in range(0, len(values), CHUNK):
            v = values[at : at + CHUNK]
            #: Sums about the mean so far, so that large means do not cancel.
            base = mean if n else v[0]
            first, second, count = np.cumsum(v - base), np.cumsum((v - base) ** 2), n + np.arange(1, len(v) + 1)
            means = base + first / count
            squares = np.maximum(m2 + second - first**2 / count, 0.0)
            asked = (count >= n_min) & (np.abs(means) > 1e-12)
            errors = np.where(count > 1, factor * np.sqrt(squares / np.maximum(count - 1, 1) / count) / np.maximum(np.abs(means), 1e-300), 0.0)
            good, bad = asked & (errors <= tolerance), asked & (errors > tolerance)
            goods = np.cumsum(good)
            #: Good ones since the last bad one; before the first bad one, those of the state count too.
            left = np.maximum.accumulate(np.where(bad, goods, -1))
            steady = np.where(left < 0, goods + stable, goods - left)
            stops = np.flatnonzero(good & (steady >= stable_steps))
            end = stops[0] if len(stops) else len(v) - 1
            n, mean, m2, stable, done = int(count[end]), float(means[end]), float(squares[end]), int(steady[end]), len(stops) > 0
            seen = np.flatnonzero(asked[: end + 1])
            error = float(errors[seen[-1]]) if len(seen) else error
            if done:
                break
        state.update((n, mean, m2, stable, done))
        std = math.sqrt(max(m2, 0.0) / (n - 1)) if n > 1 else 0.0
        yield pd.DataFrame({group: [key[0]], "n": [n], "mean": [mean], "std": [std], "error": [None if math.isnan(error) else error], "stable": [stable], "converged": [done]})

    kind = stream.schema[group].dataType.simpleString()
    return stream.select(group, order, value).groupBy(group).applyInPandasWithState(run, f"{group} {kind}, {OUTPUT}", STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time: str, group: str, width: str, late: str) -> DataFrame:
    """Rows and mean value by group and time window; rows later than the watermark are left out."""
    windowed = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group)
    return windowed.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), group, "n", "mean")


def run_available(output: DataFrame, tag: str) -> DataFrame:
    """Run a streaming query in update mode over what is there now; all updates, with their batch, as a table.

    Each batch goes to its own folder of a scratch table, so that a batch that runs again replaces itself.
    """
    spark = output.sparkSession
    folder, checkpoint = scratch_path(spark, tag), scratch_path(spark, f"{tag}-checkpoint")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    #: A stream without rows makes no batch.
    spark.createDataFrame([], output.schema).write.parquet(f"{folder}/batch=-1")
    query = output.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(output.schema.add("batch", "long")).option("basePath", folder).parquet(folder)
