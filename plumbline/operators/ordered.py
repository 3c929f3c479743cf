"""Order-dependent operators without a single-task sort.

A global running value is found in two phases: rows are range-partitioned by the key and sorted inside each
partition; each partition's closing value is one row, and a window over these few rows gives what each
partition starts from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.scratch import materialize

PART = "__part"


def shuffle_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly: a small file is one task, however much is then made of each of its rows."""
    return df.repartition(shuffle_partitions(df))


def range_parts(df: DataFrame, keys: Sequence[str | Column], tag: str) -> DataFrame:
    """df dealt by ranges of keys, with the range's number in column ``__part``, as a scratch table.

    It is written once, so that every later read sees the same ranges.
    """
    n = shuffle_partitions(df)
    return materialize(df.repartitionByRange(n, *keys).withColumn(PART, F.spark_partition_id()), tag)


def running_before(df: DataFrame, keys: Sequence[str], values: dict[str, Column], tag: str) -> DataFrame:
    """Adds for each name of values: the sum of its value over all rows before a row, in the order of keys.

    Keys should be unique; equal keys are numbered in any order. Empty input gives no rows. Nulls of a value
    count 0.
    """
    parted = range_parts(df.withColumns({n: F.coalesce(v, F.lit(0)) for n, v in values.items()}), keys, tag)
    totals = parted.groupBy(PART).agg(*(F.sum(n).alias(f"__{n}") for n in values))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(PART, *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in values))
    inside = Window.partitionBy(PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parted.withColumns({n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in values})
        .join(bases, PART)
        .withColumns({n: F.col(n) + F.col(f"__{n}") for n in values})
        .drop(PART, *(f"__{n}" for n in values))
    )
