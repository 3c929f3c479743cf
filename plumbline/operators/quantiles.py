"""Exact quantiles and ranks of groups without a group's values in one task.

Rows are counted by (group, value) with partial sums on the map side. The counts are dealt by ranges of (group,
value), so that a group of any size is spread, and running sums in two phases give each value its place in its
group. Quantiles are then single places of that order, picked by a partial aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordered import running_before
from plumbline.sources.scratch import materialize


def matching(a: str, b: str, names: Sequence[str]):
    same = [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    return reduce(lambda x, y: x & y, same) if same else F.lit(True)


def value_places(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """group, value, __equal (rows with this value), __at (rows of the group before it), __all (of the group). No nulls."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__equal"))
    return placed_values(counts, group, value)


def placed_values(counts: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``value_places`` of counts: each value of a group once, with __equal; further columns stay."""
    placed = running_before(counts, [*group, value], {"__before": F.col("__equal")}, "places")
    totals = placed.groupBy(*group).agg(F.sum("__equal").alias("__all"), F.min("__before").alias("__first"))
    joined = placed.alias("a").join(totals.alias("b"), matching("a", "b", group))
    return joined.select(*(f"a.{c}" for c in counts.columns), (F.col("a.__before") - F.col("b.__first")).alias("__at"), "b.__all")


#: Equal bins of a group's range, and groups up to which their ranges are told to all tasks.
BINS, TOLD = 4096, 4096


def _spans(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame | None:
    """group, __low, __high and __all of each group, as a table; None if there are over TOLD groups or a span has no width in numbers."""
    v = F.col(value).cast("double")
    spans = rows.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.min(v).alias("__low"), F.max(v).alias("__high"), F.count("*").alias("__all"))
    spans = materialize(spans, "quantile-spans")
    width = F.col("__high") - F.col("__low")
    odd = F.isnan(width) | (F.abs(width) == float("inf"))
    return None if spans.limit(TOLD + 1).count() > TOLD or not spans.filter(odd).isEmpty() else spans


def _places(levels: Mapping[str, float], n: str) -> list[tuple[str, Column]]:
    """Names and places of what each level is interpolated from."""
    return [(f"__{name}_{side}", f((F.col(n) - 1) * F.lit(float(q)))) for name, q in levels.items() for side, f in (("low", F.floor), ("high", F.ceil))]


def _near_places(rows: DataFrame, group: Sequence[str], value: str, levels: Mapping[str, float], spans: DataFrame) -> DataFrame:
    """``value_places`` of the rows in the bins that hold a wanted place; the other rows are counted where they are."""
    v = F.col(f"a.{value}").cast("double")
    share = F.try_divide(v - F.col("b.__low"), F.col("b.__high") - F.col("b.__low"))
    bin_ = F.coalesce(F.least(F.floor(share * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int").alias("__bin")
    told = rows.filter(F.col(value).isNotNull()).alias("a").join(F.broadcast(spans).alias("b"), matching("a", "b", group))
    binned = told.select(*(f"a.{g}" for g in group), f"a.{value}", bin_)
    counts = binned.groupBy(*group, "__bin").agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*group).orderBy("__bin")
    before = counts.select(*group, "__bin", "__n", (F.sum("__n").over(order) - F.col("__n")).alias("__before"))
    known = before.alias("a").join(F.broadcast(spans).alias("b"), matching("a", "b", group)).select("a.*", "b.__all")
    holds = reduce(lambda x, y: x | y, ((F.col("__before") <= at) & (at < F.col("__before") + F.col("__n")) for _, at in _places(levels, "__all")))
    #: At most two bins a level and group.
    wanted = materialize(known.filter(holds).select(*group, "__bin", "__before", "__all"), "quantile-bins")
    keys = [*group, "__bin"]
    chosen = binned.alias("a").join(F.broadcast(wanted).alias("b"), matching("a", "b", keys)).select("a.*")
    placed = value_places(chosen, keys, value).drop("__all")
    return placed.alias("a").join(F.broadcast(wanted).alias("b"), matching("a", "b", keys)).select(*(f"a.{g}" for g in group), f"a.{value}", "a.__equal", (F.col("a.__at") + F.col("b.__before")).alias("__at"), "b.__all")


def quantiles(rows: DataFrame, group: Sequence[str], value: str, levels: Mapping[str, float]) -> DataFrame:
    """group and, by name, quantiles of value with linear interpolation. Null values are left out.

    Rows are counted by equal bins of their group's range first; only those in bins that hold a wanted place are put
    in order. With very many groups, or values without a finite range, all are.
    """
    spans = _spans(rows, group, value)
    places = value_places(rows, group, value) if spans is None else _near_places(rows, group, value, levels, spans)
    v, out = F.col(value).cast("double"), []
    picks = [F.max(F.when((F.col("__at") <= at) & (at < F.col("__at") + F.col("__equal")), v)).alias(name) for name, at in _places(levels, "__all")]
    for name, q in levels.items():
        whole = (F.col("__n") - 1) * F.lit(float(q))
        out.append((F.col(f"__{name}_low") + (F.col(f"__{name}_high") - F.col(f"__{name}_low")) * (whole - F.floor(whole))).alias(name))
    return places.groupBy(*group).agg(F.max("__all").alias("__n"), *picks).select(*group, *out)


def with_quantiles(summary: DataFrame, rows: DataFrame, group: Sequence[str], value: str, levels: Mapping[str, float]) -> DataFrame:
    """summary (one row a group) with quantiles of value added."""
    found = quantiles(rows, group, value, levels)
    return summary.alias("a").join(found.alias("b"), matching("a", "b", group), "left").select("a.*", *(f"b.{n}" for n in levels))


def with_average_rank(rows: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """rows (no null value) with their rank in the group, from 1, equal values sharing their mean rank."""
    ranks = value_places(rows, group, value).withColumn(name, F.col("__at") + (F.col("__equal") + 1) / 2.0)
    return rows.alias("a").join(ranks.alias("b"), matching("a", "b", [*group, value])).select("a.*", f"b.{name}")
