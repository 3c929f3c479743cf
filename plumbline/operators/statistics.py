"""Statistics of campaign results: error summaries, rank curves, correlations, online convergence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plumbline.operators.ordered import PART, range_parts, running_before
from plumbline.operators.quantiles import matching, placed_values, value_places, with_quantiles
from plumbline.sources.scratch import materialize

#: Distinct values of groups whose ranks are told to all tasks at most.
TOLD_VALUES = 1 << 16


def error_statistics(rows: DataFrame, group: Sequence[str], error: str, key: str) -> DataFrame:
    """Mean, median, 95th percentile (linear), largest error and its first key, for each group."""
    summary = rows.groupBy(*group).agg(
        F.avg(error).alias("error_mean"),
        F.max(error).alias("error_max"),
        F.min_by(F.col(key), F.struct((-F.col(error)).alias("e"), F.col(key).alias("k"))).alias("error_max_key"),
    )
    return with_quantiles(summary, rows, group, error, {"error_median": 0.5, "error_p95": 0.95})


def summaries(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: mean, std (n - 1), extremes and quantiles at 1, 5, 50, 95 and 99 per cent."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("output"), F.col(c).cast("double").alias("value")) for c in columns)))
    tall = rows.select(pairs.alias("p")).select("p.*")
    summary = tall.groupBy("output").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))
    return with_quantiles(summary, tall, ["output"], "value", {f"q{round(100 * q):02d}": q for q in (0.01, 0.05, 0.5, 0.95, 0.99)})


def _merged(part: str, order: WindowSpec, last: int) -> tuple[Column, Column, Column]:
    """Count, mean and sum of squared deviations of all parts up to the one ``last`` rows from this one.

    A part has {part}c, {part}m and {part}q. Means are taken relative to the first part's, so large ones do not cancel.
    """
    upto = order.rowsBetween(Window.unboundedPreceding, last)
    first = F.first(f"{part}m", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gap = F.col(f"{part}m") - first
    c, s = F.sum(f"{part}c").over(upto), F.sum(F.col(f"{part}c") * gap).over(upto)
    return c, first + F.try_divide(s, c), F.sum(F.col(f"{part}q") + F.col(f"{part}c") * gap * gap).over(upto) - F.try_divide(s * s, c)


def prefix_statistics(rows: DataFrame, order: str, value: str, checkpoints: Sequence[int]) -> DataFrame:
    """n, mean, std, half_width (of a 95 % interval), q05 and q95 of the first n rows for each checkpoint, and their gaps.

    Checkpoints beyond the rows are the number of rows. mean_gap, std_gap, q05_gap and q95_gap: relative to all rows.
    Rows are numbered by ranges and each row is summed once, under the first checkpoint that it is in; later
    checkpoints merge the centred moments of earlier ones. Quantiles are exact; each row is counted for every
    checkpoint that it is in.
    """
    numbered = running_before(rows.select(order, value), [order], {"at": F.lit(1).cast("long")}, "prefix")
    total = numbered.count()
    wanted = sorted({min(total, n) for n in checkpoints if n > 0})
    marks = sorted({*wanted, total})
    step = F.lit(None).cast("long")
    for n in reversed(marks):
        step = F.when(F.col("at") < n, F.lit(n).cast("long")).otherwise(step)
    v = F.col(value).cast("double")
    parts = numbered.withColumn("n", step).filter("n IS NOT NULL").groupBy("n").agg(F.count(v).alias("__c"), F.avg(v).alias("__m"), (F.var_pop(v) * F.count(v)).alias("__q"))
    c, mean, q = _merged("__", Window.orderBy("n"), 0)  # one row a checkpoint
    merged = parts.select("n", c.alias("c"), mean.alias("mean"), q.alias("q"))
    std = F.sqrt(F.greatest(F.lit(0.0), F.try_divide("q", F.col("c") - 1)))
    out = merged.select("n", "mean", std.alias("std"), (1.96 * std / F.sqrt("c")).alias("half_width"))
    inside = numbered.select(v.alias("v"), F.explode(F.filter(F.array(*(F.lit(n).cast("long") for n in marks)), lambda n: F.col("at") < n)).alias("n"))
    out = with_quantiles(out, inside, ["n"], "v", {"q05": 0.05, "q95": 0.95})
    last = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = lambda x: F.try_divide(F.abs(F.col(x) - F.last(x).over(last)), F.abs(F.last(x).over(last)))
    gaps = out.withColumns({f"{x}_gap": gap(x) for x in ("mean", "std", "q05", "q95")})
    return gaps.filter(F.col("n").isin(wanted)) if wanted != marks else gaps


def online_summary(rows: DataFrame, group: Sequence[str], seconds: str, width: str, bound: float = 1e-4) -> DataFrame:
    """What queries of each group took, and how wide their certificates were.

    query_count, total_s, median_ms, p95_ms, max_ms, queries_per_s; median, p95 and max of the relative width and of the
    relative error it implies (width / (1 - width)), and the number of queries within the bound. No nulls.
    """
    measured = rows.select(*group, F.col(seconds).cast("double").alias("s"), F.col(width).cast("double").alias("w")).withColumn("e", F.col("w") / F.greatest(1.0 - F.col("w"), F.lit(2.2250738585072014e-308)))
    total = F.sum("s")
    out = measured.groupBy(*group).agg(
        F.count("*").alias("query_count"), total.alias("total_s"), (1000.0 * F.max("s")).alias("max_ms"), F.try_divide(F.count("*"), total).alias("queries_per_s"), F.max("w").alias("width_max"), F.max("e").alias("implied_max"), F.count_if(F.col("e") <= bound).alias("within_bound")
    )
    for name, column in (("ms", "s"), ("width", "w"), ("implied", "e")):
        out = with_quantiles(out, measured, group, column, {f"{name}_median": 0.5, f"{name}_p95": 0.95})
    return out.withColumns({"median_ms": 1000.0 * F.col("ms_median"), "p95_ms": 1000.0 * F.col("ms_p95")}).drop("ms_median", "ms_p95")


def guarded_correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation over the rows of a group; null if either is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(rows: DataFrame, group: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """n, censored (pairs with a null, left out), Pearson's and Spearman's correlation of each group with enough rows."""
    #: Rows are not dealt by their values: the ranks of x are told to all tasks where they are few, and of each value of y
    #: the number and the sum of x's ranks are enough. Ranks are taken less their mean, which is known.
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    counted = rows.withColumns({x: F.when(both, F.col(x).cast("double")), y: F.when(both, F.col(y).cast("double"))})
    plain = counted.groupBy(*group).agg(F.count(x).alias("n"), F.count(F.when(F.col(x).isNull(), 1)).alias("censored"), guarded_correlation(F.col(x), F.col(y)).alias("pearson"))
    pairs = counted.filter(F.col(x).isNotNull())
    rank = F.col("__at") + (F.col("__equal") - F.col("__all")) / 2.0
    x_ranks = materialize(value_places(pairs, group, x).select(*group, x, "__equal", rank.alias("__x")), "x-ranks")
    few = x_ranks.limit(TOLD_VALUES + 1).count() <= TOLD_VALUES
    ranked = pairs.alias("a").join((F.broadcast(x_ranks) if few else x_ranks).alias("b"), matching("a", "b", [*group, x])).select(*(f"a.{g}" for g in group), f"a.{y}", "b.__x")
    sums = materialize(ranked.groupBy(*group, y).agg(F.count("*").alias("__equal"), F.sum("__x").alias("__sum")), "rank-sums")
    placed = placed_values(sums, group, y).select(*group, "__equal", "__sum", rank.alias("__y"))
    across = placed.groupBy(*group).agg(F.sum(F.col("__sum") * F.col("__y")).alias("__xy"), F.sum(F.col("__equal") * F.col("__y") * F.col("__y")).alias("__yy"))
    own = x_ranks.groupBy(*group).agg(F.sum(F.col("__equal") * F.col("__x") * F.col("__x")).alias("__xx"))
    out = plain.filter(F.col("n") >= least).alias("a").join(across.alias("b"), matching("a", "b", group)).select("a.*", "b.__xy", "b.__yy")
    out = out.alias("a").join(own.alias("b"), matching("a", "b", group)).select("a.*", "b.__xx")
    return out.select(*group, "n", "pearson", F.try_divide(F.col("__xy"), F.sqrt("__xx") * F.sqrt("__yy")).alias("spearman"), "censored")


# Scans of groups: rows are dealt by ranges of (group, order), so that a hot group is spread. A range's rows of a group
# are scanned on their own; what the group's other ranges add is one row a range and group.


def _carried(parted: DataFrame, group: Sequence[str], values: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """parted with ``carry`` (windows over a group's ranges) of ``values`` (aggregates of a range) added."""
    ends = parted.groupBy(PART, *group).agg(*(v.alias(n) for n, v in values.items())).select(PART, *group, *(c.alias(n) for n, c in carry.items()))
    match = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in (PART, *group)]
    return parted.alias("a").join(ends.alias("b"), match).select("a.*", *(f"b.{n}" for n in carry))


def _ranges(group: Sequence[str]) -> tuple[WindowSpec, WindowSpec]:
    """A group's ranges before a range, and those after it."""
    order = Window.partitionBy(*group).orderBy(PART)
    return order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)


def suffix_max(rows: DataFrame, group: Sequence[str], rank: str, value: str, name: str) -> DataFrame:
    """rows with the largest value at their rank or later."""
    parted = range_parts(rows, [*group, rank], "suffix-max")
    later = _carried(parted, group, {"__top": F.max(value)}, {"__tail": F.max("__top").over(_ranges(group)[1])})
    w = Window.partitionBy(PART, *group).orderBy(rank).rowsBetween(0, Window.unboundedFollowing)
    return later.withColumn(name, F.greatest(F.max(value).over(w), "__tail")).drop(PART, "__tail")


def required_ranks(curve: DataFrame, group: Sequence[str], rank: str, error: str, threshold: float) -> DataFrame:
    """First rank whose error is within the threshold, and first from which all later ones are too."""
    held = suffix_max(curve, group, rank, error, "__later")
    out = held.groupBy(*group).agg(
        F.min(F.when(F.col(error) <= threshold, F.col(rank))).alias("first_rank"),
        F.min(F.when(F.col("__later") <= threshold, F.col(rank))).alias("stable_rank"),
    )
    return out.withColumn("achieved", F.col("stable_rank").isNotNull())


def cumulative_share(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with the share of the total of value that is reached with their own, in the order of keys."""
    summed = running_before(rows, keys, {name: F.col(value).cast("double")}, "share")
    (total,) = rows.agg(F.sum(F.col(value).cast("double"))).first()
    return summed.withColumn(name, F.try_divide(F.col(name) + F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(total)))


def _with_moments(parted: DataFrame, group: str, order: str, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    values = {"__c": F.count(v), "__m": F.avg(v), "__q": F.var_pop(v) * F.count(v)}
    c, m, q = _merged("__", Window.partitionBy(group).orderBy(PART), -1)
    rows = _carried(parted, [group], values, {"__c": F.coalesce(c, F.lit(0)), "__m": m, "__q": q})
    w = Window.partitionBy(PART, group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__n": F.count(v).over(w), "__mean": F.avg(v).over(w), "__own": F.var_pop(v).over(w) * F.count(v).over(w)})
    n, gap = F.col("__n") + F.col("__c"), F.coalesce(F.col("__mean") - F.col("__m"), F.lit(0.0))
    mean = F.when(F.col("__c") == 0, F.col("__mean")).when(F.col("__n") == 0, F.col("__m")).otherwise(F.col("__m") + gap * F.col("__n") / n)
    squares = F.coalesce("__own", F.lit(0.0)) + F.coalesce("__q", F.lit(0.0)) + F.try_divide(gap * gap * F.col("__n") * F.col("__c"), n)
    std = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(squares, n - 1))), F.lit(0.0))
    return rows.withColumns({"n": n, "mean": mean, "std": std}).drop("__c", "__m", "__q", "__n", "__mean", "__own")


def running_moments(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """rows with n, mean and std (n - 1; 0 for one row) of their group's values so far."""
    return _with_moments(range_parts(rows, [group, order], "moments"), group, order, value).drop(PART)


def online_stop(rows: DataFrame, group: str, order: str, value: str, tolerance: float, factor: float, n_min: int, stable_steps: int) -> DataFrame:
    """Where each group's relative confidence half-width first stays within the tolerance for stable_steps rows.

    One row a group: n_stop (null if it never does), and mean and error there or at the last row.
    """
    moments = _with_moments(range_parts(rows.select(group, order, value), [group, order], "online-stop"), group, order, value)
    error = F.when((F.col("n") >= n_min) & (F.abs("mean") > 1e-12), factor * F.col("std") / (F.sqrt("n") * F.abs("mean")))
    judged = moments.withColumn("error", error).withColumn("ok", F.coalesce(F.col("error") <= tolerance, F.lit(False)))
    #: Rows since the last one that was not within the tolerance.
    bad = F.when(~F.col("ok"), F.col("n"))
    judged = _carried(judged, [group], {"__bad": F.max(bad)}, {"__bad": F.max("__bad").over(_ranges([group])[0])})
    w = Window.partitionBy(PART, group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    steps = judged.withColumn("stable", F.col("n") - F.coalesce(F.greatest(F.max(bad).over(w), "__bad"), F.lit(0)))
    stop = F.min(F.when(F.col("stable") >= stable_steps, F.struct("n", "mean", "error")))
    ends = steps.groupBy(group).agg(stop.alias("s"), F.max(F.struct("n", "mean", "error")).alias("e"))
    return ends.select(group, F.col("s.n").alias("n_stop"), F.coalesce("s.mean", "e.mean").alias("mean"), F.coalesce("s.error", "e.error").alias("error"))


def lag_difference(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with their value less the one before in the group; null for the first."""
    parted = range_parts(rows, [*group, *order], "lag")
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    carried = _carried(parted, group, {"__last": last}, {"__last": F.lag("__last").over(Window.partitionBy(*group).orderBy(PART))})
    inside = Window.partitionBy(PART, *group).orderBy(*order)
    before = F.when(F.row_number().over(inside) == 1, F.col("__last.v")).otherwise(F.lag(value).over(inside))
    return carried.withColumn(name, F.col(value) - before).drop(PART, "__last")


def without_nan(value: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
