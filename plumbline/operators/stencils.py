"""Finite differences as tables: a row for each point that a derivative needs, sums of weighted results, and errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import spread

#: Share of the room to a bound that a step may take, so that two steps stay inside.
ROOM = 0.45


def _points(value: Column, offsets: Sequence[tuple[float, float]], step: Column) -> Column:
    """Points at multiples of the step with their weights; the weights' common divisor is two steps."""
    return F.array(*(F.struct(F.try_divide(F.lit(w), 2.0 * step).alias("weight"), (value + k * step).alias("moved")) for w, k in offsets))


def stencils(rows: DataFrame, names: Sequence[str], rel_step: float, bounds: Mapping[str, tuple[float, float]] | None = None, scheme: str = "central") -> DataFrame:
    """For each row and name the rows with that value moved, with name, direction, step and weight.

    A step is rel_step times the value's size, or times 1 if that is larger. ``central``: one step up and one down, each
    at most ROOM of what is left to the nearer bound, if anything is. ``edge-auto``: central where a whole step fits on
    both sides; else second-order differences to the side with more room (down if equal), steps at most ROOM of it. A
    step that is not positive is an error. The sum of weight times result is the derivative.
    """
    if scheme not in ("central", "edge-auto"):
        raise ValueError(f"unknown scheme {scheme}")
    kinds = []
    for name in names:
        value = F.col(name).cast("double")
        wanted = rel_step * F.greatest(F.abs(value), F.lit(1.0))
        centre = lambda step, value=value: (F.lit("centered"), step, _points(value, ((1.0, 1), (-1.0, -1)), step))
        if bounds is None:
            choice = [(F.lit(True), *centre(wanted))]
        else:
            low, high = (F.lit(float(b)) for b in bounds[name])
            down, up = value - low, high - value
            room = ROOM * F.least(down, up)
            if scheme == "central":
                choice = [(F.lit(True), *centre(F.when(room > 0, F.least(wanted, room)).otherwise(wanted)))]
            else:
                back, ahead = F.least(wanted, ROOM * down), F.least(wanted, ROOM * up)
                choice = [
                    ((value - wanted >= low) & (value + wanted <= high), *centre(wanted)),
                    (down >= up, F.lit("backward"), back, _points(value, ((3.0, 0), (-4.0, -1), (1.0, -2)), back)),
                    (F.lit(True), F.lit("forward"), ahead, _points(value, ((-3.0, 0), (4.0, 1), (-1.0, 2)), ahead)),
                ]
        fields = [F.struct(F.lit(name).alias("name"), d.alias("direction"), s.alias("step"), p.alias("points")) for _, d, s, p in choice]
        kinds.append(reduce(lambda other, pair: F.when(pair[0], pair[1]).otherwise(other), reversed([(c[0], f) for c, f in zip(choice[:-1], fields[:-1])]), fields[-1]))
    each = spread(rows).withColumn("__s", F.explode(F.array(*kinds)))
    checked = F.when(F.col("__s.step") > 0, F.col("__s.points")).otherwise(F.raise_error(F.concat(F.lit("no room to move "), F.col("__s.name"))))
    each = each.withColumn("__p", F.explode(checked))
    moved = {n: F.when(F.col("__s.name") == n, F.col("__p.moved")).otherwise(F.col(n)) for n in names}
    return each.withColumns(moved).select(*rows.columns, "__s.name", "__s.direction", "__s.step", "__p.weight")


def differences(results: DataFrame, keys: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """keys and the derivatives of outputs: sums of weight times result over a stencil's points."""
    return results.groupBy(*keys).agg(*(F.sum(F.col("weight") * F.col(o)).alias(o) for o in outputs))


def error_table(found: DataFrame, reference: DataFrame, keys: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """keys with the norms of both rows of outputs, and the absolute and relative error, for keys of both tables."""
    size = lambda cells: F.sqrt(sum((c * c for c in cells), F.lit(0.0)))
    #: Both tables are as long as each other; the size of the files that they come from says nothing of that.
    both = found.alias("a").join(reference.hint("merge").alias("b"), list(keys))
    a, b = ([F.col(f"{s}.{o}") for o in outputs] for s in "ab")
    #: Written as columns first: each is used by several results.
    sized = both.select(*keys, size(a).alias("norm"), size(b).alias("reference_norm"), size([x - y for x, y in zip(a, b, strict=True)]).alias("absolute_error"))
    return sized.withColumn("relative_error", F.col("absolute_error") / F.greatest("reference_norm", F.lit(2.220446049250313e-16)))
