"""Samples of an exact size without replacement, by thresholds on a hash.

Rows have a hash of their key and a seed. Counts by the hash's leading bits, summed from the lowest bucket on, show in
which bucket the wanted number is reached; only that bucket is counted again by the next bits. Rows below the
threshold are in. Of the rows that have the very hash at which it is reached (a repeated key) as many are taken as are
missing, in the order of a table that is written for them. So no row moves but these, and a larger sample of one seed
holds every key of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.samples import BITS, bits
from plumbline.sources.scratch import materialize

STEP = 13


def _edge(hashes: DataFrame, wanted: int) -> tuple[int, int]:
    """The hash at which the wanted number of rows is reached, and how many rows are below it. hashes: column h."""
    low, below = 0, 0
    for shift in range(BITS - STEP, -1, -STEP):
        inside = hashes if shift == BITS - STEP else hashes.filter(F.shiftright("h", shift + STEP) == low >> (shift + STEP))
        #: At most 2^STEP buckets, of which one number comes back.
        counts = inside.groupBy(F.shiftright("h", shift).alias("bucket")).agg(F.count("*").alias("n"))
        total = F.sum("n").over(Window.orderBy("bucket"))
        first = counts.select("bucket", "n", total.alias("total")).filter(F.col("total") >= wanted - below).orderBy("bucket").first()
        low, below = first["bucket"] << shift, below + first["total"] - first["n"]
    return low, below


def exact_sample(rows: DataFrame, key: str, wanted: int, seed: int = 0, scale: str | None = None) -> DataFrame:
    """``wanted`` of the rows, or all if there are fewer; with a name for it, also the scale sqrt(rows / sampled).

    The scale makes sums of squares over the sample estimate those over all rows.
    """
    if wanted < 0:
        raise ValueError("a sample has no negative size")
    n = rows.count()
    out = rows if wanted >= n else rows.limit(0)
    if 0 < wanted < n:
        h = bits(seed, "sample", F.col(key))
        edge, below = _edge(rows.select(h.alias("h")), wanted)
        out = rows.filter(h < edge).unionByName(_some(rows.filter(h == edge), wanted - below))
    if scale is None:
        return out
    return out.withColumn(scale, F.lit((n / min(wanted, n)) ** 0.5 if min(wanted, n) else 1.0))


def _some(rows: DataFrame, wanted: int) -> DataFrame:
    """``wanted`` rows of those that share a hash: whole parts of the written table, then the first of one more."""
    names = rows.columns
    tied = materialize(rows.select(F.struct(*names).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "sample-ties")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tied.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = tied.join(bases, "part").filter(F.col("base") + F.col("at") - F.col("first") < wanted)
    return placed.select(*(F.col(f"row.{c}").alias(c) for c in names))
