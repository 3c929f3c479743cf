"""Multi-index hashing of 64-bit fingerprints, and components of the links found.

A fingerprint is cut into segments. Table s holds every fingerprint under (s, its bits there). For a distance d
each fingerprint enumerates, in each of m segments, the Hamming ball of radius d // m around its bits: two
fingerprints within d have a segment in which they differ by no more than that, so one's ball meets the other's
entry. Matches are fetched by an equi-join on the entry and their complete distance is verified.

An entry's number is a 64-bit mix of the segment's mask and bits; two entries that share a number only give
candidates that verification drops.

Crowded entries (over CROWD fingerprints agree in a segment) are not paired. There the bits that are still free
are cut in two, and the same is done with what is left of the distance: tables keyed by both segments, balls of
radius left // 2. So the group shrinks by agreeing in more and more bits, until an entry is not crowded or at
most LEAST_FREE bits are free, which bounds it by 2 ** LEAST_FREE. No link is lost on the way, none is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import slices
from plumbline.sources.scratch import materialize, release

BITS = 64
CROWD = 64
LEAST_FREE = 8
_ALL = (1 << BITS) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit integers (splitmix64's finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4096)
def segments_of(free: int, parts: int) -> tuple[int, ...]:
    """The free bits cut into ``parts`` masks of neighbouring bits."""
    bits = [b for b in range(BITS) if free >> b & 1]
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return tuple(sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:]) if z > a)


@lru_cache(maxsize=4096)
def ball(segment: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """What to flip in a segment to reach all within radius, and how many bits each flips."""
    bits = [b for b in range(BITS) if segment >> b & 1]
    flips = [(sum(1 << b for b in chosen), n) for n in range(min(radius, len(bits)) + 1) for chosen in combinations(bits, n)]
    return np.array([f for f, _ in flips], dtype=np.uint64), np.array([n for _, n in flips], dtype=np.int32)


def entry_numbers(group: np.ndarray, segment: int, bits: np.ndarray) -> np.ndarray:
    """Numbers of the entries (group, segment, bits)."""
    return mixed(mixed(group ^ np.uint64(segment)) ^ bits)


def expanded(rows: DataFrame, parts: int, balls: bool) -> DataFrame:
    """entry, fp, free and left of rows (entry, fp, free, left): table entries, or with balls what is looked up.

    free: the bits (as a mask) that no entry has fixed yet. left: the distance that is left to them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            group, fp, free = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("entry", "fp", "free"))
            left = batch.column("left").to_numpy(zero_copy_only=False)
            for mask in np.unique(free).tolist():
                for reach in np.unique(left[free == mask]).tolist() if balls else [0]:
                    chosen = (free == mask) & (left == reach) if balls else free == mask
                    f, g = fp[chosen], group[chosen]
                    segments = segments_of(mask, parts)
                    for segment in segments:
                        flips, cost = ball(segment, reach // len(segments) if balls else 0)
                        seen = (f & np.uint64(segment))[:, None] ^ flips[None, :]
                        numbers = entry_numbers(np.repeat(g, len(flips)), segment, seen.ravel())
                        n = len(numbers)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(numbers.view(np.int64)),
                                pa.array(np.repeat(f, len(flips)).view(np.int64)),
                                pa.array(np.full(n, _signed(mask & ~segment & _ALL), dtype=np.int64)),
                                pa.array(np.tile(reach - cost, len(f)).astype(np.int32)),
                            ],
                            ["entry", "fp", "free", "left"],
                        )

    return rows.select("entry", "fp", "free", "left").mapInArrow(run, "entry long, fp long, free long, left int")


def verified(looked: DataFrame, tables: DataFrame, distance: int) -> DataFrame:
    """u > v for what was looked up and found in a table, if the complete distance is small enough.

    Both sides are dealt by entry: Spark takes what was looked up for as small as the rows that it was made of, a ball's
    size too small, and would broadcast it.
    """
    met = looked.select("entry", F.col("fp").alias("u")).join(tables.select("entry", F.col("fp").alias("v")).hint("merge"), "entry")
    return met.filter((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)).select("u", "v")


def near_links(fps: DataFrame, distance: int, segments: int, crowd: int = CROWD) -> DataFrame:
    """u > v for all pairs of the distinct fingerprints (column fp) that differ in at most ``distance`` bits."""
    if distance < 0 or segments < 1:
        raise ValueError("a distance is 0 or more, and there is at least one segment")
    start = fps.select(F.lit(0).cast("long").alias("entry"), "fp", F.lit(-1).cast("long").alias("free"), F.lit(distance).alias("left"))
    stored = probing = start
    parts, found, used = segments, None, []
    while True:
        tables = materialize(expanded(stored, parts, False).select("entry", "fp", "free"), "segment-tables")
        crowded = materialize(tables.groupBy("entry").agg(F.count("*").alias("n"), F.bit_count(F.first("free")).alias("bits")).filter((F.col("n") > crowd) & (F.col("bits") > LEAST_FREE)).select("entry"), "segment-crowds")
        looked = expanded(probing, parts, True)
        any_crowded = not crowded.isEmpty()
        calm = tables.join(crowded, "entry", "left_anti") if any_crowded else tables
        links = materialize(verified(looked, calm, distance), "segment-links")
        found = links if found is None else found.unionByName(links)
        used += [tables, crowded, probing]
        if not any_crowded:
            release(*used)
            return found.distinct()
        probing = materialize(looked.join(crowded, "entry", "left_semi").select("entry", "fp", "free", "left"), "segment-probes")
        stored = tables.join(crowded, "entry", "left_semi").withColumn("left", F.lit(0))
        parts = 2


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for all nodes of edges (u, v), by star contraction."""
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        #: Large star: larger neighbours move to the smallest neighbour or the node itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        release(edges)
        #: Small star: smaller neighbours and the node move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "small-star")
        release(large)
        #: Done when every node has one link and no root is linked itself: then all links are final stars.
        loose = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u").unionByName(edges.select(F.col("v").alias("u")).distinct().join(edges.select("u").distinct(), "u"))
        if loose.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
