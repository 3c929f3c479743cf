"""Mixing sources to target weights by hash thresholds, without sorting documents.

Every document has a hash of its doc_id. Sizes are summed by source and bucket of the hash's leading bits; a
running sum over a source's buckets finds the bucket in which its budget is reached. Only that bucket is
summed again, by the next bits, until it holds one hash. Documents whose hash is below the source's threshold
are in. A target over the source's size takes everything once and applies the threshold to the rest, so that
thresholds are nested and a document is taken floor or ceil(target / size) times, never over the allowed
number of repeats.

Targets: a source's share of the total by weight, stopped at repeats times its size, with the excess shared
again by weight among the others: the level at which min(cap, level * weight) sums to the total.

Defined results: null and empty texts have size 0 and count as whole copies of nothing. Null is a source of
its own, after all others. At the threshold the last document is in if that comes nearer to the target (a tie:
in); documents that share one hash (repeated doc_ids) go together there. An empty table gives no rows. Other
columns are kept; those named like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordered import running_before
from plumbline.sources.scratch import materialize

HASH_BITS = 60
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    """Number of runs without white space (\\x20, \\x09-\\x0D); null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text; null hashes like an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """One row a source: key, source_size and target. sized: columns key and size.

    Weights repeat over the sources in the order of their keys. Both global orders (of names, and of the
    size a unit of weight has) run by ranges.
    """
    sizes = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    ranked = running_before(sizes, ["key"], {"n": F.lit(1).cast("long")}, "mix-rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("n") % len(weights) + 1).cast("int"))
    capped = ranked.select("key", "source_size", weight.alias("w"), (repeats * F.col("source_size")).cast("double").alias("cap"))
    capped = capped.withColumn("level", F.col("cap") / F.col("w"))
    both = running_before(capped, ["level", "key"], {"caps_before": F.col("cap"), "w_before": F.col("w")}, "mix-level")
    total, w_all = both.agg(share * F.sum("source_size"), F.sum("w")).first()  # two numbers
    own = F.try_divide(F.lit(total) - F.col("caps_before"), F.lit(w_all) - F.col("w_before"))
    #: The first source in this order that its cap does not stop sets the level of all after it.
    (first,) = both.agg(F.min(F.when(own <= F.col("level"), F.struct("level", "key", own.alias("common"))))["common"]).first()
    target = F.col("cap") if first is None else F.least("cap", F.lit(first) * F.col("w"))
    return both.select("key", "source_size", target.alias("target"))


def _thresholds(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """key and edge: documents of key with a hash below edge are in. items: key, h, size; budgets: key, budget.

    Each round sums the items of one bucket a source by LEVEL_BITS more bits. It ends when no such bucket is
    divided any more, after HASH_BITS / LEVEL_BITS rounds at most.
    """
    open_ = budgets.select("key", F.lit(0).cast("long").alias("low"), F.col("budget").alias("rest"))
    settled = None
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = items if shift == HASH_BITS - LEVEL_BITS else items.join(open_.select("key", "low"), "key").filter(F.shiftright("h", shift + LEVEL_BITS) == F.shiftright("low", shift + LEVEL_BITS))
        sums = inside.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last"))
        running = Window.partitionBy("key").orderBy("bucket")
        cum = sums.withColumn("cum", F.sum("size").over(running)).join(open_.select("key", "rest"), "key")
        #: The first bucket that reaches the budget, if one does.
        edge = cum.filter(F.col("cum") >= F.col("rest")).groupBy("key").agg(F.min(F.struct("bucket", "cum", "size", "first", "last")).alias("b"))
        found = materialize(
            open_.join(edge, "key", "left").select(
                "key",
                F.col("b.first").alias("first"),
                F.col("b.last").alias("last"),
                F.shiftleft("b.bucket", shift).alias("low"),
                (F.col("rest") - (F.col("b.cum") - F.col("b.size"))).alias("rest"),
                F.col("b.size").alias("size"),
            ),
            "mix-level",
        )
        one_hash = F.col("first").isNull() | (F.col("first") == F.col("last"))
        done = found.filter(one_hash).select(
            "key",
            F.when(F.col("first").isNull(), F.lit(1 << HASH_BITS)).when(2 * F.col("rest") >= F.col("size"), F.col("first") + 1).otherwise(F.col("first")).alias("edge"),
        )
        settled = done if settled is None else settled.unionByName(done)
        open_ = found.filter(~one_hash).select("key", "low", "rest")
        if open_.isEmpty():
            break
    return settled


def source_key(source: Column) -> Column:
    """A key that orders sources by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def mix_plan(items: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """One row a source: key, source_size, target, whole (copies of all) and edge (one more below this hash)."""
    targets = source_targets(items, weights, share, repeats)
    #: Whole copies come first; what is left is the threshold's budget.
    ratio = F.try_divide(F.col("target"), F.col("source_size"))
    whole = F.coalesce(F.least(F.floor(ratio), F.lit(repeats)), F.lit(1)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = materialize(targets, "mix-targets")
    budgets = targets.filter((F.col("budget") > 0) & (F.col("whole") < repeats)).select("key", "budget")
    edges = _thresholds(items.select("key", "h", "size"), budgets)
    #: Written, so that its size is known before it meets the documents: a short plan then never moves them.
    return materialize(targets.join(edges, "key", "left").select("key", "source_size", "target", "whole", "edge"), "mix-plan")


def _copies(h: str, whole: str, edge: str) -> Column:
    return (F.col(whole) + F.when(F.col(h) < F.col(edge), 1).otherwise(0)).cast("int")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Every row's doc_id with size, source_size, target, copies and taken (= copies * size)."""
    items = docs.select("doc_id", source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"))
    items = materialize(items, "mix-items")
    mixed = items.join(mix_plan(items, weights, share, repeats), "key").withColumn("copies", _copies("h", "whole", "edge"))
    return mixed.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The rows of docs as often as the mix takes them. Texts meet only the sources' plan, not each other."""
    items = docs.select(source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"))
    #: Columns of our own, under names that the documents do not have.
    taken, own = {c.lower() for c in docs.columns}, []
    for name in ("key", "h", "plan", "copy"):
        while name in taken:
            name = f"_{name}"
        own.append(name)
    key, h, planned, copy = own
    plan = mix_plan(materialize(items, "mix-items"), weights, share, repeats).select(F.col("key").alias(key), F.struct("whole", "edge").alias(planned))
    keyed = docs.withColumns({key: source_key(F.col("source")), h: id_hash(F.col("doc_id"))}).join(plan, key)
    copies = _copies(h, f"{planned}.whole", f"{planned}.edge")
    each = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    return keyed.withColumn(copy, F.explode(each)).select(*docs.columns)
