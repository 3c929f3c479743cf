"""URL filters: a sorted sweep over reversed hosts with a stack of the rules that are open.

A host's canonical key is its labels in reverse, each ended by a dot: ``www.example.net`` becomes
``net.example.www.``. A rule for a host and its subdomains then is the interval of all keys that start with
the rule's key, and such intervals are disjoint or nested. Distinct hosts and the rules' hosts are sorted together
by key; in one pass the sweep keeps a stack with a slot for each number of labels. A host with rules that opens
takes its slot; a slot is closed as soon as the key has left its interval. Ranges of keys are swept in parallel:
each range's last stack is one row, from which the stack that the next range starts with follows.

What a slot holds of a host with rules does not grow with their number: its key and the distinct lengths of their
paths (no more than the longest path has characters). The rules themselves stay
in a table keyed by (host key, path). Each distinct (host, path) of the pages asks it for the prefixes of its path
of those lengths under each open host, an equi-join, and the longest rule found comes back.

Only distinct hosts enter the sweep and distinct (host, path) the look-up, so a host with a third of all pages is
one row in the first; what comes back to the pages is an equi-join on both, which adaptive execution can split.

Defined results: a null url, or one without ``://``, has empty host and path, and no rule fits an empty host
(but one for the empty host, which fits all). Equal rules count once. Of fitting rules the longest wins, then
the smaller text, then the smaller verdict. Repeated pages keep their rows. Columns named like the result's are
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.ordered import PART, range_parts

RULES_SCHEMA = "verdict string, host string, path string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules such as ("block", "example.com/de/") as a table of verdict, host and path."""
    rows = [(verdict, *(text[: text.index("/")], text[text.index("/") :])) for verdict, text in rules]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit("x"), url), "://", 1))
    tail = F.substring(url, F.length(rest) + 3, F.length(url))
    host = F.translate(F.regexp_extract(tail, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by a dot; the empty host's key is empty."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    )


def open_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host (distinct, from hosts) and open: key and path lengths of each host with rules whose interval holds it."""
    grouped = rules.select(host_key(F.col("host")).alias("key"), F.length("path").alias("n")).groupBy("key").agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    kind = "array<struct<key:string,lengths:array<int>>>"
    depth = F.length("key") - F.length(F.translate("key", ".", ""))
    deepest = grouped.agg(F.max(depth)).first()[0]
    if deepest is None:
        return hosts.select("host", F.array().cast(kind).alias("open"))
    events = grouped.select("key", F.lit(None).cast("string").alias("host"), depth.alias("depth"), "lengths").unionByName(
        hosts.select(host_key(F.col("host")).alias("key"), "host", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<int>").alias("lengths"))
    )
    parted = range_parts(events, ["key"], "url-sweep")
    sweep = Window.partitionBy(PART).orderBy("key", F.col("depth").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    slots = [f"slot{d}" for d in range(deepest + 1)]
    opens = [F.when(F.col("depth") == d, F.struct("key", "lengths")) for d in range(deepest + 1)]
    closing = parted.groupBy(PART).agg(*(F.max(o).alias(s) for o, s in zip(opens, slots, strict=True)))
    carried = closing.select(PART, *(F.last(s, ignorenulls=True).over(before).alias(f"{s}_in") for s in slots))
    swept = parted.select(PART, "key", "host", *(F.last(o, ignorenulls=True).over(sweep).alias(s) for o, s in zip(opens, slots, strict=True)))
    stack = [F.coalesce(s, f"{s}_in") for s in slots]
    still_open = F.array(*(F.when(F.col("key").startswith(s["key"]), s) for s in stack))
    return swept.filter(F.col("host").isNotNull()).join(carried, PART, "left").select("host", F.filter(still_open, lambda s: s.isNotNull()).alias("open"))


def best_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path (distinct, from places), rule and verdict, for those that a rule fits."""
    text = F.concat("host", "path")
    table = rules.groupBy(host_key(F.col("host")).alias("key"), F.col("path").alias("prefix")).agg(F.min(F.struct((-F.length(text)).alias("order"), text.alias("rule"), "verdict")).alias("r"))
    opened = places.join(open_hosts(places.select("host").distinct(), rules), "host")
    asked = opened.select("host", "path", F.explode("open").alias("o")).select("host", "path", F.col("o.key").alias("key"), F.explode(F.filter("o.lengths", lambda n: n <= F.length("path"))).alias("n"))
    asked = asked.select("host", "path", "key", F.expr("left(path, n)").alias("prefix"))
    found = asked.join(table, ["key", "prefix"]).groupBy("host", "path").agg(F.min("r").alias("r"))
    return found.select("host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (text of the rule that fits best, else null) and verdict.

    rules: table of verdict, host, path, of any size.
    """
    host, path = url_host_path(F.col(url))
    split = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    best = best_rules(split.select("host", "path").distinct(), rules.select("verdict", "host", "path"))
    return split.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(*split.columns, "rule", "verdict")
