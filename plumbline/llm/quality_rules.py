"""Quality rules: fixed base rules and robust multivariate outliers, all in DataFrame expressions.

Base: a text fails with fewer than ``min_words`` words or if over half of its words stand in three-word
windows that the text holds twice or more.

The method: each text gives a vector of transformed statistics (FEATURES). Per group of language and source, per
language, and over all texts, a minimum-covariance-determinant estimate of centre and scatter is found: from two
starts (the share ``core`` of the texts that are nearest to the medians in units of the median deviation, by the
sum of squares and by the largest part) concentration steps follow: mean and covariance of the texts inside,
distances to those, the share ``core`` with the smallest distances inside, and again until no determinant falls any
more (``steps`` at most). The start that ends with the smaller determinant is taken. Only texts that pass the base
rules enter.

An estimate from few texts is uncertain, so each is shrunk towards its parent's: as if ``prior`` texts of the
parent (the language's, over all texts, and last a wide scatter, WIDE) had been seen besides its own. So no size
decides whether a group is judged; a table of very few texts is judged by WIDE and loses none.

Scatters are scaled so that the median squared distance is that of a chi-squared variable (never down), and
FLOORS are added, the scatter that is granted to any group: in one whose texts are all alike in a statistic,
a text may depart from them by about 4.7 floors (a quarter of its words repeated, one symbol or mark in twenty
words, one repeated line in 25 words, a fifth more letters a word).

Verdict: squared Mahalanobis distances beyond the chi-squared variable's 0.999 quantile are rejected.

Each step is a grouped aggregation with partial sums on the map side; quantiles come from counts by bucket
(of 1/64 of an octave, or 1/256 of a statistic), so they are the same for any partitioning and no state grows with
a group. What returns to the rows are the few numbers of their group, by an equi-join on the group and a salt, so
that a hot group's rows are dealt to many tasks.

Defined results: null texts have no words. Null languages and sources are groups of their own. Repeated rows
stay. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.scratch import materialize

WORD_BREAK = r"[\\x20\\x09-\\x0D]+"
#: Transformed statistic -> standard deviation granted to any group, and that of a table without texts.
FLOORS = {"f_length": 0.04, "f_symbols": 0.048, "f_repeats": 0.105, "f_lines": 0.042, "f_capitals": 0.04, "f_marks": 0.048}
WIDE = {"f_length": 0.4, "f_symbols": 0.3, "f_repeats": 0.4, "f_lines": 0.2, "f_capitals": 0.3, "f_marks": 0.3}
FEATURES = tuple(FLOORS)
#: Buckets in a unit of a statistic, and in an octave of squared distances.
FINE, OCTAVE = 256, 64
#: A group's rows meet its few numbers in this many tasks, if those are too many groups for a broadcast.
SALTS = 16
STARTS = 2
_CELLS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates value once and gives it to body under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeated_words(words: str) -> str:
    """SQL: words (of the array expression) in three-word windows that occur twice or more, the first included.

    Windows are hashed, hashes sorted with their places; neighbours that are equal mark places. Marked places
    in order each cover three words, less what the next one covers.
    """
    hashes = "transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))"
    placed = "array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))"
    marked = "array_sort(filter(transform(s, (e, k) -> CASE WHEN e.x = get(s, k - 1).x OR e.x = get(s, k + 1).x THEN e.i END), p -> p IS NOT NULL))"
    covered = "aggregate(transform(p, (q, k) -> coalesce(least(3, q - get(p, k - 1)), 3)), 0, (a, b) -> a + b)"
    counted = _let("s", placed, _let("p", marked, covered))
    some = _let("h", hashes, f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {counted} END")
    return _let("w", words, f"CASE WHEN size(w) < 4 THEN 0 ELSE {some} END")


def _without(pattern: str) -> str:
    return f"char_length(regexp_replace(t, '{pattern}', ''))"


def statistics(docs: DataFrame, *kept: str) -> DataFrame:
    """kept columns and a text's counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_marks."""
    text = "coalesce(text, '')"
    words = f"filter(split({text}, '{WORD_BREAK}'), x -> x <> '')"
    lines = r"filter(split(t, '\\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"
    parts = {
        "word_chars": _without(WORD_BREAK),
        "n_symbols": f"char_length(t) - {_without('[#*$%&|<>]+')}",
        "n_dup_lines": _let("l", lines, "size(l) - size(array_distinct(l))"),
        "n_capitals": rf"char_length(t) - {_without(r'\\p{Lu}+')}",
        "n_marks": rf"char_length(t) - {_without('[!?]+')}",
        "rw": _let("v", words, f"struct(size(v) AS n_words, {repeated_words('v')} AS n_repeat_words)"),
    }
    packed = _let("t", text, "struct(" + ", ".join(f"{sql} AS {name}" for name, sql in parts.items()) + ")")
    counts = docs.select(*kept, F.expr(packed).alias("c"))
    names = {"n_words": "c.rw.n_words", "word_chars": "c.word_chars", "n_symbols": "c.n_symbols", "n_dup_lines": "c.n_dup_lines", "n_repeat_words": "c.rw.n_repeat_words", "n_capitals": "c.n_capitals", "n_marks": "c.n_marks"}
    return counts.select(*kept, *(F.col(path).cast("long").alias(name) for name, path in names.items()))


def features(stats: DataFrame) -> DataFrame:
    """stats with the transformed statistics: logarithm of the mean word length, and square roots of rates."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.withColumns(
        {
            "f_length": F.log(chars / words),
            "f_symbols": F.sqrt(F.col("n_symbols") / words),
            "f_repeats": F.sqrt(F.col("n_repeat_words") / words),
            "f_lines": F.sqrt(F.col("n_dup_lines") / words),
            "f_capitals": F.sqrt(F.col("n_capitals") / chars),
            "f_marks": F.sqrt(F.col("n_marks") / words),
        }
    )


def quantile_bucket(rows: DataFrame, keys: list[str], bucket: Column, *shares: float) -> DataFrame:
    """keys and b0, b1, ...: the first bucket up to which a share of a group's rows is."""
    counts = rows.groupBy(*keys, bucket.alias("__b")).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)  # a bounded number of buckets
    placed = counts.withColumns({"__c": F.sum("__n").over(upto), "__t": F.sum("__n").over(Window.partitionBy(*keys))})
    return placed.groupBy(*keys).agg(*(F.min(F.when(F.col("__c") >= F.lit(p) * F.col("__t"), F.col("__b"))).alias(f"b{k}") for k, p in enumerate(shares)))


def octave(d2: Column) -> Column:
    """Bucket of a squared distance."""
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-6))) * OCTAVE)


def octave_end(bucket: Column) -> Column:
    """Upper end of a bucket of squared distances."""
    return F.pow(F.lit(2.0), (bucket + 1) / F.lit(float(OCTAVE)))


def with_numbers(rows: DataFrame, numbers: DataFrame, *keys: str) -> DataFrame:
    """rows (with salt) joined to their group's numbers, a hot group's rows in SALTS parts."""
    return rows.join(numbers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"])


def _moments() -> list[Column]:
    out = [F.count("*").alias("n"), *(F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES))]
    return out + [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in _CELLS]


def with_factor(estimates: DataFrame) -> DataFrame:
    """Adds the lower triangular factor l{i}_{j} of the scatter with the floors' variances added, and half_log_det."""
    for i, a in enumerate(FEATURES):
        for j in range(i + 1):
            left = F.col(f"c{i}_{j}") + F.lit(FLOORS[a] ** 2 if i == j else 0.0)
            for k in range(j):
                left = left - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            estimates = estimates.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(left, F.lit(FLOORS[a] ** 2 / 2))) if i == j else left / F.col(f"l{j}_{j}"))
    return estimates.withColumn("half_log_det", sum((F.log(f"l{i}_{i}") for i in range(1, len(FEATURES))), F.log("l0_0")))


_FACTOR = [f"m{i}" for i in range(len(FEATURES))] + [f"l{i}_{j}" for i, j in _CELLS]


def with_distance(rows: DataFrame, estimates: DataFrame, *keys: str) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance to their group's estimate, by forward substitution."""
    joined = with_numbers(rows, estimates.select(*keys, *_FACTOR), *keys)
    for i, a in enumerate(FEATURES):
        left = F.col(a) - F.col(f"m{i}")
        for k in range(i):
            left = left - F.col(f"l{i}_{k}") * F.col(f"z{k}")
        joined = joined.withColumn(f"z{i}", left / F.col(f"l{i}_{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(FEATURES))), F.col("z0") * F.col("z0"))
    return joined.select(*rows.columns, d2.alias("d2"))


def chi2_quantile(p_normal: float, d: int) -> float:
    """Wilson and Hilferty's approximation; p_normal: the standard normal quantile of the probability."""
    return d * (1 - 2 / (9 * d) + p_normal * (2 / (9 * d)) ** 0.5) ** 3


def group_key(level: int) -> Column:
    """Key of a row's group: over all texts (0), of its language (1), of its language and source (2)."""
    return F.to_json(F.struct(F.lit(level).alias("k"), *(["lang"] if level else []), *(["source"] if level == 2 else [])))


def middles(rows: DataFrame) -> DataFrame:
    """g, medians m{i} and median deviations s{i} (with the floors as the least)."""

    def medians(tall: DataFrame) -> DataFrame:
        found = quantile_bucket(tall, ["g", "i"], F.floor(F.col("x") * FINE), 0.5)
        return found.select("g", "i", ((F.col("b0") + 0.5) / FINE).alias("m"))

    tall = rows.select("g", "salt", F.posexplode(F.array(*FEATURES)).alias("i", "x"))
    centre = materialize(medians(tall), "mcd-centre")
    away = with_numbers(tall, centre, "g", "i").select("g", "i", F.abs(F.col("x") - F.col("m")).alias("x"))
    both = centre.join(medians(away).withColumnRenamed("m", "s"), ["g", "i"])
    floors = F.element_at(F.array(*(F.lit(v) for v in FLOORS.values())), F.col("i") + 1)
    both = both.withColumn("s", F.greatest(1.4826 * F.col("s"), floors))
    wide = [F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(len(FEATURES)) for c in ("m", "s")]
    return materialize(both.groupBy("g").agg(*wide), "mcd-middles")


def mcd_estimates(rows: DataFrame, core: float, steps: int) -> DataFrame:
    """One row a group g: n, centre m{i} and scatter c{i}_{j} with the least determinant, scaled. rows: g, salt, FEATURES."""
    parts = [F.pow((F.col(f) - F.col(f"m{i}")) / F.col(f"s{i}"), 2) for i, f in enumerate(FEATURES)]
    starts = F.array(sum(parts[1:], parts[0]), F.greatest(*parts))
    placed = with_numbers(rows, middles(rows), "g").select("g", "salt", *FEATURES, F.posexplode(starts).alias("start", "d2"))
    both = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    keys, before = ["g", "start"], None
    for _ in range(steps):
        limits = materialize(quantile_bucket(placed, keys, octave(F.col("d2")), core), "mcd-limits")
        inner = with_numbers(placed, limits, *keys).filter(octave(F.col("d2")) <= F.col("b0"))
        estimates = materialize(with_factor(inner.groupBy(*keys).agg(*_moments())), "mcd-step")
        placed = with_distance(both, estimates, *keys)
        if before is not None:
            falls = estimates.alias("a").join(before.alias("b"), keys).agg(F.max(F.col("b.half_log_det") - F.col("a.half_log_det"))).first()[0]  # one number
            if falls is None or falls < 1e-3:
                break
        before = estimates
    best = estimates.groupBy("g").agg(F.min_by(F.struct("start", *(c for c in estimates.columns if c not in keys)), F.struct("half_log_det", "start")).alias("e"))
    best = materialize(best.select("g", "e.*").drop("start"), "mcd-best")
    typical = quantile_bucket(with_distance(rows, best, "g"), ["g"], octave(F.col("d2")), 0.5)
    counts = rows.groupBy("g").agg(F.count("*").alias("n_all"))
    scale = F.greatest(octave_end(F.col("b0")) / F.lit(chi2_quantile(0.0, len(FEATURES))), F.lit(1.0))
    scaled = best.join(typical, "g").join(counts, "g").withColumn("scale", scale)
    return scaled.select("g", F.col("n_all").alias("n"), *(f"m{i}" for i in range(len(FEATURES))), *((F.col(f"c{i}_{j}") * F.col("scale")).alias(f"c{i}_{j}") for i, j in _CELLS))


def shrunk(own: DataFrame, parent: DataFrame | None, prior: float, on: list[str]) -> DataFrame:
    """own's estimates as if ``prior`` texts of the parent's had been seen too; without a parent, of scatter WIDE."""
    d = range(len(FEATURES))
    if parent is None:
        names = [f"c{i}_{j}" for i, j in _CELLS]
        wide = [F.lit(WIDE[FEATURES[i]] ** 2 if i == j else 0.0) for i, j in _CELLS]
        share = F.col("n") / (F.col("n") + F.lit(prior))
        return own.withColumns({name: share * F.col(name) + (1 - share) * w for name, w in zip(names, wide, strict=True)})
    joined = own.alias("a").join(parent.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on] or F.lit(True))
    share = F.col("a.n") / (F.col("a.n") + F.lit(prior))
    gap = [F.col(f"a.m{i}") - F.col(f"b.m{i}") for i in d]
    centre = [(F.col(f"b.m{i}") + share * gap[i]).alias(f"m{i}") for i in d]
    scatter = [(share * F.col(f"a.c{i}_{j}") + (1 - share) * F.col(f"b.c{i}_{j}") + share * (1 - share) * gap[i] * gap[j]).alias(f"c{i}_{j}") for i, j in _CELLS]
    return joined.select("a.g", "a.lang", "a.source", "a.n", *centre, *scatter)


def judge_quality(docs: DataFrame, min_words: int = 50, core: float = 0.75, steps: int = 12, prior: float = 50.0) -> DataFrame:
    """Every row's counts, base_failed, distance (squared; null if not judged) and kept."""
    stats = statistics(docs, "doc_id", "lang", "source")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = materialize(features(stats).withColumn("base_failed", failed), "quality-stats")
    judged = rows.filter(~F.col("base_failed")).withColumn("salt", F.pmod(F.hash("doc_id", *FEATURES), F.lit(SALTS)))
    levels = F.explode(F.array(*(F.struct(group_key(k).alias("g"), F.lit(k).alias("level"), F.when(F.lit(k > 0), F.col("lang")).alias("lang"), F.when(F.lit(k > 1), F.col("source")).alias("source")) for k in range(3))))
    tall = judged.select(levels.alias("k"), "salt", *FEATURES).select("k.*", "salt", *FEATURES)
    names = tall.select("g", "level", "lang", "source").distinct()
    found = materialize(mcd_estimates(tall.select("g", "salt", *FEATURES), core, steps).join(names, "g"), "mcd")
    level = [found.filter(F.col("level") == k).drop("level") for k in range(3)]
    by_lang = shrunk(level[1], shrunk(level[0], None, prior, []), prior, [])
    final = materialize(with_factor(shrunk(level[2], by_lang, prior, ["lang"])), "mcd-shrunk")
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    placed = with_distance(judged.select(*base, "salt", group_key(2).alias("g"), *FEATURES), final, "g")
    accepted = placed.select(*base, F.col("d2").alias("distance"), (F.col("d2") <= chi2_quantile(3.0902, len(FEATURES))).alias("kept"))
    others = rows.filter("base_failed").select(*base, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return accepted.unionByName(others)
