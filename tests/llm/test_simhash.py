import random

import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import multi_index as M
from plumbline.llm import simhash as S


def brute_fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_whole_result_against_brute_force(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "déjà", "Éa", "x", "y1", "the", "of", "zz"]
    texts = [None, "", " \n\t", "one", "One two", "one  TWO", "a b c", "A\x0bb\x0cC", "tail " * 20_000]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        texts += [" ".join(base), " ".join(base).upper(), " ".join([*base, rng.choice(words)])]
    rows = [(1000 - i, t, "clash") for i, t in enumerate(texts)] + [(1000, None, "x"), (5, "one", "x")]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)).collect()
    prints = {(i, t): brute_fingerprint(t) for i, t, _ in rows}
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((i, f"{brute_fingerprint(t):016x}") for i, t, _ in rows)
    root = brute_components(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), fp in prints.items():
        least[root[fp]] = min(i, least.get(root[fp], i))
    assert all(r.component_id == least[root[int(r.fingerprint, 16)]] for r in got)


def chains(rng, count, steps):
    values = {0}
    for _ in range(count):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            values.add(at)
            for _ in range(rng.choice(steps)):
                at ^= 1 << rng.randrange(64)
    return sorted(v - (1 << 64) if v >> 63 else v for v in values)


def all_links(values, distance):
    return {(max(a, b), min(a, b)) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance}


def found_links(spark, values, *args):
    fps = spark.createDataFrame([(v,) for v in values], "fp long").repartition(3)
    return {(r.u, r.v) for r in M.near_links(fps, *args).collect()}


@pytest.mark.parametrize(("distance", "segments"), [(0, 1), (2, 2), (2, 3), (3, 2), (3, 4), (6, 4)])
def test_all_links_at_any_distance(spark, distance, segments):
    values = chains(random.Random(9), 40, [1, 2, 2, 3, 5])
    expected = all_links(values, distance)
    assert found_links(spark, values, distance, segments) == expected and (distance == 0 or len(expected) > 100)


@pytest.mark.parametrize(("distance", "segments"), [(2, 2), (3, 3)])
def test_crowded_entries_lose_nothing(spark, distance, segments):
    rng = random.Random(4)
    base = rng.getrandbits(63)
    values = {base ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 6))) for _ in range(250)}
    values |= {base ^ (1 << 45) ^ (1 << b) for b in range(30)} | {rng.getrandbits(63) for _ in range(50)}
    values = sorted(values)
    assert found_links(spark, values, distance, segments, 8) == found_links(spark, values, distance, segments) == all_links(values, distance)


def test_components_of_links(spark):
    values = chains(random.Random(9), 40, [1, 2, 2, 3])
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    root = {r.node: r.root for r in M.components(M.near_links(fps, 2, 2)).collect()}
    expected = brute_components(values, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    assert {v: root.get(v, v) for v in values} == expected


def test_tables_are_keyed_by_segments_and_candidates_are_dropped(spark):
    base = 0x0123456789ABCDEF
    #: The first two agree in their lower half only, the first and the third are near.
    values = [base, base ^ (0xFFFF << 40), base ^ 1]
    start = spark.createDataFrame([(0, v, -1, 2) for v in values], "entry long, fp long, free long, left int")
    by_parts = {n: {r.entry for r in M.expanded(start, n, False).collect()} for n in (1, 2, 4)}
    assert len({frozenset(e) for e in by_parts.values()}) == 3 and [len(e) for e in by_parts.values()] == [3, 4, 7]
    looked, tables = M.expanded(start, 2, True), M.expanded(start, 2, False)
    assert looked.count() == 3 * 2 * 33
    met = {(r.u, r.v) for r in looked.selectExpr("entry", "fp u").join(tables.selectExpr("entry", "fp v"), "entry").filter("u > v").collect()}
    kept = {(r.u, r.v) for r in M.verified(looked, tables, 2).collect()}
    assert kept == {(max(base, base ^ 1), min(base, base ^ 1))} and met > kept and len(met) == 3


def test_empty_and_one_of_each(spark):
    docs = spark.createDataFrame([(3, "a b c d", 1), (1, "A b c d", 2), (1, "A b c d", 2), (7, None, 3), (8, "", 4), (None, "n", 5), (None, "n", 6)], "doc_id long, text string, n_chars int")
    assert S.near_duplicates(docs.limit(0)).count() == 0
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 7]
    assert S.one_of_each(docs.limit(0)).count() == 0


def test_bad_distance(spark):
    with pytest.raises(ValueError):
        M.near_links(spark.range(1).select(F.col("id").alias("fp")), -1, 2)


def test_what_is_looked_up_is_not_broadcast(spark):
    """A ball has many more rows than the table that it is made of, whose size Spark takes for it."""
    fps = spark.range(100).select(F.xxhash64("id").alias("fp"))
    start = fps.select(F.lit(0).cast("long").alias("entry"), "fp", F.lit(-1).cast("long").alias("free"), F.lit(2).alias("left"))
    plan = M.verified(M.expanded(start, 2, True), M.expanded(start, 2, False), 2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
