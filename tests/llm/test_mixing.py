import random

from plumbline.llm import mixing as M


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    keys = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None] * (None in sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    target, left, open_ = {}, share * sum(sizes.values()), set(keys)
    while open_:
        total = sum(weight[k] for k in open_)
        stopped = {k for k in open_ if left * weight[k] / total > repeats * sizes[k]}
        if not stopped:
            target |= {k: left * weight[k] / total for k in open_}
            break
        for k in stopped:
            target[k] = float(repeats * sizes[k])
        left -= sum(target[k] for k in stopped)
        open_ -= stopped
    return target


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 200]))), rng.choice(sources)) for i in range(n)]


def test_targets_and_nearness(spark):
    for seed, sources in ((1, ["a", "b", None, "é", "B"]), (2, ["x"]), (3, [f"s{i}" for i in range(40)] + ["hot"] * 30)):
        rows = rows_of(seed, 1500, sources)
        got = M.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
        size = {i: len(t.split()) for i, t, _ in rows}
        source = {i: s for i, _, s in rows}
        sums = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
        target = brute_targets(sums)
        taken = dict.fromkeys(sums, 0)
        assert len(got) == len(rows)
        for r in got:
            assert r["size"] == size[r.doc_id] and r.source_size == sums[source[r.doc_id]]
            assert abs(r.target - target[source[r.doc_id]]) < 1e-6 * max(1, r.target)
            assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
            taken[source[r.doc_id]] += r.taken
        for s in sums:
            largest = max((size[i] for i in size if source[i] == s), default=0)
            assert abs(taken[s] - target[s]) <= largest / 2 + 1e-6


def test_reruns_agree_whatever_the_partitions(spark):
    docs = spark.createDataFrame(rows_of(4, 600, ["a", "b", "c"]), "doc_id long, text string, source string")
    runs = [{(r.doc_id, r.taken) for r in M.mix_sources(docs.repartition(n)).collect()} for n in (1, 5)]
    assert runs[0] == runs[1]


def test_edges(spark):
    rows = [(1, None, None), (1, "a b", None), (1, "a b", None), (None, "", "s"), (2, "x " * 50_000, "t")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size int")
    got = M.mix_sources(docs).collect()
    assert len(got) == 5 and sorted(r["size"] for r in got) == [0, 0, 2, 2, 50_000]
    assert M.mix_sources(docs.limit(0)).count() == 0
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)
