import random

import corpus_pipeline as P
from pyspark.sql import functions as F
from plumbline.llm import simhash as N


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_recall_and_precision_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    texts = []
    for i in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(80, 400))]
        texts.append(" ".join(base))
        for _ in range(2):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 35))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(" ".join([*base, *(rng.choice(vocabulary) for _ in range(len(base) // 10))]))
    #: A hot group: 120 near copies of one text, and texts that only share its half.
    base = [rng.choice(vocabulary) for _ in range(300)]
    for _ in range(120):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(base[:150] + [rng.choice(vocabulary) for _ in range(150)]) for _ in range(20)]
    texts += [None, "", "  ", "one", "One", "one two", "a b c d e", "a b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in N.similar_copies(docs).collect()}
    assert len(got) == len(texts)
    sets = [shingles(t) for t in texts]
    similar = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    found = sum(got[i] == got[j] for i, j in similar)
    low = [(i, j) for i, j in similar if jaccard(sets[i], sets[j]) < 0.9 and i < 600]
    print("recall", found, len(similar), "0.8 to 0.9:", sum(got[i] == got[j] for i, j in low), len(low))
    assert len(low) > 100 and sum(got[i] == got[j] for i, j in low) >= 0.95 * len(low)
    assert found >= 0.98 * len(similar)
    #: Every link is verified: components never leave those of the whole brute-force graph.
    root = list(range(len(texts)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, j in similar:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    assert all(find(i) == find(c) for i, c in got.items())
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_stage_takes_near_copies_that_op7_leaves(spark):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((2 * i, " ".join(base)))
        for _ in range(3):
            base[rng.randrange(200)] = "edited"
        rows.append((2 * i + 1, " ".join(base)))
    sets = [shingles(t) for _, t in rows]
    assert all(jaccard(sets[2 * i], sets[2 * i + 1]) >= 0.8 for i in range(40))
    kept = [r.doc_id for r in P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sum(i % 2 == 0 for i in kept) == 40 and sum(i % 2 for i in kept) <= 2


def separate_pairs(rng, n_words, pairs):
    """Texts that are similar to one other text only, by 0.8 to 0.85 (as near to that as so few words can be)."""
    texts = []
    while len(texts) < 2 * pairs:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
        copy = list(base)
        if n_words < 15:
            copy.append(f"w{rng.randrange(10**6)}")
        else:
            for _ in range(max(1, round(n_words / 45))):
                copy[rng.randrange(len(copy))] = "edited"
            while jaccard(shingles(" ".join(base)), shingles(" ".join(copy))) > 0.85:
                copy.append(f"w{rng.randrange(10**6)}")
        if jaccard(shingles(" ".join(base)), shingles(" ".join(copy))) >= 0.8:
            texts += [" ".join(base), " ".join(copy)]
    return texts


def test_recall_at_every_length(spark):
    """Pairs at the bound of similarity, alone: all of the short ones, 0.9 and more of the long ones."""
    rng, found = random.Random(8), {}
    lengths = (8, 12, 24, 60, 150, 400, 900)
    texts = [t for n in lengths for t in separate_pairs(rng, n, 100)]
    got = {r.doc_id: r.component_id for r in N.similar_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).collect()}
    for k, n in enumerate(lengths):
        found[n] = sum(got[i] == got[i + 1] for i in range(200 * k, 200 * k + 200, 2))
    print("recall of 100", found)
    assert all(found[n] == 100 for n in (8, 12, 24, 60, 150)) and all(found[n] >= 90 for n in (400, 900))
    assert all(got[i] // 2 == i // 2 for i in got)


def test_short_hot_group(spark):
    """A group of short texts, each similar to a base, and a chain in which only neighbours are similar."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join([*base, f"x{rng.randrange(10**6)}", f"y{i}"]) for i in range(150)]
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[i : i + 44]) for i in range(0, 120, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for every in (False, True):
        got = {r.doc_id: r.component_id for r in N.similar_copies(docs, every=every).collect()}
        assert {got[i] for i in range(150)} == {0} and {got[i] for i in range(150, 190)} == {150}


def test_sets_that_share_a_number_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i} b c d e f g") for i in range(30)] + [(99, "a3 b c d e f g")], "doc_id long, text string")
    plain = N.with_sets
    clashing = lambda docs, words: plain(docs, words).withColumn("node", F.lit(7 << 32).cast("long"))
    feats = N.numbered_apart(clashing(docs, 5)).collect()
    assert len({r.node for r in feats}) == len({r.full for r in feats}) == 30 and {r.node >> 32 for r in feats} == {7}
    expected = sorted(N.similar_copies(docs).collect())
    monkeypatch.setattr(N, "with_sets", clashing)
    assert sorted(N.similar_copies(docs).collect()) == expected


def test_sets_by_shuffle_and_by_broadcast_agree(spark, monkeypatch):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[i % 3 * 30 :], f"x{i}"])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent = sorted(N.similar_copies(docs).collect())
    monkeypatch.setattr(N, "BROADCAST_NODES", 0)
    assert sorted(N.similar_copies(docs).collect()) == sent and len({r.component_id for r in sent}) == 3


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    assert N.similar_copies(docs).count() == 0 and N.one_of_each(docs).count() == 0


def test_no_link_is_lost_in_long_texts(spark):
    """Pairs of long texts at the bound of similarity, whose segments often all differ: every one is found."""
    texts = separate_pairs(random.Random(18), 400, 150)
    got = {r.doc_id: r.component_id for r in N.similar_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: i // 2 * 2 for i in range(300)}


def test_parities_bound_the_difference():
    rng = N.np.random.default_rng(3)
    for n, m, common in ((0, 0, 0), (0, 5, 0), (1, 1, 1), (64, 65, 60), (100, 3000, 80), (500, 520, 460), (4096, 4097, 4000), (900, 900, 0)):
        pool = rng.permutation(N.np.unique(rng.integers(0, 1 << 48, 12_000, dtype=N.np.uint64)))
        a, b = pool[:n], pool[n - common : n - common + m]
        least = N.least_difference(N.parities(a), N.parities(b))
        assert least == N.least_difference(N.parities(b), N.parities(a)) <= n + m - 2 * common
    assert least > (n + m) / 9


def test_only_sets_that_may_be_similar_are_brought_together(spark, monkeypatch):
    """Texts that share a rare shingle and nothing else do not reach the comparison of their sets; a copy does."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = [" ".join(["one rare line of text", *(word() for _ in range(20))]) for _ in range(12)]
    texts += [" ".join(texts[0].split()[:-1])]
    got, plain = [], N.similar_pairs
    monkeypatch.setattr(N, "similar_pairs", lambda pairs, *rest: got.append(pairs.count()) or plain(pairs, *rest))
    found = {r.doc_id: r.component_id for r in N.similar_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), every=True).collect()}
    assert found == {**{i: i for i in range(12)}, 12: 0} and got == [1]


def test_tasks_forget_what_other_stages_remember(spark):
    """A task of near-dedup lets go the codec that its process has of an earlier stage."""
    from plumbline.llm import bpe
    from plumbline.llm.queries import tokenizer_path

    class Task:
        schema = spark.createDataFrame([], "doc_id long, text string").schema
        select = lambda self, *names: self
        mapInArrow = lambda self, run, kind: run

    run = N.with_sets(Task(), 5)
    bpe.codec(tokenizer_path("byte_bpe_50k.json"))
    assert len(bpe._codecs) == 1 and list(run(iter([]))) == [] and bpe._codecs == {}


def test_crowd_that_is_not_joined_is_not_paired(spark, monkeypatch):
    """Near copies of one text, many too far from all others to be joined: few rounds, and far fewer comparisons than pairs."""
    rng = random.Random(23)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(400):
        copy = list(base)
        for place in rng.sample(range(150), 1 + i % 6):
            copy[place] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    root = list(range(400))
    for i in range(400):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert sum(i == r for i, r in enumerate(root)) > 100 and sum(r == root[0] for r in root) > 150
    compared, plain = [], N.not_too_different
    monkeypatch.setattr(N, "not_too_different", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in N.similar_copies(docs).collect()} == dict(enumerate(root))
    print("compared", compared)
    assert len(compared) <= 3 and sum(compared) < 400 * 399 / 2 / 8


def test_rows_without_or_with_one_doc_id_are_all_compared(spark):
    """No different text is dropped for its doc_id, and near copies are found among rows that have none."""
    rng = random.Random(31)
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(6)]
    text = lambda k, edits: " ".join([*bases[k][: 60 - edits], *(f"e{i}" for i in range(edits))])
    #: One id with three texts, two of them near copies; a near copy without id of a named row; three rows without ids, two of them near copies.
    rows = [(7, text(0, 0)), (7, text(1, 0)), (7, text(1, 1)), (3, text(2, 0)), (None, text(2, 1)), (None, text(3, 0)), (None, text(3, 1)), (None, text(4, 0)), (9, text(5, 0)), (9, text(5, 0))]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, `key` string, `a.b` string").repartition(3)
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    which = lambda r: (r.doc_id, next(k for k in range(6) if r.text.startswith(" ".join(bases[k][:50]))))
    assert sorted(map(which, kept.collect()), key=lambda x: x[1]) == [(7, 0), (7, 1), (3, 2), (None, 3), (None, 4), (9, 5)]
