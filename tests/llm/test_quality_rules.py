import random
import re

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality_rules as Q


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for found in places.values() if len(found) > 1 for i in found for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n \t", "a", "a b c", "a b c a b c", "a a a a a", "x\nx\n \n\nx", "#*$%&|<> !", "é É\x0bß\x85y\xa0z", "w " * 20_000]
    texts += ["".join(rng.choice("ab \n#") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.statistics(docs, "doc_id").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id])


def bucket(values, share):
    """The first bucket up to which a share of the values is."""
    values = np.sort(values)
    return values[int(np.ceil(share * len(values) - 1e-9)) - 1]


def octave(d2):
    return np.floor(np.log2(np.maximum(d2, 1e-6)) * Q.OCTAVE)


def brute_mcd(x, core=0.75, steps=12):
    """n, centre and scaled scatter of the rows of x, in numpy."""
    floors = np.array(list(Q.FLOORS.values()))
    middle = lambda c: (bucket(np.floor(c * Q.FINE), 0.5) + 0.5) / Q.FINE
    m = np.array([middle(c) for c in x.T])
    s = np.maximum(1.4826 * np.array([middle(np.abs(c - v)) for c, v in zip(x.T, m, strict=True)]), floors)
    z2 = ((x - m) / s) ** 2
    found = {0: [z2.sum(axis=1), None], 1: [z2.max(axis=1), None]}
    before = None
    for _ in range(steps):
        for k, (d2, _old) in found.items():
            inner = x[octave(d2) <= bucket(octave(d2), core)]
            mean, cov = inner.mean(axis=0), np.cov(inner.T, bias=True)
            full = cov + np.diag(floors**2)
            found[k] = [np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(full), x - mean), (np.linalg.slogdet(full)[1] / 2, k, mean, cov)]
        dets = [found[k][1][0] for k in found]
        if before is not None and max(b - a for a, b in zip(dets, before, strict=True)) < 1e-3:
            break
        before = dets
    _, k, mean, cov = min((f[1] for f in found.values()), key=lambda e: e[:2])
    typical = 2.0 ** ((bucket(octave(found[k][0]), 0.5) + 1) / Q.OCTAVE)
    return len(x), mean, cov * max(1.0, typical / Q.chi2_quantile(0.0, x.shape[1])), dets


def brute_shrunk(own, parent, prior=50.0):
    n, mean, cov = own[:3]
    share = n / (n + prior)
    if parent is None:
        return n, mean, share * cov + (1 - share) * np.diag(np.array(list(Q.WIDE.values())) ** 2)
    gap = mean - parent[1]
    return n, parent[1] + share * gap, share * cov + (1 - share) * parent[2] + share * (1 - share) * np.outer(gap, gap)


def make_docs(spark, outliers=()):
    rng = random.Random(8)
    rows = []
    for i in range(500):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(50, 90))]
        if i % 25 == 0:
            words = [w + rng.choice("#$%") for w in words]
        rows.append((i, " ".join(words), "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 5}"))
    rows += [(1000 + k, text, "en", "hot") for k, text in enumerate(outliers)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_estimates_against_brute_force(spark):
    docs = make_docs(spark)
    got = {r.doc_id: r for r in Q.judge_quality(docs).collect()}
    assert len(got) == 500
    stats = Q.features(Q.statistics(docs, "doc_id", "lang", "source")).filter("n_words >= 50").collect()
    groups = {}
    for r in stats:
        groups.setdefault((r.lang, r.source), []).append(r)
    vectors = lambda rows: np.array([[r[f] for f in Q.FEATURES] for r in rows])
    top = brute_shrunk(brute_mcd(vectors(stats)), None)
    floors = np.array(list(Q.FLOORS.values()))
    assert min(map(len, groups.values())) < 60 < max(map(len, groups.values()))
    for (lang, _), rows in groups.items():
        by_lang = brute_shrunk(brute_mcd(vectors([r for r in stats if r.lang == lang])), top)
        _, mean, cov = brute_shrunk(brute_mcd(vectors(rows)), by_lang)
        x = vectors(rows) - mean
        for r, d2 in zip(rows, np.einsum("ij,jk,ik->i", x, np.linalg.inv(cov + np.diag(floors**2)), x), strict=True):
            assert abs(got[r.doc_id].distance - d2) < 1e-6 * max(1, d2)
            assert got[r.doc_id].kept == (d2 <= Q.chi2_quantile(3.0902, len(Q.FEATURES)))
    judged = [r for r in got.values() if r.distance is not None]
    assert len(judged) == len(stats) and all(not r.kept for r in judged if r.doc_id % 25 == 0)
    assert sum(r.kept for r in judged if r.doc_id % 25) > 0.99 * sum(1 for r in judged if r.doc_id % 25)


def test_concentration_lowers_the_determinant():
    x = np.random.default_rng(1).normal(size=(300, 6)) * 0.2
    x[:60] += 3
    runs = [min(brute_mcd(x, steps=n)[3]) for n in (1, 2, 4, 12)]
    assert all(a >= b - 1e-9 for a, b in zip(runs, runs[1:]))


def test_outliers_in_every_statistic(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    plain = [[word(rng.randint(2, 8)) for _ in range(80)] for _ in range(6)]
    line = " ".join(word(4) for _ in range(5))
    texts = [
        " ".join(word(14) for _ in range(80)),
        " ".join(w + "#" * (i % 3 == 0) for i, w in enumerate(plain[1])),
        " ".join([*plain[2][:44], *plain[2][:18], *plain[2][44:62]]),
        "\n".join([" ".join(plain[3][:45]), *[line] * 8]),
        " ".join(w.upper() for w in plain[4]),
        " ".join(w + "!" * (i % 3 == 0) for i, w in enumerate(plain[5])),
    ]
    got = {r.doc_id: r for r in Q.judge_quality(make_docs(spark, texts)).collect()}
    for k in range(6):
        assert not got[1000 + k].base_failed and not got[1000 + k].kept, (Q.FEATURES[k], got[1000 + k])


def test_edges(spark):
    rows = [(1, None, None, None), (1, "", "en", None), (None, "a b " * 40, None, "s"), (2, " ".join(f"w{i}" for i in range(60)), "en", "s")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, kept int")
    got = Q.judge_quality(docs).collect()
    assert sorted((r.n_words, r.base_failed, r.kept) for r in got) == [(0, True, False), (0, True, False), (60, False, True), (80, True, False)]
    assert Q.judge_quality(docs.limit(0)).count() == 0


def test_groups_with_nulls(spark):
    docs = make_docs(spark).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    got = Q.judge_quality(docs).collect()
    assert len(got) == 500 and sum(r.distance is not None for r in got) == sum(not r.base_failed for r in got) > 450


def test_few_texts_are_not_rejected(spark):
    assert all(r.kept for r in Q.judge_quality(make_docs(spark).filter("doc_id in (1, 2, 25)")).collect() if not r.base_failed)
