import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from plumbline.llm import spelling


def brute(rows, every=97, least=3, times=2):
    """The contract by deletion forms: words one edit apart share one, then are compared whole."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}
    met = defaultdict(set)
    for w in counts:
        for form in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            met[form].add(w)

    def edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: {v for form in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in met[form] if v != w and edit(v, w)} for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    parts = ["ing", "tion", "ä", "é", "st", "er", "ÿ", "×", "a", "b", "Ab", "ü", "qu"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 5))) for _ in range(150)]
    words += [w[:i] + rng.choice("abx") + w[i + rng.randint(0, 1) :] for w in words for i in [rng.randrange(len(w))]]
    #: Anagrams of two letters, long words one edit apart, repeats.
    words += ["".join(rng.choice("ab") for _ in range(8)) for _ in range(120)] + ["long" * 20 + x for x in ("", "x", "y", "xy")] + ["a" * 300, "a" * 301, "a" * 302]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", "1", "\n"]) for _ in range(60)) for _ in range(80)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, texts[1]), (5, texts[1]), (200, None), (201, ""), (202, " ".join(words * 3))]


@pytest.mark.parametrize("most", [4096, 20])
def test_equals_brute_force(spark, rows, most):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(3)
    got, expected = rows_of(spelling.spelling_variants(docs, every=7, most=most)), brute(rows, every=7)
    assert len(expected) > 200 and sum(r[1] is not None for r in expected) > 20
    assert got == expected


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert rows_of(spelling.spelling_variants(docs, most=300)) == brute([tuple(r) for r in docs.collect()])


def test_chains_of_forms(spark):
    chain = ["aaaaa" + "b" * k for k in range(7)]
    rows = [(1, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k)))]
    got = rows_of(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), every=1 << 33))
    assert got == brute(rows, every=1 << 33) and {r[2] for r in got} == {chain[-1]}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert spelling.spelling_variants(docs).collect() == [] == spelling.spelling_variants(docs.limit(0)).collect()
