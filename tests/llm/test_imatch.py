import hashlib
import random

import numpy as np
import xxhash

from plumbline.llm import imatch as I


def brute_terms(text):
    strip = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»…“”„‘’–—"
    words = {w.strip(strip) for w in text.lower().split()} - {""}
    return {xxhash.xxh64(w.encode(), seed=0).intdigest() // 2 * 2 or 2 for w in words}


def brute_signatures(terms, shares):
    """Every signature is a hash of a sorted set, in plain Python: (share, subsets) groups read bits from the right."""
    hash_ = lambda found: xxhash.xxh32(b"".join(t.to_bytes(8, "little") for t in sorted(found)), seed=7).hexdigest() if found else "-" * 8
    out, low = [hash_(terms)], 1
    for share, subsets in shares:
        out += [hash_({t for t in terms if t >> low & (share - 1) == k}) for k in range(subsets)]
        low += share.bit_length() - 1
    return out


def brute_fingerprint(text, lexicon):
    terms = brute_terms(text)
    first = brute_signatures(terms & lexicon, [(4, 4), (16, 16), (64, 24), (256, 16), (1024, 8)])
    return first, brute_signatures(terms, [(8, 8)]) if terms else [hashlib.sha256(text.encode()).hexdigest()[:8], *["-" * 8] * 8]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    part = 0 if a[0][0][0] != "-" and b[0][0][0] != "-" else 1
    pairs = [(x, y) for x, y in zip(a[part], b[part], strict=True) if (x, y) != ("-" * 8, "-" * 8)]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def brute(rows, least=1e-4, most=0.02):
    tie = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64(t.encode(), seed=42).intdigest())
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: ((r[0] is not None, r[0] or 0), tie(r[1])))
    by_row, by_text = {}, {}
    for df, texts in ((by_row, [t for _, t in rows]), (by_text, {t for _, t in rows})):
        for t in texts:
            for term in brute_terms(t):
                df[term] = df.get(term, 0) + 1
    n = len({t for _, t in rows})
    lexicon = {t for t, c in by_row.items() if c >= max(2, least * n) and by_text[t] <= max(2, most * n)}
    make, out = lambda t: brute_fingerprint(t, lexicon), []
    flat = lambda f: "".join(f[0] + f[1])
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = make(text), make(edited), make(after)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), flat(a), flat(b), brute_likeness(a, b), brute_likeness(a, c)))
    return out


def as_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_whole_result_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"term{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    #: A third of the rows are copies of one text, whose terms stay in the band.
    rows = [(i * 3 % 457, t) for i, t in enumerate(texts + texts[:10])] + [(1000 + i, texts[7]) for i in range(80)]
    rows += [(9999, None), (9998, ""), (None, "Null id, é"), (12, "term1 term2"), (12, "term1 term1")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(5)
    assert as_rows(I.fingerprints(docs, most=0.2)) == sorted(brute(rows, most=0.2), key=str)


def test_equal_texts_and_likeness():
    make = I.Fingerprinter(np.array(sorted(I.term_hash(w) for w in ("a", "b", "c", "d")), dtype=np.uint64))
    assert make("A, b c!") == make("c b a")
    assert make("") == make("") and make("")[0] == "-" and I.likeness(make(""), make("x y")) == 0.0
    assert I.likeness(make("a b"), make("a b zz")) == 1.0
    assert 0 < I.likeness(make("a b c d"), make("a b c")) < 1
    assert make("zz yy")[0] == "-" and make("zz yy") != make("zz xx")
    #: A text without lexicon terms is still like one that got such a term.
    assert 0 < I.likeness(make("zz yy xx ww vv"), make("zz yy xx ww vv a")) < 1
    assert len({len(make(t)) for t in ("", "zz", "a b zz")}) == 1


def test_a_hot_group_keeps_its_terms(spark):
    hot = " ".join(f"hot{i}" for i in range(30))
    rows = [(i, hot) for i in range(60)] + [(100 + i, f"{hot} other{i}") for i in range(2)] + [(200 + i, f"cold{i} common") for i in range(60)]
    lexicon = set(I.build_lexicon(spark.createDataFrame(rows, "doc_id long, text string"), most=0.1).tolist())
    assert all(I.term_hash(f"hot{i}") in lexicon for i in range(30)) and I.term_hash("common") not in lexicon


def test_lexicon_is_bounded(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(i % 40))) for i in range(200)], "doc_id long, text string")
    bound = lambda most: len(I.build_lexicon(docs, most=1.0, max_lexicon=most))
    assert bound(10) == 0 < bound(30) < bound(60) <= 39


def test_edges(spark):
    one = spark.createDataFrame([(5, "only one here")], "doc_id long, text string")
    (row,) = I.fingerprints(one).collect()
    assert row.near_next == 1.0 and row.n_chars == 13
    assert I.fingerprints(one.limit(0)).count() == 0
    long_ = spark.createDataFrame([(1, "w " * 30_000), (2, "")], "doc_id long, text string")
    assert as_rows(I.fingerprints(long_)) == sorted(brute([(1, "w " * 30_000), (2, "")]), key=str)
