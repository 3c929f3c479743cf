import random
import re
from collections import Counter

import duckdb
import pytest

from plumbline.llm import collocations, queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=30, best=2000):
    """The contract, by dictionaries of all phrases."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, 5) for i in range(len(ws) - k + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    gone = {(lang, p[i:j]) for (lang, p), (_, b, _, _) in out.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * b >= 80 * f[lang, p[i:j]]}
    found = []
    for lang in n:
        rows = sorted((-s, -a, " ".join(p).encode(), l, r) for (g, p), (s, a, l, r) in out.items() if g == lang and (g, p) not in gone)[:best]
        found += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(rows, 1)]
    return sorted(found)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["New", "york", "TIMES", "é", "\xa0x", "\x00"]
    texts = ["".join(rng.choices(words, k=1)[0] + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b"]) for _ in range(120)) for _ in range(60)]
    out = [(rng.choice(["en", "en", None, "und", "de"]), t) for t in texts]
    return out + [("en", "new york times square " * 300), ("de", "x " * 500), ("en", None), (None, ""), ("xx", ".")] + out[:3]


@pytest.mark.parametrize("most", [1 << 21, 5])
def test_equals_brute_force(spark, rows, monkeypatch, most):
    """Both ways of the semi-join: groups sent to all tasks, and occurrences dealt by key."""
    monkeypatch.setattr(collocations, "SENT", most)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, key int").repartition(3)
    got, expected = rows_of(collocations.phrases(docs, least=5, best=40)), brute(rows, least=5, best=40)
    assert len(expected) > 60 and {len(r[2].split(" ")) for r in expected} == {2, 3, 4}
    assert got == expected


def test_shared_keys_take_another_seed(spark, rows, monkeypatch):
    plain = collocations.word_key
    monkeypatch.setattr(collocations, "word_counts", lambda docs, seed, f=collocations.word_counts: f(docs, seed) if seed else f(docs, seed).selectExpr("lang", "word", "key % 3 AS key", "f"))
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert plain("a", b"b", 0) != plain("a", b"b", 1) and rows_of(collocations.phrases(docs, best=40)) == brute(rows, best=40)


def test_sql_and_brute_force_agree(spark):
    folder = "/root/testdata/sf0.001"
    got = rows_of(queries.op12_phrase_mining(spark, folder))
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text").collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    sql = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE_SQL['op12_phrase_mining']})").fetchall()
    assert got == brute(docs) == sorted(sql) and got


def test_empty_tables(spark):
    docs = spark.createDataFrame([(None, None), ("en", " . ")], "lang string, text string")
    assert collocations.phrases(docs).collect() == [] == collocations.phrases(docs.limit(0)).collect()
