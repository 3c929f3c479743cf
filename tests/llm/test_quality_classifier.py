import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from plumbline.llm import quality_classifier as Q


@pytest.mark.parametrize(("size", "least"), [("sf0.01", 0.7), ("sf0.1", 0.9)])
def test_held_out_accuracy(spark, size, least):
    folder = f"/root/testdata/{size}"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = Q.train(docs, labels)
    scored = Q.score_quality(docs, model).withColumn("held", Q.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert {r.held for r in scored} == {True, False}
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    tested = [r for r in scored if r.held]
    good, bad = [r.score >= 0.3 for r in tested if r.quality == 1], [r.score < 0.3 for r in tested if r.quality == 0]
    assert sum(good) / len(good) > 0.95
    assert sum(bad) / len(bad) > least
    assert all(0 <= r.score <= 1 for r in scored)
    assert Q.keep_quality(docs, model).count() == Q.score_quality(docs, model).filter("score >= 0.3").count()


def brute_size(content, data):
    """Compressed size of data in pieces of 1024 bytes with a dictionary, without the model's code."""
    total = 0
    for at in range(0, len(data), 1024):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=3)
        total += len(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False).compress(data[at : at + 1024]))
    return total


def test_scores_against_a_plain_computation(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = Q.train(docs, labels)
    assert all(content[:4] == b"\x37\xa4\x30\xec" for content in model.dictionaries[0])
    scores = {r.doc_id: r.score for r in Q.score_quality(docs, model).collect()}
    for r in docs.limit(25).collect():
        x = []
        shape = re.sub("[^\x00-\xff]", "?", r.text)
        shape = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in shape)
        for data, (good, bad) in zip((r.text.encode(), shape.encode("latin-1")), model.dictionaries, strict=True):
            a, b = brute_size(good, data), brute_size(bad, data)
            x += [(b - a) / (b + a), (len(data) - a) / (len(data) + a)]
        assert np.isclose(scores[r.doc_id], 1 / (1 + np.exp(-(np.dot(x, model.weights[:4]) + model.weights[4]))), atol=1e-9)


def test_fit_is_where_the_likelihood_is_flat():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) * [1, 5, 0.1, 2] + [0, 3, 1, -2]
    y = (rng.random(200) < 1 / (1 + np.exp(-(x[:, 0] + 4 * x[:, 2] - 4)))).astype(float)
    w = np.array(Q.fit_logistic(x, y, ridge=1e-9))
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.allclose(x.T @ (y - p), 0, atol=1e-5) and abs((y - p).sum()) < 1e-5


def test_sample_is_bounded_and_takes_long_texts(spark):
    rows = [(i, f"{'good' if i % 2 else 'bad'} {i} " * (20_000 if i == 1 else 3)) for i in range(200)]
    docs = spark.createDataFrame([*rows, rows[1], (4, None), (6, "")], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    usable = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    bad, good = Q.chosen_texts(docs, labels, 1000, 1 << 20)
    assert sorted(bad + good) == sorted(t for _, t in usable) and rows[1][1] in good
    bad, good = Q.chosen_texts(docs, labels, 1000, 2000)
    assert 1500 < sum(map(len, bad + good)) <= 2000 and rows[1][1] not in good


def test_edges(spark):
    rows = [(1, "", "x"), (2, None, "y"), (None, "a b", "z"), (2, None, "y"), (5, "word " * 40_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    assert [r.score for r in Q.score_quality(docs, model).collect()] == [0.5] * 5
    labelled = spark.createDataFrame([(i, f"{'good plain text' if i % 2 else '### $$$ !!!'} {i}") for i in range(60)], "doc_id long, text string")
    model = Q.train(labelled, labelled.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    got = {(r.doc_id, r.score) for r in Q.score_quality(docs, model).collect()}
    assert len(got) == 4 and all(0 <= s <= 1 for _, s in got)
    assert Q.score_quality(docs.limit(0), model).count() == 0
    assert Q.keep_quality(docs, model).columns == docs.columns
