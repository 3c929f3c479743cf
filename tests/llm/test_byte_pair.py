import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from plumbline.llm import bpe, bpe_units, token_counts, token_files
from plumbline.sources.scratch import scratch_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", " \n a  b\n\n c ", "<|endoftext|>", "x<|endoftext|>y <|endoftext|> z", "it's we'll 'S", "a" * 3000 + " " * 300 + "b", "aaa" * 7 + "\n" * 9, "the cat  "]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    alphabet = "ab'sdt reve 09²½ \n\t\x85\xa0\u2009\u3000\x1c\x00!#<|endoftext|>éßŒǅжЖ漢字😀\u0301Ⅷ٣ΣσςİAB"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(400)]


def test_units_join_to_the_text(texts):
    assert all("".join(bpe_units.units(t)) == t and all(bpe_units.units(t)) for t in texts)


def test_memo_stays_bounded():
    memo = bpe_units.Memo(lambda new: [len(u) for u in new], most=10)
    for i in range(50):
        known = memo.learn({f"a{i}", "b"})
        assert known[f"a{i}"] == len(f"a{i}") and known["b"] == 1 and len(known) <= 11 and len(memo.older) <= 5


def test_encoding_and_decoding_equal_the_library(spark, texts):
    library = Tokenizer.from_file(BYTES)
    expected = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    assert {r.doc_id: r.ids for r in bpe.encode(docs, BYTES).collect()} == expected
    decoded = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, BYTES), BYTES).collect()}
    assert decoded == {i: library.decode(ids, skip_special_tokens=False) for i, ids in expected.items()}
    for r in bpe.round_trip_digests(docs, BYTES).collect():
        assert r.n_tokens == len(expected[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(expected[r.doc_id], dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded[r.doc_id].encode()).hexdigest()
    both = bpe.encode_and_decode(docs, BYTES).collect()
    assert {r.doc_id: (r.ids, r.text, r.n_tokens) for r in both} == {i: (ids, decoded[i], len(ids)) for i, ids in expected.items()}


def test_broken_bytes_decode_as_replacement(spark):
    vocabulary = bpe_units.load_vocabulary(BYTES)
    ids = [vocabulary.byte_ids[b] for b in b"\xff\xe2\x82a"]
    rows = spark.createDataFrame([(1, ids), (2, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(rows, BYTES).collect()}
    assert got == {1: Tokenizer.from_file(BYTES).decode(ids, skip_special_tokens=False), 2: ""}


def test_counts_equal_the_library(spark, texts):
    library = Tokenizer.from_file(BYTES)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTES, 20).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert got[i] == (len(t.encode()), n, n > 20), t


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, None), (1, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, BYTES).collect()) == [(0, 0)] * 3
    assert {(r.n_tokens, r.decoded_sha256) for r in bpe.round_trip_digests(docs, BYTES).collect()} == {(0, hashlib.sha256(b"").hexdigest())}
    for make in (token_counts.count_tokens, bpe.encode, bpe.round_trip_digests, bpe.encode_and_decode):
        assert make(docs.limit(0), BYTES).count() == 0


def test_token_files_round_trip(spark, texts, monkeypatch):
    library = Tokenizer.from_file(WORDS)
    rows = [(i * 7 % 1009 if i else None, t) for i, t in enumerate(texts)] + [(2000, None), (2000, "again"), (2000, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = scratch_path(spark, "test-files")
    shards = token_files.write_token_files(docs, WORDS, folder)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_digests(shards, folder, rows=50).collect())
    at, expected = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((-1 if doc_id is None else doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert got == sorted(expected)
    first = shards.orderBy("shard").first()
    mapped = list(token_files.shard_parts(folder, first.shard, first.width, 7))
    assert first.base == 0 and sum(len(p[0]) for p in mapped) == first.n_docs and sum(len(p[3]) for p in mapped) == mapped[-1][2][-1] == first.n_tokens
    #: A store that cannot be mapped is read by places and gives the same; nothing of an attempt is left.
    monkeypatch.setattr(token_files, "_store", lambda uri: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), uri.removeprefix("file://")))
    read = list(token_files.shard_parts(folder, first.shard, first.width, 7))
    assert len(read) == len(mapped) > 1 and all((a == b).all() for p, q in zip(read, mapped, strict=True) for a, b in zip(p, q, strict=True))
    monkeypatch.undo()
    assert all(n.startswith(("shard-", ".shard-")) for n in os.listdir(folder.removeprefix("file://")))
    folder = scratch_path(spark, "test-none")
    assert token_files.read_token_digests(token_files.write_token_files(docs.limit(0), WORDS, folder), folder).count() == 0
