import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from plumbline.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "  a ", "▁a", "\n", "a\nb", "<s>", "</s> <unk>", "<0x41>", "\x00a", "①ﬁ", "é", "漢字 が", "thand" * 200, "a" * 3000, " " * 1500 + "b", "\n" * 700]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    alphabet = "ab'sdt reve 09²½ \n\t\x85\xa0 　\x1c\x00!#<s></s><0x41>éßŒǅжЖ漢字😀́Ⅷ٣Σςİ▁▁AB"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50))) for _ in range(500)] + ["".join(rng.choice("thandie") for _ in range(n)) for n in range(1, 900, 9)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_encoding_and_decoding_equal_the_library(spark, texts, library):
    expected = {i: library.encode(t) for i, t in enumerate(texts)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = pieces.encode(docs, PATH)
    assert {r.doc_id: r.ids for r in encoded.collect()} == expected
    decoded = {i: library.decode(ids) for i, ids in expected.items()}
    assert {r.doc_id: r.text for r in pieces.decode(encoded, PATH).collect()} == decoded
    for r in pieces.round_trip_digests(docs, PATH).collect():
        ids = expected[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded[r.doc_id].encode()).hexdigest()


def test_any_ids_decode_as_the_library_does(library):
    rng, model = random.Random(4), pieces.piece_model(PATH)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999), 259]) for _ in range(rng.randint(1, 8))]
        assert model.decode(np.array(ids, dtype="<i4").tobytes()) == library.decode(ids), ids


def test_short_and_long_segments_merge_alike(monkeypatch, texts):
    expected = pieces.PieceModel(PATH).encode_all(texts)
    for limit in (0, 100_000):
        monkeypatch.setattr(pieces, "LONG", limit)
        assert pieces.PieceModel(PATH).encode_all(texts) == expected


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, None), (1, None), (1, "")], "doc_id long, text string")
    got = pieces.round_trip_digests(docs, PATH).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got] == [(0, nothing, nothing)] * 4
    assert [r.text for r in pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).collect()] == [""]
    for make in (pieces.encode, pieces.round_trip_digests):
        assert make(docs.limit(0), PATH).count() == 0
