import zlib

import numpy as np
import pytest

from plumbline.llm import token_files
from plumbline.llm.queries import tokenizer_path


def test_wide_vocabulary(spark, tmp_path):
    from tokenizers import Tokenizer, models

    path = str(tmp_path / "wide.json")
    Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0")).save(path)
    ids = [65_535, 65_536, 69_999, 7]
    docs = spark.createDataFrame([(i, f"w{n}") for i, n in enumerate(ids)], "doc_id long, text string")
    folder = f"file://{tmp_path}/wide"
    shards = token_files.write_token_files(docs, path, folder)
    assert {r.width for r in shards.collect()} == {4}
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.read_token_digests(shards, folder).collect()}
    assert got == {i: (2, zlib.crc32(np.array([n, 1], dtype="<u4").tobytes())) for i, n in enumerate(ids)}
    with pytest.raises(ValueError):
        token_files.write_token_files(docs, path, f"file://{tmp_path}/narrow", width=2)
    with pytest.raises(ValueError):
        token_files.write_token_files(docs, path, f"file://{tmp_path}/end", end=1 << 32)


def test_new_words_are_encoded_together(monkeypatch):
    """Ids of words, special strings among them, are the library's, with one encoding for many words."""
    encoder = token_files.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    special = [t.content for t in encoder.library.get_added_tokens_decoder().values()]
    words = [*special, *(f"a{s}b{s}" for s in special), "\u200b", "e\u0301", "\x00", "a\x1cb", "\xa0x", "\U0001f642,x.", *(f"word{i}" for i in range(600))]
    expected = [np.array(encoder.library.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes() for w in words]
    encodings, plain = [], token_files.np.searchsorted
    monkeypatch.setattr(token_files.np, "searchsorted", lambda *a: encodings.append(1) or plain(*a))
    assert encoder._encode_words(words) == expected and len(encodings) == -(-len(words) // 256)


def test_stems_are_encoded_once():
    """Words of a stem and punctuation have the library's ids; a stem in other cases and before other ends is not new."""
    encoder = token_files.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    letters = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    marks = [chr(i) for i in range(33, 0x180) if not chr(i).isalnum()]
    words = [*letters, letters, *(f"stem{m}" for m in marks), *(f"{m}stem" for m in marks), *(f"St{m}em{m}" for m in marks), *(f"Stra\xdfe{m}'{m}" for m in marks)]
    words += ["a" + "".join(marks), "it's", "we'll.", "I'd,", "a1", "1a", "x\u0301", "\u0130x", "\u03a3a\u03a3", "\xaa", "a\xb5b", "a\xd7b", "end<|endoftext|>", "<|endoftext|>.", "a!\x00", "a.\u0301", "\xa0a.", "a" * 5000]
    expected = [np.array(encoder.library.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes() for w in words]
    assert encoder._encode_words(words) == expected
    made = []
    encoder.stems.make = lambda new: made.append(new) or encoder._encode_stems(new)
    assert len(set(encoder._encode_words(["Naturally", "naturally", "NATURALLY"]))) == 1 and made == [["naturally"]]
    encoder._encode_words(["naturally.", "Naturally,", "naturally."])
    assert sorted(sum(made[1:], [])) == []
