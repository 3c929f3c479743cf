"""Byte-pair encoding with a priority queue of merge ranks over a doubly linked symbol list, and decoding.

The vocabulary is a byte-level file of the tokenizers library; results equal the library's with
``add_special_tokens=False``, without truncation or padding: special strings inside a text are one token.
Decoding concatenates the ids' vocabulary strings; bytes that are no UTF-8 become U+FFFD.

Encoding and decoding need no other row, so nothing is shuffled. A task holds the vocabulary, a group of
texts and a bounded memo of units it has encoded.

Defined results: null is an empty text, which has no ids. Repeated rows stay. An empty table gives no rows.
Extra columns play no part.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import slices, store
from plumbline.llm.bpe_units import ByteVocabulary, Memo, Pretokens, groups, load_vocabulary, units

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are written as little-endian 32-bit integers of this machine")
_codecs: dict[str, Codec] = store()


def merge_word(symbols: list[int], vocabulary: ByteVocabulary) -> list[int]:
    """Apply merges to a pre-token's symbols: lowest rank first, then leftmost.

    The queue holds rank << 32 | place; an entry is stale if that rank's pair is no longer at that place.
    """
    n = len(symbols)
    rank_of, pairs, merged_of = vocabulary.ranks.get, vocabulary.pairs, vocabulary.merged
    queue = []
    left = symbols[0]
    for i in range(1, n):
        right = symbols[i]
        if (rank := rank_of(left << 32 | right)) is not None:
            queue.append(rank << 32 | i - 1)
        left = right
    if not queue:
        return symbols
    heapify(queue)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        entry = heappop(queue)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        j = after[i]
        if j >= n or symbols[i] < 0 or symbols[i] << 32 | symbols[j] != pairs[rank]:
            continue
        symbols[i] = merged = merged_of[rank]
        symbols[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := rank_of(merged << 32 | symbols[k])) is not None:
                heappush(queue, rank << 32 | i)
        h = before[i]
        if h >= 0 and (rank := rank_of(symbols[h] << 32 | merged)) is not None:
            heappush(queue, rank << 32 | h)
    return [s for s in symbols if s >= 0]


class Codec:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, path: str) -> None:
        self.vocabulary: ByteVocabulary = load_vocabulary(path)
        self.split = Pretokens(path, self.vocabulary.special)
        self.memo = Memo(lambda new: [self._unit(u) for u in new], 600_000)

    def _word(self, word: str) -> bytes:
        ids = self.vocabulary.byte_ids
        return array("I", merge_word([ids[b] for b in word.encode("utf-8")], self.vocabulary)).tobytes()

    def _unit(self, unit: str) -> bytes:
        """A unit's ids; a pre-token that is a part of it is remembered as if it were a unit, which it may be too."""
        words = self.split.plain(unit)
        if len(words) == 1:
            return self._word(unit)
        known, out = self.memo.known, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self.memo.older.get(word) or self._word(word)
            out.append(ids)
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out = []
        for group in groups(texts):
            cut = [[(p, i % 2) for i, p in enumerate(self.split.parts(t))] for t in group]
            found = [[[p] if special else units(p) for p, special in parts] for parts in cut]
            known = self.memo.learn({u for parts, own in zip(cut, found, strict=True) for (_, special), us in zip(parts, own, strict=True) if not special for u in us})
            for parts, own in zip(cut, found, strict=True):
                out.append(b"".join(np.array([self.vocabulary.special[us[0]]], dtype="<u4").tobytes() if special else b"".join(map(known.__getitem__, us)) for (_, special), us in zip(parts, own, strict=True)))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, given as little-endian unsigned 32-bit integers."""
        pieces = self.vocabulary.pieces
        return b"".join(map(pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """This process's codec for a vocabulary file."""
    return _codecs.get(path) or _codecs.setdefault(path, Codec(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            encoded = codec(path).encode_all([t or "" for t in batch.column("text").to_pylist()])
            offsets = np.cumsum([0, *(len(e) // 4 for e in encoded)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids (array of int; null is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [codec(path).decode(np.array(i or [], dtype="<u4").tobytes()) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and sha256 of the ids (unsigned 32-bit, little-endian) and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            use = codec(path)
            encoded = use.encode_all([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(e) // 4 for e in encoded], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
                    pa.array([hashlib.sha256(use.decode(e).encode("utf-8")).hexdigest() for e in encoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens and ids (array of int) added and text as its ids decode; n_chars, if there, follows."""
    docs = docs.drop("n_tokens", "ids")
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            use = codec(path)
            encoded = use.encode_all([t or "" for t in batch.column(place).to_pylist()])
            offsets = np.cumsum([0, *(len(e) // 4 for e in encoded)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))
            columns = [pa.array([use.decode(e) for e in encoded], pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(offsets).astype(np.int64)), ids], [*batch.schema.names, "n_tokens", "ids"])

    schema = docs.select("*", F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<int>").alias("ids")).schema
    done = docs.mapInArrow(run, schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
