"""Token ids in flat binary files with 64-bit document offsets, memory-mapped for reading.

Documents are dealt by ranges of doc_id, sorted, encoded and written, one shard for each range:

- ``shard-NNNNN.bin``: the ids of the shard's documents one after the other, little-endian unsigned, 16 bits
  wide if the vocabulary has at most 65,536 ids, else 32;
- ``shard-NNNNN.idx``: for each document its id and where its ids end in the shard, little-endian signed
  64-bit integers (the smallest value stands for a null id).

A shard's base, the number of ids in all shards before it, is the prefix sum of the shards' sizes: one row a
shard. The shards in order of their numbers are the whole in ascending doc_id order.

A file is written under a name of its own attempt and then renamed, so that a task that runs again, here or
elsewhere, leaves one whole file. What failed attempts left is deleted, by the task itself or, if its executor was
lost, at the end. The folder may be in any store that pyarrow reaches by URI; where files cannot be mapped, the
bytes of some documents at a time are read from their place in the store.

Encoding is the tokenizers library's without added special tokens, plus one end id a document. Words
(runs without ASCII white space, which that pre-tokenizer never joins) are encoded once and kept in a bounded
memo of ids. A new word of Latin letters and perhaps punctuation after them is two units to a pre-tokenizer that cuts
there and ignores case (PARTS): both are remembered, so that a stem is encoded once for all words that it is in.

Defined results: a null text is empty and has the end id only. Null doc_ids come first; equal doc_ids are
ordered by text. An empty table writes no shard. Extra columns play no part.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.batches import slices, store
from plumbline.llm.bpe_units import Memo, groups
from plumbline.operators.ordered import shuffle_partitions
from plumbline.sources.scratch import materialize

NULL_ID = -(1 << 63)
SUFFIXES = ("bin", "idx")
#: Words that a task remembers, of about 200 bytes each.
MEMO = 900_000
#: New words that are encoded in one go.
TOGETHER = 256
#: Separators that Python's split() takes for white space and the pre-tokenizer does not.
_NOT_WHITE = re.compile("[\x1c-\x1f]")
_WORD = re.compile("[^\t-\r ]+")
#: Lower-cased stems and ends of words that a task remembers.
STEMS = 800_000
#: A stem of letters that NFC leaves alone and an end without letters, digits, apostrophes and characters of special strings.
_STEM = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!\"#$%&()*+,./:;=?@^_`{}~\\[\\]\\\\-]*)")
#: Normalizers and pre-tokenizers to which these two are units of their own.
PARTS = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)
_encoders: dict[str, WordEncoder] = store()


class WordEncoder:
    """Ids of texts by white-space words, with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo = Memo(self._encode_words, MEMO)
        self.stems = Memo(self._encode_stems, STEMS)
        self.last = self._last_ids(path)

    def _last_ids(self, path: str) -> np.ndarray | None:
        """Whether each id is the last of a unit, if the vocabulary cuts as PARTS says and marks those."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = tuple((spec[name] or {}).get(kinds) for name, kinds in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        suffix = spec["model"].get("end_of_word_suffix")
        if parts != PARTS or spec["post_processor"] or not suffix or spec["model"].get("dropout") or spec["model"].get("unk_token"):
            return None
        return np.array([(self.library.id_to_token(i) or "").endswith(suffix) for i in range(1 + max(self.library.get_vocab().values()))])

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        if self.last is None:
            return self._encode_whole(words)
        cut = [(m[1].lower(), m[2]) if (m := _STEM.fullmatch(w)) else None for w in words]
        known = self.stems.learn({part for parts in cut if parts for part in parts if part})
        whole = iter(self._encode_whole([w for w, parts in zip(words, cut) if not parts]))
        return [(known[parts[0]] + known[parts[1]] if parts[1] else known[parts[0]]) if parts else next(whole) for parts in cut]

    def _encode_stems(self, stems: list[str]) -> list[bytes]:
        """Ids of each of these units: many are one text, in which a unit ends with an id that only ends have."""
        out, parts = [], [stems[at : at + TOGETHER] for at in range(0, len(stems), TOGETHER)]
        for part, found in zip(parts, self.library.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) != len(part):
                raise ValueError(f"{len(part)} units have {len(ends)} ends")
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _encode_whole(self, words: list[str]) -> list[bytes]:
        """Ids of each word: many words are one encoding, which tells each id's word."""
        out, parts = [], [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        for part, found in zip(parts, self.library.encode_batch(parts, is_pretokenized=True, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4").tobytes()
            at = (4 * np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(part) + 1))).tolist()
            out += [ids[a:b] for a, b in zip(at, at[1:])]
        return out

    def encode_all(self, texts: list[str], end: int) -> list[bytes]:
        """Ids of each text and the end id, as little-endian unsigned 32-bit integers."""
        last = np.array([end], dtype="<u4").tobytes()
        out = []
        for group in groups(texts):
            cut = [_WORD.findall(t) if _NOT_WHITE.search(t) else t.split() for t in group]
            known = self.memo.learn(set().union(*cut))
            out += [b"".join(map(known.__getitem__, words)) + last for words in cut]
        return out


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a vocabulary file."""
    return _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def id_width(path: str, end: int) -> int:
    """Bytes an id: 2 if the vocabulary's ids and the end id are below 65,536, else 4."""
    from tokenizers import Tokenizer

    highest = max(Tokenizer.from_file(path).get_vocab().values(), default=0)
    if not 0 <= end < 1 << 32:
        raise ValueError(f"end id {end} does not fit in 32 bits")
    return 2 if max(highest, end) < 1 << 16 else 4


def write_token_files(docs: DataFrame, path: str, folder: str, end: int = 1, width: int | None = None) -> DataFrame:
    """Write the shards to folder (a URI) and return one row a shard: shard, n_docs, n_tokens, width, base.

    width: bytes an id, the vocabulary's if not given; one that is too small for it is refused.
    """
    least = id_width(path, end)
    width = least if width is None else width
    if width not in (2, 4) or width < least:
        raise ValueError(f"ids of this vocabulary need {least} bytes, not {width}")
    kind = np.dtype(f"<u{width}")
    top = np.iinfo(kind).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        attempt = f"{root}/attempt-{uuid.uuid4().hex}"
        n, total, out, index = 0, 0, None, None
        try:
            for batch in slices(batches):
                if not batch.num_rows:
                    continue
                if out is None:
                    out, index = (store.open_output_stream(f"{attempt}.{suffix}") for suffix in SUFFIXES)
                ends = []
                for encoded in encoder(path).encode_all([t or "" for t in batch.column("text").to_pylist()], end):
                    tokens = np.frombuffer(encoded, dtype="<u4")
                    if tokens.max() > top:
                        raise ValueError(f"id {tokens.max()} does not fit in {width} bytes")
                    out.write(tokens.astype(kind).tobytes())
                    total += len(tokens)
                    ends.append(total)
                ids = [NULL_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
                index.write(np.column_stack([np.array(ids, dtype="<i8"), np.array(ends, dtype="<i8")]).tobytes())
                n += len(ids)
            if out is None:
                return
            out.close()
            index.close()
            for suffix in SUFFIXES:
                store.move(f"{attempt}.{suffix}", f"{root}/shard-{shard:05d}.{suffix}")
        except BaseException:
            clear_attempts(folder, os.path.basename(attempt))
            raise
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(shuffle_partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = materialize(dealt.mapInArrow(run, "shard int, n_docs long, n_tokens long"), "token-shards")
    clear_attempts(folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumns({"width": F.lit(width), "base": F.coalesce(F.sum("n_tokens").over(before), F.lit(0))})


def clear_attempts(folder: str, name: str = "attempt-") -> None:
    """Delete files of attempts whose names start with ``name``."""
    from pyarrow import fs

    store, root = _store(folder)
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(name):
            store.delete_file(info.path)


def shard_parts(folder: str, shard: int, width: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, starts and ends (in the shard) of up to ``rows`` documents, and their token ids from the first start on.

    Local files are memory-mapped; of others only these documents' bytes are read.
    """
    store, root = _store(folder)
    name, kind = f"{root}/shard-{shard:05d}", f"<u{width}"
    if store.type_name == "local":
        flat, index = np.memmap(f"{name}.bin", dtype=kind, mode="r"), np.memmap(f"{name}.idx", dtype="<i8", mode="r").reshape(-1, 2)
        for at in range(0, len(index), rows):
            ends = index[at : at + rows, 1]
            starts = np.r_[index[at - 1, 1] if at else 0, ends[:-1]]
            yield index[at : at + rows, 0], starts, ends, flat[starts[0] : ends[-1]]
        return
    with store.open_input_file(f"{name}.bin") as tokens, store.open_input_file(f"{name}.idx") as index:
        before = 0
        for at in range(0, index.size(), 16 * rows):
            part = np.frombuffer(index.read_at(min(16 * rows, index.size() - at), at), dtype="<i8").reshape(-1, 2)
            starts = np.r_[before, part[:-1, 1]]
            before = int(part[-1, 1])
            yield part[:, 0], starts, part[:, 1], np.frombuffer(tokens.read_at(width * (before - int(starts[0])), width * int(starts[0])), dtype=kind)


def read_token_digests(shards: DataFrame, folder: str, rows: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files. shards: what writing returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, width, base in zip(*(batch.column(name).to_pylist() for name in ("shard", "width", "base")), strict=True):
                for ids, starts, ends, flat in shard_parts(folder, shard, width, rows):
                    first = starts[0]
                    crc = [zlib.crc32(flat[a - first : b - first].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(np.array(ids), pa.int64(), mask=ids == NULL_ID),
                            "start": pa.array(starts + base, pa.int64()),
                            "n_tokens": pa.array(ends - starts, pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    dealt = shards.select("shard", "width", "base").repartition(shuffle_partitions(shards), "shard")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
