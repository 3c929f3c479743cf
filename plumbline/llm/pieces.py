"""SentencePiece encoding and decoding by vectorised merge rounds.

A text becomes its characters, with a mark for every space and one in front. The units of a batch (a run of marks
and the run of other characters after it) are held as one flat numpy array of symbols, cut into segments between
characters that no vocabulary piece has side by side, since no merge can cross there. In each round every
segment's least pair rank (that of the piece the pair makes) is found, all segments merge it where it stands, the
arrays are compacted and segments without a pair leave. Characters that are no piece become their bytes' pieces.

Where a piece's pairs with other pieces may all come later than the piece itself, a segment merges all its places
of the least rank at once, from the left without overlaps; else only the leftmost one, since what it makes may
have to merge before the next place does. A segment of over LONG symbols would need as many rounds as that has
merges; it takes its merges from a priority queue instead. So results equal the library's on any text.

Units repeat, so a bounded memo keeps their ids. Rows need no other row: nothing is shuffled, and a task holds the
vocabulary, the memo and one slice of texts.

Defined results: null is an empty text, which has no ids. Repeated rows stay. An empty table gives no rows. Extra
columns play no part. Models whose normaliser is not the identity (with marks for spaces, one of them in front),
without byte pieces, or with pieces that go beyond a unit are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.batches import slices, store
from plumbline.llm.bpe_units import Memo, groups

#: Fixed value: the mark that stands for a space.
MARK = "▁"
#: Symbols of a segment from which on a priority queue does its merges.
LONG = 512
_UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+")
_PROBES = ("a", " a  b ", "①ﬁＡ́", "\t\n\x00\x7f 　​", MARK, "ÄÄ \U0001f600")
_NONE = np.int64(1) << np.int64(40)
_known: dict[str, PieceModel] = store()


def _bytewise(error: UnicodeError) -> tuple[str, int]:
    """A replacement character for each byte that is no UTF-8."""
    return "�", error.start + 1


codecs.register_error("plumbline-bytewise", _bytewise)


class PieceModel:
    """Encodes and decodes texts with one model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        text = [library.id_to_piece(i) for i in range(n)]
        if any(library.normalize(p) != self.marked(p) for p in _PROBES):
            raise ValueError(f"{path}: the model's normaliser changes texts")
        special = {i for i in range(n) if library.is_control(i) or library.is_unknown(i) or library.is_byte(i)}
        if any(library.is_unused(i) for i in range(n)) or sum(library.is_byte(i) for i in range(n)) != 256:
            raise ValueError(f"{path}: unused pieces, or not all bytes are pieces")
        ids = {text[i]: i for i in range(n) if i not in special}
        scores = np.array([library.get_score(i) for i in range(n)])
        _, rank = np.unique(-scores, return_inverse=True)
        self.bytes = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        self._vocabulary(ids, rank, n)
        unknown = " ⁇ "  # fixed value: what the library decodes an unknown piece to
        self.surface = [text[i].replace(MARK, " ").encode() for i in range(n)]
        for i in special:
            self.surface[i] = bytes([int(text[i][3:5], 16)]) if library.is_byte(i) else unknown.encode() if library.is_unknown(i) else b""
        self.control = {i for i in special if library.is_control(i)}
        self.leading = {i for p, i in ids.items() if p.startswith(MARK)}
        self.memo = Memo(self.encode_units, 400_000)

    def _vocabulary(self, ids: dict[str, int], rank: np.ndarray, n: int) -> None:
        """Tables of characters, of neighbours inside pieces, and of pairs that make a piece."""
        symbols = dict(ids)
        for c in sorted({c for p in ids for c in p}):
            symbols.setdefault(c, n + len(symbols))
        self.chars = np.full(0x110000, -1, dtype=np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.chars[ord(c)] = i
        self.neighbours = np.array(sorted({ord(a) << 32 | ord(b) for p in ids for a, b in zip(p, p[1:])}), dtype=np.int64)
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in ids):
            raise ValueError("pieces go beyond a unit")
        made, late = {}, set()
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    made[a << 32 | b] = i
                    late.update(int(rank[s]) for s in (a, b) if s < n and rank[s] >= rank[i])
        self.keys = np.array(sorted(made), dtype=np.int64)
        self.makes = np.array([made[k] for k in self.keys.tolist()], dtype=np.int64)
        self.ranks = rank[self.makes].astype(np.int64)
        self.alone = np.zeros(int(rank.max()) + 1, dtype=bool)  # ranks that merge one place at a time
        self.alone[sorted(late)] = True
        self.pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.makes.tolist())))

    @staticmethod
    def marked(text: str) -> str:
        """The text with marks."""
        return MARK + text.replace(" ", MARK) if text else ""

    def _pairs(self, symbols: np.ndarray, segment: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pair at each place of ``at``; no rank at a segment's end or where no piece is made."""
        rank, piece = np.full(len(at), _NONE), np.full(len(at), -1, dtype=np.int64)
        inside = np.flatnonzero(at + 1 < len(symbols))
        inside = inside[segment[at[inside]] == segment[at[inside] + 1]]
        left, right = symbols[at[inside]], symbols[at[inside] + 1]
        wanted = left << 32 | right
        found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = (self.keys[found] == wanted) & (left >= 0)
        rank[inside[hit]], piece[inside[hit]] = self.ranks[found[hit]], self.makes[found[hit]]
        return rank, piece

    def _queue(self, symbols: list[int]) -> list[int]:
        """One long segment's symbols, merged by least rank and then leftmost place."""
        n, pair = len(symbols), self.pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*pair[k], i) for i in range(n - 1) if symbols[i] >= 0 and symbols[i + 1] >= 0 and (k := symbols[i] << 32 | symbols[i + 1]) in pair]
        queue = [(rank, i, made, symbols[i], symbols[i + 1]) for rank, made, i in queue]
        heapify(queue)
        gone = [False] * n
        while queue:
            _, i, made, a, b = heappop(queue)
            j = after[i]
            if gone[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], gone[j] = made, True
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and symbols[x] >= 0 and symbols[y] >= 0 and (new := pair.get(symbols[x] << 32 | symbols[y])):
                    heappush(queue, (new[0], x, new[1], symbols[x], symbols[y]))
        return [s for s, left in zip(symbols, gone) if not left]

    def merge(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their segments (numbered upwards) when no pair is left."""
        done = []
        sizes = np.bincount(segment)
        for s in np.flatnonzero(sizes > LONG):
            own = self._queue(symbols[segment == s].tolist())
            done.append((np.array(own, dtype=np.int64), np.full(len(own), s)))
        short = sizes[segment] <= LONG
        symbols, segment = symbols[short], segment[short]
        rank, piece = self._pairs(symbols, segment, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            lengths = np.diff(np.r_[starts, len(segment)])
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            live = least < _NONE
            if not live.all():
                done.append((symbols[~live], segment[~live]))
                symbols, segment, rank, piece, least = symbols[live], segment[live], rank[live], piece[live], least[live]
                if not len(symbols):
                    break
            places = np.flatnonzero(rank == least)
            order = np.arange(len(places))
            own = np.r_[True, segment[places[1:]] != segment[places[:-1]]]
            fresh = own | np.r_[True, np.diff(places) > 1]
            run = order - np.maximum.accumulate(np.where(fresh, order, 0))
            places = places[np.where(self.alone[least[places]], own, run % 2 == 0)]
            symbols[places] = piece[places]
            stay = np.ones(len(symbols), dtype=bool)
            stay[places + 1] = False
            changed = np.zeros(len(symbols), dtype=bool)
            for back in (0, 1, 2):  # the pair before a merged symbol starts one or two places back
                changed[np.maximum(places - back, 0)] = True
            symbols, segment, rank, piece = symbols[stay], segment[stay], rank[stay], piece[stay]
            at = np.flatnonzero(changed[stay])
            rank[at], piece[at] = self._pairs(symbols, segment, at)
        if not done:
            return symbols, segment
        symbols, segment = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(segment, kind="stable")
        return symbols[order], segment[order]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit (marked text), as little-endian 32-bit integers."""
        codes = np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        beside = codes[:-1] << 32 | codes[1:]
        found = np.minimum(np.searchsorted(self.neighbours, beside), len(self.neighbours) - 1)
        cut = (unit[1:] != unit[:-1]) | (self.neighbours[found] != beside)
        segment = np.cumsum(np.r_[0, cut]) if len(codes) else np.empty(0, dtype=np.int64)
        #: A character that is no piece is kept as its negative code, from -2 on.
        symbols = np.where(self.chars[codes] >= 0, self.chars[codes], -2 - codes)
        of = unit[np.flatnonzero(np.r_[True, cut])] if len(codes) else unit
        symbols, segment = self.merge(symbols, segment)
        unit = of[segment]
        odd = np.flatnonzero((symbols < 0) | (symbols >= len(self.surface)))
        if len(odd):
            spelled = [self._as_bytes(s) for s in symbols[odd].tolist()]
            sizes = np.ones(len(symbols), dtype=np.int64)
            sizes[odd] = [len(x) for x in spelled]
            unit, symbols = np.repeat(unit, sizes), np.repeat(symbols, sizes)
            symbols[np.repeat(np.isin(np.arange(len(sizes)), odd), sizes)] = np.concatenate(spelled)
        data = symbols.astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(unit, minlength=len(units)))).tolist()
        return [data[a:z] for a, z in zip([0, *ends], ends)]

    def _as_bytes(self, symbol: int) -> np.ndarray:
        """Byte pieces of a character that is no piece."""
        code = -2 - symbol if symbol < 0 else int(np.flatnonzero(self.chars == symbol)[0])
        return self.bytes[np.frombuffer(chr(code).encode(), dtype=np.uint8)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        out = []
        for group in groups(texts):
            cut = [_UNIT.findall(self.marked(t)) for t in group]
            known = self.memo.learn(set().union(*cut))
            out += [b"".join(map(known.__getitem__, us)) for us in cut]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, given as little-endian 32-bit integers."""
        numbers = np.frombuffer(ids, dtype="<i4").tolist()
        runs = [numbers]
        if not self.control.isdisjoint(numbers):
            #: Bytes before and after a control piece make no character together.
            runs = [list(own) for control, own in groupby(numbers, self.control.__contains__) if not control]
        text = "".join(b"".join(map(self.surface.__getitem__, run)).decode("utf-8", "plumbline-bytewise") for run in runs)
        #: The mark that encoding puts in front is no part of the text.
        return text[1:] if runs and runs[0] and runs[0][0] in self.leading else text


def piece_model(path: str) -> PieceModel:
    """This process's model of a file."""
    return _known.get(path) or _known.setdefault(path, PieceModel(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            encoded = piece_model(path).encode_all([t or "" for t in batch.column("text").to_pylist()])
            offsets = np.cumsum([0, *(len(e) // 4 for e in encoded)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids (array of int; null is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [piece_model(path).decode(np.array(i or [], dtype="<i4").tobytes()) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and sha256 of the ids (decimal, joined by commas) and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            model = piece_model(path)
            encoded = model.encode_all([t or "" for t in batch.column("text").to_pylist()])
            listed = [",".join(map(str, np.frombuffer(e, dtype="<i4").tolist())) for e in encoded]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(e) // 4 for e in encoded], pa.int64()),
                    pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids in listed], pa.string()),
                    pa.array([hashlib.sha256(model.decode(e).encode()).hexdigest() for e in encoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
