"""Token counts by rank-synchronous merging of arrays.

The distinct pre-tokens of a group of texts are held as one ragged numpy array of symbol ids with the word
that each symbol belongs to. In each round every word's lowest-rank pair is found and merged everywhere it
stands in that word (from the left, without overlaps), in all words at once; words without a pair that
merges leave. What is left of a word is its number of tokens.

A merged symbol is later than its parts, so merging all places of the lowest pair at once gives what merging
them one by one gives. Units of a text (bpe_units) that were seen before cost a look-up in a bounded memo.

Counts equal the tokenizers library's without added special tokens, truncation or padding; a special string
inside a text is one token. No row needs another one, so nothing is shuffled.

Defined results: null is an empty text, of 0 bytes and 0 tokens. Repeated rows stay. An empty table gives no
rows. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.batches import slices, store
from plumbline.llm.bpe_units import Memo, Pretokens, groups, load_vocabulary, units

_counters: dict[str, Counter] = store()


class Counter:
    """Counts tokens with one vocabulary."""

    def __init__(self, path: str) -> None:
        vocabulary = load_vocabulary(path)
        self.split = Pretokens(path, vocabulary.special)
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int64)
        keys = np.array(vocabulary.pairs, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array(vocabulary.merged, dtype=np.int64)
        self.none = len(keys)
        self.words = Memo(self.count_words)
        self.memo = Memo(self.count_units)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or one past the last."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), self.none - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], self.none)

    def count_words(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        data = [w.encode("utf-8") for w in words]
        lengths = np.array([len(d) for d in data], dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(data), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        counts = lengths.copy()
        ranks = self.pair_ranks(symbols, word)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            least = np.minimum.reduceat(ranks, starts)
            #: Words that cannot merge any more leave.
            live = np.repeat(least < self.none, sizes)
            if not live.all():
                symbols, word, ranks = symbols[live], word[live], ranks[live]
                sizes, least = sizes[least < self.none], least[least < self.none]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(least, sizes)
            #: In a run of neighbouring hits (equal symbols) every second one merges, from the left.
            places = np.flatnonzero(hit)
            fresh = np.r_[True, (np.diff(places) > 1) | (word[places[1:]] != word[places[:-1]])]
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run_start) % 2 == 0]
            symbols[places] = self.merged[ranks[places]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[places + 1] = False
            counts -= np.bincount(word[places], minlength=len(counts))
            changed = np.zeros(len(symbols), dtype=bool)
            changed[places] = True
            changed[np.maximum(places - 1, 0)] = True
            #: A merged symbol may follow another merged one's removed half.
            changed[np.maximum(places - 2, 0)] = True
            symbols, word, ranks, changed = symbols[stay], word[stay], ranks[stay], np.flatnonzero(changed[stay])
            ranks[changed] = self.pair_ranks(symbols, word, changed)
        return counts.tolist()

    def pair_ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of the pair that starts at each place (of ``at``); none at a word's last symbol."""
        at = np.arange(len(symbols)) if at is None else at
        after = np.minimum(at + 1, max(len(symbols) - 1, 0))
        inside = (after > at) & (word[after] == word[at])
        out = np.full(len(at), self.none)
        out[inside] = self.rank(symbols[at[inside]], symbols[after[inside]])
        return out

    def count_units(self, found: list[str]) -> list[int]:
        """Tokens of each unit."""
        cut = [self.split.plain(u) for u in found]
        known = self.words.learn({w for words in cut for w in words})
        return [sum(known[w] for w in words) for words in cut]

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out = []
        for group in groups(texts):
            cut = [self.split.parts(t) for t in group]
            plain = [[u for p in parts[::2] for u in units(p)] for parts in cut]
            known = self.memo.learn(set().union(*plain)) if plain else {}
            out += [len(parts) // 2 + sum(map(known.__getitem__, us)) for parts, us in zip(cut, plain, strict=True)]
        return out


def counter(path: str) -> Counter:
    """This process's counter for a vocabulary file."""
    return _counters.get(path) or _counters.setdefault(path, Counter(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = counter(path).count_all(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([t > limit for t in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
