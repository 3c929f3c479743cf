"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of at least five letters. A share of
the occurrences, told by a hash of document and run, loses one letter. Words with enough occurrences are compared.

A word's path in the trie is its vector of counts: how many of its letters are in each of GROUPS groups, then the
same for its first 8, 4, 12, 6 and 16 letters with other groups (PREFIX_GROUPS). One inserted, deleted or replaced
letter raises one count by one at most and lowers one by one at most, in the whole word and in each prefix. So a
search goes down the trie with a surplus and a deficit of one each to spend per set of groups, and every near word
is in a node that it reaches. Words in a reached leaf are verified by their common beginning and end.

On Spark the trie's top is a table. In each round every word goes down BLOCK levels, as itself and as a visitor of
what it can reach with its budgets; a node of at most ``most`` words ends there, the others go on. Each node then is
a group: its words (dealt again to each of several tasks if it has many visitors) are the subtrie, a visitor goes
down it in numpy, depth first over blocks of the frontier. A word visits only paths after its own, so each pair is
met once. Nothing is capped; a group holds at most ``most`` words and about as many visitors. Only words with equal
vectors through all levels cannot be parted: anagrams in each stretch of four letters, a few dozen.

A word's form is its near word with the most occurrences (ties: the smallest), if that has at least ``times`` the
word's own. Its root is the last of the chain of forms, found by doubling steps: as counts double along a chain, it
is short, and the number of rounds is the logarithm of its length.

Defined results: null texts have no words; a null doc_id is written as nothing. Repeated rows count again. An empty
table gives no rows. Words of any length are kept whole. Extra columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import slices
from plumbline.sources.scratch import materialize, release

LEAST_LETTERS = 5
GROUPS, PREFIX_GROUPS, PREFIXES, BLOCK = 12, 8, (8, 4, 12, 6, 16), 4
LEVELS = GROUPS + PREFIX_GROUPS * len(PREFIXES)
#: Nodes of a subtrie with so few words are not gone down any further; so many frontier entries are taken at a time.
FEW, FRONTIER = 4, 1 << 16
#: Letters that are compared in arrays; longer words one by one.
WIDE = 48
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
_RUN = re.compile(f"[a-z\xc0-\xff]{{{LEAST_LETTERS},}}")


def word_counts(docs: DataFrame, every: int = 97) -> DataFrame:
    """word and n (occurrences) of docs; partial counts by task are summed. ``every``: see ``changed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches, 256):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LETTERS:
                            continue
                    counts[word] += n
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Group of each letter (256 of them) in whole words and in prefixes, so that groups are about equally used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.bincount(np.frombuffer("".join(batch.column("word").to_pylist()).encode("latin-1"), dtype=np.uint8), minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n)], ["letter", "n"])

    #: 256 rows at most.
    used = dict(words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect())
    rank = np.empty(256, dtype=np.int64)
    rank[sorted(range(256), key=lambda c: (-used.get(c, 0), c))] = np.arange(256)
    return tuple(np.where(rank % (2 * n) < n, rank % (2 * n), 2 * n - 1 - rank % (2 * n)) for n in (GROUPS, PREFIX_GROUPS))


def vectors(words: list[bytes], groups: Sequence[np.ndarray]) -> np.ndarray:
    """Counts of each word (latin-1) on each level; 255 stands for more."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    letters = np.frombuffer(b"".join(words), dtype=np.uint8)
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sets = []
    for prefix, group, n in ((None, groups[0], GROUPS), *((p, groups[1], PREFIX_GROUPS) for p in PREFIXES)):
        own = slice(None) if prefix is None else place < prefix
        sets.append(np.bincount(word[own] * n + group[letters[own]], minlength=len(words) * n).reshape(-1, n))
    return np.minimum(np.concatenate(sets, axis=1), 255).astype(np.uint8)


def _starts_set(level: int) -> bool:
    """Whether a set of groups, with budgets of its own, begins at this level."""
    return level == 0 or level >= GROUPS and (level - GROUPS) % PREFIX_GROUPS == 0


def _steps() -> np.ndarray:
    """What BLOCK counts can change by within a surplus and a deficit of one."""
    out = np.zeros((1 + BLOCK * (BLOCK + 1), BLOCK), dtype=np.int16)
    moves = [(i, j) for i in range(-1, BLOCK) for j in range(-1, BLOCK) if i != j]
    for row, (up, down) in zip(out[1:], moves, strict=True):
        row[up] += up >= 0
        row[down] -= down >= 0
    return out


def descended(rows: DataFrame, level: int, groups: Sequence[np.ndarray]) -> DataFrame:
    """rows (path, word, n, up, down, own) gone down BLOCK levels, in all ways that their budgets allow."""
    steps = _steps()
    ups, downs = (steps > 0).sum(axis=1), (steps < 0).sum(axis=1)
    #: A word that is still on its own path goes on to later ones only.
    first = np.array([next((x for x in s if x), 0) for s in steps.tolist()])
    fresh = _starts_set(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            counts = vectors([w.encode("latin-1") for w in batch.column("word").to_pylist()], groups)[:, level : level + BLOCK].astype(np.int16)
            own = batch.column("own").to_numpy(zero_copy_only=False)
            up, down = (np.zeros(batch.num_rows, np.int64) if fresh else batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("up", "down"))
            paths = batch.column("path").to_pylist()
            for step, more, less, turn in zip(steps, ups, downs, first):
                seen = counts + step
                rows = np.flatnonzero((up + more <= 1) & (down + less <= 1) & (seen >= 0).all(axis=1) & (seen <= 255).all(axis=1) & (~own | (turn >= 0)))
                if len(rows):
                    ends = seen[rows].astype(np.uint8)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([paths[r] + e.tobytes() for r, e in zip(rows.tolist(), ends)], pa.binary()),
                            batch.column("word").take(pa.array(rows)),
                            batch.column("n").take(pa.array(rows)),
                            pa.array((up[rows] + more).astype(np.int32)),
                            pa.array((down[rows] + less).astype(np.int32)),
                            pa.array(own[rows] & (turn == 0)),
                        ],
                        ["path", "word", "n", "up", "down", "own"],
                    )

    return rows.mapInArrow(run, "path binary, word string, n long, up int, down int, own boolean")


def trie_groups(words: DataFrame, groups: Sequence[np.ndarray], most: int) -> tuple[DataFrame, list[DataFrame]]:
    """path, part, word, n, up, down and own: nodes with their words and visitors, in parts; and tables to release."""
    rows = words.select(F.lit(b"").alias("path"), "word", "n", F.lit(0).alias("up"), F.lit(0).alias("down"), F.lit(True).alias("own"))
    settled, spare = None, []
    for level in range(0, LEVELS, BLOCK):
        last = level + BLOCK >= LEVELS
        reached = materialize(descended(rows, level, groups), "trie-reached")
        sizes = reached.groupBy("path").agg(F.count_if("own").alias("words"), F.count_if(~F.col("own")).alias("visitors"))
        open_ = F.lit(False) if last else F.col("words") > most
        parts = F.ceil(F.greatest("visitors", F.lit(1)) / most)
        sizes = materialize(sizes.filter("words > 0").select("path", open_.alias("open"), parts.cast("int").alias("parts")), "trie-sizes")
        met = reached.join(sizes, "path")
        part = F.when(F.col("own"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), "parts").cast("int")))
        calm = met.filter(~F.col("open")).select("path", F.explode(part).alias("part"), "word", "n", "up", "down", "own")
        settled = calm if settled is None else settled.unionByName(calm)
        spare += [reached, sizes]
        if last or sizes.filter("open").isEmpty():
            return settled, spare
        rows = met.filter("open").select(*rows.columns)
    raise AssertionError("the last level settles all")


def _near(a: bytes, b: bytes) -> bool:
    """Whether two different words are one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    front = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[front + (len(a) == len(b)) :] == b[front + 1 :]


class Subtrie:
    """The words of one node, from a level on."""

    def __init__(self, words: list[bytes], counts: np.ndarray, depth: int) -> None:
        self.words, self.depth = words, depth
        changed = (counts[1:, depth:] != counts[:-1, depth:]).cumsum(axis=1) > 0
        #: Levels of nodes: their first word, the end of their words, their count, and where their children begin.
        self.first, self.count, self.child = [np.array([0])], [np.array([0])], []
        for k in range(LEVELS - depth):
            first = np.flatnonzero(np.r_[True, changed[:, k]])
            self.child.append(np.searchsorted(first, np.r_[self.first[-1], len(words)]))
            self.first.append(first)
            self.count.append(counts[first, depth + k].astype(np.int16))
        self.end = [np.r_[f[1:], len(words)] for f in self.first]

    def candidates(self, counts: np.ndarray, up: np.ndarray, down: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Visitors and words whose vectors are near. own: a visitor's place among the words, which it looks beyond; -1: none."""
        n = len(counts)
        stack = [(0, np.arange(n), np.zeros(n, dtype=np.int64), up, down)]
        while stack:
            k, who, node, u, d = stack.pop()
            if len(who) > FRONTIER:
                half = len(who) // 2
                stack += [(k, *(x[s] for x in (who, node, u, d))) for s in (slice(half, None), slice(half))]
                continue
            first, end = self.first[k][node], self.end[k][node]
            ahead = end > own[who] + 1
            small = ahead & ((end - first <= FEW) | (self.depth + k == LEVELS))
            if small.any():
                a, sizes = first[small], (end - first)[small]
                offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                visitor, word = np.repeat(who[small], sizes), np.repeat(a, sizes) + offset
                later = word > own[visitor]
                yield visitor[later], word[later]
            on = np.flatnonzero(ahead & ~small)
            if not len(on):
                continue
            who, node, u, d = who[on], node[on], u[on], d[on]
            if _starts_set(self.depth + k):
                u, d = np.zeros_like(u), np.zeros_like(d)
            children = self.child[k][node + 1] - self.child[k][node]
            row = np.repeat(np.arange(len(on)), children)
            node = np.repeat(self.child[k][node], children) + np.arange(len(row)) - np.repeat(np.cumsum(children) - children, children)
            off = self.count[k + 1][node] - counts[who[row], self.depth + k].astype(np.int16)
            u, d = u[row] + (off > 0) * off, d[row] - (off < 0) * off
            fits = (u <= 1) & (d <= 1)
            stack.append((k + 1, who[row[fits]], node[fits], u[fits], d[fits]))


def _matrices(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as rows of letters from the left and from the right, and their lengths; longer ones than WIDE are cut."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    width = max(1, min(WIDE, int(sizes.max(initial=1))))
    left = np.frombuffer(b"".join(w[:width].ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(-1, width)
    right = np.frombuffer(b"".join(w[-width:][::-1].ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(-1, width)
    return left, right, sizes


def _verified(a: tuple, b: tuple, words: Sequence[list[bytes]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether word i of a and word j of b are one edit apart: beginnings and ends they share leave one letter at most."""

    def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        width = min(x.shape[1], y.shape[1])
        differs = x[i, :width] != y[j, :width]
        return np.where(differs.any(axis=1), differs.argmax(axis=1), width)

    n, m = a[2][i], b[2][j]
    longer, shorter = np.maximum(n, m), np.minimum(n, m)
    front, back = np.minimum(shared(a[0], b[0]), shorter), np.minimum(shared(a[1], b[1]), shorter)
    good = (longer - shorter <= 1) & (front + back >= longer - 1)
    for k in np.flatnonzero(longer > WIDE).tolist():
        good[k] = _near(words[0][i[k]], words[1][j[k]])
    return good


def near_words(groups: DataFrame, letters: Sequence[np.ndarray]) -> DataFrame:
    """word, n_near, best_n and best (its near word of largest count) by group; groups: see ``trie_groups``."""

    def search(batch: pa.Table) -> pa.Table:
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        counts = vectors(words, letters)
        depth = len(batch.column("path")[0].as_py())
        own = batch.column("own").to_numpy()
        n = batch.column("n").to_numpy()
        home = np.flatnonzero(own)
        home = home[np.lexsort(counts[home].T[::-1])]
        order = np.r_[home, np.flatnonzero(~own)]
        words, counts, n = [words[i] for i in order], counts[order], n[order]
        up, down = (batch.column(c).to_numpy()[order].astype(np.int64) for c in ("up", "down"))
        size = len(home)
        place = np.where(np.arange(len(order)) < size, np.arange(len(order)), -1)
        trie = Subtrie(words[:size], counts[:size], depth)
        both = _matrices(words)
        found = np.zeros(len(words), dtype=np.int64)
        best_n, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), -1)
        #: Places in the order of the words, to break ties.
        rank = np.empty(len(words), dtype=np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        #: In further parts the node's words are there for the visitors only.
        for at in range(size if batch.column("part")[0].as_py() else 0, len(words), 4096):
            s = slice(at, at + 4096)
            for who, word in trie.candidates(counts[s], up[s], down[s], place[s]):
                for cut in range(0, len(who), FRONTIER):
                    i, j = who[cut : cut + FRONTIER] + at, word[cut : cut + FRONTIER]
                    good = _verified(both, both, (words, words), i, j)
                    i, j = np.r_[i[good], j[good]], np.r_[j[good], i[good]]
                    np.add.at(found, i, 1)
                    #: The best neighbour of each word: of largest count, then first in order.
                    turn = np.lexsort((rank[j], -n[j], i))
                    i, j = i[turn], j[turn]
                    lead = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, dtype=np.int64)
                    i, j = i[lead], j[lead]
                    better = (best[i] < 0) | (n[j] > best_n[i]) | ((n[j] == best_n[i]) & (rank[j] < rank[best[i]]))
                    best_n[i[better]], best[i[better]] = n[j[better]], j[better]
        got = np.flatnonzero(found)
        return pa.table(
            {
                "word": pa.array([words[i].decode("latin-1") for i in got], pa.string()),
                "n_near": pa.array(found[got]),
                "best_n": pa.array(best_n[got]),
                "best": pa.array([words[i].decode("latin-1") for i in best[got]], pa.string()),
            }
        )

    return groups.groupBy("path", "part").applyInArrow(search, "word string, n_near long, best_n long, best string")


def with_roots(forms: DataFrame) -> DataFrame:
    """forms (word, form, ...) with root: the last of the chain of forms. Steps double in each round."""
    steps = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialize(steps.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "spelling-roots")
        release(steps)
        steps = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return forms.join(steps, "word")


def spelling_variants(docs: DataFrame, every: int = 97, least: int = 3, times: int = 2, most: int = 4096) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs (columns doc_id, text) that occurs ``least`` times.

    every: an occurrence loses a letter where this divides its hash. times: a form has so many times the
    occurrences. most: words of a trie's node that one task takes.
    """
    words = materialize(word_counts(docs, every).filter(F.col("n") >= least), "spelling-words")
    letters = letter_groups(words)
    groups, spare = trie_groups(words, letters, most)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    near = near_words(groups, letters).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n"))
    is_form = F.col("best_n") >= times * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    forms = materialize(forms, "spelling-forms")
    release(words, *spare)
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
