"""Phrase mining by set-oriented joins of sorted occurrences.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and \\x0A to \\x0D, and pieces into words at \\x20 and \\x09.
All is counted per language. An occurrence relation of length k holds, for each document, the sorted places at which
a frequent phrase of k words begins and that phrase's number. Length k + 1 is made as in SETM: the relation is
merge-joined with that of single words on the piece and the next place, the joined phrases are counted by group, and
a semi-join with the frequent groups gives the relation of length k + 1, which is persisted. A phrase is frequent
if it occurs ``least`` times; parts of a frequent phrase are frequent, so nothing is lost on the way.

On Spark a relation is a table with one row a document: its places and numbers are sorted arrays in binary columns,
so joining a document's two relations needs no shuffle. Groups are counted by a key of two numbers (the phrase's and
the added word's), with partial counts in each task, then by a shuffle. Frequent groups get numbers by ranges of
keys, from 1. Up to SENT groups their sorted keys are sent to all tasks for the semi-join; with more, the occurrences
are dealt by key, joined, and gathered again by document. Words' keys are 64-bit hashes of language and word, checked
over all words: if two words share one, the next seed is taken.

A phrase's score is its lowest over all cuts in two parts, in decimals of 38 digits. Phrases inside a longer one with
``within`` of their occurrences go. Ranks come from a global order by ranges.

Defined results: null texts are empty, a null language is ``und``. Repeated rows count again. Documents of any
length are one row each. An empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import slices
from plumbline.operators.ordered import running_before
from plumbline.sources.scratch import materialize, release

#: So many frequent groups (12 bytes each) are sent to all tasks at most.
SENT = 1 << 21
#: Distinct words, and joined phrases, that a task counts before it hands them on.
COUNTED_WORDS, COUNTED_PHRASES = 200_000, 1 << 21
#: Words, of all languages, whose keys a task remembers.
KNOWN_WORDS = 600_000
_UPPER, _CUTS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_UPPER + _CUTS + b"\t", _UPPER.lower() + b"." * len(_CUTS) + b" ")
_NUMBERS = "<i4"


def slots(text: str | None) -> list[bytes]:
    """The text's words in order, and ``.`` where a piece ends."""
    return (text or "").encode().translate(_PLAIN).replace(b".", b" . ").split()


def word_key(lang: str, word: bytes, seed: int) -> int:
    """A signed 64-bit key of a language's word; never 0."""
    name = lang.encode()
    value = xxhash.xxh3_64_intdigest(len(name).to_bytes(4, "little") + name + word, seed) or 1
    return value - (1 << 64) if value >> 63 else value


def _lang(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, key and f of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, word, word_key(lang, word, seed), n) for lang, own in counts.items() for word, n in own.items() if word != b"."]
            columns = list(zip(*rows)) or [[], [], [], []]
            words = pa.array([w.decode() for w in columns[1]], pa.string())
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), words, pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["lang", "word", "key", "f"])

        for batch in slices(batches, 256):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts[lang].update(slots(text))
            if sum(map(len, counts.values())) > COUNTED_WORDS:
                yield out()
                counts.clear()
        yield out()

    return _lang(docs).mapInArrow(run, "lang string, word string, key long, f long").groupBy("lang", "word", "key").agg(F.sum("f").alias("f"))


def numbered(groups: DataFrame) -> DataFrame:
    """groups with a number in the order of their keys, from 1, as a scratch table."""
    return materialize(running_before(groups, ["key"], {"number": F.lit(1).cast("long")}, "phrase-order").withColumn("number", F.col("number").cast("int") + 1), "phrase-groups")


def sent(groups: DataFrame) -> Broadcast | None:
    """The groups' sorted keys with their numbers, for all tasks; None if they are over SENT."""
    if groups.count() > SENT:
        return None
    table = groups.select("key", "number").toArrow()
    keys, numbers = table.column("key").to_numpy(), table.column("number").to_numpy()
    order = np.argsort(keys)
    return groups.sparkSession.sparkContext.broadcast((keys[order], numbers[order]))


def numbers_of(keys: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of each key, 0 where it is no frequent group's."""
    if not len(known[0]):
        return np.zeros(len(keys), dtype=_NUMBERS)
    at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
    return np.where(known[0][at] == keys, known[1][at], 0).astype(_NUMBERS)


def semi_joined(rows: DataFrame, keys_of: Callable, kept: str, groups: DataFrame) -> DataFrame:
    """The relation of the frequent groups: row, kept columns, place and number (sorted arrays) of rows.

    keys_of gives the places and keys of a row of an Arrow batch (as dict of columns). kept: a schema like "a int".
    """
    names = [c.split()[0] for c in kept.split(", ")]
    known = sent(groups)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            places, numbers = [], []
            for i in range(batch.num_rows):
                place, key = keys_of({n: c[i] for n, c in columns.items()})
                number = numbers_of(key, known.value)
                places.append(place[number > 0].astype(_NUMBERS).tobytes())
                numbers.append(number[number > 0].tobytes())
            full = pa.array([len(p) > 0 for p in places])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(places, pa.binary()), pa.array(numbers, pa.binary())], [*names, "place", "number"]).filter(full)

    if known is not None:
        return rows.mapInArrow(look, f"{kept}, place binary, number binary")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for i in range(batch.num_rows):
                place, key = keys_of({n: c[i] for n, c in columns.items()})
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), columns["row"][i])), pa.array(place.astype(np.int32)), pa.array(key)], ["row", "place", "key"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            places, numbers = [], []
            for found in batch.column("found").to_pylist():
                pairs = np.array(sorted((x["place"], x["number"]) for x in found), dtype=_NUMBERS).reshape(-1, 2)
                places.append(pairs[:, 0].tobytes())
                numbers.append(pairs[:, 1].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(places, pa.binary()), pa.array(numbers, pa.binary())], [*names, "place", "number"])

    met = rows.mapInArrow(deal, "row long, place int, key long").join(groups.select("key", "number").hint("merge"), "key")
    found = met.groupBy("row").agg(F.collect_list(F.struct("place", "number")).alias("found"))  # one document's occurrences
    return rows.select(*names).join(found, "row").mapInArrow(gather, f"{kept}, place binary, number binary")


def word_relation(docs: DataFrame, seed: int, groups: DataFrame) -> DataFrame:
    """row, lang, size (slots of the document), place and number of the frequent words; a piece's end is a slot of its own."""
    rows = materialize(_lang(docs).withColumn("row", F.monotonically_increasing_id()), "phrase-texts") if groups.count() > SENT else _lang(docs).withColumn("row", F.lit(0).cast("long"))
    memo: dict[str, dict[bytes, int]] = {}

    def keys_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        lang = row["lang"]
        known = memo.setdefault(lang, {b".": 0})
        if sum(map(len, memo.values())) > KNOWN_WORDS:
            memo.clear()
            memo[lang] = known = {b".": 0}
        own = slots(row["text"])
        for w in set(own).difference(known):
            known[w] = word_key(lang, w, seed)
        keys = np.array([known[w] for w in own], dtype=np.int64)
        places = np.flatnonzero(keys)
        return places, keys[places]

    return semi_joined(rows, keys_of, "row long", groups)


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=_NUMBERS)


def joined(row: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the phrases of k + 1 words: a phrase of k words and the word at the place after it."""
    word_place, word, place, phrase = (_numbers(row[c]) for c in ("word_place", "word", "place", "number"))
    at = np.searchsorted(word_place, place + k)
    at = np.minimum(at, max(len(word_place) - 1, 0))
    on = np.flatnonzero(word_place[at] == place + k) if len(word_place) else np.empty(0, dtype=np.int64)
    return place[on], phrase[on].astype(np.int64) << 32 | word[at[on]].astype(np.int64)


def phrase_counts(relation: DataFrame, k: int) -> DataFrame:
    """key and f of the phrases of k + 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(waiting) if waiting else np.empty(0, dtype=np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "f"])

        for batch in slices(batches):
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for i in range(batch.num_rows):
                waiting.append(joined({n: c[i] for n, c in columns.items()}, k)[1])
                size += len(waiting[-1])
            if size > COUNTED_PHRASES:
                yield out()
                waiting, size = [], 0
        yield out()

    return relation.mapInArrow(run, "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, least: int, longest: int, seed: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of 1 to ``longest`` words (w1.. as words' numbers, f), and lang's n.

    The first table has lang and word of each number. A ValueError tells that two words share a key.
    """
    words = materialize(word_counts(docs, seed), "phrase-words")
    if not words.groupBy("key").count().filter("count > 1").isEmpty():
        raise ValueError("two words share a key")
    totals = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    groups = numbered(words.filter(F.col("f") >= least))
    release(words)
    tables = [groups.select(F.col("number").alias("w1"), "lang", "word", "f", "number")]
    names = "row long, word_place binary, word binary"
    relation = word_relation(docs, seed, groups)
    #: Numbered as it is written: later steps read the same numbers.
    relation = materialize(relation.select(F.monotonically_increasing_id().alias("row"), F.col("place").alias("word_place"), F.col("number").alias("word"), "place", "number"), "phrase-relation-1")
    for k in range(1, longest):
        found = phrase_counts(relation, k).filter(F.col("f") >= least)
        groups = numbered(found)
        parts = groups.select("number", "f", F.shiftright("key", 32).cast("int").alias("before"), F.col("key").bitwiseAND(0xFFFFFFFF).cast("int").alias(f"w{k + 1}"))
        before = tables[-1].select(F.col("number").alias("before"), *(f"w{i}" for i in range(1, k + 1)))
        tables.append(materialize(parts.join(before, "before").drop("before"), "phrase-table"))
        if k + 1 < longest:
            longer = materialize(semi_joined(relation, lambda row, k=k: joined(row, k), names, groups), f"phrase-relation-{k + 1}")
            release(relation)
            relation = longer
    release(relation)
    return tables, totals


def _words(first: int, last: int) -> list[str]:
    return [f"w{i}" for i in range(first, last + 1)]


def scored(tables: list[DataFrame], scale: int) -> list[DataFrame]:
    """For each length from 2: w1.., a, l, r and score, of the cut that scores lowest (ties: the earliest)."""
    out = []
    for k in range(2, len(tables) + 1):
        rows = tables[k - 1].select(*_words(1, k), F.col("f").alias("a"))
        cuts = []
        for cut in range(1, k):
            head = tables[cut - 1].select(*_words(1, cut), F.col("f").alias(f"l{cut}"))
            tail = tables[k - cut - 1].select(*(F.col(f"w{i}").alias(f"w{i + cut}") for i in range(1, k - cut + 1)), F.col("f").alias(f"r{cut}"))
            rows = rows.join(head, _words(1, cut)).join(tail, _words(cut + 1, k))
            score = F.expr(f"(cast(a as decimal(20, 0)) * cast({scale} as decimal(18, 0))) div (cast(l{cut} as decimal(20, 0)) + cast(r{cut} as decimal(20, 0)))")
            cuts.append(F.struct(score.alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
        best = F.array_min(F.array(*cuts))
        out.append(rows.select(*_words(1, k), "a", best["l"].alias("l"), best["r"].alias("r"), best["score"].alias("score")))
    return out


def outermost(candidates: list[DataFrame], tables: list[DataFrame], within: Column) -> list[DataFrame]:
    """Candidates of each length that no longer one holds with so many of their occurrences (``within`` of f and a)."""
    out = []
    for k, rows in enumerate(candidates, 2):
        parts = None
        for longer in range(k + 1, len(tables) + 1):
            for at in range(1, longer - k + 2):
                part = tables[longer - 1].select(*(F.col(f"w{at + i - 1}").alias(f"w{i}") for i in range(1, k + 1)), "f")
                parts = part if parts is None else parts.unionByName(part)
        if parts is not None:
            most = parts.groupBy(*_words(1, k)).agg(F.max("f").alias("f"))
            rows = rows.join(most, _words(1, k), "left").filter(F.col("f").isNull() | ~within).drop("f")
        out.append(rows)
    return out


def phrases(docs: DataFrame, least: int = 30, longest: int = 4, percent: int = 80, scale: int = 2_000_000, best: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of 2 to ``longest`` words.

    docs: columns lang and text. least: occurrences of a phrase; percent: a phrase goes if a longer one has so much
    of its occurrences; scale: the score is floor(scale * a / (l + r)).
    """
    for seed in range(8):
        try:
            tables, totals = frequent_phrases(docs, least, longest, seed)
            break
        except ValueError:
            if seed == 7:
                raise
    within = F.expr(f"cast(f as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {percent}")
    kept = outermost(scored(tables, scale), tables, within)
    words = tables[0].select("number", "lang", "word")
    named = None
    for k, rows in enumerate(kept, 2):
        for i in range(1, k + 1):
            own = words.select(F.col("number").alias(f"w{i}"), F.col("word").alias(f"word{i}"), *(["lang"] if i == 1 else []))
            rows = rows.join(own, f"w{i}")
        rows = rows.select("lang", F.concat_ws(" ", *(f"word{i}" for i in range(1, k + 1))).alias("phrase"), "a", "l", "r", "score")
        named = rows if named is None else named.unionByName(rows)
    ordered = named.withColumns({"less_score": -F.col("score"), "less_a": -F.col("a")})
    placed = running_before(ordered, ["lang", "less_score", "less_a", "phrase"], {"place": F.lit(1).cast("long")}, "phrase-ranks")
    first = placed.groupBy("lang").agg(F.min("place").alias("first"))
    ranked = placed.join(first, "lang").withColumn("rank", F.col("place") - F.col("first") + 1).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
