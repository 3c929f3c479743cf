"""I-Match document fingerprints from several randomised lexicon subsets.

Terms are lower-cased white-space words without leading and trailing punctuation, held as hashes of 63 bits (the
lowest bit is left for a mark). The lexicon keeps terms within a band of inverse document frequency: in at most ``most`` of the distinct texts (so that
a large group of copies does not push its own terms out), and in at least ``least`` of them, copies counted (and in
two at least). The full lexicon gives one signature of a text: its distinct lexicon terms, sorted and hashed.
Each randomised subset of the lexicon gives one more. Subsets come in groups: a group's subsets are disjoint
random shares of the lexicon (1/4, 1/16, ... of it each), so that short and long texts each meet subsets in which
they have few terms.

Document frequencies over distinct texts, without moving texts: over all rows they are sums of partial counts.
With S rows more than distinct texts, a term in c rows is in c - S to c texts, so only terms between the band's
upper end and S rows above it are in doubt. For those, what copies have added is counted and taken off: a text in
k rows has added k - 1. A bitmap of fixed size (2 ** BITMAP bits, by hash) tells most texts that have no copy, which
are then not looked at again; texts that it cannot tell cost time only.

Bound of what is broadcast (8 bytes a term): all document frequencies add up to D, the number of distinct terms of
a text times the number of texts, so at most D / f terms are in f texts or more. For the terms in doubt f is the
band's upper end; for the lexicon its lower end, which is D / ``max_lexicon`` at least. Both ends are shares of the
number of texts, so neither bound grows with the corpus.

A fingerprint is the signatures in a fixed order, eight hex digits each; a subset in which a text has no term
gives dashes. The lexicon's signatures come first, then a few of all terms, likewise in random shares. Likeness
of two fingerprints is the share of equal signatures among those that at least one of them has, over the lexicon's
part, or over the part of all terms if one of the texts has no lexicon term. A text without any term has the hash
of its characters in that part.

The edited text of a document ends in the next document's beginning. Documents are dealt by ranges of doc_id,
compressed, and sorted; a task streams its range with one document of look-back, and only a range's first and
last documents meet in a second step, one row a range.

Defined results: null is an empty text. Null doc_ids come first, equal ones are ordered by their texts' XXH64. A
single document is its own next one. Repeated rows stay. An empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.batches import slices
from plumbline.llm.bpe_units import groups
from plumbline.operators.ordered import PART, shuffle_partitions
from plumbline.sources.scratch import materialize

BITMAP = 26
#: (one subset's share of the lexicon is 1 / share, number of subsets); shares are powers of two, and each
#: group reads bits of the term's hash that no other group reads.
GROUPS = ((4, 4), (16, 16), (64, 24), (256, 16), (1024, 8))
#: The same for the part of all terms.
ALL_GROUPS = ((8, 8),)
SIZE = 8
EMPTY = "-" * SIZE
#: Digits of the lexicon's part.
SPLIT = SIZE * (1 + sum(n for _, n in GROUPS))
PUNCTUATION = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "¡¿«»…“”„‘’–—"
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def term_hash(word: str) -> int:
    """Hash of a word's term, an even number; 0 if nothing but punctuation is in it."""
    term = word.strip(PUNCTUATION)
    return xxhash.xxh64_intdigest(term.encode("utf-8"), 0) & ~1 or 2 if term else 0


class TermMemo(dict):
    """Hashes by word, found when first asked for, in two generations; 0 for words that have no term.

    The hash of a term that is among ``marked`` (sorted hashes) is given plus 1; with ``only`` others give 0.
    """

    def __init__(self, marked: np.ndarray | None = None, only: bool = False, most: int = 500_000) -> None:
        super().__init__()
        self.marked = None if marked is None else array("Q", marked.astype(np.uint64).tobytes())
        self.only, self.most, self.older = only, most, {}

    def __missing__(self, word: str) -> int:
        found = self.older.get(word)
        if found is None:
            found = term_hash(word)
            if found and self.marked is not None:
                at = bisect_left(self.marked, found)
                inside = at < len(self.marked) and self.marked[at] == found
                found = found + inside if inside or not self.only else 0
        if 2 * len(self) > self.most:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def terms(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of a text's terms."""
        found = set(map(self.__getitem__, set(text.lower().split())))
        found.discard(0)
        return np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))


#: This process's memo of plain hashes; a task that runs here later finds its words known.
_plain = TermMemo()
_ONE = np.uint64(1)


class Fingerprinter:
    """Fingerprints of texts for one lexicon (sorted term hashes)."""

    def __init__(self, lexicon: np.ndarray) -> None:
        self.memo = TermMemo(lexicon)

    def __call__(self, text: str) -> str:
        found = self.memo.terms(text)
        marks = found & _ONE
        terms = found ^ marks
        inside = terms[marks.astype(bool)]
        first = signatures(inside, GROUPS) if len(inside) else "-" * SPLIT
        if len(terms):
            return first + signatures(terms, ALL_GROUPS)
        return first + hashlib.sha256(text.encode("utf-8")).hexdigest()[:SIZE] + EMPTY * sum(n for _, n in ALL_GROUPS)


_fingerprinters: dict[bytes, Fingerprinter] = {}


def fingerprinter(lexicon: np.ndarray) -> Fingerprinter:
    """This process's fingerprints for a lexicon; only the last one's memo is kept."""
    key = hashlib.sha256(lexicon.tobytes()).digest()
    if key not in _fingerprinters:
        _fingerprinters.clear()
        _fingerprinters[key] = Fingerprinter(lexicon)
    return _fingerprinters[key]


def _signature(terms: bytes) -> str:
    return xxhash.xxh32_hexdigest(terms, 7)


def signatures(found: np.ndarray, shares: tuple[tuple[int, int], ...]) -> str:
    """Signature of all of found and those of the random subsets, in order."""
    out, bits = [_signature(found.astype("<u8").tobytes())], 1
    for share, subsets in shares:
        subset = (found >> np.uint64(bits)) & np.uint64(share - 1)
        bits += share.bit_length() - 1
        parts = [EMPTY] * subsets
        chosen = np.flatnonzero(subset < subsets)
        if len(chosen):
            own = subset[chosen]
            order = np.argsort(own, kind="stable")
            own, terms = own[order], found[chosen[order]].astype("<u8").tobytes()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for place, a, b in zip(own[cuts[:-1]].tolist(), cuts, cuts[1:]):
                parts[place] = _signature(terms[8 * a : 8 * b])
        out += parts
    return "".join(out)


def likeness(a: str, b: str) -> float:
    """Share of equal signatures among those that a or b has, in the lexicon's part or in that of all terms."""
    if a == b:
        return 1.0
    lexicon = a[0] != "-" and b[0] != "-"
    both = equal = 0
    for i in range(0, SPLIT, SIZE) if lexicon else range(SPLIT, len(a), SIZE):
        x, y = a[i : i + SIZE], b[i : i + SIZE]
        if x != EMPTY or y != EMPTY:
            both += 1
            equal += x == y
    return equal / both if both else 0.0


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term (hash as long) and df over all rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in groups([t or "" for t in batch.column("text").to_pylist()], 48_000_000):
                terms, counts = np.unique(np.concatenate(list(map(_plain.terms, group))), return_counts=True)
                yield pa.RecordBatch.from_pydict({"term": pa.array(terms.view(np.int64)), "df": pa.array(counts.astype(np.int64))})

    return docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def copied_texts(copies: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** BITMAP bits, by the text hashes h of copies."""
    place = F.pmod(F.col("h"), F.lit(1 << BITMAP))
    packed_ = copies.select(F.bitmap_bucket_number(place + 1).alias("b"), F.bitmap_bit_position(place + 1).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros((1 << BITMAP) // 8, dtype=np.uint8)
    for r in packed_.collect():  # one row in 2 ** 15 bits
        out[4096 * (r.b - 1) : 4096 * r.b] = np.frombuffer(r.bits, np.uint8)
    return out


def added_by_copies(docs: DataFrame, copies: DataFrame, wanted: np.ndarray) -> DataFrame:
    """term and added: in how many rows more than distinct texts a wanted term (sorted hashes) is.

    copies: h and k (rows) of the texts that have any.
    """
    shared, bitmap = (docs.sparkSession.sparkContext.broadcast(x) for x in (wanted, copied_texts(copies)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = TermMemo(shared.value, only=True)
        for batch in slices(batches):
            place = batch.column("h").to_numpy() % (1 << BITMAP)
            kept = batch.filter(pa.array((bitmap.value[place >> 3] >> (place & 7) & 1).astype(bool)))
            places = [np.searchsorted(shared.value, memo.terms(text) ^ _ONE).astype(np.int32) for text in kept.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([kept.column("h"), pa.array(places, pa.list_(pa.int32()))], ["h", "terms"])

    texts = docs.select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, "h long, terms array<int>").dropDuplicates(["h"])
    added = texts.join(copies, "h").select(F.explode("terms").alias("place"), (F.col("k") - 1).alias("k")).groupBy("place").agg(F.sum("k").alias("added"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = shared.value[batch.column("place").to_numpy()]
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms.view(np.int64)), "added": batch.column("added")})

    return added.mapInArrow(name, "term long, added long")


def _hashes(terms: DataFrame) -> np.ndarray:
    return np.sort(terms.select("term").toPandas()["term"].to_numpy(dtype=np.int64).view(np.uint64))


def build_lexicon(docs: DataFrame, least: float = 1e-4, most: float = 0.02, max_lexicon: int = 1 << 21) -> np.ndarray:
    """Sorted hashes of the terms in the band, at most max_lexicon of them. docs: no text is null."""
    hashes = docs.groupBy(F.xxhash64("text").alias("h")).agg(F.count("*").alias("k"))
    rows, n = hashes.agg(F.coalesce(F.sum("k"), F.lit(0)), F.count("*")).first()
    low, high = max(2, least * n), max(2, most * n)
    #: Only what may be in the band is written: most terms of a corpus are in one document.
    some = materialize(document_frequencies(docs).filter((F.col("df") >= low) & (F.col("df") <= high + rows - n)), "term-df")
    band, doubt = some.filter(F.col("df") <= high), some.filter(F.col("df") > high)
    if rows > n and not doubt.isEmpty():
        added = added_by_copies(docs, materialize(hashes.filter("k > 1"), "copied-texts"), _hashes(doubt))
        fewer = doubt.join(added, "term").select("term", (F.col("df") - F.col("added")).alias("df")).filter(F.col("df") <= high)
        band = band.unionByName(materialize(fewer, "term-doubt"))
    total = band.agg(F.sum("df")).first()[0] or 0
    return _hashes(band.filter(F.col("df") >= total / max_lexicon))


def edited_text(text: str, after: str) -> str:
    """text with its last half replaced by the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _row(doc_id: int | None, text: str, own: str, after: str, next_own: str, fingerprint: Fingerprinter) -> tuple:
    edited = edited_text(text, after)
    changed = own if edited == text else fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_own)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text) and text, compressed, of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in slices(batches):
            texts = pa.array([press.compress((t or "").encode("utf-8")) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), texts], ["doc_id", "tie", "text"])

    tied = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    return tied.mapInArrow(run, "doc_id long, tie long, text binary")


def fingerprints(docs: DataFrame, least: float = 1e-4, most: float = 0.02, max_lexicon: int = 1 << 21) -> DataFrame:
    """Each document's fingerprint, its edited text's, and likeness to that and to the next document's."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, least, most, max_lexicon))
    names = [*(x.split()[0] for x in SCHEMA.split(", ")), "place", "text"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingerprint, last, rows, plain = Fingerprinter(shared.value), None, [], zstandard.ZstdDecompressor()
        for batch in slices(batches):
            for doc_id, kept in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = plain.decompress(kept).decode("utf-8")
                own = fingerprint(text)
                if last is None:
                    #: The range's first document, for the range before.
                    rows.append((doc_id, None, None, None, None, None, None, 1, kept))
                else:
                    rows.append((*_row(*last[:3], text, own, fingerprint), 0, None))
                last = doc_id, text, own, kept
                if len(rows) >= 2048:
                    yield _batch(rows, names, kinds)
                    rows = []
        if last is not None:
            rows.append((last[0], None, None, None, None, None, None, 2, last[3]))
            yield _batch(rows, names, kinds)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingerprint, plain = Fingerprinter(shared.value), zstandard.ZstdDecompressor()
        for batch in slices(batches, 64):
            rows = []
            for row in batch.to_pylist():
                text, after = (plain.decompress(row[c]).decode("utf-8") for c in ("text", "after"))
                rows.append(_row(row["doc_id"], text, fingerprint(text), after, fingerprint(after), fingerprint))
            if rows:
                yield _batch(rows, names[:-2], kinds[:-2])

    dealt = packed(docs).repartitionByRange(shuffle_partitions(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    done = materialize(dealt.mapInArrow(run, f"{SCHEMA}, place int, text binary").withColumn(PART, F.spark_partition_id()), "imatch")
    ends = done.filter("place > 0").select(PART, "place", "doc_id", "text")
    #: One number a range goes through the window; the texts are joined to its result.
    order = Window.orderBy(PART)
    parts = ends.filter("place = 1").select(PART).select(F.lag(PART).over(order).alias("before"), F.max(PART).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("final"), PART)
    firsts = parts.join(ends.filter("place = 1").select(PART, F.col("text").alias("after")), PART).select(F.coalesce("before", "final").alias(PART), "after")
    tails = ends.filter("place = 2").drop("place").join(firsts, PART).select("doc_id", "text", "after").repartition(shuffle_partitions(docs))
    return done.filter("place = 0").select(*names[:-2]).unionByName(tails.mapInArrow(close, SCHEMA))
