"""SimHash near-duplicates: fingerprints, links by multi-index hashing, components.

Words: A-Z lower-cased, runs without \\x20, \\x09-\\x0D. A shingle is some words in a row; fewer words than a
shingle has: the whole sequence is the one shingle. A fingerprint's bit is 1 if it is set in over half of the
XXH64 values (seed 42) of the shingles. No words: fingerprint zero.

Two uses, both by segment tables and verification:

- ``near_duplicates``: 64-bit fingerprints over all shingles, repeats included, linked at ``distance`` or fewer
  differing bits. All such links are found, see ``multi_index``.
- ``similar_copies``: links of texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more.
  A short fingerprint is too coarse for that: at 0.8 every bit differs with a probability of 0.15. So the
  fingerprint has SEGMENTS x WIDTH bits over the set, each shingle once (XXH64 and mixes of it for further
  words). Table s has each set under its segment s; the sets of an entry stand in a row, in the order of their numbers,
  and each is compared with the two before it, on the sets themselves (48 bits a shingle). This joins most
  groups of copies, and costs no more than the entries have rows.

  Then every link is looked for that this has left. All shingles have one order; two similar sets share one of their
  first n - ceil(similarity n) + 1 shingles in it, whatever the order is, so sets are entered under these. Of a pair
  that shares the shingles at places i and j, at most min(n - i, m - j) shingles can be common from there on; for the
  first common shingle that is all of them, so a pair is compared where that is enough. All pairs of sets of different
  components that share an entry and pass this are compared: no similar pair ends in two components.

The order puts last what is frequent in an eighth of the sets, most frequent last, so that lines which many texts share
are entries of few of them; the others are in the order of their hashes. An order only decides how many pairs meet,
never which links are found, so the HOT most frequent of them are enough.

With the segments' pairs, each set is compared with one centre of each of its entries: the set of about its size that
has the fewest shingles before the entry's, so the fewest that others lack. What is linked is joined. Where the pairs of
different components that can be similar would still be many more than the rows, other centres follow, until a
round finds no link or few pairs are left. So groups of copies are not paired with themselves. What stays is pairs of
sets of different components that share shingles and pass the bound above: these are compared one by one, their number is
not bounded by the rows.

A set's number (its node) is a sketch, the fingerprint's last 32 bits, before 32 bits of the set's hash. By the segments
only sets meet whose sketches differ in SKETCH_LIMIT bits or fewer. Different sets with one number are found by their
64-bit hashes and numbered anew, until no two are left.

Equal fingerprints, or equal sets, are one node from the start.
Components come from alternating large-star and
small-star rounds over the links, each round a scratch table in the cluster's shared folder.

Defined results: null and empty texts have no words; by fingerprint they are linked like any other, by
similarity they are one node without links. Component ids are the smallest doc_id reachable; null ids are
ignored unless the component has no other. Repeated rows stay. An empty table gives no rows. Other columns play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.batches import forget, slices
from plumbline.llm.multi_index import components, mixed, near_links
from plumbline.sources.scratch import materialize, release

SEED = 42
#: The long fingerprint's segments, and the 64-bit words that hold them.
WIDTH, SEGMENTS, LONGS = 28, 16, 7
#: Two sketches are the last 32 bits of two fingerprints: 4.8 bits differ at similarity 0.8, 16 by chance.
SKETCH_LIMIT = 11
#: Frequent shingles (8 bytes each) that are told to all tasks at most, and how often an eighth of the sets has one.
HOT, HOT_LEAST = 1 << 17, 3
#: So many pairs for each row of an entry are compared at once; before more, what centres link is joined.
FEW = 4
#: So many set numbers (8 bytes each) are sent to all executors at most; more are joined by a shuffle.
BROADCAST_NODES = 1 << 21
#: A column that no table of documents has.
ROW = "__plumbline row"
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 14
_LITTLE = np.dtype("<u8")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of a text, in order, repeats included."""
    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return np.empty(0, _LITTLE)
    joined, starts, at = b" ".join(parts), [0], 0
    for part in parts:
        at += len(part) + 1
        starts.append(at)
    digest = xxhash.xxh64_intdigest
    ends = starts[words:] or [at]
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends)], dtype=_LITTLE)


def majority(hashes: np.ndarray, longs: int = 1) -> np.ndarray:
    """64-bit words whose bits are set in over half of the hashes (of the hashes' k-th mix for the k-th word)."""
    ones = np.zeros(64 * longs, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        words = np.stack([mixed(part + np.uint64(k)) if k else part for k in range(longs)], axis=1).astype(_LITTLE)
        ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(_LITTLE)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    return int(majority(shingle_hashes(text, words)).view("<i8")[0])


def with_fingerprint(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [fingerprint(text.as_py(), words) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, segments: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (columns doc_id, text)."""
    docs = materialize(with_fingerprint(docs, words), "fingerprints")
    nodes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes")
    roots = materialize(components(near_links(nodes.select("fp"), distance, segments)), "fp-roots")
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def packed(hashes: np.ndarray) -> bytes:
    """48-bit numbers, six bytes each."""
    return hashes.astype(_LITTLE).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes | pa.Buffer) -> np.ndarray:
    """The numbers of ``packed``."""
    parts = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(parts), 8), np.uint8)
    out[:, :6] = parts
    return out.view(_LITTLE).reshape(-1)


def parities(numbers: np.ndarray) -> bytes:
    """One bit for each remainder by a power of two, not less than the count: whether an odd number of the set has it."""
    width = max(64, 1 << (len(numbers) - 1).bit_length()) if len(numbers) else 64
    counts = np.bincount((numbers & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """From two sets' parities, how many numbers only one of the sets has, at least."""
    if len(a) > len(b):
        a, b = b, a
    few, many, width = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 4 * len(b)
    while 2 * width > 8 * len(a):
        many, width = many >> width ^ many & (1 << width) - 1, width // 2
    return (few ^ many).bit_count()


def with_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, node, full (the set's 64-bit hash), fingerprint words f0.., size, parities and set (see ``packed``)."""
    names = ["node", "full", *(f"f{k}" for k in range(LONGS)), "size", "odd", "set"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, 512):
            nodes, full, prints, sizes, odd, sets = [], [], [], [], [], []
            for text in batch.column("text"):
                hashes = np.unique(shingle_hashes(text.as_py(), words))
                prints.append(majority(hashes, LONGS))
                full.append(xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED))
                nodes.append(int(prints[-1][-1]) >> 32 << 32 | full[-1] >> 32)
                small = np.unique(hashes >> np.uint64(16))
                sizes.append(len(small))
                odd.append(parities(small))
                sets.append(packed(small))
            table = np.array(prints, dtype=np.uint64).reshape(-1, LONGS).view(np.int64)
            columns = [batch.column("doc_id"), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, full)), *(pa.array(c) for c in table.T.copy()), pa.array(sizes, pa.int32()), pa.array(odd, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{n} long" for n in names[:-3])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {longs}, size int, odd binary, set binary")


def numbered_apart(feats: DataFrame) -> DataFrame:
    """feats with other numbers for sets that share one; the sketch in the number stays. As a rule there are none."""
    turn = 0
    while True:
        clashes = feats.groupBy("node").agg(F.min("full").alias("a"), F.max("full").alias("b")).filter("a <> b").select("node", F.lit(True).alias("clash"))
        if clashes.isEmpty():
            return feats
        turn += 1
        other = F.col("node").bitwiseAND(~0xFFFFFFFF).bitwiseOR(F.xxhash64("full", F.lit(turn)).bitwiseAND(0xFFFFFFFF))
        apart = feats.join(clashes, "node", "left").withColumn("node", F.when(F.col("clash"), other).otherwise(F.col("node")))
        apart = materialize(apart.select(*feats.columns), "copy-feats")
        release(feats)
        feats = apart


def segment_entries(nodes: DataFrame) -> DataFrame:
    """node and entry (segment number and value, in 32 bits) for every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.stack([batch.column(f"f{k}").to_numpy() for k in range(LONGS)], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")[:, : SEGMENTS * WIDTH]
            values = (bits.reshape(-1, SEGMENTS, WIDTH) @ (np.int64(1) << np.arange(WIDTH, dtype=np.int64))).astype(np.uint32)
            entries = values | (np.arange(SEGMENTS, dtype=np.uint32) << np.uint32(WIDTH))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), SEGMENTS))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(rows), pa.array(entries.reshape(-1).view(np.int32))], ["node", "entry"])

    return nodes.select("node", *(f"f{k}" for k in range(LONGS))).mapInArrow(run, "node long, entry int")


def frequent_shingles(feats: DataFrame) -> np.ndarray:
    """The shingles that are frequent in an eighth of the sets, HOT at most, most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [unpacked(data.as_buffer()) for data in batch.column("set")]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])

    some = feats.filter(F.col("node").bitwiseAND(7) == 0).select("set").mapInArrow(run, "shingle long")
    counted = some.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_LEAST)
    return counted.orderBy(F.desc("n"), "shingle").limit(HOT).toArrow().column("shingle").to_numpy().view(np.uint64)[::-1].copy()


def prefix_entries(feats: DataFrame, similarity: float, frequent: np.ndarray) -> DataFrame:
    """node, size, entry and at for the first shingles of each set, of which two similar sets share one; at: its place."""
    order = np.argsort(frequent)
    known = frequent[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            entries, counts = [np.empty(0, np.uint64)], []
            for data in batch.column("set"):
                found = unpacked(data.as_buffer())
                n = len(found)
                if n and len(known):
                    place = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    found = found[np.argsort(np.where(known[place] == found, order[place], -1), kind="stable")]
                entries.append(found[: n - int(np.ceil(similarity * n - 1e-9)) + 1])
                counts.append(len(entries[-1]))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            at = np.concatenate([np.empty(0, np.int32), *(np.arange(c, dtype=np.int32) for c in counts)])
            yield pa.RecordBatch.from_arrays([batch.column("node").take(rows), batch.column("size").take(rows), pa.array(np.concatenate(entries).view(np.int64)), pa.array(at)], ["node", "size", "entry", "at"])

    return feats.filter("size > 0").select("node", "size", "set").mapInArrow(run, "node long, size int, entry long, at int")


def shared_entries(entries: DataFrame, similarity: float) -> DataFrame:
    """The distinct rows of entries that hold two sets or more, with root (the set itself so far).

    Without rows that come too late for a set as small as the entry's smallest: no pair of theirs can be similar.
    """
    entry = Window.partitionBy("entry")
    several = entries.withColumn("several", F.min("node").over(entry) != F.max("node").over(entry)).withColumn("least", F.min("size").over(entry)).filter("several")
    early = several.filter(F.col("size") - F.col("at") >= _least_common(F.col("size") + F.col("least"), similarity))
    return early.select("node", "size", "entry", "at").distinct().withColumn("root", F.col("node"))


def not_too_different(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) without those whose sets' parities differ too often for similar sets. sets: node, size and odd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            most = (1 - similarity) / (1 + similarity) * (batch.column("m").to_numpy() + batch.column("n").to_numpy()) + 1e-6
            least = [least_difference(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["u", "v"]).filter(pa.array(np.array(least, dtype=np.int64) <= most))

    x, y = (sets.select(F.col("node").alias(a), F.col("size").alias(b), F.col("odd").alias(c)) for a, b, c in ("umx", "vny"))
    #: Pairs are more than the rows that Spark takes them for, so they are not broadcast by its estimate.
    return pairs.join(x.hint("merge"), "u").join(y.hint("merge"), "v").select("u", "v", "m", "n", "x", "y").mapInArrow(run, "u long, v long")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar. sets: node and set, each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                a, b = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                common = len(np.intersect1d(a, b, assume_unique=True))
                good.append(common >= similarity * (len(a) + len(b) - common) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    x, y = sets.select(F.col("node").alias("u"), F.col("set").alias("x")), sets.select(F.col("node").alias("v"), F.col("set").alias("y"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _sketch_distance(a: str, b: str) -> Column:
    return F.bit_count(F.shiftrightunsigned(F.col(a).bitwiseXOR(F.col(b)), 32))


def _pairs(rows: DataFrame) -> DataFrame:
    """The distinct pairs u > v of rows (node, other)."""
    return rows.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()


def segment_pairs(entries: DataFrame) -> DataFrame:
    """u > v: each set with the two before it in an entry of segments, if their sketches are near."""
    order = Window.partitionBy("entry").orderBy("node")
    met = entries.select("node", *(F.lag("node", k).over(order).alias(name) for k, name in ((1, "one"), (2, "two"))))
    near = met.select("node", F.explode(F.array("one", "two")).alias("other")).filter("other is not null")
    return _pairs(near.filter((F.col("node") != F.col("other")) & (_sketch_distance("node", "other") <= SKETCH_LIMIT)))


def _least_common(sizes: Column, similarity: float) -> Column:
    """How many shingles two similar sets share at least, by the sum of their sizes."""
    return sizes * F.lit(similarity / (1 + similarity)) - 1e-6


def _can_be_similar(a: str, b: str, similarity: float) -> Column:
    """Whether two sets (structs) of one entry can be similar and this is the first shingle that they share."""
    size, at = ((F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in ("size", "at"))
    return F.least(size[0] - at[0], size[1] - at[1]) >= _least_common(size[0] + size[1], similarity)


def open_entries(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of entries that hold sets of different components, with the root of each set's. roots: see ``components``."""
    entry = Window.partitionBy("entry")
    rooted = entries.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return materialize(rooted.withColumn("open", F.min("root").over(entry) != F.max("root").over(entry)).filter("open").drop("open"), "copy-open")


def pairs_to_compare(entries: DataFrame, similarity: float) -> tuple[float, int]:
    """Pairs of sets of different components in open entries that can be similar, and rows of these.

    Where pairs are many, those that can be similar are estimated by the pairs of a part of the sets, no more than rows.
    """
    sized = entries.groupBy("entry", "root").agg(F.count("*").alias("n")).groupBy("entry").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    found = sized.agg(F.sum((F.col("n").cast("double") * F.col("n") - F.col("own")) / 2).alias("pairs"), F.sum("n").alias("rows")).first()
    pairs, rows = found["pairs"] or 0, found["rows"] or 0
    if pairs <= FEW * rows:
        return pairs, rows
    part = int(np.ceil(np.sqrt(pairs / rows)))
    some = entries.filter(F.pmod(F.xxhash64("node"), F.lit(part)) == 0)
    return part * part * met_pairs(some, similarity).count(), rows


def centre_pairs(entries: DataFrame, turn: int, similarity: float) -> DataFrame:
    """u > v: each set with one of another component that has about its size, from each of its open entries.

    In turn 0 that is the one with the fewest shingles before the entry's, so with the fewest that others do not have;
    in later turns any.
    """
    width = max(0.01, float(-np.log(similarity)))
    rows = entries.select("entry", F.floor(F.log("size") / width + turn / 2).alias("class"), "root", F.struct("node", "root", "size", "at").alias("a"))
    first = F.max(F.struct(*([] if turn else [-F.col("a.at")]), F.xxhash64("a.node", F.lit(turn)), "a"))
    centres = rows.groupBy("entry", "class").agg(first.alias("first"), F.min("root").alias("low"), F.max("root").alias("high"))
    centres = materialize(centres.filter("low <> high").select("entry", "class", F.col("first.a").alias("b")), "copy-centres")
    met = rows.drop("root").join(centres, ["entry", "class"]).filter("a.root <> b.root").filter(_can_be_similar("a", "b", similarity))
    return _pairs(met.select("a.node", F.col("b.node").alias("other")))


def met_pairs(entries: DataFrame, similarity: float) -> DataFrame:
    """node and other, once for each entry, for all pairs of sets of different components that can be similar."""
    rows = entries.select("entry", F.struct("node", "root", "size", "at").alias("a"))
    met = rows.join(rows.withColumnRenamed("a", "b"), "entry").filter("a.node > b.node and a.root <> b.root").filter(_can_be_similar("a", "b", similarity))
    return met.select("a.node", F.col("b.node").alias("other"))


def one_row(feats: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """One row (node and the columns names) of each of nodes."""
    if nodes.count() <= BROADCAST_NODES:
        #: The sets of all documents stay where they are; only those that are asked for are dealt.
        nodes = F.broadcast(nodes)
    return feats.select("node", *names).join(nodes, "node", "left_semi").groupBy("node").agg(*(F.first(c).alias(c) for c in names))


def similar_links(feats: DataFrame, similarity: float, every: bool = False) -> DataFrame:
    """Verified links u, v: similar sets are of one component of these. feats: see ``with_sets``; deleted on the way."""
    shared = materialize(shared_entries(prefix_entries(feats, similarity, frequent_shingles(feats)), similarity), "copy-entries")
    names = [*(f"f{k}" for k in range(LONGS)), "size", "odd"]
    sets = materialize(one_row(feats, materialize(shared.select("node").distinct(), "copy-used"), names), "copy-sets")

    def verify(pairs: DataFrame) -> DataFrame:
        near = materialize(not_too_different(pairs, sets, similarity), "copy-near")
        met = materialize(near.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "copy-met")
        return materialize(similar_pairs(near, one_row(feats, met, ["set"]), similarity), "copy-links")

    links, turn = sets.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0), 0
    found = None if every else verify(segment_pairs(segment_entries(sets)).union(centre_pairs(shared, turn, similarity)).distinct())
    while found is not None and not found.isEmpty():
        roots = components(links.unionByName(found))
        #: What is linked so far, by one link a set.
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        still = open_entries(shared, roots)
        release(shared)
        shared, (pairs, rows) = still, pairs_to_compare(still, similarity)
        if pairs <= FEW * rows:
            break
        turn += 1
        found = verify(centre_pairs(shared, turn, similarity))
    links = links.unionByName(verify(_pairs(met_pairs(shared, similarity))))
    release(shared, sets, feats)
    return links


def similar_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, every: bool = False) -> DataFrame:
    """doc_id and component_id of every row of docs (columns doc_id, text), by the similarity of shingle sets.

    every: all pairs are compared at once, also those that the segments or centres would have joined. The result is
    the same, at the square of a group's size.
    """
    feats = numbered_apart(materialize(with_sets(docs, words), "copy-feats"))
    named = materialize(feats.select("doc_id", "node"), "copy-named")
    roots = materialize(components(similar_links(feats, similarity, every)), "copy-components")
    ids = named.groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = materialize(ids.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "copy-rooted")
    ids = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return named.join(ids, "node").select("doc_id", "component_id")


def row_name() -> Column:
    """What tells a row of documents from others: its doc_id, and its text (a hash). Those without doc_id come last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("key"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, whole, with one document (the smallest doc_id) of each component of similar copies.

    Equal rows (doc_id and text) stay once. Rows of one doc_id with texts of different components stay, one a component.
    Rows without doc_id are compared like others; one stays where its component has no row with a doc_id.
    """
    return first_rows(docs, similar_copies(docs.select(row_name().alias("doc_id"), "text"), words, similarity))


def first_rows(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs whose name (see ``row_name``) is its component_id in named, once each."""
    least = named.filter("doc_id = component_id")
    found = materialize(least.groupBy("doc_id").agg(F.count("*").alias("n")), "kept-ids")
    #: The kept ids grow with the documents, so both are dealt by doc_id and text whatever their size.
    left, right = docs.alias("__docs"), found.select(F.col("doc_id.doc_id").alias("id"), "doc_id.key").alias("__found").hint("merge")
    same = F.col("__docs.doc_id").eqNullSafe(F.col("__found.id")) & (F.xxhash64("__docs.text") == F.col("__found.key"))
    kept = left.join(right, same, "left_semi").select(*(F.col(f"__docs.`{c}`") for c in docs.columns))
    return kept if found.filter("n > 1").isEmpty() else kept.withColumn(ROW, row_name()).dropDuplicates([ROW]).drop(ROW)
