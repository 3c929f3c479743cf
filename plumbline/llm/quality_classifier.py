"""Quality by compression: zstandard dictionaries of good and bad labelled texts.

Two views of a text are compressed whole, in pieces of PIECE bytes: the text itself, and its shape, where letters
are a or A, digits 0 and all else stays (characters beyond Latin-1 are ``?``), so that what is told by layout
needs no vocabulary. For each view there are two dictionaries, trained on pieces of all chosen good and all chosen
bad texts, and two normalised differences (b - a) / (b + a):

- of its size with the dictionary of bad texts (b) against the one with that of good texts (a);
- of its plain size (b) against its size with the dictionary of good texts (a), which tells texts that good ones
  do not explain, or that repeat themselves.

The score is a logistic function of the four, fitted on labelled texts that are in no dictionary.

Bounds of the sample, all parameters: up to ``per_class`` texts of each label, the ones with the smallest hash of
their id, and in that order as many as fit into ``max_bytes`` together (one that does not fit is passed over); of
three, two go to their label's dictionary and one to the fit. Sizes are looked at first, so only texts of the
sample reach the driver. The model is four dictionaries of up to ``dict_bytes`` and five numbers; it is sent to the
tasks with the function. Where a sample is too small to train a dictionary, its texts are the dictionary.

Defined results: null and empty texts have no differences (all 0) and score what the fit gives there. If a
label has fewer than six texts to learn from, all texts score 0.5. Repeated rows stay. An empty table gives
no rows. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import forget, slices

PIECE = 1024
LEVEL = 3
FOLDS = 5
_SHAPES = bytes(97 if chr(i).islower() else 65 if chr(i).isupper() else 48 if chr(i).isdigit() else i for i in range(256))


def words_view(text: str) -> bytes:
    """The text itself."""
    return text.encode("utf-8")


def shape_view(text: str) -> bytes:
    """Letters as a or A, digits as 0, other characters as they are."""
    return text.encode("latin-1", "replace").translate(_SHAPES)


VIEWS: tuple[Callable[[str], bytes], ...] = (words_view, shape_view)


def pieces(data: bytes) -> list[bytes]:
    """data in pieces of PIECE bytes."""
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def _compressor(content: bytes) -> Callable[[bytes], bytes]:
    kept = zstandard.ZstdCompressionDict(content)
    kept.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=kept, write_content_size=False, write_dict_id=False).compress


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary trained on the pieces of all texts, or their last bytes where there are too few."""
    try:
        return zstandard.train_dictionary(size, [p for t in texts for p in pieces(t)]).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


def differ(dictionaries: tuple[tuple[bytes, bytes], ...]) -> Callable[[str | None], tuple[float, ...]]:
    """A function that gives a text's differences. dictionaries: (good, bad) for each view."""
    pairs = [tuple(map(_compressor, pair)) for pair in dictionaries]

    def measure(text: str | None) -> tuple[float, ...]:
        if not text:
            return (0.0,) * (2 * len(VIEWS))
        out = []
        for view, (good, bad) in zip(VIEWS, pairs, strict=True):
            data = view(text)
            a, b = (sum(len(press(p)) for p in pieces(data)) for press in (good, bad))
            out += [(b - a) / (b + a), (len(data) - a) / (len(data) + a)]
        return tuple(out)

    return measure


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries of each view, and the logistic fit's weights with the intercept last."""

    dictionaries: tuple[tuple[bytes, bytes], ...]
    weights: tuple[float, ...]

    def scorer(self) -> Callable[[list[str | None]], np.ndarray]:
        """A function that gives the scores of some texts."""
        if not self.weights:
            return lambda texts: np.full(len(texts), 0.5)
        measure, w = differ(self.dictionaries), np.array(self.weights)

        def score(texts: list[str | None]) -> np.ndarray:
            x = np.array([measure(t) for t in texts], dtype=float).reshape(-1, len(w) - 1)
            return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))

        return score


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights and intercept of P(y = 1) by Newton's method, with x standardised and a small ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + ridge * np.eye(len(w)), design.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / scale
    return (*map(float, slopes), float(w[-1] - slopes @ mean))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that nothing is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def chosen_texts(docs: DataFrame, labels: DataFrame, per_class: int, max_bytes: int) -> tuple[list[str], list[str]]:
    """Bad and good texts of the sample, each in the order of their ids' hash."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = [usable.filter(F.col("quality") == q).orderBy(*order).limit(per_class) for q in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_class ids
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size")).filter("size > 0")
    sizes = own.select("doc_id", "h", "size").join(picked, "doc_id").orderBy(*order, "h", "quality").limit(2 * per_class).collect()
    left, wanted = max_bytes, {}
    for r in sizes:
        key = (r.doc_id, r.h, r.quality)
        if r["size"] <= left and key not in wanted:
            left -= r["size"]
            wanted[key] = len(wanted)
    texts: tuple[list[str], list[str]] = ([], [])
    if wanted:
        rows = docs.sparkSession.createDataFrame([(*k, n) for k, n in wanted.items()], "doc_id long, h long, quality int, n int")
        found = {r.n: r for r in own.join(F.broadcast(rows), ["doc_id", "h"]).select("n", "quality", "text").dropDuplicates(["n"]).collect()}
        for n in sorted(found):
            texts[found[n].quality].append(found[n].text)
    return texts


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_bytes: int = 24 << 20, dict_bytes: int = 256 << 10) -> CompressionModel:
    """A model from the labelled documents that are not held out."""
    texts = chosen_texts(docs, labels, per_class, max_bytes)
    if min(map(len, texts)) < 6:
        return CompressionModel((), ())
    parts = [([t for i, t in enumerate(part) if i % 3], part[::3]) for part in texts]
    dictionaries = tuple((dictionary([view(t) for t in parts[1][0]], dict_bytes), dictionary([view(t) for t in parts[0][0]], dict_bytes)) for view in VIEWS)
    measure = differ(dictionaries)
    x = np.array([measure(t) for _, rest in parts for t in rest])
    y = np.array([float(q) for q, (_, rest) in enumerate(parts) for _ in rest])
    return CompressionModel(dictionaries, fit_logistic(x, y))


def score_quality(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id and score of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        score = model.scorer()
        for batch in slices(batches):
            values = score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_quality(docs: DataFrame, model: CompressionModel, least: float = 0.3) -> DataFrame:
    """The rows of docs, whole, whose score is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        score = model.scorer()
        for batch in slices(batches):
            yield batch.filter(pa.array(score(batch.column("text").to_pylist()) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
