"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, mixing, quality_classifier, simhash, surrogates
from plumbline.llm.queries import SURROGATE_KEY, tokenizer_path
from plumbline.sources.scratch import materialize
from plumbline.sources.tables import table


#: Rows that go to a Python task at a time: texts of thousands of rows would be held by Spark and by the task at once.
BATCH_ROWS = 1024


def in_small_batches(spark: SparkSession) -> None:
    """Set the session's batches for Python tasks to BATCH_ROWS at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    in_small_batches(spark)
    return quality_classifier.keep_quality(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles of a similarity of 0.8 or more."""
    in_small_batches(spark)
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the text."""
    in_small_batches(spark)
    done = surrogates.replace_pii(docs, SURROGATE_KEY)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; the text is what the ids decode to."""
    in_small_batches(spark)
    return bpe.encode_and_decode(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("PII surrogates", pii),
    ("source mixing", mix),
    ("BPE tokens", tokens),
]

#: SQL cannot express the classifier, the fingerprints, the surrogates or the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
    return docs
