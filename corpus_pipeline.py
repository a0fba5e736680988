"""The corpus pipeline: five operators of ``tileflow.llm`` from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of ``documents``; the last returns the pieces of the packed
sequences. A stage's result is meant to be written as Parquet and read again as the next
one's ``docs``; ``run`` does that in the shared folder of the session, and deletes what a
stage wrote on the way as soon as its result is there.

Defined results
    Nulls in any column: as the operators define them; a null text scores as the empty text, is a class of its
    own, holds no secret, has size 0 (and so is taken as often as its source's whole copies say) and is
    packed as the end id alone. Ties: each operator's. Repeated rows: one is kept by near-dedup.
    Empty table: empty results. Very long texts: handled whole, cut only when packed. Columns beyond
    those of ``documents``, whatever their names: dropped by the first stage, ignored by all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.llm import mixing, near_duplicates, packing, quality_classifier, secrets
from tileflow.llm.scratch import passing, small_batches, stage, tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.7)."""
    small_batches(spark)
    return _columns(quality_classifier.accepted(docs, tables(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of smallest id."""
    small_batches(spark)
    return _columns(near_duplicates.deduplicated(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret found replaced by a mark; n_chars follows the text."""
    small_batches(spark)
    clean = secrets.redacted(_columns(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, 0 to 3 times each."""
    return _columns(mixing.mixed_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    small_batches(spark)
    return packing.packing_report(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

#: The classifier's scores and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, label = tables(spark, sf_dir, "documents"), lambda name: f"pipeline-{name.replace(' ', '-')}"
    for name, step in STAGES[:-1]:
        with passing(spark, keep=label(name)):
            docs = stage(step(spark, docs, sf_dir), label(name))
    return STAGES[-1][1](spark, docs, sf_dir)
