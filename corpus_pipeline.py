"""A corpus pipeline: toxic documents go, then exact copies, then near copies; sources are mixed to weights; texts are encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Its result is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hydrospark.llm import bpe, exact_dedup, mixing, near_copies as near, toxicity
from hydrospark.llm.common import documents, labels
from hydrospark.plans.scratch import written


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores 0.5 or more go."""
    return toxicity.drop_toxic(docs, labels(spark, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8) the row with the least doc_id stays."""
    return near.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return bpe.digests(docs)


STAGES = [("toxicity", toxic_documents), ("exact dedup", exact_copies), ("near dedup", near_copies), ("mixing", mixture), ("byte BPE", encoding)]

#: The toxicity and near-copy stages are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
