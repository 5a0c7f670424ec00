"""A bounded sample of labelled documents, for the operators that fit a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(parts: int) -> Column:
    """crc32 of doc_id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def sample(documents: DataFrame, labels: DataFrame, label: str, eligible: Column, most: int) -> DataFrame:
    """doc_id, text, y of at most `most` labelled documents, chosen by a hash of the id.

    Only the chosen ids, `most` rows at the most, are broadcast; texts are not shuffled.
    Null labels are left out; of several labels for a document the largest counts; of
    several rows with one doc_id all are used.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & eligible)
        .groupBy("doc_id").agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
