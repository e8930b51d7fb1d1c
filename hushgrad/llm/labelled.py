"""Labelled rows for fitting classifiers: all of them, or bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import crc_mod


def labelled(labels: DataFrame, label: str, divisor: int, held: int) -> DataFrame:
    """(doc_id, y) of all rows outside the held fold (crc32 of doc_id's text, modulo the divisor).

    Null ids and labels are left out; of several labels of a document the largest counts.
    """
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y")).where(crc_mod("doc_id", divisor) != held)


def sampled(labels: DataFrame, label: str, divisor: int, held: int, negatives: int, positives: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y) of at most so many rows of each class, first by a hash of doc_id, and the number of all rows by class.
    """
    rows = labelled(labels, label, divisor, held)
    total = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    first = lambda y, n: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return first(0, negatives).union(first(1, positives)), total
