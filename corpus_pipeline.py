"""A pipeline of corpus stages: toxic documents go, one of near-duplicates stays, benchmark passages and personal data
leave the texts, and what is left is packed into sequences.

All stages but the last return the columns they got, extra ones of any name included; an empty table passes through all
of them. Texts may be of any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from hushgrad.llm import decontam, neardup, packing, personal, toxicity
from hushgrad.llm._shared import saved


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Null and empty texts are scored as texts without words; repeated rows
    share their fate."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id; a row without an id only where no row of
    its group has one. Rows without words, null texts among them, are nobody's copies and stay."""
    return neardup.deduplicated(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that lie in benchmark windows; texts of which half is such words go. Null and empty texts
    stay as they are, as does everything without benchmark items."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data covered; no row goes, and null and empty texts stay as they are."""
    return personal.redacted(docs)


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their places in sequences; a null or empty text is one id 0, repeated rows are
    packed each."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmarks),
    ("personal_data", without_personal_data),
    ("packing", in_sequences),
]

#: Classifiers, tokens and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each over the written rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = len(STAGES) - 1
    return reduce(lambda d, s: saved(s[1][1](spark, d, sf_dir), s[1][0]) if s[0] < last else s[1][1](spark, d, sf_dir), enumerate(STAGES), docs)
