"""From raw documents to packed training sequences.

Each stage works on all rows that the one before kept, its result written as a table in the
shared folder and read again. All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.llm import mixing, packing, quality_trees, secret_scan
from tallycast.llm import near_copies as near_copies_of
from tallycast.llm.common import keep, release, table
from tallycast.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_trees.accepted(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of the smallest id, then of the first row number."""
    return near_copies_of.first_of_groups(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to the names of their kinds, and lengths follow; all documents stay."""
    length = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return secret_scan.redact(docs).withColumn("n_chars", length)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, one row each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("mixture", mixture), ("sequences", sequences)]
ORACLE_SQL = None  # the classifier and the packing have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
