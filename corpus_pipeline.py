"""A corpus pipeline of five stages: quality rules, near duplicates, repeated passages, source mixing, SentencePiece.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the next one's
documents. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlark.functions.storage import materialize
from ledgerlark.llm.mixing import mixed_rows
from ledgerlark.llm.neardup import one_of_each
from ledgerlark.llm.pieces import piece_digest
from ledgerlark.llm.quality import keep_good
from ledgerlark.llm.substrings import cut_texts


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go; texts stay as they are."""
    return keep_good(docs)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the smallest id."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that also stand in a document with a smaller id go; all rows stay."""
    return cut_texts(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most three times."""
    return mixed_rows(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoding of each document: sizes, checksum, parity and round trip."""
    return piece_digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_join),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("sentence_pieces", sentence_pieces),
]

#: No SQL states banded near duplicates, suffix-sorted passages or SentencePiece; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
