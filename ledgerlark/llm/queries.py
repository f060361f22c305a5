"""Queries of the numbered operators over the given tables, with SQL where SQL states the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm.licenses import scan_licenses
from ledgerlark.llm.mixing import MIX_SQL, mix_sources
from ledgerlark.llm.neardup import near_duplicates
from ledgerlark.llm.pieces import piece_digest
from ledgerlark.llm.quality import QUALITY_SQL, quality_verdicts
from ledgerlark.llm.ranked_search import RANKED_SQL, ranked_search
from ledgerlark.llm.resampling import resample
from ledgerlark.llm.substrings import repeats_digest
from ledgerlark.llm.token_counts import count_tokens
from ledgerlark.llm.token_files import token_files_digest
from ledgerlark.llm.topk import TOP_SQL, top_of_every_50th
from ledgerlark.llm.toxicity import grade_documents
from ledgerlark.llm.url_filter import URL_SQL, filter_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_digest(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_of_every_50th(_table(spark, sf_dir, "embeddings"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_pages(_table(spark, sf_dir, "pages"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_sentence_pieces, op2_token_counts, op3_license_scan, op4_quality_rules, op5_toxicity, op6_mix_sources, op7_substring_dedup, op8_jaccard_join, op9_token_files, op10_top_k,
        op11_url_filter, op12_importance_resampling, op13_ranked_search,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": QUALITY_SQL, "op6_mix_sources": MIX_SQL, "op10_top_k": TOP_SQL, "op11_url_filter": URL_SQL, "op13_ranked_search": RANKED_SQL}
