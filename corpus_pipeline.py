"""Corpus pipeline over `documents`: quality rules, language ID, near-duplicates, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns it was given; the
last adds the pieces of every text. run() writes each stage as Parquet in the shared folder and reads
it again, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cueloom.llm import decontaminate, language, neardup, quality, spm
from cueloom.llm.common import small_batches, stored
from cueloom.llm.queries import table, tokenizer_path
from cueloom.session import ship_package

#: Language ID and SentencePiece have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail a base rule or come from a rejected host."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognised language."""
    ship_package(spark)
    small_batches(spark)
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group."""
    ship_package(spark)
    small_batches(spark)
    return neardup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold benchmark passages by the contamination rule."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, ids and round_trip."""
    ship_package(spark)
    small_batches(spark)
    return spm.encode_merges(docs, tokenizer_path("piece_bpe_32k.model"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
