"""The training-data pipeline: quality rules, language ID, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vaultlens.llm import language, mixing, neardup, packing, quality
from vaultlens.llm.common import stored, table

#: Least posterior of the predicted language.
SURE = 0.5
#: Most bits a byte, by what is usual for the language.
STRANGE = 2.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are no outliers of their language and source."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which one language is likelier than all others together, and that aren't strange for it."""
    return language.keep(docs, language.fit(docs), SURE, STRANGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five words, similarity 0.8."""
    return neardup.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each row, in sequences of 2048 ids."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("near-duplicates", near_duplicates), ("source mix", source_mix), ("packing", pack)]

#: No SQL: covariance estimates, context trees and tokenizers aren't expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
