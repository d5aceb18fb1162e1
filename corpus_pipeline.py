"""A training corpus from raw documents: five stages, each one operator of pelagraph.llm.

Each stage gets the rows that its predecessor kept, written as Parquet and read again. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pelagraph.llm import language_id, mixing, ngram_jaccard, packing, quality_rules
from pelagraph.llm.common import crc_mod, keep, table
from pelagraph.storage import drop, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined or decided by a narrow margin go."""
    return language_id.accepted(docs, language_id.fit(docs, crc_mod("doc_id", 4) != 2))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their stratum's certified threshold rejects go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays, the one with the smallest id."""
    return ngram_jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, so that sources get their target shares."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 2048."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard_join", join_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express compression, token ids or packing; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as hold:  # what a stage has written on its way goes
            after = hold(keep(stage(spark, docs, sf_dir), name))
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
