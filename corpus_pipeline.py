"""A corpus pipeline: stages over the table documents, each written as Parquet and read again for the next.

Defined results: a null or empty text fails the quality rules, so it goes in the first stage; of equal texts the row with the largest doc_id
stays, and of rows that repeat both text and doc_id one; of near copies the row with the smallest doc_id; a null doc_id loses to any other, and such a row
is not cut; a text of which all words go is packed as its end id alone; an empty table gives no rows; other columns, whatever their
names, are kept up to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, packing, quality_rules, simhash, substring_dedup
from tessera.llm.common import documents, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality_rules.kept_documents(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts: the one with the largest doc_id."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints: the one with the smallest doc_id.

    The rule is that of op9_simhash: shingles of three words, three bits of 64. Most copies of five-word similarity 0.8 lie further apart, and stay.
    """
    return simhash.kept_documents(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return substring_dedup.cleaned_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", pack_sequences),
]
#: The stages take robust covariances, XXH64 bits and byte-pair merges, which DuckDB does not have; tests hold each stage to its operator, which has brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
