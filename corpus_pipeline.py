"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's input. All but the last keep the columns
of documents, whatever their names. Null ids, texts and other nulls pass through; null and
empty texts are scored as empty, are near duplicates of one another, have no
repeats and are packed as their end id alone; texts of any length are read whole; repeated rows
are duplicates; no documents give no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamlode.llm import packing, rules, simhash, suffix, tokens
from seamlode.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at 0.5 or more."""
    model = rules.train(docs, table(spark, sf_dir, "labels"), fold=1, folds=3)
    return rules.kept(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class (5-word shingles, similarity 0.8)."""
    return simhash.one_of_each(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that start more than once."""
    return suffix.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces placed in sequences of 1024 ids."""
    return packing.pack(packing.pieces(docs, tokens.public_vocabulary()))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_dedup),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the learned, hashed and tokenised stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
