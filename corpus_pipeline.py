"""From raw documents to packed training sequences: five stages, each reading what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, near_dedup, packing, quality, secrets
from tidemark.llm.shared import discard, passing, staged, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with the same text but for white space."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: five words, a similarity of 0.8 or more."""
    return near_dedup.drop_near_copies(docs, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in a packed sequence."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]

#: A trained model, near-copies and tokens are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written to the shared folder and read by the next.

    Each stage judges every row by its own values. Null and blank texts leave in the first; rows that repeat a text, whatever
    their doc_id or without one, come down to one in the second; a null source or language is a value of its own. Texts are
    whole at any length, other columns travel along, whatever their names, and an empty table gives no rows. What a
    stage wrote for itself is deleted once its result is written, and that result once the next one's is.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing() as kept:
            done = staged(stage(spark, docs, sf_dir), name)
            kept.append(done)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
