"""Queries of this subpackage and their SQL: ``opN_<name>`` applies operator N to its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, knn, langid, licenses, near_dedup, packing, quality, secrets, warc
from tidemark.llm.shared import table


def op1_voronoi_knn(spark, sf_dir):
    return knn.voronoi_knn(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op2_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark, sf_dir):
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"))


def op6_seekable_warc(spark, sf_dir):
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark, sf_dir):
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op3_secret_ownership(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("places")


def op7_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.document_path())


def op4_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_quality_cotraining(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_voronoi_knn, op2_near_dedup, op3_secret_ownership, op4_language_id, op5_byte_bpe, op6_seekable_warc, op7_license_scan, op8_exact_dedup, op9_quality_cotraining, op10_best_fit_packing)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES = {
    "op1_voronoi_knn": knn.ORACLE_SQL,
    "op2_near_dedup": near_dedup.ORACLE_SQL,
    "op3_secret_ownership": secrets.ORACLE_SQL,
    "op6_seekable_warc": warc.ORACLE_SQL,
    "op7_license_scan": licenses.ORACLE_SQL,
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
}
