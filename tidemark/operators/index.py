"""Search indexes as tables ``mu_id, conversation_id, text, vector, deleted``, kept up to date by functions.

Re-adding replaces, removing marks, compacting drops what is marked. A search never looks at marked rows and is exact
within its conversation, so an index can be rebuilt at any time without changing what it finds.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import search

COLUMNS = ["mu_id", "conversation_id", "text", "vector", "deleted"]


def indexed(rows: DataFrame, known: DataFrame | None = None, dim: int = 64) -> DataFrame:
    """Rows (mu_id, conversation_id, text) as an index; ``known`` (key, vector) as in :func:`search.embedded`."""
    return search.embedded(rows, F.col("text"), known, dim).withColumn("deleted", F.lit(False)).select(COLUMNS)


def rebuilt(units: DataFrame, text: Column, statuses: tuple[str, ...] = ("active",), known: DataFrame | None = None, dim: int = 64) -> DataFrame:
    """A new index of the units with one of the statuses."""
    return indexed(units.where(F.col("status").isin(*statuses)).select("mu_id", "conversation_id", text.alias("text")), known, dim)


def upserted(at: DataFrame, rows: DataFrame, known: DataFrame | None = None, dim: int = 64) -> DataFrame:
    """The index with rows (mu_id, conversation_id, text); ids that it has are replaced."""
    return at.join(rows.select("mu_id"), "mu_id", "left_anti").select(COLUMNS).unionByName(indexed(rows, known, dim))


def removed(at: DataFrame, ids: DataFrame) -> DataFrame:
    """The index with ids (mu_id) marked as deleted."""
    gone = ids.select("mu_id").distinct().withColumn("_gone", F.lit(True))
    return at.join(gone, "mu_id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).select(COLUMNS)


def compacted(at: DataFrame) -> DataFrame:
    return at.where("NOT deleted")


def synced(at: DataFrame, units: DataFrame, text: Column, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    """The index after all units that ask for it (needs_reindex): those with one of the statuses replaced, the others removed."""
    due = units.where("needs_reindex")
    stays = F.col("status").isin(*statuses)
    return upserted(removed(at, due.where(~stays)), due.where(stays).select("mu_id", "conversation_id", text.alias("text")))


def searched(at: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, mu_id, score`` of queries (query_id, conversation_id, vector) among rows that aren't deleted."""
    return search.dense_topk(queries.select("query_id", "conversation_id", "vector"), compacted(at).select("mu_id", "conversation_id", "vector"), k)


def keyword_searched(at: DataFrame, queries: DataFrame, k: int, question: str = "question") -> DataFrame:
    """``query_id, rank, mu_id, score`` by keywords among rows that aren't deleted."""
    return search.bm25_topk(compacted(at), queries, k, doc_id="mu_id", text="text", question=question, scope="conversation_id")


def all_rebuilt(units: DataFrame, labels: DataFrame, dim: int = 64) -> dict[str, DataFrame]:
    """The indexes of a memory: active claims, forgotten claims, and labels."""
    named = labels.select("mu_id", "conversation_id", search.label_text().alias("text"))
    return {"active": rebuilt(units, F.col("claim"), dim=dim), "forgotten": rebuilt(units, F.col("claim"), ("forgotten",), dim=dim), "label": indexed(named, dim=dim)}


def all_synced(indexes: dict[str, DataFrame], units: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """The same indexes after all units that ask for it; labels have no such mark and are built anew."""
    fresh = {"active": synced(indexes["active"], units, F.col("claim")), "forgotten": synced(indexes["forgotten"], units, F.col("claim"), ("forgotten",))}
    return fresh | {"label": indexed(labels.select("mu_id", "conversation_id", search.label_text().alias("text")))}


def write(at: DataFrame, path: str, **facts) -> None:
    """The index as Parquet, and its facts (model, dimension, ...) as one JSON row beside it."""
    at.write.mode("overwrite").parquet(f"{path}/rows")
    at.sparkSession.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load(spark, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/facts").first()["value"])
