"""Adapters from plain tables to the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def turns(conversations: DataFrame) -> DataFrame:
    """Dialogue turns of ``conversations`` (conv_id, turn, role, text)."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("conversation_id"), F.lit("S0").alias("session_id"), F.col("turn").alias("turn_index"), F.concat(F.lit("D"), F.col("turn").cast("string")).alias("dia_id"),
        F.col("role").alias("speaker"), F.col("text").alias("text"), F.lit("").alias("timestamp"),
    )


def event_units(events: DataFrame) -> DataFrame:
    """Memory units made of ``events``: the user is the conversation, the event a unit; the other fields follow its number."""
    ts = F.col("ts").cast("timestamp")
    i = F.col("event_id")
    return events.select(
        i.alias("mu_id"), F.col("user_id").alias("conversation_id"), i.alias("seq"), ts.alias("created_at"),
        F.when(i % 3 != 0, F.timestamp_micros(F.unix_micros(ts) + (i % 40) * 3_600_000_000)).alias("last_accessed"), (i % 13).alias("retrieval_count"),
        F.round(F.col("value") / (F.col("value") + 20.0), 4).alias("importance"), F.round(0.3 + (i % 7) / 10.0, 4).alias("confidence"), (i % 17 == 0).alias("user_pinned"),
        F.when(i % 11 < 8, "active").when(i % 11 < 10, "archived").otherwise("forgotten").alias("status"), F.when((i % 11 == 8), F.concat(F.lit("label_"), i.cast("string"))).alias("compressed_label_id"),
    )


def now() -> Column:
    """The moment at which the example queries look at the tables."""
    return F.lit("2024-02-10 00:00:00").cast("timestamp")
