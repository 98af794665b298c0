"""Salience of memory units: a forgetting curve, importance, and penalties from the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
RECENCY, IMPORTANCE, STABILITY, MOST_DOUBLINGS, MOST_PENALTY = 0.60, 0.40, 2.0, 10, 0.40
SUPERSEDED, CONFLICTED = 0.30, 0.10
DAY = 86_400_000_000


def days_since(now: Column, then: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.greatest(F.lit(0.0), (micros(now) - micros(then)) / F.lit(float(DAY)))


def salience(now: Column, penalty: Column | None = None) -> Column:
    """round(clamp(0.6 e^(-t/S) + 0.4 importance - penalty), 4) over the columns of a memory unit."""
    unit = lambda c, top: F.greatest(F.lit(0.0), F.least(F.lit(top), c))
    idle = days_since(now, F.coalesce("last_accessed", "created_at", now))
    stability = F.lit(STABILITY) * F.pow(F.lit(2.0), F.least(F.col("retrieval_count"), F.lit(MOST_DOUBLINGS)))
    total = RECENCY * F.exp(-idle / stability) + IMPORTANCE * unit(F.col("importance"), 1.0) - unit(F.coalesce(penalty if penalty is not None else F.lit(0.0), F.lit(0.0)), MOST_PENALTY)
    return F.round(unit(total, 1.0), 4)


def graph_penalties(edges: DataFrame) -> DataFrame:
    """``mu_id, penalty``: 0.30 for a unit that is superseded, 0.10 for one in conflict, 0.40 at most."""
    has = lambda kind, cost: F.max(F.when(F.col("edge_type") == kind, cost).otherwise(0.0))
    total = has("superseded_by", SUPERSEDED) + has("conflicts_with", CONFLICTED)
    return edges.groupBy(F.col("source_mu_id").alias("mu_id")).agg(F.least(total, F.lit(MOST_PENALTY)).alias("penalty"))


def scored(units: DataFrame, now: Column, edges: DataFrame | None = None) -> DataFrame:
    """Units with ``salience``, penalised if ``edges`` are given."""
    if edges is None:
        return units.withColumn("salience", salience(now))
    return units.join(graph_penalties(edges), "mu_id", "left").withColumn("salience", salience(now, F.col("penalty"))).drop("penalty")


def ranked(units: DataFrame) -> DataFrame:
    """Rank by salience within a conversation, ties by mu_id."""
    return units.withColumn("rank", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("salience"), "mu_id")))


def compression_candidates(units: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Units that aren't pinned and lie below the threshold, with their place in ascending order."""
    low = units.where(~F.col("user_pinned") & (F.col("salience") < threshold))
    return low.withColumn("place", F.row_number().over(Window.partitionBy("conversation_id").orderBy("salience", "mu_id")))
