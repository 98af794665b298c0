"""Capacity-bounded lifecycle: which active units leave, and where they go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.salience import scored


@dataclass(frozen=True)
class Lifecycle:
    capacity: int = 500
    trigger: float = 0.90
    target: float = 0.70
    forget: float = 0.15
    compress: float = 0.40

    def __post_init__(self):
        if self.capacity < 1 or not self.target < self.trigger or not self.forget < self.compress:
            raise ValueError("needs capacity >= 1, target < trigger, forget < compress")

    @staticmethod
    def tuned(capacity: int) -> Lifecycle:
        """A small memory forgets and compresses much earlier."""
        return Lifecycle(capacity, forget=0.80, compress=0.95) if capacity <= 20 else Lifecycle(capacity)


def due(units: DataFrame, config: Lifecycle) -> DataFrame:
    """Conversations whose active units reach the trigger share of the capacity."""
    n = units.where("status = 'active'").groupBy("conversation_id").agg(F.count("*").alias("n_active"))
    return n.where(F.col("n_active") / F.lit(float(config.capacity)) >= config.trigger)


def evictions(units: DataFrame, now: Column, config: Lifecycle, edges: DataFrame | None = None, only_due: bool = True) -> DataFrame:
    """``conversation_id, mu_id, salience, place, destination`` of every unit that leaves.

    Lowest salience first, then longest idle, then mu_id, until the target share is reached; pinned units stay.
    """
    active = scored(units.where("status = 'active'"), now, edges)
    n = due(units, config) if only_due else units.where("status = 'active'").groupBy("conversation_id").agg(F.count("*").alias("n_active"))
    order = Window.partitionBy("conversation_id").orderBy("salience", F.coalesce("last_accessed", "created_at"), "mu_id")
    placed = active.where(~F.col("user_pinned")).withColumn("place", F.row_number().over(order)).join(n, "conversation_id")
    surplus = F.greatest(F.lit(0), F.col("n_active") - F.lit(int(config.target * config.capacity)))
    return placed.where(F.col("place") <= surplus).select(
        "conversation_id", "mu_id", "salience", "place", F.when(F.col("salience") < config.forget, "forgotten").otherwise("archived").alias("destination")
    )


def batch_summary(units: DataFrame, now: Column, config: Lifecycle, edges: DataFrame | None = None) -> DataFrame:
    """Per conversation due: units scored, forgotten, compressed, and the pressure before and after."""
    gone = evictions(units, now, config, edges).groupBy("conversation_id").agg(
        F.count_if(F.col("destination") == "forgotten").alias("n_forgotten"), F.count_if(F.col("destination") == "archived").alias("n_compressed")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    left = F.col("n_active") - zero("n_forgotten") - zero("n_compressed")
    share = lambda c: F.round(c / F.lit(float(config.capacity)), 6)
    return due(units, config).join(gone, "conversation_id", "left").select(
        "conversation_id", F.col("n_active").alias("n_scored"), zero("n_forgotten").alias("n_forgotten"), zero("n_compressed").alias("n_compressed"),
        share(F.col("n_active")).alias("pressure_before"), share(left).alias("pressure_after"),
    )
