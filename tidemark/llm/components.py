"""Connected components by alternating stars, with joins and aggregates only; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import staged


def _pointed(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Rows joined with the least neighbour of their u. Both sides come from tables, so a hub can be split at run time."""
    return rows.join(staged(least, "least"), "u")


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``links`` (u, v) as ``node, label``: the smallest node of each component for every node but that one.

    Self-links and nulls are ignored; repeated links count once. No links, no rows.
    """
    u, v = F.col("u"), F.col("v")
    edges = staged(links.where("u <> v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _are_stars(edges):
            return edges.select(u.alias("node"), v.alias("label"))
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # an edge gives one edge at most, so repeats may wait for the second half
        large = staged(_pointed(both, least).where("v > u").select(v.alias("u"), F.col("m").alias("v")).where("u <> v"), "large")
        joined = _pointed(large, large.groupBy("u").agg(F.min("v").alias("m")))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = staged(small.distinct(), "small")
    raise RuntimeError("components did not settle")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node points to one other that points nowhere. Edges keep components together, so these are whole then."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("is_target")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("is_target")))
    nodes = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("is_target").alias("is_target"))
    wrong = (F.col("points") > 1) | ((F.col("points") == 1) & (F.col("is_target") == 1))
    return nodes.agg(F.count_if(wrong).alias("n")).first()["n"] == 0
