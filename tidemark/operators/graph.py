"""The provenance graph as joins over an edge table (source_mu_id, target_mu_id, edge_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(units: DataFrame, edges: DataFrame) -> DataFrame:
    """All units, and ends of edges that are no units."""
    ends = edges.select(F.col("source_mu_id").alias("mu_id")).unionByName(edges.select(F.col("target_mu_id").alias("mu_id")))
    return units.select("mu_id").unionByName(ends).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """``node, neighbour, edge_type`` for each end of an edge."""
    way = lambda a, b: edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour"), "edge_type")
    return way("source_mu_id", "target_mu_id").unionByName(way("target_mu_id", "source_mu_id"))


def neighbours(edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    chosen = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    return both_ways(chosen).select("node", "neighbour").where("node <> neighbour").distinct()


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``seed, neighbour, hop``: everything within ``hops`` steps of each seed (mu_id), without the seed itself."""
    if hops < 1:
        raise ValueError("hops must be at least 1")
    steps = neighbours(edges)
    seen = seeds.select(F.col("mu_id").alias("seed"), F.col("mu_id").alias("neighbour"), F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        reached = front.select("seed", F.col("neighbour").alias("node")).join(steps, "node").select("seed", "neighbour").distinct()
        front = reached.join(seen, ["seed", "neighbour"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def degrees(units: DataFrame, edges: DataFrame) -> DataFrame:
    """``mu_id, degree, centrality``; parallel edges count each, and centrality is degree / (n - 1), or 1 for a lone node."""
    ends = both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))
    every = nodes(units, edges)
    total = every.agg(F.count("*").alias("n"))
    degree = F.coalesce("degree", F.lit(0).cast("long"))
    return every.join(ends, every.mu_id == ends.node, "left").crossJoin(F.broadcast(total)).select(
        "mu_id", degree.alias("degree"), F.when(F.col("n") > 1, F.round(degree / (F.col("n") - 1), 6)).otherwise(1.0).alias("centrality")
    )


def betweenness(units: DataFrame, edges: DataFrame, sources: int | None = None) -> DataFrame:
    """``conversation_id, mu_id, betweenness``: normalised, per conversation, along directed edges.

    Shortest paths need a search from every node, so each conversation, bounded by its capacity, is solved by itself.
    ``sources`` asks for the sampled measure: searches start at so many nodes, chosen by hash, and are scaled up.
    """
    of = units.select("conversation_id", "mu_id")
    inner = edges.select("source_mu_id", "target_mu_id").join(of.withColumnRenamed("mu_id", "source_mu_id"), "source_mu_id").select("conversation_id", "source_mu_id", "target_mu_id")

    def solve(left, right):
        import hashlib
        from collections import deque

        import pandas as pd

        names = sorted(set(left["mu_id"]) | set(right["source_mu_id"]) | set(right["target_mu_id"]))
        out = {n: set() for n in names}
        for s, t in zip(right["source_mu_id"], right["target_mu_id"], strict=True):
            out[s].add(t)
        score = dict.fromkeys(names, 0.0)
        chosen = names if sources is None or sources >= len(names) else sorted(names, key=lambda x: hashlib.md5(str(x).encode()).digest())[:sources]
        for start in chosen:
            order, paths, dist, back = [], {start: 1.0}, {start: 0}, {}
            queue = deque([start])
            while queue:
                v = queue.popleft()
                order.append(v)
                for w in sorted(out[v]):
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        queue.append(w)
                    if dist[w] == dist[v] + 1:
                        paths[w] = paths.get(w, 0.0) + paths[v]
                        back.setdefault(w, []).append(v)
            share = dict.fromkeys(order, 0.0)
            for w in reversed(order):
                for v in back.get(w, []):
                    share[v] += paths[v] / paths[w] * (1 + share[w])
                if w != start:
                    score[w] += share[w]
        n = len(names)
        scale = (1 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * n / max(1, len(chosen))
        conversation = (left if len(left) else right)["conversation_id"].iloc[0]
        return pd.DataFrame({"conversation_id": conversation, "mu_id": names, "betweenness": [round(score[x] * scale, 9) for x in names]})

    kind = dict(units.dtypes)
    inner = inner.select([F.col(c).alias(c) for c in inner.columns])  # other columns than those of the nodes
    return of.groupBy("conversation_id").cogroup(inner.groupBy("conversation_id")).applyInPandas(solve, f"conversation_id {kind['conversation_id']}, mu_id {kind['mu_id']}, betweenness double")


def with_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones; of equal ends and type the new one stays."""
    key = ["source_mu_id", "target_mu_id", "edge_type"]
    once = new.dropDuplicates(key)
    return edges.join(once.select(key), key, "left_anti").select(edges.columns).unionByName(once, allowMissingColumns=True).select(edges.columns)


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those named (source_mu_id, target_mu_id, and edge_type if it has one)."""
    key = [c for c in ("source_mu_id", "target_mu_id", "edge_type") if c in gone.columns]
    return edges.join(gone.select(key).distinct(), key, "left_anti").select(edges.columns)


def with_nodes(units: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (mu_id, ...) with new ones, which replace those of the same id."""
    return units.join(new.select("mu_id"), "mu_id", "left_anti").select(units.columns).unionByName(new, allowMissingColumns=True).select(units.columns)


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the named units (mu_id)."""
    drop = lambda e, end: e.join(gone.select(F.col("mu_id").alias(end)), end, "left_anti").select(edges.columns)
    return drop(drop(edges, "source_mu_id"), "target_mu_id")


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))
