"""Ranked lanes fused, guarded, reranked and expanded. A lane is ``query_id, mu_id, rank`` with ranks from 1."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.words import all_tokens

# fixed values
RRF_K, GRAPH_DISCOUNT, SALIENCE_WEIGHT = 60, 0.8, 1e-4
CE_WEIGHT, CE_SALIENCE, CE_CONFIDENCE, CE_SUPERSEDED, PER_TURN, CANDIDATE_CHARS = 3.0, 0.02, 0.01, 0.10, 2, 450
EXPANDS = ["related_to", "conflicts_with"]


def rrf(lanes: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """``query_id, mu_id, rrf_score, sources, best_rank``: the sum of weight / (k + rank) over all lanes."""
    named = [lane.select("query_id", "mu_id", "rank", F.lit(name).alias("lane"), F.lit(float((weights or {}).get(name, 1.0))).alias("w")) for name, lane in lanes.items()]
    rows = reduce(DataFrame.unionByName, named)
    return rows.groupBy("query_id", "mu_id").agg(
        F.round(F.sum(F.col("w") / (F.lit(float(k)) + F.col("rank"))), 9).alias("rrf_score"), F.array_sort(F.collect_set("lane")).alias("sources"), F.min("rank").alias("best_rank")
    )


def top(fused: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k best of each query with ``rank``; by ``rrf_score`` and mu_id unless told otherwise."""
    by = order or (F.desc("rrf_score"), F.col("mu_id"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= k)


def graph_lane(seeds: DataFrame, fused: DataFrame, edges: DataFrame, units: DataFrame) -> DataFrame:
    """``query_id, mu_id, rrf_score``: related or conflicting neighbours of dense seeds that no lane has found.

    Seeds: query_id, mu_id, rank. The first seed by rank gives its fused score, discounted. Neighbours are of the same
    conversation and not forgotten.
    """
    e = edges.where(F.col("edge_type").isin(EXPANDS) & (F.col("source_mu_id") != F.col("target_mu_id")))
    step = e.select(F.col("source_mu_id").alias("seed"), F.col("target_mu_id").alias("mu_id")).unionByName(e.select(F.col("target_mu_id").alias("seed"), F.col("source_mu_id").alias("mu_id"))).distinct()
    of = lambda name: units.select(F.col("mu_id").alias(name), F.col("conversation_id").alias(f"_{name}_c"), "status")
    reach = seeds.select("query_id", F.col("mu_id").alias("seed"), "rank").join(step, "seed")
    reach = reach.join(of("seed").drop("status"), "seed").join(of("mu_id"), "mu_id").where("_seed_c = _mu_id_c AND status <> 'forgotten'")
    fresh = reach.join(fused.select("query_id", "mu_id"), ["query_id", "mu_id"], "left_anti")
    first = fresh.groupBy("query_id", "mu_id").agg(F.min(F.struct("rank", "seed")).alias("by"))
    score = fused.select("query_id", F.col("mu_id").alias("seed"), F.col("rrf_score").alias("_s"))
    return first.select("query_id", "mu_id", F.col("by.seed").alias("seed")).join(score, ["query_id", "seed"]).select("query_id", "mu_id", F.round(GRAPH_DISCOUNT * F.col("_s"), 9).alias("rrf_score"))


def relation_meta(edges: DataFrame) -> DataFrame:
    """``mu_id, superseded_by, conflicts_with, related_to``: outgoing supersessions, the others in both directions."""
    way = lambda a, b: edges.select(F.col(a).alias("mu_id"), F.col(b).alias("other"), "edge_type")
    both = way("source_mu_id", "target_mu_id").unionByName(way("target_mu_id", "source_mu_id").where("edge_type <> 'superseded_by'"))
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("edge_type") == kind, F.col("other")))).alias(kind)
    return both.groupBy("mu_id").agg(of("superseded_by"), of("conflicts_with"), of("related_to"))


def fresh_only(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Hits without those that another hit of the same query supersedes; the set that is looked at doesn't shrink meanwhile."""
    newer = edges.where("edge_type = 'superseded_by'").select(F.col("source_mu_id").alias("mu_id"), F.col("target_mu_id").alias("newer"))
    present = hits.select("query_id", F.col("mu_id").alias("newer"))
    stale = hits.select("query_id", "mu_id").join(newer, "mu_id").join(present, ["query_id", "newer"]).select("query_id", "mu_id").distinct()
    return hits.join(stale, ["query_id", "mu_id"], "left_anti").select(hits.columns)


def hydrated(fused: DataFrame, units: DataFrame, pool: int, keep_forgotten: Column | None = None, transient: DataFrame | None = None) -> DataFrame:
    """Fused rows joined with their units; forgotten ones go unless ``keep_forgotten``; then the pool's best stay.

    ``transient`` has the stand-ins of hits that are no units (query_id, mu_id and a unit's facts).
    """
    facts = ["conversation_id", "claim", "status", "salience", "confidence", "source_dia_ids"]
    known = fused.join(units.select("mu_id", *facts), "mu_id").where((F.col("status") != "forgotten") | (keep_forgotten if keep_forgotten is not None else F.array_contains("sources", "forgotten")))
    if transient is not None:
        known = known.unionByName(fused.join(transient.select("query_id", "mu_id", *facts), ["query_id", "mu_id"]).select(known.columns))
    return top(known, pool, F.desc(F.col("rrf_score") + SALIENCE_WEIGHT * F.col("salience")), F.col("mu_id"))


def promotions(hits: DataFrame) -> DataFrame:
    """``mu_id, reason``: units that a search brings back to active; the caller applies it."""
    label = F.array_contains("sources", "label") & F.col("status").isin("archived", "compressed")
    return hits.where((F.col("status") == "forgotten") | label).select("mu_id", F.when(F.col("status") == "forgotten", "forgotten").otherwise("label").alias("reason")).distinct()


def overlap_score(question: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder: distinct words in common."""
    return F.size(F.array_intersect(all_tokens(question), all_tokens(text))).cast("double")


def candidate_text(most: int = CANDIDATE_CHARS) -> Column:
    """Metadata, claim, original text, label and neighbouring turns of a hit in one passage, without what is contained already.

    Columns: session_id, source_speaker, timestamp, claim, original_text, label_summary, context_text; any may be null.
    """
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    meta = F.concat_ws(" | ", part("Session:", F.col("session_id")), part("Speaker:", F.col("source_speaker")), part("Time:", F.substring(F.col("timestamp"), 1, 10)))
    claim, original, label, near = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("claim", "original_text", "label_summary", "context_text"))
    return F.substring(F.concat_ws(
        " ", F.when(meta != "", F.concat(F.lit("["), meta, F.lit("]"))), F.when(claim != "", claim), F.when((original != "") & ~claim.contains(original), original),
        F.when((label != "") & ~claim.contains(label) & ~original.contains(label), label),
        F.when((near != "") & ~claim.contains(near) & ~original.contains(near) & ~label.contains(near), near),
    ), 1, most)


def model_scores(pairs: DataFrame, backend: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """``query_id, mu_id, ce`` of pairs (query_id, mu_id, question, passage) by a cross-encoder that scores lists; null where it fails."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            try:
                scores = [float(x) for x in backend(pdf["question"].tolist(), pdf["passage"].tolist())]
            except Exception:  # whatever a model raises: the caller falls back
                scores = [None] * len(pdf)
            yield pdf[["query_id", "mu_id"]].assign(ce=scores)

    kinds = dict(pairs.dtypes)
    return pairs.select("query_id", "mu_id", "question", "passage").mapInPandas(run, f"query_id {kinds['query_id']}, mu_id {kinds['mu_id']}, ce double")


def reranked_or_fused(hits: DataFrame, k: int, per_turn: int = PER_TURN) -> DataFrame:
    """As :func:`reranked`; queries of which any hit has no score keep their fused order, cut to k."""
    lost = hits.groupBy("query_id").agg(F.bool_or(F.col("ce").isNull()).alias("_lost")).where("_lost").select("query_id")
    scored = reranked(hits.join(lost, "query_id", "left_anti").select(hits.columns), k, per_turn)
    plain = top(hits.join(lost, "query_id", "left_semi").select(hits.columns), k, F.col("rank")) if "rank" in hits.columns else top(hits.join(lost, "query_id", "left_semi").select(hits.columns), k)
    return scored.unionByName(plain.withColumn("final_score", F.lit(None).cast("double")).select(scored.columns))


def reranked(hits: DataFrame, k: int, per_turn: int = PER_TURN) -> DataFrame:
    """The k best by ``3 minmax(ce) + rrf / max(rrf) + 0.02 salience + 0.01 confidence - 0.10 [superseded]``.

    Hits: query_id, mu_id, ce, rrf_score, salience, confidence, superseded, source_dia_ids. At most ``per_turn`` hits
    lead with the same turn; the places left are filled in score order.
    """
    w = Window.partitionBy("query_id")
    low, spread = F.min("ce").over(w), F.max("ce").over(w) - F.min("ce").over(w)
    ce = (F.col("ce") - low) / F.when(spread == 0, 1.0).otherwise(spread)
    final = CE_WEIGHT * ce + F.col("rrf_score") / F.coalesce(F.nullif(F.max("rrf_score").over(w), F.lit(0.0)), F.lit(1.0)) + CE_SALIENCE * F.col("salience") + CE_CONFIDENCE * F.col("confidence")
    final = F.round(final - F.when(F.col("superseded"), CE_SUPERSEDED).otherwise(0.0), 9)
    lead = F.coalesce(F.array_min("source_dia_ids"), F.col("mu_id").cast("string"))
    scored = hits.withColumns({"final_score": final, "_lead": lead})
    nth = F.row_number().over(Window.partitionBy("query_id", "_lead").orderBy(F.desc("final_score"), "mu_id"))
    spare = scored.withColumn("_spare", (nth > per_turn).cast("int"))
    chosen = top(spare, k, F.col("_spare"), F.desc("final_score"), F.col("mu_id"))
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_spare", F.desc("final_score"), "mu_id"))).drop("_spare", "_lead")


def source_lane(turn_hits: DataFrame, links: DataFrame) -> DataFrame:
    """Turn hits (query_id, conversation_id, dia_id, rank) as a lane of units; a turn no unit quotes is the hit ``se_<dia_id>``.

    A unit has a row for each of its turns that was found, so the fusion adds them up.
    """
    joined = turn_hits.join(links, ["conversation_id", "dia_id"], "left")
    ids = F.coalesce("mu_ids", F.array(F.concat(F.lit("se_"), F.col("dia_id"))))
    return joined.select("query_id", F.explode(ids).alias("mu_id"), "rank")


def expanded_topk(hits: DataFrame, edges: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """Dense hits (query_id, mu_id, score) among active units, with their active neighbours at 0.8 of the seed's score.

    Neighbours come over relations, supersessions and conflicts in both directions, of the same conversation; the best
    seed counts. ``query_id, rank, mu_id, score, source``.
    """
    live = units.where("status = 'active'").select("mu_id", "conversation_id")
    found = hits.join(live, "mu_id").select("query_id", "mu_id", "score", "conversation_id")
    e = edges.where("source_mu_id <> target_mu_id")
    step = e.select(F.col("source_mu_id").alias("seed"), F.col("target_mu_id").alias("other")).unionByName(e.select(F.col("target_mu_id").alias("seed"), F.col("source_mu_id").alias("other"))).distinct()
    near = found.select("query_id", F.col("mu_id").alias("seed"), "score", F.col("conversation_id").alias("_c")).join(step, "seed").select("query_id", F.col("other").alias("mu_id"), "score", "_c")
    near = near.join(live.select([F.col(c).alias(c) for c in live.columns]), "mu_id").where("_c = conversation_id").join(found.select("query_id", "mu_id"), ["query_id", "mu_id"], "left_anti")
    more = near.groupBy("query_id", "mu_id").agg(F.round(GRAPH_DISCOUNT * F.max("score"), 9).alias("score")).withColumn("source", F.lit("graph"))
    every = found.select("query_id", "mu_id", "score", F.lit("dense").alias("source")).unionByName(more)
    return top(every, k, F.desc("score"), F.col("mu_id")).select("query_id", "rank", "mu_id", "score", "source")


def label_lane(label_hits: DataFrame, units: DataFrame) -> DataFrame:
    """Label hits (query_id, mu_id, rank, short_summary) whose units still lie in the archive."""
    return label_hits.join(units.where(F.col("status").isin("archived", "compressed")).select("mu_id"), "mu_id", "left_semi").select(label_hits.columns)


def followed(hits: DataFrame, archives: DataFrame) -> DataFrame:
    """Hits of the label lane with the claim of their archived snapshot, where it can be read."""
    snapshot = archives.select("mu_id", F.get_json_object("full_memory_unit_json", "$.claim").alias("_claim"))
    return hits.join(snapshot, "mu_id", "left").withColumn("claim", F.when(F.array_contains("sources", "label"), F.coalesce("_claim", "claim")).otherwise(F.col("claim"))).drop("_claim")


def transient_units(hits: DataFrame, turns: DataFrame) -> DataFrame:
    """Stand-in units for hits ``se_<dia_id>`` (query_id, conversation_id, mu_id): the turn itself as the claim."""
    lone = hits.where(F.col("mu_id").startswith("se_")).withColumn("dia_id", F.substring("mu_id", 4, 1 << 20))
    return lone.join(turns, ["conversation_id", "dia_id"]).select(
        "query_id", "mu_id", "conversation_id", F.concat(F.col("speaker"), F.lit(": "), F.col("text")).alias("claim"), F.array("dia_id").alias("source_dia_ids"), F.col("speaker").alias("source_speaker"),
        "session_id", "timestamp",
        F.lit(0.5).alias("salience"), F.lit(0.5).alias("confidence"), F.lit("active").alias("status"),
    )
