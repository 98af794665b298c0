"""How two claims of a conversation relate: a decision list over token overlap, topics and keyword flags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import claims as C
from tidemark.functions.words import claim_tokens, entity_overlap, jaccard

# fixed values
CONTRADICTS, ENTAILS, SAME, RELATED, NEGATED, MOVED = 0.70, 0.70, 0.60, 0.10, 0.25, 0.30
EXCLUSIVE = ["employment", "location", "relationships"]
GUARD = 0.20


def described(units: DataFrame) -> DataFrame:
    """Units with what the rules look at, computed once for each claim and not for each pair."""
    c = F.col("claim")
    return units.withColumns({
        "_tokens": claim_tokens(c), "_topic": C.topic(c), "_entities": C.entities(c), "_neg": C.has_negation(c), "_update": C.has_update_verb(c), "_temporal": C.is_temporal_claim(c),
    })


def overlap(a: str = "a", b: str = "b") -> Column:
    return jaccard(F.col(f"{a}._tokens"), F.col(f"{b}._tokens"))


def inference(a: str, b: str, j: Column | None = None) -> dict[str, Column]:
    """Deterministic stand-in for a language-inference model: contradiction, entailment, neutral."""
    j = overlap(a, b) if j is None else j
    turned = F.col(f"{b}._neg") & ~F.col(f"{a}._neg") & (j >= NEGATED)
    entail = F.when(turned, 0.05).when(j >= SAME, F.round(0.75 + 0.20 * j, 4)).otherwise(0.10)
    return {"contradiction": F.when(turned, 0.85).when(j >= SAME, 0.05).otherwise(0.10), "entailment": entail}


def relationship(a: str = "a", b: str = "b", nli: dict[str, Column] | None = None, j: Column | None = None) -> tuple[Column, Column]:
    """Relationship and confidence of older claim ``a`` and newer claim ``b``; the first rule that holds decides.

    ``j`` is a column with the :func:`overlap` of the pair, which most rules look at.
    """
    j = overlap(a, b) if j is None else j
    nli = nli or inference(a, b, j)
    same = (F.col(f"{a}._topic") == F.col(f"{b}._topic")) & (F.col(f"{a}._topic") != C.GENERAL)
    update, temporal, negated = (F.col(f"{b}.{x}") for x in ("_update", "_temporal", "_neg"))
    entails = nli["entailment"] >= ENTAILS
    both_named = (F.size(f"{a}._entities") > 0) & (F.size(f"{b}._entities") > 0)
    moved = same & F.col(f"{a}._topic").isin(EXCLUSIVE) & (j < MOVED) & both_named & (entity_overlap(F.col(f"{a}._entities"), F.col(f"{b}._entities")) == 0)
    rules = [
        ((nli["contradiction"] >= CONTRADICTS) & negated & (j >= NEGATED), "contradiction", nli["contradiction"]),
        (entails & ~same, "related", nli["entailment"] * 0.5),
        (entails & update, "updated_fact", nli["entailment"]),
        (entails, "same_fact", nli["entailment"]),
        (update & same, "updated_fact", F.lit(0.75)),
        (moved, "updated_fact", F.lit(0.68)),
        (temporal & same, "temporal_change", F.lit(0.70)),
        (same | (j >= RELATED), "related", F.greatest(j, F.when(same, 0.3).otherwise(0.0))),
    ]
    kind, confidence = F.lit("unrelated"), F.greatest(F.lit(0.0), 1 - j)
    for holds, name, value in reversed(rules):
        kind, confidence = F.when(holds, name).otherwise(kind), F.when(holds, value).otherwise(confidence)
    return kind, confidence


#: A language-inference model: lists of premises and hypotheses to rows of contradiction, entailment, neutral.
Inference = Callable[[list[str], list[str]], list[tuple[float, float, float]]]


def model_inference(pairs: DataFrame, model: Inference) -> DataFrame:
    """Pairs (a, b) with ``_con`` and ``_ent`` of a model, null where it can't be loaded or fails."""
    kinds = dict(pairs.select(F.col("a.mu_id").alias("x"), F.col("b.mu_id").alias("y")).dtypes)

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            try:
                scores = [(float(c), float(e)) for c, e, _ in model(pdf["p"].tolist(), pdf["h"].tolist())]
            except Exception:  # whatever a model raises: the rules decide
                scores = [(None, None)] * len(pdf)
            yield pdf[["x", "y"]].assign(_con=[s[0] for s in scores], _ent=[s[1] for s in scores])

    asked = pairs.select(F.col("a.mu_id").alias("x"), F.col("b.mu_id").alias("y"), F.col("a.claim").alias("p"), F.col("b.claim").alias("h"))
    found = asked.mapInPandas(run, f"x {kinds['x']}, y {kinds['y']}, _con double, _ent double")
    return pairs.join(found, (F.col("a.mu_id") == F.col("x")) & (F.col("b.mu_id") == F.col("y")))


def compared(older: DataFrame, newer: DataFrame, model: Inference | None = None) -> DataFrame:
    """All pairs of one conversation with the older unit first: ``mu_a_id, mu_b_id, relationship, confidence``.

    Both need conversation_id, seq, mu_id, claim. Conversations are bounded by the capacity of their memory, so the pairs
    of one are bounded too. With a ``model`` its scores decide, and the rules wherever it fails.
    """
    pairs = described(older).alias("a").join(described(newer).alias("b"), (F.col("a.conversation_id") == F.col("b.conversation_id")) & (F.col("a.seq") < F.col("b.seq")))
    pairs, j = pairs.withColumn("_j", overlap()), F.col("_j")  # once a pair, not once a rule
    if model is None:
        kind, confidence = relationship(j=j)
    else:
        pairs, rules = model_inference(pairs, model), inference("a", "b", j)
        kind, confidence = relationship(nli={"contradiction": F.coalesce("_con", rules["contradiction"]), "entailment": F.coalesce("_ent", rules["entailment"])}, j=j)
    return pairs.select(
        F.col("a.conversation_id").alias("conversation_id"), F.col("a.mu_id").alias("mu_a_id"), F.col("b.mu_id").alias("mu_b_id"),
        kind.alias("relationship"), F.round(confidence, 6).alias("confidence"),
    )


def scan_conversations(units: DataFrame) -> DataFrame:
    """Every active unit against all earlier active ones of its conversation."""
    return compared(units, units)


def resolve_incoming(units: DataFrame, mu_ids: DataFrame) -> DataFrame:
    """The named units against all earlier ones of their conversations."""
    return compared(units, units.join(mu_ids.select("mu_id"), "mu_id", "left_semi"))


def edges_for(comparisons: DataFrame) -> DataFrame:
    """Edges that comparisons ask for: superseding old to new, conflicts both ways, relations old to new."""
    edge = lambda s, t, kind: F.struct(F.col(s).alias("source_mu_id"), F.col(t).alias("target_mu_id"), F.lit(kind).alias("edge_type"))
    r = F.col("relationship")
    edges = (
        F.when(r.isin("same_fact", "updated_fact", "temporal_change"), F.array(edge("mu_a_id", "mu_b_id", "superseded_by")))
        .when(r == "contradiction", F.array(edge("mu_a_id", "mu_b_id", "conflicts_with"), edge("mu_b_id", "mu_a_id", "conflicts_with")))
        .when(r == "related", F.array(edge("mu_a_id", "mu_b_id", "related_to")))
    )
    named = comparisons.select("conversation_id", F.col("confidence").alias("weight"), r, F.explode(edges).alias("e"))
    return named.select("conversation_id", "e.*", "weight", F.to_json(F.struct("relationship")).alias("metadata_json"))


def new_edges(wanted: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Wanted edges without self-loops, repeats and those that exist already."""
    key = ["source_mu_id", "target_mu_id", "edge_type"]
    once = wanted.where("source_mu_id <> target_mu_id").dropDuplicates(key)
    return once if existing is None else once.join(existing.select(key), key, "left_anti")


def edge_outcomes(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Wanted edges with ``outcome``: ``created``, ``edge_exists`` for one that is there or comes twice, ``edge_failed`` without two ends."""
    key = ["source_mu_id", "target_mu_id", "edge_type"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    there = existing.select(key).distinct().withColumn("_there", F.lit(True))
    marked = wanted.withColumn("_n", nth).join(there, key, "left")
    bad = F.col("source_mu_id").isNull() | F.col("target_mu_id").isNull() | F.col("edge_type").isNull() | (F.col("source_mu_id") == F.col("target_mu_id"))
    return marked.withColumn("outcome", F.when(bad, "edge_failed").when(F.coalesce("_there", F.lit(False)) | (F.col("_n") > 1), "edge_exists").otherwise("created")).drop("_n", "_there")


def counters(comparisons: DataFrame) -> DataFrame:
    """Per conversation: conflicts, updates, related, and the edges they make."""
    r = F.col("relationship")
    return comparisons.groupBy("conversation_id").agg(
        F.count_if(r == "contradiction").alias("conflicts"), F.count_if(r.isin("same_fact", "updated_fact", "temporal_change")).alias("updates"),
        F.count_if(r == "related").alias("related"),
        F.sum(F.when(r == "contradiction", 2).when(r == "unrelated", 0).otherwise(1)).alias("edges_created"),
    )


def guarded_supersessions(edges: DataFrame, units: DataFrame, guard: float = GUARD) -> DataFrame:
    """Superseding edges whose newer claim isn't much less certain than the older: ``source_mu_id, target_mu_id``."""
    certain = lambda side: units.select(F.col("mu_id").alias(f"{side}_mu_id"), F.col("confidence").alias(f"{side}_confidence"))
    known = edges.where("edge_type = 'superseded_by'").join(certain("source"), "source_mu_id").join(certain("target"), "target_mu_id")
    return known.where(F.round(F.col("target_confidence") + guard, 9) >= F.col("source_confidence")).select("source_mu_id", "target_mu_id", "source_confidence", "target_confidence")
