"""Ingestion and questions over many conversations at once.

Bulk ingestion is set-wise: every claim against all earlier ones of its conversation. Replay follows the messages one by
one, since a later claim may depend on what an earlier one superseded; what the rules look at is computed in columns
first, and only the decisions are folded per conversation, which its capacity bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import claims as C
from tidemark.functions.words import dedup_tokens, jaccard
from tidemark.operators import chunking, context, extraction, fusion, lifecycle, relations, salience, search, store
from tidemark.sources.scratch import staged

# fixed values
BATCH_SAME, KNOWN_SAME, GUARD = 0.60, 0.85, 0.20
NO_ANSWER = "No information available."


def message_claims(turns: DataFrame) -> DataFrame:
    """Claims of every spoken turn, each numbered by message and fact: the input of both kinds of ingestion."""
    chunks = chunking.turn_chunks(turns)
    facts = extraction.extract_facts(chunks).join(chunks.select("chunk_id", F.col("turn_index_start").alias("turn_index")), "chunk_id")
    mu_id = F.substring(F.sha2(F.concat_ws("|", F.col("conversation_id"), F.col("turn_index").cast("string"), F.col("fact_no").cast("string"), "claim"), 256), 1, 16)
    return facts.withColumns({"mu_id": mu_id, "seq": F.col("turn_index") * 100 + F.col("fact_no")})


def batch_deduped(claims: DataFrame, least: float = BATCH_SAME) -> DataFrame:
    """Claims of a message without those like one that is kept before them."""
    row = F.struct(F.col("seq"), F.col("mu_id"), dedup_tokens(F.col("claim")).alias("t"))
    batch = claims.groupBy("conversation_id", "turn_index").agg(F.array_sort(F.collect_list(row)).alias("b"))
    keep = F.aggregate("b", F.slice("b", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: jaccard(k["t"], x["t"]) >= least), kept).otherwise(F.concat(kept, F.array(x))))
    kept = batch.select(F.explode(F.transform(keep, lambda k: k["mu_id"])).alias("mu_id"))
    return claims.join(kept, "mu_id", "left_semi").select(claims.columns)


def bulk_ingest(turns: DataFrame, prior: DataFrame | None = None, nli: relations.Inference | None = None) -> tuple[DataFrame, DataFrame]:
    """Units and edges of all messages, each claim judged against all earlier ones: ``(units, edges)``.

    ``prior`` (conversation_id, mu_id, seq, claim, confidence) are units of before, all earlier than any message; edges may
    start or end at them, and :func:`superseded` tells which are replaced.
    """
    claims = staged(batch_deduped(staged(message_claims(turns), "messages")), "claims")
    columns = ["conversation_id", "mu_id", "seq", "claim", "confidence"]
    before = claims.select(columns)
    if prior is not None:
        before = staged(before.unionByName(prior.select("conversation_id", "mu_id", (F.col("seq") - (1 << 40)).alias("seq"), "claim", "confidence")), "before")
    compared = staged(relations.compared(before, claims, nli), "compared")
    earlier = before.select("conversation_id", F.col("mu_id").alias("a"), F.col("seq").alias("sa"), dedup_tokens(F.col("claim")).alias("ta"))
    later = claims.select("conversation_id", F.col("mu_id").alias("b"), F.col("seq").alias("sb"), dedup_tokens(F.col("claim")).alias("tb"))
    sizes = F.size("ta"), F.size("tb")
    near = F.least(*sizes) / F.nullif(F.greatest(*sizes), F.lit(0)) >= KNOWN_SAME  # no overlap is larger
    alike = earlier.join(later, "conversation_id").where((F.col("sa") < F.col("sb")) & near & (jaccard(F.col("ta"), F.col("tb")) >= KNOWN_SAME)).select(F.col("b").alias("mu_id"))
    known = alike.unionByName(compared.where("relationship = 'same_fact'").select(F.col("mu_b_id").alias("mu_id"))).distinct()
    new = staged(claims.join(known, "mu_id", "left_anti").select(claims.columns), "new")
    ends = new.select("mu_id") if prior is None else new.select("mu_id").unionByName(prior.select("mu_id"))
    edges = relations.new_edges(relations.edges_for(compared))
    edges = edges.join(ends.select(F.col("mu_id").alias("source_mu_id")), "source_mu_id", "left_semi").join(ends.select(F.col("mu_id").alias("target_mu_id")), "target_mu_id", "left_semi")
    edges = staged(edges, "edges")
    gone = superseded(edges, before).withColumn("_gone", F.lit(True))
    units = new.join(gone, "mu_id", "left").withColumn("status", F.when(F.col("_gone"), "archived").otherwise("active")).drop("_gone")
    return staged(units, "units"), edges


def superseded(edges: DataFrame, units: DataFrame) -> DataFrame:
    """``mu_id`` of the units that a newer claim replaces, unless the guard holds it back."""
    return relations.guarded_supersessions(edges, units, GUARD).select(F.col("source_mu_id").alias("mu_id")).distinct()


def processed(memory: store.Memory, turns: DataFrame, now: Column, config: lifecycle.Lifecycle | None = None, idle_days: int = store.IDLE_DAYS, nli: relations.Inference | None = None) -> store.Memory:
    """The memory after a batch of messages: extracted, deduplicated, scored, inserted, resolved, and held to its capacity.

    New claims are compared with active units and labelled archived ones. A replaced unit that was active is archived; of one
    that was not, only the edge tells. Then the lifecycle evicts, and labels that nothing matched for ``idle_days`` decay.
    """
    config = config or lifecycle.Lifecycle()
    prior = memory.units.where("status = 'active' OR (status = 'archived' AND compressed_label_id IS NOT NULL)")
    order = Window.partitionBy("conversation_id").orderBy("created_at", "mu_id")
    prior = staged(prior.withColumn("seq", F.row_number().over(order)).select("conversation_id", "mu_id", "seq", "claim", "confidence", "status"), "prior")
    new, edges = bulk_ingest(turns, prior.drop("status"), nli)
    gone = superseded(edges, prior.unionByName(new.select("conversation_id", "mu_id", "seq", "claim", "confidence", "status"))).join(prior.where("status = 'active'"), "mu_id", "left_semi")
    changed = store.overlaid(memory.units, gone.select("mu_id", F.lit("archived").alias("status"), now.alias("updated_at")))
    facts = {"created_at": now, "updated_at": now, "retrieval_count": F.lit(0).cast("long"), "user_pinned": F.lit(False), "needs_reindex": F.lit(True), "entities": C.entities(F.col("claim")), "original_text": F.col("claim")}
    kinds = {f.name: f.dataType for f in memory.units.schema.fields}
    rows = new.withColumns(facts).withColumn("last_accessed", F.lit(None).cast("timestamp"))
    rows = salience.scored(rows, now)
    rows = rows.select([(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
    rows = rows.join(memory.units.select("mu_id"), "mu_id", "left_anti").select(memory.units.columns)  # a message may be read twice
    known = memory.edges.columns
    more = relations.new_edges(edges, memory.edges).select([(F.col(c) if c in edges.columns else F.lit(None)).cast(memory.edges.schema[c].dataType).alias(c) for c in known])
    after = memory._replace(units=staged(store.inserted(changed, rows), "units"), edges=staged(memory.edges.unionByName(more), "edges"))
    out = staged(lifecycle.evictions(after.units, now, config, after.edges), "evicted")
    after = store.compressed(after, out.where("destination = 'archived'"), now)
    after = store.forgotten(after._replace(units=staged(after.units, "units")), out.where("destination = 'forgotten'"), now)
    return store.staged_memory(store.decayed(after, now, idle_days))


def replay_ingest(turns: DataFrame) -> DataFrame:
    """``conversation_id, mu_id, turn_index, claim, outcome, superseded_by`` after following the messages one by one.

    Outcomes: ``active``, ``archived`` (superseded later), ``repeat`` (like one of its message) or ``known`` (like an
    active one).
    """
    claims = relations.described(message_claims(turns)).withColumn("_dedup", dedup_tokens(F.col("claim")))
    rows = claims.select("conversation_id", "mu_id", "turn_index", "seq", "claim", "confidence", "_tokens", "_dedup", "_topic", "_entities", "_neg", "_update", "_temporal")

    def fold(pdf):
        import pandas as pd

        def like(x, y):
            both = len(x | y)
            return len(x & y) / both if both else 0.0

        def relate(a, b):
            j = like(a["_tokens"], b["_tokens"])
            turned = b["_neg"] and not a["_neg"] and j >= relations.NEGATED
            same = a["_topic"] == b["_topic"] != "general"
            if turned:
                return "contradiction"
            if j >= relations.SAME:
                return "related" if not same else "updated_fact" if b["_update"] else "same_fact"
            if b["_update"] and same:
                return "updated_fact"
            if same and a["_topic"] in relations.EXCLUSIVE and j < relations.MOVED and a["_entities"] and b["_entities"] and not a["_entities"] & b["_entities"]:
                return "updated_fact"
            if b["_temporal"] and same:
                return "temporal_change"
            return "related" if same or j >= relations.RELATED else "unrelated"

        units = pdf.sort_values("seq").to_dict("records")
        active, message, at = [], [], None
        for u in units:
            u["_tokens"], u["_dedup"], u["_entities"] = set(u["_tokens"]), set(u["_dedup"]), {e.lower() for e in u["_entities"]}
            if u["turn_index"] != at:
                at, message = u["turn_index"], []
            if any(like(u["_dedup"], m["_dedup"]) >= BATCH_SAME for m in message):
                u["outcome"] = "repeat"
                continue
            message.append(u)
            found = [(a, relate(a, u)) for a in active]
            if any(like(a["_dedup"], u["_dedup"]) >= KNOWN_SAME or r == "same_fact" for a, r in found):
                u["outcome"] = "known"
                continue
            for a, r in found:
                if r in ("updated_fact", "temporal_change") and round(u["confidence"] + GUARD, 9) >= a["confidence"]:
                    a["outcome"], a["superseded_by"] = "archived", u["mu_id"]
            active = [a for a in active if a["outcome"] == "active"]
            u["outcome"] = "active"
            active.append(u)
        columns = ["conversation_id", "mu_id", "turn_index", "claim", "outcome", "superseded_by"]
        return pd.DataFrame([{c: u.get(c) for c in columns} for u in units], columns=columns)

    kind = dict(rows.dtypes)
    return rows.groupBy("conversation_id").applyInPandas(fold, f"conversation_id {kind['conversation_id']}, mu_id string, turn_index {kind['turn_index']}, claim string, outcome string, superseded_by string")


@dataclass(frozen=True)
class Retrieval:
    """What a search looks at: hits returned, the constant of the fusion, the depth of each lane (0 leaves it out)."""

    top_k: int = 5
    rrf_k: int = 60
    dense: int = 20
    bm25: int = 20
    label: int = 10
    forgotten: int = 20
    source: int = 20
    graph: bool = True
    pool: int = 50
    context: int = 2
    promote: bool = True

    def __post_init__(self):
        if self.top_k < 1 or self.rrf_k < 1 or min(self.dense, self.bm25, self.label, self.forgotten, self.source, self.context) < 0 or not (self.dense or self.bm25):
            raise ValueError("needs top_k and rrf_k of 1 or more, depths of 0 or more, and a dense or a bm25 lane")


class Asked(NamedTuple):
    """Answers with their evidence, the hits behind them, the access log of these, and the units they bring back."""

    answers: DataFrame
    hits: DataFrame
    accesses: DataFrame
    promotions: DataFrame


def labels_of(units: DataFrame) -> DataFrame:
    """The labels of archived units that carry one: ``mu_id, conversation_id, topic, short_summary, key_entities``."""
    c = F.col("claim")
    return units.where("status IN ('archived', 'compressed') AND compressed_label_id IS NOT NULL").select(
        "mu_id", "conversation_id", C.topic(c).alias("topic"), F.substring(c, 1, store.LABEL_CHARS).alias("short_summary"), F.array_sort(C.entities(c)).alias("key_entities")
    )


def _by_lane(asked: DataFrame, rows: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows (conversation_id, doc, ...) of several lanes in one table, and each query once a lane; a scope is a conversation of a lane."""
    scope = F.concat_ws("|", "lane", "conversation_id")  # names of lanes hold no bar
    every = reduce(DataFrame.unionByName, [r.withColumn("lane", F.lit(name)) for name, r in rows.items()])
    each = asked.withColumn("lane", F.explode(F.array(*map(F.lit, rows)))).withColumn("query", F.struct("lane", "query_id"))
    return every.withColumn("scope", scope), each.withColumn("scope", scope)


def _lanes(asked: DataFrame, units: DataFrame, turns: DataFrame | None, labels: DataFrame, config: Retrieval, vectors: DataFrame | None) -> dict[str, DataFrame]:
    depth = {"dense": config.dense, "bm25": config.bm25, "label": config.label, "forgotten": config.forgotten, "source": config.source if turns is not None else 0}
    claims = lambda status: units.where(F.col("status") == status).select("conversation_id", F.col("mu_id").alias("doc"), F.col("claim").alias("text"))
    named = labels.select("conversation_id", F.col("mu_id").alias("doc"), search.label_text().alias("text"))
    said = None if turns is None else turns.select("conversation_id", F.col("dia_id").alias("doc"), "text")
    lanes = {}
    if near := {n: r for n, r in {"dense": claims("active"), "label": named}.items() if depth[n]}:
        rows, each = _by_lane(asked, near)
        rows = search.embedded(rows, F.col("text"), vectors).select("scope", F.col("doc").alias("mu_id"), "vector")
        each = search.embedded(each, F.col("question"), vectors).select("scope", F.col("query").alias("query_id"), "vector")
        found = staged(search.dense_topk(each, rows, max(depth[n] for n in near), "scope"), "near")
        lanes |= {n: found.where((F.col("query_id.lane") == n) & (F.col("rank") <= depth[n])).select("query_id.query_id", "mu_id", "rank") for n in near}
    if words := {n: r for n, r in {"bm25": claims("active"), "forgotten": claims("forgotten"), "source": said}.items() if depth[n]}:
        rows, each = _by_lane(asked, words)
        found = staged(search.bm25_topk(rows, each, max(depth[n] for n in words), doc_id="doc", query_id="query", question="question", scope="scope"), "words")
        lanes |= {n: found.where((F.col("query.lane") == n) & (F.col("rank") <= depth[n])).select("query.query_id", F.col("doc").alias("mu_id"), "rank") for n in words}
    if "label" in lanes:
        lanes["label"] = fusion.label_lane(lanes["label"], units)
    if "source" in lanes:
        hits = lanes["source"].withColumnRenamed("mu_id", "dia_id").join(asked.select("query_id", "conversation_id"), "query_id")
        lanes["source"] = fusion.source_lane(hits, search.units_of_turns(units))
    return lanes


def retrieve(
    questions: DataFrame,
    units: DataFrame,
    edges: DataFrame,
    turns: DataFrame | None = None,
    k: int | Retrieval = 5,
    labels: DataFrame | None = None,
    archives: DataFrame | None = None,
    vectors: DataFrame | None = None,
    rerank: str | Callable[[list[str], list[str]], list[float]] | None = None,
) -> DataFrame:
    """Fused, hydrated, guarded and perhaps reranked hits of questions (query_id, conversation_id, question).

    ``query_id, rank, mu_id, conversation_id, rrf_score, sources, best_rank, claim, status, salience, confidence,
    source_dia_ids, is_from_label, label_summary, promoted``. Dense, keyword, label and forgotten lanes over units, a keyword
    lane over turns; neighbours of dense hits; turns that no unit quotes as hits of their own. A label's hit shows the
    archived claim. ``rerank``: ``"overlap"`` or a function over lists of questions and passages; where it fails the fused
    order stays. Hits of forgotten and labelled units are active again (``promoted``) unless the configuration says no.
    """
    config = k if isinstance(k, Retrieval) else Retrieval(top_k=k)
    units = _completed(units)
    labels = labels_of(units) if labels is None else labels
    asked = staged(questions.select("query_id", "conversation_id", "question"), "asked")
    lanes = _lanes(asked, units, turns, labels, config, vectors)
    fused = staged(fusion.rrf(lanes, k=config.rrf_k), "fused")
    if config.graph and "dense" in lanes:
        expanded = fusion.graph_lane(lanes["dense"], fused, edges, units)
        deepest = max(config.dense, config.bm25, config.label, config.forgotten, config.source) + 1
        fused = staged(fused.unionByName(expanded.withColumns({"sources": F.array(F.lit("graph")), "best_rank": F.lit(deepest)})), "expanded")
    transient = None
    if "source" in lanes:
        transient = staged(fusion.transient_units(fused.join(asked.select("query_id", "conversation_id"), "query_id"), turns), "transient")
    hits = fusion.hydrated(fused, units, max(config.pool, config.top_k) if rerank else config.top_k, transient=transient)
    hits = hits.join(labels.select("mu_id", F.col("short_summary").alias("label_summary")), "mu_id", "left")
    from_label = F.array_contains("sources", "label") & F.col("status").isin("archived", "compressed")
    hits = hits.withColumns({"is_from_label": from_label, "label_summary": F.when(from_label, F.col("label_summary"))})
    if archives is not None:
        hits = fusion.followed(hits, archives)
    hits = staged(fusion.fresh_only(hits, edges), "fresh")
    if rerank:
        hits = _reranked(asked, hits, units, edges, turns, transient, config, rerank)
    back = (F.col("status") == "forgotten") | F.col("is_from_label") if config.promote else F.lit(False)
    hits = hits.withColumn("promoted", back)
    columns = ["query_id", "rank", "mu_id", "conversation_id", "rrf_score", "sources", "best_rank", "claim", "status", "salience", "confidence", "source_dia_ids", "is_from_label", "label_summary", "promoted"]
    return hits.select(columns)


def _completed(units: DataFrame) -> DataFrame:
    """Units with the columns that retrieval reads; what lacks is null, and the salience 0.5."""
    kinds = {"salience": "double", "compressed_label_id": "string", "original_text": "string", "session_id": "string", "source_speaker": "string", "timestamp": "string"}
    return units.withColumns({c: F.lit(0.5 if c == "salience" else None).cast(kind) for c, kind in kinds.items() if c not in units.columns})


def _reranked(asked, hits, units, edges, turns, transient, config: Retrieval, rerank) -> DataFrame:
    facts = units.select("mu_id", "original_text", "session_id", "source_speaker", "timestamp")
    stale = edges.where("edge_type = 'superseded_by'").select(F.col("source_mu_id").alias("mu_id"), F.lit(True).alias("superseded")).distinct()
    told = hits.join(facts, "mu_id", "left").join(stale, "mu_id", "left").join(asked.select("query_id", "question"), "query_id").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
    if turns is None or not config.context:
        told = told.withColumn("context_text", F.lit(None).cast("string"))
    else:
        near = search.context_text(turns, config.context).select("conversation_id", F.col("dia_id").alias("_lead"), F.col("context").alias("context_text"))
        told = told.withColumn("_lead", F.array_min("source_dia_ids")).join(near, ["conversation_id", "_lead"], "left").drop("_lead")
    told = staged(told.withColumn("passage", fusion.candidate_text()), "passages")
    if callable(rerank):
        told = told.join(fusion.model_scores(told, rerank), ["query_id", "mu_id"])
    elif rerank == "overlap":
        told = told.withColumn("ce", fusion.overlap_score(F.col("question"), F.col("passage")))
    else:
        raise ValueError("rerank is overlap or a function")
    return fusion.reranked_or_fused(told, config.top_k)


def ask(questions: DataFrame, units: DataFrame, edges: DataFrame, turns: DataFrame | None = None, k: int | Retrieval = 5, answers: Callable[[DataFrame], DataFrame] | None = None, now: Column | None = None, **search_by) -> Asked:
    """Questions answered by the top claim, or by ``answers``, which gets prompts (id, prompt) and returns (id, content).

    Answers: ``query_id, answer, context, passed, grounding_score, warnings``; without any hit, or an answer of a model, the
    fixed text. ``search_by`` goes to :func:`retrieve`.
    """
    hits = staged(retrieve(questions, units, edges, turns, k, **search_by), "hits")
    meta = fusion.relation_meta(edges)
    facts = _completed(units).select("mu_id", "source_speaker", "session_id", "timestamp")
    shown = context.entries(hits.drop("status").join(meta, "mu_id", "left").join(facts, "mu_id", "left"))
    shown = staged(context.with_claims(context.with_claims(shown, units, "superseded_by"), units, "conflicts_with"), "shown")
    blocks = questions.select("query_id", "question").join(context.rendered(shown), "query_id", "left").withColumn("context", F.coalesce("context", F.lit(context.NOTHING)))
    if answers is None:
        best = hits.groupBy("query_id").agg(F.min_by("claim", "rank").alias("answer"))
    else:
        found = blocks.join(hits.select("query_id").distinct(), "query_id", "left_semi")  # no hits, no call
        best = answers(found.select(F.col("query_id").alias("id"), context.prompt(F.col("context"), F.col("question")).alias("prompt"))).select(F.col("id").alias("query_id"), F.col("content").alias("answer"))
    said = blocks.join(best, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NO_ANSWER)).alias("answer"), "context")
    said = staged(said, "said")
    guard = context.grounding(said.select("query_id", "answer"), context.evidence(shown)).select("query_id", "passed", "grounding_score", "warnings")
    moment = F.current_timestamp() if now is None else now
    return Asked(said.join(guard, "query_id"), hits, used(hits, moment), fusion.promotions(hits.where("promoted")))


def used(hits: DataFrame, now: Column) -> DataFrame:
    """The access log of hits (mu_id, ts), without turns that no unit quotes."""
    return hits.where(~F.col("mu_id").startswith("se_")).select("mu_id", now.alias("ts"))


def routed(messages: DataFrame, intent: Column) -> tuple[DataFrame, DataFrame]:
    """Questions and statements of a batch of messages."""
    return messages.where(intent == "question"), messages.where(intent == "statement")


def sessions(turns: DataFrame) -> DataFrame:
    """Turns with ``session_no`` from 1 in order of first appearance."""
    first = turns.groupBy("conversation_id", "session_id").agg(F.min("turn_index").alias("_first"))
    numbered = first.withColumn("session_no", F.row_number().over(Window.partitionBy("conversation_id").orderBy("_first")))
    return turns.join(numbered.drop("_first"), ["conversation_id", "session_id"])


def fast_ingest(turns: DataFrame) -> DataFrame:
    """Turns as claims at once, without extraction or comparison; importance is the salience of a fresh unit, 0.80."""
    return extraction.turn_claims(turns).withColumns({"importance": F.lit(0.80), "confidence": F.lit(0.9), "status": F.lit("active")})


def live_turns(messages: DataFrame) -> DataFrame:
    """Messages (conversation_id, session_id, turn_index, speaker, text) as turns, ready for chunking."""
    return messages.withColumns({"dia_id": F.concat(F.lit("D"), F.col("turn_index").cast("string")), "timestamp": F.lit("")})
