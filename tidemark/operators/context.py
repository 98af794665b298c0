"""Evidence blocks for questions, and the check that answers rest on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.words import retrieval_tokens

# ---- fixed values: section order and headings, markers, prompts ------------------------------------------------------
SECTIONS = {
    "active": "ACTIVE MEMORIES (use these first)",
    "restored": "RESTORED FROM COMPRESSED (label match — full data retrieved)",
    "superseded": "HISTORICAL CONTEXT (superseded, kept for reference)",
    "conflicted": "CONFLICTING (treat with caution)",
}
NOTHING = "(No memory evidence retrieved for this query.)"
LOST = "(fact no longer available)"
REFUSAL = r"(?i)no\s+information\s+available"
UNCERTAIN = [
    "uncertain", "unclear", "conflict", "contradiction", "contradictory", "both", "however", "but", "may", "might", "not sure", "not clear",
    "conflicting", "disagree", "inconsistent",
]
#: Our own words; no result depends on them.
ANSWER_RULES = (
    "Below are excerpts of a conversation that ran over several days, and one question about it. Reply in as few words as the answer takes, from the excerpts alone and "
    'without their numbers. Where they do not tell, the whole reply is "No information available."\n\nExcerpts:\n'
)
NO_EVIDENCE = "[No evidence retrieved]"
MOST_ENTRIES, LEAST_GROUNDING = 10, 0.3
# ----------------------------------------------------------------------------------------------------------------------


def section() -> Column:
    """Of a hit with is_from_label, superseded_by, conflicts_with."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(F.col("is_from_label"), "restored").when(some("superseded_by"), "superseded").when(some("conflicts_with"), "conflicted").otherwise("active")


def entries(hits: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """The first ``most`` hits of each query with their section; the entry number is the rank."""
    return hits.where(F.col("rank") <= most).withColumn("section", section())


def source_info() -> Column:
    part = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.col(c)))
    return F.concat_ws(" | ", part("Speaker", "source_speaker"), part("Session", "session_id"), part("Date", "timestamp"), F.concat(F.lit("Confidence: "), F.format_string("%.2f", F.col("confidence"))))


def with_claims(rows: DataFrame, units: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_claims``: claims of the listed units in order, with a note for those that are gone."""
    claims = units.select(F.col("mu_id").alias("_id"), F.col("claim").alias("_claim"))
    listed = rows.select("query_id", "mu_id", F.posexplode(column).alias("_at", "_id")).join(claims, "_id", "left")
    texts = listed.groupBy("query_id", "mu_id").agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_claim", F.lit(LOST)).alias("c")))).alias("_l"))
    return rows.join(texts.select("query_id", "mu_id", F.col("_l.c").alias(f"{column}_claims")), ["query_id", "mu_id"], "left")


def rendered(shown: DataFrame) -> DataFrame:
    """``query_id, context``: sections in order, each entry with its source line.

    Rows: entries with claim, the columns of :func:`source_info`, label_summary, superseded_by_claims, conflicts_with_claims.
    """
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    extra = (
        F.when((F.col("section") == "superseded") & some("superseded_by_claims"), F.concat(F.lit("\n    SUPERSEDED BY: "), F.array_join("superseded_by_claims", "; ")))
        .when((F.col("section") == "conflicted") & some("conflicts_with_claims"), F.concat(F.lit("\n    CONFLICTS WITH: "), F.array_join("conflicts_with_claims", "; ")))
        .when((F.col("section") == "restored") & (F.coalesce("label_summary", F.lit("")) != ""), F.concat(F.lit('\n    Label matched: "'), F.col("label_summary"), F.lit('"')))
        .otherwise("")
    )
    text = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("claim"), F.lit("\n    "), source_info(), extra)
    by_section = shown.withColumn("_text", text).groupBy("query_id", "section").agg(F.array_sort(F.collect_list(F.struct("rank", "_text"))).alias("_e"))
    names = list(SECTIONS)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("section"))
    heading = F.element_at(F.array(*[F.lit(SECTIONS[n]) for n in names]), place.cast("int"))
    block = F.concat(heading, F.lit(":\n"), F.array_join("_e._text", "\n"))
    return by_section.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), block.alias("b")))).alias("_b")).select("query_id", F.array_join("_b.b", "\n\n").alias("context"))


def evidence(shown: DataFrame) -> DataFrame:
    """``query_id, n_entries, has_conflicted, evidence_tokens`` of the entries' claims and label summaries."""
    words = F.flatten(F.collect_list(F.concat(retrieval_tokens(F.col("claim")), retrieval_tokens(F.coalesce("label_summary", F.lit(""))))))
    return shown.groupBy("query_id").agg(F.count("*").alias("n_entries"), F.bool_or(F.col("section") == "conflicted").alias("has_conflicted"), F.array_sort(F.array_distinct(words)).alias("evidence_tokens"))


def grounding(answers: DataFrame, found: DataFrame, least: float = LEAST_GROUNDING) -> DataFrame:
    """``query_id, passed, grounding_score, is_no_info, n_answer, n_overlap, warnings`` of each answer (query_id, answer).

    A refusal passes, with a warning where there was evidence; an answer without evidence fails; any other passes if
    enough of its distinct words occur in the evidence. Unacknowledged conflicts only warn.
    """
    t = answers.join(found, "query_id", "left").withColumns({"_n": F.coalesce("n_entries", F.lit(0)), "_a": F.trim(F.coalesce("answer", F.lit("")))})
    refuses = (F.col("_a") == "") | F.col("_a").rlike(REFUSAL)
    mine = F.array_distinct(retrieval_tokens(F.col("_a")))
    common = F.size(F.array_intersect(mine, F.coalesce("evidence_tokens", F.array().cast("array<string>"))))
    score = F.when(refuses, 1.0).when(F.col("_n") == 0, 0.0).otherwise(F.round(common / F.greatest(F.size(mine), F.lit(1)), 6))
    unsure = F.lit(False)
    for marker in UNCERTAIN:
        unsure = unsure | F.lower("_a").contains(marker)
    warn = lambda rule, text: F.when(rule, F.lit(text))
    warnings = F.array_compact(F.array(
        warn(refuses & (F.col("_n") > 0), "refusal despite evidence"), warn(~refuses & (F.col("_n") == 0), "no evidence"),
        warn(~refuses & (F.col("_n") > 0) & (score < least), "low grounding"), warn(~refuses & (F.col("_n") > 0) & F.coalesce("has_conflicted", F.lit(False)) & ~unsure, "conflict not acknowledged"),
    ))
    counted = ~refuses & (F.col("_n") > 0)
    return t.select(
        "query_id", (refuses | ((F.col("_n") > 0) & (score >= least))).alias("passed"), score.alias("grounding_score"), refuses.alias("is_no_info"),
        F.when(refuses, 0).otherwise(F.size(mine)).alias("n_answer"), F.when(counted, common).otherwise(0).alias("n_overlap"), warnings.alias("warnings"),
    )


def checked_batch(answers: DataFrame, found: DataFrame, least: float = LEAST_GROUNDING) -> DataFrame:
    """As :func:`grounding`, for answers and evidence of the same questions; raises where one lacks the other."""
    lost = answers.select("query_id").join(found.select("query_id"), "query_id", "left_anti").unionByName(found.select("query_id").join(answers.select("query_id"), "query_id", "left_anti"))
    if bad := lost.limit(1).collect():
        raise ValueError(f"answers and evidence differ: {bad[0]['query_id']}")
    return grounding(answers, found, least)


def debug_prompt(evidence: Column, question: Column) -> Column:
    """The evidence and the question alone, for a look at what a model would see."""
    return F.concat(F.lit("Evidence:\n"), F.coalesce(evidence, F.lit(NO_EVIDENCE)), F.lit("\n\nQuestion: "), question)


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.coalesce(context, F.lit(NOTHING)), F.lit("\n\nQuestion:\n"), question, F.lit("\n\nAnswer:"))


def evidence_prompt(chunks: DataFrame) -> DataFrame:
    """``query_id, evidence``: ``[Evidence i]`` blocks of retrieved chunks (query_id, rank, text)."""
    block = F.concat(F.lit("[Evidence "), F.col("rank").cast("string"), F.lit("]\n"), F.col("text"))
    return chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("_e")).select("query_id", F.array_join("_e.b", "\n\n").alias("evidence"))


def answer_prompt(evidence: Column, question: Column) -> Column:
    return F.concat(F.lit(ANSWER_RULES), F.coalesce(evidence, F.lit(NO_EVIDENCE)), F.lit("\n\nQuestion:\n"), question, F.lit("\n\nAnswer:"))
