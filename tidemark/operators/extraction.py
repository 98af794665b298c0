"""Chunks to facts: rule-based extraction, provenance, model payloads, turns as claims."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.claims import claim_confidence, importance, topic

# ---- fixed values ----------------------------------------------------------------------------------------------------
OPINION_PREFIX = r"(?i)^\s*(i\s+(think|feel|guess|hope|wish|wonder)|maybe|perhaps|probably)\s+"
SENTENCE_END = r"(?<=[.!?])\s+"
COMPOUND = r"(?i)\s+(?:and|but)\s+(?=i\s|my\s|we\s)"
CODE_FENCE = r"(?im)^```(?:json)?\s*|\s*```$"
MOST_FACTS, LEAST_CHARS, MOST_CHARS, SPEAKER_CHARS = 7, 10, 300, 80
# ----------------------------------------------------------------------------------------------------------------------

#: Our own words; no result depends on them.
EXTRACTION_RULES = (
    "List what the excerpt states about its speakers, as JSON {\"facts\": [{\"claim\", \"speaker\", \"source_dia_id\"}]}, at most %d of them, each a full sentence that can be read alone. "
    "Leave out questions, wishes and small talk.\n\nExcerpt:\n"
)


@dataclass(frozen=True)
class Extractor:
    """How facts are extracted; values out of range are errors."""

    most_facts: int = MOST_FACTS
    mode: str = "rules"
    confidence: float = 0.9
    fallback_confidence: float = 0.5

    def __post_init__(self):
        if self.mode not in ("rules", "model"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if not 1 <= self.most_facts <= 50:
            raise ValueError("most_facts must lie in 1 to 50")
        if not 0 <= self.fallback_confidence <= 1 or not 0 <= self.confidence <= 1:
            raise ValueError("confidences must lie in 0 to 1")

    def prompts(self, chunks: DataFrame) -> DataFrame:
        """``id, prompt`` of chunks, for a model."""
        return chunks.select(F.col("chunk_id").alias("id"), F.concat(F.lit(EXTRACTION_RULES % self.most_facts), F.col("text")).alias("prompt"))

    def facts(self, chunks: DataFrame, answers: DataFrame | None = None) -> DataFrame:
        """Facts of chunks, by a model's answers (id, content) if the mode asks for them, else by rules."""
        if self.mode == "model" and answers is None:
            raise ValueError("mode model needs answers")
        payloads = answers.select(F.col("id").alias("chunk_id"), F.col("content").alias("payload")) if self.mode == "model" else None
        return extract_facts(chunks, payloads, self.most_facts)


FACTS = "array<struct<claim:string,speaker:string,source_dia_id:string>>"


def rule_facts(chunks: DataFrame, most: int = MOST_FACTS) -> DataFrame:
    """``chunk_id, fact_no, claim, speaker`` by rules: lines, speaker prefix, sentences, clauses.

    Questions, opinions and fragments go, long claims are cut, repeats within a chunk count once, ``most`` stay.
    """
    text = F.col("text")
    body = F.when(text.startswith("[") & text.contains("\n"), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(text)
    said = chunks.where((F.size("dia_ids") > 0) | (F.size("speakers") > 0)).select("chunk_id", "speakers", F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    head = F.trim(F.substring_index("line", ":", 1))
    peels = F.col("line").contains(":") & (head != "") & (F.length(head) <= SPEAKER_CHARS)
    said = said.where(F.trim("line") != "").select(
        "chunk_id", "speakers", "line_no", F.when(peels, F.substring_index(head, " ", 1)).alias("named"),
        F.when(peels, F.trim(F.regexp_replace("line", r"^[^:]*:", ""))).otherwise(F.col("line")).alias("line"),
    )
    clauses = said.select("*", F.posexplode(F.split("line", SENTENCE_END)).alias("sentence_no", "sentence"))
    clauses = clauses.select("*", F.posexplode(F.split("sentence", COMPOUND)).alias("clause_no", "clause"))
    claim = F.regexp_replace(F.trim("clause"), r"\.+$", "")
    kept = clauses.withColumn("claim", claim).where((F.length("claim") >= LEAST_CHARS) & ~F.col("claim").endswith("?") & ~F.col("claim").rlike(OPINION_PREFIX))
    kept = kept.withColumn("claim", F.substring("claim", 1, MOST_CHARS)).withColumn("_key", F.regexp_replace(F.lower("claim"), r"\s+", " "))
    place = ["line_no", "sentence_no", "clause_no"]
    firsts = kept.withColumn("_n", F.row_number().over(Window.partitionBy("chunk_id", "_key").orderBy(*place))).where("_n = 1")
    numbered = firsts.withColumn("fact_no", F.row_number().over(Window.partitionBy("chunk_id").orderBy(*place)))
    return numbered.where(F.col("fact_no") <= most).select("chunk_id", "fact_no", "claim", F.when(F.array_contains("speakers", F.col("named")), F.col("named")).alias("speaker"))


def parse_facts(payload: Column) -> Column:
    """The facts of a model's JSON answer as an array; null where it can't be read. Items may be strings or objects."""
    bare = F.trim(F.regexp_replace(payload, CODE_FENCE, ""))
    items = F.from_json(F.get_json_object(bare, "$.facts"), "array<string>")
    as_object = lambda x: F.from_json(x, "struct<claim:string,speaker:string,source_dia_id:string>")
    fact = lambda x: F.when(x.startswith("{"), as_object(x)).otherwise(F.struct(x.alias("claim"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("source_dia_id")))
    return F.filter(F.transform(items, fact), lambda f: F.trim(f["claim"]) != "")


def with_provenance(facts: DataFrame) -> DataFrame:
    """Facts joined with their chunk's arrays, narrowed to the suggested turn if the chunk has it.

    Adds ``source_speaker, source_dia_ids, timestamp`` to rows with dia_ids, speakers, timestamps, speaker, source_dia_id.
    """
    at = F.coalesce(F.array_position("dia_ids", F.col("source_dia_id")), F.lit(0)).cast("int")
    here = at > 0
    everyone = F.array_join(F.array_distinct("speakers"), ", ")
    suggested = F.coalesce("speaker", F.lit(""))
    speaker = F.when(here, F.coalesce(F.get("speakers", at - 1), suggested)).when(F.array_contains("speakers", F.col("speaker")), F.col("speaker")).otherwise(everyone)
    stamp = F.when(here, F.get("timestamps", at - 1)).otherwise(F.get("timestamps", F.lit(0)))
    return facts.withColumns({
        "source_speaker": speaker,
        "source_dia_ids": F.when(here, F.array("source_dia_id")).otherwise(F.col("dia_ids")),
        "timestamp": F.nullif(stamp, F.lit("")),
    })


def extract_facts(chunks: DataFrame, payloads: DataFrame | None = None, most: int = MOST_FACTS) -> DataFrame:
    """Claims of all chunks with confidence, topic, importance and provenance.

    ``payloads`` (chunk_id, payload) are a model's answers; chunks without a readable one fall back to the rules.
    """
    rules = rule_facts(chunks, most).withColumn("source_dia_id", F.lit(None).cast("string"))
    if payloads is None:
        found = rules.withColumn("from_model", F.lit(False))
    else:
        read = payloads.select("chunk_id", parse_facts(F.col("payload")).alias("facts")).where("facts IS NOT NULL")
        listed = read.select("chunk_id", F.posexplode("facts").alias("fact_no", "fact")).select("chunk_id", (F.col("fact_no") + 1).alias("fact_no"), "fact.*")
        model = listed.where(F.col("fact_no") <= most).where(~F.trim("claim").endswith("?")).withColumn("from_model", F.lit(True))
        lost = rules.join(read.select("chunk_id"), "chunk_id", "left_anti").withColumn("from_model", F.lit(False))
        found = model.select(*lost.columns).unionByName(lost)
    joined = found.join(chunks.select("chunk_id", "conversation_id", "session_id", "dia_ids", "speakers", "timestamps"), "chunk_id")
    confidence = F.when(F.col("from_model"), claim_confidence(F.col("claim"), 0.9)).otherwise(claim_confidence(F.col("claim"), 0.5))
    out = with_provenance(joined).withColumns({"confidence": confidence, "topic": topic(F.col("claim")), "importance": importance(F.col("claim"))})
    return out.select("chunk_id", "conversation_id", "session_id", "fact_no", "claim", "confidence", "topic", "importance", "source_speaker", "source_dia_ids", "timestamp")


def turn_claims(turns: DataFrame, least: int = 3) -> DataFrame:
    """Each spoken turn as one claim ``speaker: text``."""
    text = F.trim("text")
    return turns.where((F.length(text) >= least) & ~F.lower("speaker").isin("summary", "system_summary")).select(
        F.substring(F.sha2(F.concat_ws("|", F.col("conversation_id"), "dia_id", text), 256), 1, 16).alias("mu_id"), "conversation_id", "session_id", "turn_index",
        F.concat(F.col("speaker"), F.lit(": "), text).alias("claim"), F.array("dia_id").alias("source_dia_ids"), F.col("speaker").alias("source_speaker"),
    )
