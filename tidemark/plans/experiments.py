"""Whole evaluations: chunk or ingest, retrieve, answer, measure, report. ``python -m tidemark.plans.experiments FILE`` runs one."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import subprocess
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import chunking, evaluation, fusion, lifecycle, search, store
from tidemark.plans import engine
from tidemark.sources import dialogues, sinks
from tidemark.sources.scratch import staged


def _settings(path: str) -> dict:
    """The object in a JSON or YAML file, or what it has under ``experiment``."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml  # only where such a file is given

        raw = yaml.safe_load(text) or {}
    else:
        raw = json.loads(text)
    return raw.get("experiment", raw)


def _digest(config) -> str:
    return hashlib.sha256(json.dumps(dataclasses.asdict(config), sort_keys=True).encode()).hexdigest()[:12]


@dataclass(frozen=True)
class Experiment:
    """Retrieval over chunks."""

    strategy: str = "turn"
    top_k: int = 5
    window: int = 3
    context: int = 0
    retrieval: str = "bm25"

    @staticmethod
    def from_file(path: str) -> Experiment:
        """From JSON or YAML, flat or under ``experiment``; keys that no field has are ignored."""
        return Experiment(**{k: v for k, v in _settings(path).items() if k in Experiment.__dataclass_fields__})

    def digest(self) -> str:
        return _digest(self)


@dataclass(frozen=True)
class MemoryRun:
    """A run of the memory, as a tree of settings; unknown keys and values out of range are errors."""

    name: str = "memory"
    dataset: str = ""
    output: str = ""
    rerank: str | None = None
    fast: bool = False
    retrieval: engine.Retrieval = field(default_factory=engine.Retrieval)
    lifecycle: lifecycle.Lifecycle = field(default_factory=lifecycle.Lifecycle)

    def __post_init__(self):
        if not self.name:
            raise ValueError("a run needs a name")
        if self.rerank not in (None, "overlap"):
            raise ValueError(f"unknown rerank {self.rerank!r}")

    @staticmethod
    def of(raw: dict) -> MemoryRun:
        parts = {"retrieval": engine.Retrieval, "lifecycle": lifecycle.Lifecycle}
        for kind, given in [(MemoryRun, raw), *((parts[k], raw[k]) for k in parts if k in raw)]:
            if unknown := sorted(set(given) - set(kind.__dataclass_fields__)):
                raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return MemoryRun(**{k: parts[k](**v) if k in parts else v for k, v in raw.items()})

    @staticmethod
    def from_file(path: str) -> MemoryRun:
        return MemoryRun.of(_settings(path))

    def digest(self) -> str:
        return _digest(self)


class Run(NamedTuple):
    """What a run of the memory found."""

    predictions: DataFrame
    metrics: DataFrame
    by_category: DataFrame
    ingested: DataFrame


def code_version(folder: str = ".") -> str | None:
    """The commit that ``folder`` is at, if it is a git repository."""
    done = subprocess.run(["git", "-C", folder, "rev-parse", "--short=12", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() or None if done.returncode == 0 else None


def _judged(questions: DataFrame, found: DataFrame) -> DataFrame:
    """Questions with answer and retrieved turns (qa_id, predicted_answer, retrieved_dia_ids) and their metrics."""
    t = questions.join(found, "qa_id", "left").withColumns({"predicted_answer": F.coalesce("predicted_answer", F.lit("")), "retrieved_dia_ids": F.coalesce("retrieved_dia_ids", F.array().cast("array<string>"))})
    answer, gold = F.col("predicted_answer"), F.col("answer")
    return t.withColumns({
        "f1": evaluation.token_f1(answer, gold), "exact_match": evaluation.exact_match(answer, gold),
        "evidence_recall": evaluation.evidence_recall(F.col("gold_evidence_ids"), F.col("retrieved_dia_ids")),
    })


def _chunk_hits(chunks: DataFrame, asked: DataFrame, config: Experiment) -> DataFrame:
    """``query_id, rank, chunk_id`` by keywords, by vectors, or by both fused."""
    deep = config.top_k if config.retrieval != "hybrid" else max(3 * config.top_k, 20)
    lanes = {}
    if config.retrieval in ("bm25", "hybrid"):
        lanes["bm25"] = search.bm25_topk(chunks, asked, deep, doc_id="chunk_id", scope="conversation_id").select("query_id", F.col("chunk_id").alias("mu_id"), "rank")
    if config.retrieval in ("dense", "hybrid"):
        near = search.embedded(chunks, F.col("text")).select(F.col("chunk_id").alias("mu_id"), "conversation_id", "vector")
        lanes["dense"] = search.dense_topk(search.embedded(asked, F.col("text")).select("query_id", "conversation_id", "vector"), near, deep).select("query_id", "mu_id", "rank")
    if not lanes:
        raise ValueError(f"unknown retrieval {config.retrieval!r}")
    if len(lanes) == 1:
        return next(iter(lanes.values())).withColumnRenamed("mu_id", "chunk_id")
    return fusion.top(fusion.rrf({n: staged(r, n) for n, r in lanes.items()}), config.top_k).select("query_id", "rank", F.col("mu_id").alias("chunk_id"))


def chunk_retrieval(turns: DataFrame, questions: DataFrame, config: Experiment) -> DataFrame:
    """Predictions of retrieval over chunks; the best chunk is the answer."""
    chunks = chunking.build_chunks(turns, config.strategy, config.window, config.context)
    asked = questions.select(F.col("qa_id").alias("query_id"), "conversation_id", F.col("question").alias("text"))
    hits = _chunk_hits(chunks, asked, config).join(chunks.select("chunk_id", "dia_ids", "text"), "chunk_id")
    found = hits.groupBy(F.col("query_id").alias("qa_id")).agg(F.min_by("text", "rank").alias("predicted_answer"), F.array_distinct(F.flatten(F.collect_list("dia_ids"))).alias("retrieved_dia_ids"))
    return _judged(questions, found)


def _answered(questions: DataFrame, units: DataFrame, edges: DataFrame, turns: DataFrame, config: MemoryRun, answers: Callable[[DataFrame], DataFrame] | None, **tables) -> DataFrame:
    """Predictions with what the guard says: grounding_score, passed, and the number of units shown."""
    asked = questions.select(F.col("qa_id").alias("query_id"), "conversation_id", "question")
    told = engine.ask(asked, units, edges, turns, config.retrieval, answers, rerank=config.rerank, **tables)
    shown = told.hits.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("source_dia_ids"))).alias("retrieved_dia_ids"), F.count("*").alias("n_units"))
    found = told.answers.join(shown, "query_id", "left").select(
        F.col("query_id").alias("qa_id"), F.col("answer").alias("predicted_answer"), "retrieved_dia_ids", "grounding_score", "passed", F.coalesce("n_units", F.lit(0).cast("long")).alias("n_units"), F.lit(None).cast("double").alias("total_ms")
    )
    return _judged(questions, found)


def memory_retrieval(turns: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """Predictions of the memory: turns ingested in bulk, questions asked of the units."""
    units, edges = engine.bulk_ingest(turns)
    return _answered(questions, units, edges, turns, MemoryRun(retrieval=engine.Retrieval(top_k=k)), None)


def full_system(turns: DataFrame, questions: DataFrame, now: Column, config: MemoryRun | None = None, answers: Callable[[DataFrame], DataFrame] | None = None) -> Run:
    """All conversations through the whole memory: ingestion with capacity and decay, questions, metrics.

    ``fast`` takes turns as claims. ``ingested``: units of each status a conversation.
    """
    config = config or MemoryRun()
    spark = turns.sparkSession
    if config.fast:
        units = engine.fast_ingest(turns)
        memory = store.empty_memory(spark)._replace(units=staged(units, "fast"))
        edges = staged(spark.createDataFrame([], store.EDGE_SCHEMA), "edges")
    else:
        memory = engine.processed(store.empty_memory(spark), turns, now, config.lifecycle)
        edges = memory.edges
    tables = {} if config.fast else {"labels": memory.labels, "archives": memory.archives}
    predictions = staged(_answered(questions, memory.units, edges, turns, config, answers, **tables), "predictions")
    return Run(predictions, evaluation.memory_metrics(predictions), evaluation.memory_metrics(predictions, "category"), store.compression_stats(memory.units))


def report(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics of all predictions, and by category."""
    return evaluation.run_metrics(predictions), evaluation.run_metrics(predictions, "category")


def analysed(predictions: DataFrame, covered: DataFrame, folder: str) -> str:
    """Failures by type, coverage and missing turns, written as JSON, CSV and the Markdown that is returned.

    Predictions: query_id, conversation_id, category, question, gold, retrieved, deeper; ``covered`` (conversation_id, dia_id).
    """
    per_conversation = covered.groupBy("conversation_id").agg(F.collect_set("dia_id").alias("covered"))
    failed = staged(evaluation.failures(predictions.join(per_conversation, "conversation_id", "left")), "failed")
    coverage = staged(evaluation.coverage(predictions, covered), "coverage")
    lost = evaluation.missing(predictions, covered, 20)
    counts = {r["primary_type"]: r["n"] for r in failed.groupBy("primary_type").agg(F.count("*").alias("n")).collect()}  # one row a type
    rows = lambda df: [r.asDict() for r in df.collect()]
    text = sinks.analysis_report(counts, rows(coverage), rows(lost), rows(failed.orderBy("query_id").limit(sinks.REPORTED)))
    failed.write.mode("overwrite").json(f"{folder}/failures")
    sinks.flat_lists(coverage).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/coverage")
    sinks.flat_lists(failed).write.mode("overwrite").option("header", True).csv(f"{folder}/failures_csv")
    predictions.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report")
    return text


def main(path: str, spark: SparkSession | None = None) -> Run | None:
    """Runs the settings of a file over its dataset and writes all outputs; without questions, the record of an empty run."""
    config = MemoryRun.from_file(path)
    spark = spark or SparkSession.builder.getOrCreate()
    turns, questions = (staged(t, name) for t, name in zip(dialogues.load(spark, config.dataset), ("turns", "questions"), strict=True))
    if questions.isEmpty():
        sinks.empty_run(spark, config.name, "no questions").write.mode("overwrite").json(f"{config.output}/empty")
        return None
    run = full_system(turns, questions, F.current_timestamp(), config)
    sinks.write_run(run.predictions.withColumnRenamed("answer", "gold_answer"), run.metrics, run.by_category, config.output, name=config.name, digest=config.digest(), code=code_version())
    run.ingested.write.mode("overwrite").json(f"{config.output}/ingested")
    return run


if __name__ == "__main__":
    main(sys.argv[1])
