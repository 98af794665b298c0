"""Results written as JSON, CSV and Markdown."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import scratch

__all__ = ["scratch", "uuid"]
LOW_F1, CELL_CHARS, REPORTED, CHUNK_CHARS = 0.3, 200, 10, 400


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(path)


def write_retrieval_debug(predictions: DataFrame, path: str) -> None:
    """The columns that show what was retrieved."""
    wanted = ("qa_id", "conversation_id", "question", "gold_answer", "gold_evidence_ids", "retrieved_chunks", "retrieved_dia_ids", "evidence_recall")
    predictions.select([c for c in wanted if c in predictions.columns]).write.mode("overwrite").json(path)


def write_category_csv(metrics: DataFrame, path: str) -> None:
    metrics.orderBy("category").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def failure_cases(predictions: DataFrame, answered_only: bool = False) -> DataFrame:
    """Predictions of low F1 with their texts cut for a cell."""
    low = predictions.where(F.col("f1") < LOW_F1)
    if answered_only:
        low = low.where(F.coalesce("predicted_answer", F.lit("")) != "")
    cut = [F.substring(c, 1, CELL_CHARS).alias(c) if c in ("question", "gold_answer", "predicted_answer") else F.col(c) for c in low.columns]
    return flat_lists(low.select(cut))


def flat_lists(rows: DataFrame) -> DataFrame:
    """Lists of strings joined by ``|``, for CSV."""
    return rows.select([F.array_join(c, "|").alias(c) if t == "array<string>" else F.col(c) for c, t in rows.dtypes])


def write_failures_csv(predictions: DataFrame, path: str, answered_only: bool = False) -> None:
    failure_cases(predictions, answered_only).write.mode("overwrite").option("header", True).csv(path)


def failure_report(predictions: DataFrame) -> str:
    """Markdown of the first failures, by qa_id."""
    rows = predictions.where(F.col("f1") < LOW_F1).orderBy("qa_id").limit(REPORTED).collect()
    out = ["# Failure cases", ""]
    for r in rows:
        out += [f"## {r['qa_id']}", "", f"- Question: {r['question']}", f"- Gold: {r['gold_answer']}", f"- Answer: {r['predicted_answer']}", f"- F1: {r['f1']}"]
        if "top_chunk" in predictions.columns:
            out.append(f"- Top chunk: {(r['top_chunk'] or '')[:CHUNK_CHARS]}")
        out.append("")
    return "\n".join(out) if rows else "# Failure cases\n\nNone.\n"


def compared_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Metrics of several runs as rows of one table."""
    tables = [m.withColumn("run", F.lit(name)) for name, m in runs.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_comparison_csv(runs: dict[str, DataFrame], path: str) -> None:
    """One row a run."""
    compared_runs(runs).orderBy("run").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(metrics: DataFrame, path: str, **facts) -> None:
    """The one row of a run's metrics as JSON, with facts such as the configuration's digest."""
    row = metrics.first()
    text = json.dumps((row.asDict(recursive=True) if row else {}) | facts, sort_keys=True, default=str)
    metrics.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_run(predictions: DataFrame, metrics: DataFrame, by_category: DataFrame, folder: str, **facts) -> None:
    """All outputs of a run of the memory: predictions and metrics as JSON, categories and answered failures as CSV."""
    write_predictions(predictions, f"{folder}/predictions")
    write_metrics(metrics, f"{folder}/metrics", **facts)
    write_category_csv(flat_lists(by_category), f"{folder}/categories")
    write_failures_csv(predictions, f"{folder}/failures", answered_only=True)


def analysis_report(counts: dict[str, int], coverage: list[dict], missing: list[dict], cases: list[dict]) -> str:
    """Markdown of an analysis: failures by type, coverage by category, missing turns, and some cases."""
    out = ["# Analysis", "", "| Failure | Questions |", "|---|---|", *[f"| {k} | {n} |" for k, n in sorted(counts.items())], "", "| Category | Gold turns | Covered |", "|---|---|---|"]
    out += [f"| {c['category'] or 'all'} | {c['n_gold']} | {c['n_covered']} |" for c in coverage]
    out += ["", "Missing: " + (", ".join(f"{m['conversation_id']}/{m['dia_id']}" for m in missing) or "none"), ""]
    return "\n".join(out + [f"- {c['query_id']}: {c['primary_type']} ({c['bucket']})" for c in cases]) + "\n"


def empty_run(spark, name: str, reason: str) -> DataFrame:
    """The record of a run that had nothing to evaluate."""
    return spark.createDataFrame([(name, 0, reason)], "experiment string, n long, reason string")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """An index is its table of vectors (mu_id, conversation_id, vector)."""
    vectors.write.mode("overwrite").parquet(path)


def retained(folder: str, newest: int = 10) -> list[str]:
    """Names of snapshots (sub-folders, named by time) beyond the newest; the caller removes them."""
    return sorted((p.name for p in Path(folder).iterdir() if p.is_dir()), reverse=True)[newest:]
