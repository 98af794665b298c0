"""Dialogue datasets in JSON: any of three shapes, many key names, to flat turns and questions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = "sample_id string, conversation_id string, session_id string, turn_index int, dia_id string, speaker string, text string, timestamp string"
QUESTIONS = "qa_id string, conversation_id string, question string, answer string, category string, gold_evidence_ids array<string>"


def _first(item: dict, *keys: str, default=None):
    """The first value that is there and not empty; a number 0 counts as there."""
    return next((item[k] for k in keys if item.get(k) not in (None, "", [], {})), default)


def _items(raw) -> list[tuple[str | None, dict]]:
    if isinstance(raw, dict) and isinstance(raw.get("data"), list):
        raw = raw["data"]
    if isinstance(raw, list):
        return [(None, x) for x in raw]
    if isinstance(raw, dict):
        return [(str(k), v) for k, v in raw.items()]
    raise ValueError("a dataset is a list, an object with data, or an object of conversations")


def evidence_ids(raw) -> list[str]:
    """Ids of a string or list, split at semicolons, trimmed, without blanks."""
    listed = raw if isinstance(raw, list) else [raw] if raw else []
    return [p.strip() for x in listed for p in re.split(r";\s*", str(x)) if p.strip()]


def _turns(item: dict, conversation: str, sample: str) -> Iterator[tuple]:
    nested = _first(item, "conversation", "sessions", "dialogue", default=[])
    sessions: list[tuple[str, str, list, str | None]] = []
    if isinstance(nested, dict):
        numbered = sorted((int(m[1]), k) for k in nested if (m := re.fullmatch(r"session_(\d+)", k)))
        summaries = item.get("session_summary") or nested.get("session_summary") or {}
        for n, key in numbered:
            sessions.append((key, str(nested.get(f"{key}_date_time") or ""), nested[key] or [], summaries.get(key) or summaries.get(f"{key}_summary") or summaries.get(str(n))))
    else:
        for n, s in enumerate(nested):
            if isinstance(s, dict) and any(isinstance(s.get(k), list) for k in ("conversation", "turns", "messages", "dialogue")):
                said = _first(s, "conversation", "turns", "messages", "dialogue", default=[])
                sessions.append((str(_first(s, "session_id", "id", default=f"session_{n + 1}")), str(_first(s, "date_time", "timestamp", default="")), said, s.get("summary")))
            else:
                sessions.append(("session_1", "", nested, None))
                break
    at = 0
    for session, date, messages, summary in sessions:
        for m in messages:
            if not isinstance(m, dict):
                continue
            text = _first(m, "text", "content", "utterance", "message", default="")
            yield sample, conversation, session, at, str(_first(m, "dia_id", "id", "turn_id", default=f"{session}:{at}")), str(_first(m, "speaker", "role", "author", default="unknown")), str(text), str(_first(m, "timestamp", "time", default=date))
            at += 1
        if summary:
            yield sample, conversation, session, at, f"{session}_summary", "summary", str(summary), date
            at += 1


def _questions(item: dict, conversation: str) -> Iterator[tuple]:
    for i, q in enumerate(_first(item, "qa", "questions", "qa_pairs", default=[])):
        if not isinstance(q, dict) or not (question := str(_first(q, "question", "query", default="")).strip()):
            continue
        answer = _first(q, "answer", "adversarial_answer", "gold_answer", default="")
        answer = " ".join(map(str, answer)) if isinstance(answer, list) else str(answer)
        gold = evidence_ids(_first(q, "evidence", "evidence_ids", "gold_evidence_ids", default=[]))
        yield str(_first(q, "qa_id", "id", default=f"{conversation}_qa_{i}")), conversation, question, answer, str(_first(q, "category", "type", default="unknown")), gold


def _parsed(kind: str):
    def run(batches):
        import pandas as pd

        names = [x.split()[0] for x in re.split(r",\s*", TURNS if kind == "turns" else QUESTIONS)]
        for pdf in batches:
            rows = []
            for content in pdf["value"]:
                for i, (key, item) in enumerate(_items(json.loads(content))):
                    if not isinstance(item, dict):
                        continue  # one bad conversation doesn't stop the others
                    conversation = str(_first(item, "conversation_id", "conv_id", "id", "sample_id", default=key or f"conv_{i}"))
                    sample = str(_first(item, "sample_id", "id", default=conversation))
                    rows += _turns(item, conversation, sample) if kind == "turns" else _questions(item, conversation)
            yield pd.DataFrame(rows, columns=names)

    return run


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and questions of datasets, a row (value) each."""
    rows = files.select("value")
    return rows.mapInPandas(_parsed("turns"), TURNS), rows.mapInPandas(_parsed("questions"), QUESTIONS)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Turns and questions of all JSON files under ``path``; a missing path is an error when it is read."""
    return parsed(spark.read.text(path, wholetext=True))


def statistics(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """``category, n`` of the questions, with rows ``(conversations)`` and ``(turns)``."""
    n = lambda df, name, what: df.agg(what.alias("n")).select(F.lit(name).alias("category"), "n")
    return questions.groupBy("category").agg(F.count("*").alias("n")).unionByName(n(turns, "(conversations)", F.countDistinct("conversation_id"))).unionByName(n(turns, "(turns)", F.count("*")))


def synthetic(spark: SparkSession, conversations: int = 2, sessions: int = 2, turns: int = 4, questions: int = 3) -> tuple[DataFrame, DataFrame]:
    """A deterministic dataset of any size, made by expressions."""
    c = spark.range(conversations).select(F.concat(F.lit("conv_"), F.col("id").cast("string")).alias("conversation_id"))
    each = c.select("conversation_id", F.explode(F.sequence(F.lit(1), F.lit(sessions))).alias("s")).select("*", F.explode(F.sequence(F.lit(1), F.lit(turns))).alias("t"))
    said = each.select(
        F.col("conversation_id").alias("sample_id"), "conversation_id", F.format_string("session_%d", "s").alias("session_id"), ((F.col("s") - 1) * turns + F.col("t") - 1).cast("int").alias("turn_index"),
        F.format_string("D%d:%d", "s", "t").alias("dia_id"), F.when(F.col("t") % 2 == 1, "Ann").otherwise("Ben").alias("speaker"),
        F.format_string("This is turn %d of session %d.", "t", "s").alias("text"), F.format_string("%d May, 2023", "s").alias("timestamp"),
    )
    kinds = F.array(*map(F.lit, ("single_hop", "multi_hop", "temporal")))
    q = c.select("conversation_id", F.explode(F.sequence(F.lit(0), F.lit(questions - 1))).alias("q")) if questions else c.select("conversation_id", F.lit(0).alias("q")).limit(0)
    asked = q.select(
        F.concat("conversation_id", F.lit("_qa_"), F.col("q").cast("string")).alias("qa_id"), "conversation_id", F.format_string("What was said in turn %d?", F.col("q") % turns + 1).alias("question"),
        F.format_string("turn %d", F.col("q") % turns + 1).alias("answer"), F.get(kinds, (F.col("q") % 3).cast("int")).alias("category"), F.array(F.format_string("D1:%d", F.col("q") % turns + 1)).alias("gold_evidence_ids"),
    )
    return said, asked


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from JSON: an object a line, a bare list, or an object that lists them under ``predictions``."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    begins = first["value"].strip() if first else ""
    lines = begins.startswith("{") and begins.endswith("}") or begins.startswith("[") and begins.endswith("]")
    rows = spark.read.option("multiLine", not lines).json(path)
    return rows.select(F.explode("predictions").alias("p")).select("p.*") if rows.columns == ["predictions"] else rows
