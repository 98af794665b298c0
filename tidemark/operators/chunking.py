"""Dialogue turns grouped into retrieval chunks. Turns: conversation_id, session_id, turn_index, dia_id, speaker, text, timestamp."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMMARIES = ["summary", "system_summary"]
CHUNK = ["chunk_id", "conversation_id", "session_id", "turn_index_start", "turn_index_end", "dia_ids", "speakers", "timestamps", "text", "chunk_strategy"]
COSINE = 0.65


def line() -> Column:
    """``[timestamp] speaker: text``; without a timestamp the brackets go."""
    said = F.concat(F.col("speaker"), F.lit(": "), F.col("text"))
    return F.when(F.coalesce("timestamp", F.lit("")) != "", F.concat(F.lit("["), F.col("timestamp"), F.lit("] "), said)).otherwise(said)


def header(dia_ids: Column) -> Column:
    return F.concat(F.lit("[Conversation: "), F.col("conversation_id"), F.lit(" | Session: "), F.col("session_id"), F.lit(" | Dialog IDs: "), F.array_join(dia_ids, ","), F.lit("]\n"))


def chunk_id(strategy: str, dia_ids: Column) -> Column:
    key = F.concat_ws("|", F.col("conversation_id"), F.lit(strategy), F.array_join(dia_ids, "_"))
    return F.concat(F.col("conversation_id"), F.lit(f"__{strategy}__"), F.substring(F.sha1(key.cast("binary")), 1, 8))


def _is_summary() -> Column:
    return F.lower("speaker").isin(SUMMARIES)


def _finished(df: DataFrame, strategy: str, dia_ids: Column) -> DataFrame:
    """Named chunks; of equal ids the first stays."""
    named = df.withColumns({"chunk_id": chunk_id(strategy, dia_ids), "chunk_strategy": F.lit(strategy)})
    first = Window.partitionBy("chunk_id").orderBy("turn_index_start", "turn_index_end", "text")
    return named.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(CHUNK)


def _single(turns: DataFrame, text: Column, strategy: str) -> DataFrame:
    one = turns.select(
        "conversation_id", "session_id", F.col("turn_index").alias("turn_index_start"), F.col("turn_index").alias("turn_index_end"),
        F.array("dia_id").alias("dia_ids"), F.array("speaker").alias("speakers"), F.array("timestamp").alias("timestamps"), text.alias("text"),
    )
    return _finished(one, strategy, F.col("dia_ids"))


def turn_chunks(turns: DataFrame, context: int = 0) -> DataFrame:
    """One chunk for each turn that is no summary, with ``context`` turns before and after it in its text."""
    spoken = turns.where(~_is_summary())
    here = header(F.array("dia_id"))
    if context <= 0:
        return _single(spoken, F.concat(here, line()), "turn")
    order = Window.partitionBy("conversation_id").orderBy("turn_index")
    near = lambda tag, a, b: F.transform(F.collect_list(line()).over(order.rowsBetween(a, b)), lambda x: F.concat(F.lit(f"[{tag}] "), x))
    text = F.concat(here, F.array_join(F.concat(near("Prior", -context, -1), F.array(line()), near("Next", 1, context)), "\n"))
    return _single(spoken.withColumn("_text", text), F.col("_text"), "turn")


def window_chunks(turns: DataFrame, size: int = 3) -> DataFrame:
    """A window of ``size`` turns from each turn on; the last ones are shorter."""
    size = size if size >= 1 else 3
    frame = Window.partitionBy("conversation_id").orderBy("turn_index").rowsBetween(0, size - 1)
    rows = turns.where(~_is_summary()).select(
        "conversation_id", "session_id", F.col("turn_index").alias("turn_index_start"), F.max("turn_index").over(frame).alias("turn_index_end"),
        F.collect_list("dia_id").over(frame).alias("dia_ids"), F.array_distinct(F.collect_list("speaker").over(frame)).alias("speakers"),
        F.collect_list("timestamp").over(frame).alias("timestamps"), F.collect_list(line()).over(frame).alias("_lines"),
    )
    text = F.concat(header(F.col("dia_ids")), F.array_join("_lines", "\n"))
    return _finished(rows.withColumn("text", text), f"window{size}", F.col("dia_ids"))


def summary_chunks(turns: DataFrame) -> DataFrame:
    """One chunk for each summary turn."""
    return _single(turns.where(_is_summary()), F.concat(header(F.array("dia_id")), line()), "session_summary")


def build_chunks(turns: DataFrame, strategy: str, window: int = 3, context: int = 0) -> DataFrame:
    """Chunks by strategy ``turn``, ``window3`` or ``session_summary``."""
    if strategy == "turn":
        return turn_chunks(turns, context)
    if strategy == "window3":
        return window_chunks(turns, window)
    if strategy == "session_summary":
        return summary_chunks(turns)
    raise ValueError(f"unknown strategy {strategy!r}")


@dataclass(frozen=True)
class Semantic:
    """How turns are grouped by meaning; values out of range are errors."""

    threshold: float = COSINE
    mode: str = "previous"
    most: int | None = None
    least: int = 1
    text_chars: int | None = None

    def __post_init__(self):
        if self.mode not in ("previous", "centroid"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if not -1 <= self.threshold <= 1:
            raise ValueError("threshold must lie in [-1, 1]")
        if self.least < 1 or (self.most is not None and self.most < self.least):
            raise ValueError("1 <= least <= most")
        if self.text_chars is not None and self.text_chars < 1:
            raise ValueError("text_chars must be at least 1")

    def breaks(self, turns: DataFrame, key: str = "conversation_id", order: str = "turn_index") -> DataFrame:
        """``key, order, chunk_no`` of turns with a vector."""
        if self.mode == "previous":
            return semantic_breaks(turns, self.threshold, key=key, order=order).select(key, order, "chunk_no")
        return centroid_breaks(turns, self.threshold, self.most, self.least, key, order)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic_breaks(turns: DataFrame, threshold: float = COSINE, vector: str = "vector", key: str = "conversation_id", order: str = "turn_index") -> DataFrame:
    """``turns`` with ``chunk_no`` from 0: a new chunk starts where the cosine to the turn before falls below the threshold."""
    if not -1 <= threshold <= 1:
        raise ValueError("threshold must lie in [-1, 1]")
    w = Window.partitionBy(key).orderBy(order)
    apart = F.lag(vector).over(w).isNotNull() & (F.round(dot(F.lag(vector).over(w), F.col(vector)), 9) < threshold)
    marked = turns.withColumn("_break", apart.cast("int"))
    return marked.withColumn("chunk_no", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def semantic_chunks(turns: DataFrame, threshold: float = COSINE) -> DataFrame:
    """Chunks between semantic breaks; lines are ``speaker [timestamp]: text``, ids ``conversation#semantic#first-last``."""
    stamp = F.when(F.coalesce("timestamp", F.lit("")) != "", F.concat(F.lit(" ["), F.col("timestamp"), F.lit("]"))).otherwise("")
    said = F.concat(F.col("speaker"), stamp, F.lit(": "), F.col("text"))
    broken = semantic_breaks(turns, threshold)
    turn = F.struct("turn_index", "dia_id", "speaker", "timestamp", said.alias("line"), "session_id")
    grouped = broken.groupBy("conversation_id", "chunk_no").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    first, last = F.col("t.turn_index")[0], F.element_at("t.turn_index", -1)
    return grouped.select(
        F.concat(F.col("conversation_id"), F.lit("#semantic#"), first.cast("string"), F.lit("-"), last.cast("string")).alias("chunk_id"), "conversation_id",
        F.col("t.session_id")[0].alias("session_id"), first.alias("turn_index_start"), last.alias("turn_index_end"), F.col("t.dia_id").alias("dia_ids"),
        F.array_distinct("t.speaker").alias("speakers"), F.col("t.timestamp").alias("timestamps"), F.array_join("t.line", "\n").alias("text"), F.lit("semantic").alias("chunk_strategy"),
    )


def centroid_breaks(turns: DataFrame, threshold: float = COSINE, most: int | None = None, least: int = 1, key: str = "conversation_id", order: str = "turn_index") -> DataFrame:
    """``key, order, chunk_no``: each turn against the normalised mean of its chunk so far, which only a fold can follow.

    A chunk of ``most`` turns ends; one of fewer than ``least`` goes on.
    """
    if not -1 <= threshold <= 1 or least < 1 or (most is not None and most < least):
        raise ValueError("threshold in [-1, 1], 1 <= least <= most")
    kinds = dict(turns.dtypes)

    def fold(pdf):
        import numpy as np

        pdf = pdf.sort_values(order)
        numbers, total, held, at = [], None, 0, 0
        for v in pdf["vector"]:
            v = np.asarray(v, dtype=float)
            if total is not None:
                norm = np.linalg.norm(total)
                near = float(total @ v / norm) if norm else 0.0
                if most is not None and held >= most or (near < threshold and held >= least):
                    at, total, held = at + 1, None, 0
            total = v if total is None else total + v
            held += 1
            numbers.append(at)
        return pdf[[key, order]].assign(chunk_no=numbers)

    return turns.select(key, order, "vector").groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, chunk_no long")
