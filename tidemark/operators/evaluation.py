"""Metrics of answers and retrievals, and what went wrong where they are low."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.words import bounded, normal_answer, words

# fixed values
TEMPORAL_QUESTION = (
    r"when|before|after|since|during|how long|first time|last time|year|month|week|date|ago|recently|earliest|latest|order|sequence|timeline|chronolog|"
    r"which came first|who came first|prior to"
)


def token_f1(predicted: Column, gold: Column) -> Column:
    """Overlap of normalised words with multiplicity; 1 for two empty answers, 0 if one is empty; four places."""
    p, g = words(normal_answer(predicted)), words(normal_answer(gold))
    times = lambda all_, x: F.size(F.filter(all_, lambda y: y == x))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, x: s + F.least(times(p, x), times(g, x)))
    # 2 P R / (P + R) with P = common / |p| and R = common / |g|
    f1 = F.round(2 * common / (F.size(p) + F.size(g)), 4)
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(f1)


def exact_match(predicted: Column, gold: Column) -> Column:
    return normal_answer(predicted) == normal_answer(gold)


def token_f1_rows(rows: DataFrame, key: str, predicted: str, gold: str) -> DataFrame:
    """``key, f1, exact_match`` like the two above, for answers of any length: words are counted and joined, not searched."""
    read = rows.select(key, words(normal_answer(F.col(predicted))).alias("_p"), words(normal_answer(F.col(gold))).alias("_g"))
    counted = lambda c, n: read.select(key, F.explode(c).alias("_w")).groupBy(key, "_w").agg(F.count("*").alias(n))
    common = counted("_p", "_np").join(counted("_g", "_ng"), [key, "_w"]).groupBy(key).agg(F.sum(F.least("_np", "_ng")).alias("_c"))
    p, g = F.size("_p"), F.size("_g")
    f1 = F.when((p == 0) & (g == 0), 1.0).when((p == 0) | (g == 0), 0.0).otherwise(F.round(2 * F.coalesce("_c", F.lit(0)) / (p + g), 4))
    return read.join(common, key, "left").select(key, f1.alias("f1"), (F.col("_p") == F.col("_g")).alias("exact_match"))


def evidence_recall(gold: Column, retrieved: Column) -> Column:
    """Share of gold ids, repeats included, among the retrieved ones; null without gold."""
    found = F.size(F.filter(gold, lambda x: F.array_contains(retrieved, x)))
    return F.round(found / F.nullif(F.size(gold), F.lit(0)), 4)


def _at_place(rows: DataFrame, value: str, keys: tuple[str, ...], place: Callable[[Column], Column], name: str) -> DataFrame:
    """``keys, name``: the value at a place (of the count n) in ascending order.

    Counts by whole powers of two of the value's distance from 0 come first, at most some thousand a key; only the bucket
    that holds the place is looked into, by counts of its distinct values. So no task sees all values of a hot key.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    size = F.when(F.abs(F.col("_v").cast("double")) > 0, F.floor(F.log2(F.abs(F.col("_v").cast("double"))) * 8)).cast("int")
    bucket = F.when(F.col("_v") < 0, -(size + 10_000)).when(F.col("_v") == 0, F.lit(0)).otherwise(size + 10_000)
    marked = known.withColumn("_b", bucket)
    by = Window.partitionBy(*keys)
    counts = marked.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(by.orderBy("_b")).alias("_upto")
    found = counts.select(*keys, "_b", "_c", upto, F.sum("_c").over(by).alias("_n")).withColumn("_place", place(F.col("_n")))
    found = found.where((F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_c") < F.col("_place"))).select(*keys, "_b", (F.col("_place") - F.col("_upto") + F.col("_c")).alias("_place"))
    on = reduce(lambda x, y: x & y, [F.col(f"m.{k}").eqNullSafe(F.col(f"f.{k}")) for k in (*keys, "_b")])
    inside = marked.alias("m").join(found.alias("f"), on).select(*[F.col(f"m.{k}").alias(k) for k in keys], "m._v", "f._place")
    values = inside.groupBy(*keys, "_v", "_place").agg(F.count("*").alias("_c"))
    return values.withColumn("_upto", F.sum("_c").over(by.orderBy("_v"))).where(F.col("_upto") >= F.col("_place")).groupBy(*keys).agg(F.min("_v").alias(name))


def percentile(rows: DataFrame, value: str, p: float, *keys: str) -> DataFrame:
    """``keys, p<nn>``: the value at place max(1, floor(p n)) in ascending order, not interpolated."""
    return _at_place(rows, value, keys, lambda n: F.greatest(F.lit(1), F.floor(F.lit(p) * n)), f"p{round(p * 100)}")


def latency_percentiles(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """``keys, n, mean, p50, p95``."""
    mean = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"))
    out = mean
    for p in (0.50, 0.95):
        found = percentile(rows, value, p, *keys)
        out = out.join(found, list(keys)) if keys else out.crossJoin(F.broadcast(found))
    return out


def histogram_percentile(rows: DataFrame, value: str, p: float, *keys: str) -> DataFrame:
    """The other rule, of monitoring: the value at place floor(n p) + 1."""
    return _at_place(rows, value, keys, lambda n: F.least(n, F.floor(n * p) + 1), f"p{round(p * 100)}")


def run_metrics(predictions: DataFrame, *keys: str) -> DataFrame:
    """Averages over predictions (f1, exact_match, evidence_recall) with counts of zero and perfect recall."""
    avg = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    recall = F.col("evidence_recall")
    return predictions.groupBy(*keys).agg(
        F.count("*").alias("n"), avg("f1").alias("avg_f1"), avg(F.col("exact_match").cast("double")).alias("avg_em"), F.round(F.avg(recall), 4).alias("avg_recall"),
        F.count_if(recall == 0).alias("zero_recall"), F.count_if(recall == 1).alias("perfect_recall"),
    )


def lane_distribution(hits: DataFrame) -> DataFrame:
    """``lane, n`` over the sources of all hits."""
    return hits.select(F.explode("sources").alias("lane")).groupBy("lane").agg(F.count("*").alias("n"))


def duplicate_turns(retrieved: DataFrame) -> DataFrame:
    """Mean number of repeated dia_ids a question (query_id, retrieved_dia_ids as a list of lists)."""
    flat = F.flatten("retrieved_dia_ids")
    return retrieved.agg(F.round(F.avg(F.size(flat) - F.size(F.array_distinct(flat))), 4).alias("avg_duplicates"))


def session_density(hits: DataFrame) -> DataFrame:
    """Mean over questions of the largest share that one session has of the hits (query_id, session_id)."""
    counts = hits.groupBy("query_id", "session_id").agg(F.count("*").alias("n"))
    return counts.groupBy("query_id").agg((F.max("n") / F.sum("n")).alias("share")).agg(F.round(F.avg("share"), 4).alias("session_density"))


def recall_bucket(recall: Column) -> Column:
    return F.when(recall >= 1, "perfect").when(recall > 0, "partial").otherwise("zero")


def failures(rows: DataFrame) -> DataFrame:
    """Five flags and the primary type of each question that has gold and not perfect recall.

    Rows: query_id, conversation_id, question, category, gold, retrieved, deeper (retrieved at a greater depth, may be
    null), covered (turns any unit of the conversation quotes, null if unknown).
    """
    gold, got = F.array_distinct("gold"), F.col("retrieved")
    some = F.arrays_overlap(gold, got)
    every = F.size(F.array_except(gold, got)) == 0
    none = ~some
    flags = {
        "extraction_miss": none & F.col("covered").isNotNull() & ~F.coalesce(F.arrays_overlap(gold, F.col("covered")), F.lit(False)),
        "retrieval_miss": none & (F.col("covered").isNull() | F.coalesce(F.arrays_overlap(gold, F.col("covered")), F.lit(False))),
        "ranking_depth": none & F.coalesce(F.arrays_overlap(gold, F.col("deeper")), F.lit(False)),
        "provenance": some & ~every,
        "temporal": none & F.col("question").rlike(bounded(TEMPORAL_QUESTION)),
    }
    flagged = rows.where(F.size("gold") > 0).withColumn("bucket", recall_bucket(evidence_recall(F.col("gold"), got))).where("bucket <> 'perfect'").withColumns(flags)
    primary = F.lit("unknown")
    for name in ("temporal", "provenance", "retrieval_miss", "ranking_depth", "extraction_miss"):
        primary = F.when(F.col(name), name).otherwise(primary)
    return flagged.select("query_id", "conversation_id", "category", "bucket", *flags, primary.alias("primary_type"))


def coverage(gold: DataFrame, covered: DataFrame) -> DataFrame:
    """Per category, and for all (category null): gold turns and those that a unit quotes (conversation_id, dia_id)."""
    each = gold.select("conversation_id", "category", F.explode(F.array_distinct("gold")).alias("dia_id"))
    known = covered.select("conversation_id", "dia_id").distinct().withColumn("_known", F.lit(1))
    joined = each.join(known, ["conversation_id", "dia_id"], "left")
    return joined.rollup("category").agg(F.count("*").alias("n_gold"), F.count("_known").alias("n_covered"), F.round(F.count("_known") / F.count("*"), 4).alias("coverage"))


def missing(gold: DataFrame, covered: DataFrame, most: int = 50) -> DataFrame:
    """``category, conversation_id, dia_id``: the first gold turns that no unit quotes, in that order."""
    each = gold.select("query_id", "conversation_id", "category", F.explode(F.array_distinct("gold")).alias("dia_id"))
    known = covered.select("conversation_id", "dia_id").distinct()
    return each.join(known, ["conversation_id", "dia_id"], "left_anti").orderBy("category", "conversation_id", "dia_id", "query_id").limit(most).select("category", "conversation_id", "dia_id")


def top_index(hits: DataFrame, column: str = "dia_id", most: int = 10) -> DataFrame:
    """``qa_id, top<most>``: of each question the best hits (qa_id, rank), in order."""
    listed = hits.where(F.col("rank") <= most).groupBy("qa_id").agg(F.array_sort(F.collect_list(F.struct("rank", column))).alias("_h"))
    return listed.select("qa_id", F.col(f"_h.{column}").alias(f"top{most}"))


def memory_metrics(predictions: DataFrame, *keys: str) -> DataFrame:
    """Metrics of a run of the memory: those of answers, of grounding and guard, units a question, and latencies.

    Predictions: f1, exact_match, evidence_recall, grounding_score, passed, n_units, total_ms; only latencies above 0 count.
    """
    avg = lambda c, places=4: F.round(F.coalesce(F.avg(c), F.lit(0.0)), places)
    more = predictions.groupBy(*keys).agg(
        avg("grounding_score").alias("avg_grounding"), avg(F.col("passed").cast("double")).alias("guard_pass_rate"), avg("n_units", 2).alias("avg_units"),
        F.round(F.avg("total_ms"), 4).alias("mean_ms"),
    )
    answers, timed = run_metrics(predictions, *keys), latency_percentiles(predictions.where("total_ms > 0"), "total_ms", *keys).drop("n", "mean")
    if not keys:
        return answers.crossJoin(F.broadcast(more)).crossJoin(F.broadcast(timed))  # single rows
    return answers.join(more, list(keys)).join(timed, list(keys), "left")


def usage_metrics(predictions: DataFrame) -> DataFrame:
    """Mean tokens and retrieved chunks over predictions (input_tokens, output_tokens, n_chunks), rounded as in reports."""
    avg = lambda c, places: F.round(F.coalesce(F.avg(c), F.lit(0.0)), places)
    out = predictions.agg(F.count("*").alias("n"), avg("input_tokens", 1).alias("avg_input_tokens"), avg("output_tokens", 1).alias("avg_output_tokens"), avg("n_chunks", 2).alias("avg_chunks"))
    if "generation_ms" not in predictions.columns:
        return out
    timed = latency_percentiles(predictions.where("generation_ms > 0"), "generation_ms").select(F.col("mean").alias("mean_ms"), "p50", "p95")
    return out.crossJoin(F.broadcast(timed))  # single rows


def covered_turns(units: DataFrame) -> DataFrame:
    """``conversation_id, covered``: the turns that any unit of the conversation quotes."""
    return units.select("conversation_id", F.explode("source_dia_ids").alias("d")).groupBy("conversation_id").agg(F.array_sort(F.collect_set("d")).alias("covered"))
