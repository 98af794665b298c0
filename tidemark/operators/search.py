"""Single-lane search: exact dense top-k and BM25, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.words import retrieval_tokens
from tidemark.operators.chunking import dot
from tidemark.sources.scratch import staged

# fixed values: the usual parameters of Okapi BM25
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Distinct query terms up to which they are broadcast; beyond it they are joined by a shuffle.
SMALL_VOCABULARY = 200_000


def unit_vector(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0)))


def hashed_vector(tokens: Column, dim: int = 64) -> Column:
    """A deterministic embedding: signed counts of tokens hashed by MD5, scaled to length 1."""
    digits = lambda t, at, n: F.conv(F.substring(F.md5(t.cast("binary")), at, n), 16, 10).cast("long")
    pairs = F.transform(tokens, lambda t: F.struct((digits(t, 1, 8) % dim).alias("slot"), F.when(digits(t, 9, 1) < 8, 1.0).otherwise(-1.0).alias("sign")))
    count = lambda held: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(held, F.lit(0.0), lambda s, p: s + F.when(p["slot"] == i, p["sign"]).otherwise(0.0)))
    # arrays of one, so that tokens are hashed and counted once
    return F.get(F.transform(F.transform(F.array(pairs), count), unit_vector), F.lit(0))


def embedded(rows: DataFrame, text: Column, known: DataFrame | None = None, dim: int = 64) -> DataFrame:
    """Rows with ``vector``: that of ``known`` (key, vector) for the text's key, else the hashed one.

    ``known`` is a cache or the output of a model; the key is the text's SHA-256.
    """
    hashed = hashed_vector(retrieval_tokens(text), dim)
    if known is None:
        return rows.withColumn("vector", hashed)
    vectors = known.select(F.col("key").alias("_key"), F.col("vector").alias("_vector"))
    joined = rows.withColumn("_key", F.sha2(text, 256)).join(vectors, "_key", "left")
    return joined.withColumn("vector", F.coalesce("_vector", hashed)).drop("_key", "_vector")


def label_text() -> Column:
    """What a compressed label is searched by."""
    return F.concat(F.coalesce("topic", F.lit("")), F.lit(": "), F.coalesce("short_summary", F.lit("")), F.lit(" entities: "), F.array_join(F.coalesce("key_entities", F.array().cast("array<string>")), ", "))


def dense_topk(queries: DataFrame, units: DataFrame, k: int, scope: str | None = "conversation_id") -> DataFrame:
    """``query_id, rank, mu_id, score``: largest inner products, exact, within the query's scope, ties to the smaller id.

    Queries: query_id, vector and the scope column; units: mu_id, vector and the scope column. A scope that no unit has
    gives no rows. Without a scope every query meets every unit: a stated set of queries against all rows.
    """
    q, u = queries.alias("q"), units.alias("u")
    on = (F.col(f"q.{scope}") == F.col(f"u.{scope}")) if scope else F.lit(True)
    scored = q.join(u, on).select("q.query_id", "u.mu_id", F.round(dot(F.col("q.vector"), F.col("u.vector")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "mu_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "mu_id", "score")


def _terms(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    return rows.select(*key, retrieval_tokens(F.col(text)).alias("_tokens"))


def bm25_scores(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", question: str = "text", scope: str | None = None) -> DataFrame:
    """``query_id, doc_id, score`` for every document that shares a term with the query.

    Statistics are those of all documents (of the scope). Idf may be negative; such values are replaced by a quarter of
    the mean idf over the vocabulary. Terms of a query count as often as it repeats them. Documents without tokens count
    in N; scopes in which none has tokens give no rows.
    """
    by = [scope] if scope else []
    read = staged(_terms(docs, [doc_id, *by], text).withColumn("_len", F.size("_tokens")), "tokens")  # read three times
    total = read.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"))
    df = read.select(*by, F.explode(F.array_distinct("_tokens")).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("_df"))
    # without a scope these are single rows and may be broadcast; with one they grow with it, and the planner decides
    with_facts = (lambda t, facts: t.join(facts, by)) if by else (lambda t, facts: t.crossJoin(F.broadcast(facts)))
    idf = with_facts(df, total).withColumn("_idf", F.log(F.col("_n") - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5))
    mean = idf.groupBy(*by).agg(F.avg("_idf").alias("_mean"))
    idf = with_facts(idf, mean).withColumn("_idf", F.when(F.col("_idf") < 0, EPSILON * F.col("_mean")).otherwise(F.col("_idf")))
    wanted = _terms(queries, [query_id, *by], question).select(query_id, *by, F.explode("_tokens").alias("term")).groupBy(query_id, *by, "term").agg(F.count("*").alias("_times"))
    vocabulary = wanted.select("term").distinct()
    if vocabulary.limit(SMALL_VOCABULARY + 1).count() <= SMALL_VOCABULARY:
        vocabulary = F.broadcast(vocabulary)
    weighed = wanted.join(idf.join(vocabulary, "term", "left_semi"), [*by, "term"])
    tf = read.select(doc_id, *by, "_len", F.explode("_tokens").alias("term")).join(vocabulary, "term").groupBy(doc_id, *by, "_len", "term").agg(F.count("*").alias("_tf"))
    hit = tf.join(weighed, [*by, "term"])
    part = F.col("_times") * F.col("_idf") * F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return hit.withColumn("_part", part).groupBy(query_id, doc_id).agg(F.round(F.sum("_part"), 6).alias("score"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, positive: bool = True, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", question: str = "text", scope: str | None = None) -> DataFrame:
    """``query_id, rank, doc_id, score``; with ``positive`` only scores above 0, else all documents of the scope are ranked."""
    if not positive and not scope:
        raise ValueError("ranking documents that share no word with the query needs a scope")
    scores = bm25_scores(docs, queries, doc_id, text, query_id, question, scope)
    if positive:
        scores = scores.where("score > 0")
    else:
        asked = _terms(queries, [query_id, scope], question).where(F.size("_tokens") > 0).drop("_tokens")
        pool = asked.join(docs.select(doc_id, scope), scope)
        scores = pool.select(query_id, doc_id).join(scores, [query_id, doc_id], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select(query_id, "rank", doc_id, "score")


def context_text(turns: DataFrame, window: int) -> DataFrame:
    """``conversation_id, dia_id, context``: ``speaker: text`` of the turn and its neighbours; the bare text for window 0."""
    if window <= 0:
        return turns.select("conversation_id", "dia_id", F.col("text").alias("context"))
    frame = Window.partitionBy("conversation_id").orderBy("turn_index").rowsBetween(-window, window)
    said = F.concat(F.col("speaker"), F.lit(": "), F.col("text"))
    return turns.select("conversation_id", "dia_id", F.array_join(F.collect_list(said).over(frame), " ").alias("context"))


def units_of_turns(units: DataFrame) -> DataFrame:
    """``conversation_id, dia_id, mu_ids``: which units quote a turn."""
    return units.select("conversation_id", "mu_id", F.explode("source_dia_ids").alias("dia_id")).groupBy("conversation_id", "dia_id").agg(F.array_sort(F.collect_set("mu_id")).alias("mu_ids"))
