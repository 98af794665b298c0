"""The library's queries over plain tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import claims as C
from tidemark.functions import safety as S
from tidemark.functions import words as W
from tidemark.operators import chunking, context, evaluation, extraction, fusion, graph, lifecycle, monitoring, relations, salience, search, store
from tidemark.plans import engine, experiments
from tidemark.plans import fixtures as X
from tidemark.plans import sql as Q
from tidemark.sources import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return T.turns(T.read(spark, d, "conversations"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    return T.event_units(T.read(spark, d, "events"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Each event of a user linked from the one before it."""
    i = F.col("event_id")
    kind = F.when(i % 4 == 0, "superseded_by").when(i % 4 == 1, "conflicts_with").otherwise("related_to")
    rows = T.read(spark, d, "events").select(F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("source_mu_id"), i.alias("target_mu_id"), kind.alias("edge_type"))
    return rows.where("source_mu_id IS NOT NULL")


def _vectors(spark: SparkSession, d: str, part=None) -> DataFrame:
    v = F.col("embedding") if part is None else F.slice("embedding", *part)
    return T.read(spark, d, "embeddings").select(F.col("vec_id").alias("mu_id"), F.col("label").alias("conversation_id"), v.alias("vector"))


def _lane(spark: SparkSession, d: str, k: int, part=None) -> DataFrame:
    v = _vectors(spark, d, part)
    asked = v.where("mu_id % 50 = 0").select(F.col("mu_id").alias("query_id"), "conversation_id", "vector")
    return search.dense_topk(asked, v, k)


def _lane_sql(k: int, part: str = "") -> str:
    v = f"embedding{part}"
    return f"""(SELECT * FROM (SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({Q.dot('q.v', 'u.v')}, 6) DESC, u.vec_id) AS rank,
      u.vec_id AS mu_id, round({Q.dot('q.v', 'u.v')}, 6) AS score
      FROM (SELECT *, {v} AS v FROM embeddings WHERE vec_id % 50 = 0) q JOIN (SELECT *, {v} AS v FROM embeddings) u ON q.label = u.label) WHERE rank <= {k})"""


# ---- search and fusion -----------------------------------------------------------------------------------------------
@query(f"""WITH {Q.bm25('documents', '(SELECT item_id AS query_id, text FROM benchmark)')},
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 5""")
def bm25_topk(spark, d):
    asked = T.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25_topk(T.read(spark, d, "documents").select("doc_id", "text"), asked, 5)


def _every_turn(spark, d):
    """All turns as documents, and as questions."""
    t = _turns(spark, d)
    return t.select("conversation_id", F.col("turn_index").alias("doc_id"), "text"), t.select("conversation_id", F.concat_ws(":", "conversation_id", F.col("turn_index").cast("string")).alias("query_id"), "text")


_SCOPED = Q.bm25(f"(SELECT conversation_id, turn_index AS doc_id, text FROM {Q.turns()})", f"(SELECT conversation_id, conversation_id || ':' || turn_index AS query_id, text FROM {Q.turns()})", "conversation_id")


@query(f"""WITH {_SCOPED},
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 3""")
def bm25_by_conversation(spark, d):
    docs, asked = _every_turn(spark, d)
    return search.bm25_topk(docs, asked, 3, scope="conversation_id")


@query(f"""WITH {_SCOPED},
p AS (SELECT q.query_id, d.doc_id FROM q JOIN d USING (conversation_id) WHERE len(q.w) > 0),
z AS (SELECT p.query_id, p.doc_id, coalesce(score, 0) AS score FROM p LEFT JOIN s USING (query_id, doc_id)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM z)
SELECT * FROM r WHERE rank <= 10""")
def bm25_all_ranked(spark, d):
    docs, asked = _every_turn(spark, d)
    return search.bm25_topk(docs, asked, 10, positive=False, scope="conversation_id")


@query(f"SELECT query_id, CAST(rank AS INTEGER) AS rank, mu_id, score FROM {_lane_sql(10)}")
def dense_topk(spark, d):
    return _lane(spark, d, 10)


_FUSED = f"""l AS (SELECT *, 'left' AS lane FROM {_lane_sql(20, '[1:32]')} UNION ALL SELECT *, 'right' FROM {_lane_sql(20, '[33:64]')}),
f AS (SELECT query_id, mu_id, round(sum(1.0 / (CAST(60 AS DOUBLE) + rank)), 9) AS rrf_score, list_sort(list(DISTINCT lane)) AS sources, CAST(min(rank) AS INTEGER) AS best_rank FROM l GROUP BY ALL)"""


def _fused(spark, d):
    return fusion.rrf({"left": _lane(spark, d, 20, (1, 32)), "right": _lane(spark, d, 20, (33, 32))})


@query(f"""WITH {_FUSED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, mu_id) AS INTEGER) AS rank FROM f)
SELECT * FROM r WHERE rank <= 10""")
def rrf_hybrid(spark, d):
    return fusion.top(_fused(spark, d), 10)


@query(f"""WITH {_FUSED}, u AS (SELECT unnest(sources) AS lane FROM f) SELECT lane, count(*) AS n FROM u GROUP BY lane""")
def lane_distribution(spark, d):
    return evaluation.lane_distribution(_fused(spark, d))


def _vector_edges(spark, d):
    return T.read(spark, d, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("source_mu_id"), (F.col("vec_id") + 10).alias("target_mu_id"), F.lit("superseded_by").alias("edge_type"))


@query(f"""WITH h AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, mu_id, score FROM {_lane_sql(10)})
SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.query_id = h.query_id AND h.mu_id % 3 = 0 AND o.mu_id = h.mu_id + 10)""")
def freshness_guard(spark, d):
    return fusion.fresh_only(_lane(spark, d, 10), _vector_edges(spark, d))


@query(f"""WITH {_FUSED},
h AS (SELECT *, CAST(mu_id % 7 AS DOUBLE) AS ce, CAST(mu_id % 10 AS DOUBLE) / 10 AS salience, CAST(mu_id % 5 AS DOUBLE) / 5 AS confidence, mu_id % 3 = 0 AS superseded, 'D' || (mu_id % 4) AS lead FROM f),
w AS (SELECT *, (ce - min(ce) OVER p) / CASE WHEN max(ce) OVER p = min(ce) OVER p THEN 1 ELSE max(ce) OVER p - min(ce) OVER p END AS c, max(rrf_score) OVER p AS top FROM h WINDOW p AS (PARTITION BY query_id)),
s AS (SELECT query_id, mu_id, lead, round(3.0 * c + rrf_score / CAST(top AS DOUBLE) + CAST(0.02 AS DOUBLE) * salience + CAST(0.01 AS DOUBLE) * confidence - CASE WHEN superseded THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 9) AS final_score FROM w),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id, lead ORDER BY final_score DESC, mu_id) > 2 AS spare FROM s),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY spare, final_score DESC, mu_id) AS INTEGER) AS rank FROM x)
SELECT query_id, mu_id, round(final_score, 6) AS final_score, rank FROM r WHERE rank <= 5""")
def ce_rerank_diversity(spark, d):
    m = F.col("mu_id")
    hits = _fused(spark, d).withColumns({
        "ce": (m % 7).cast("double"), "salience": (m % 10) / 10.0, "confidence": (m % 5) / 5.0, "superseded": m % 3 == 0, "source_dia_ids": F.array(F.concat(F.lit("D"), (m % 4).cast("string"))),
    })
    return fusion.reranked(hits, 5).select("query_id", "mu_id", F.round("final_score", 6).alias("final_score"), "rank")


@query(f"""WITH e AS {Q.event_edges()}, b AS (SELECT source_mu_id AS mu_id, target_mu_id AS other, edge_type FROM e UNION ALL SELECT target_mu_id, source_mu_id, edge_type FROM e WHERE edge_type <> 'superseded_by')
SELECT mu_id, coalesce(list_sort(list(DISTINCT other) FILTER (edge_type = 'superseded_by')), []) AS superseded_by, coalesce(list_sort(list(DISTINCT other) FILTER (edge_type = 'conflicts_with')), []) AS conflicts_with,
  coalesce(list_sort(list(DISTINCT other) FILTER (edge_type = 'related_to')), []) AS related_to FROM b GROUP BY mu_id""")
def relation_meta(spark, d):
    return fusion.relation_meta(_edges(spark, d))


@query(f"""WITH h AS (SELECT query_id, mu_id, score FROM {_lane_sql(10)} JOIN embeddings ON vec_id = mu_id WHERE mu_id % 4 <> 0),
e AS (SELECT vec_id AS a, vec_id + 10 AS b FROM embeddings WHERE vec_id % 3 = 0), s AS (SELECT a AS seed, b AS other FROM e UNION SELECT b, a FROM e),
n AS (SELECT query_id, other AS mu_id, round(CAST(0.8 AS DOUBLE) * max(score), 9) AS score FROM h JOIN s ON seed = h.mu_id JOIN embeddings u ON u.vec_id = other JOIN embeddings v ON v.vec_id = h.mu_id
  WHERE other % 4 <> 0 AND u.label = v.label AND NOT EXISTS (SELECT 1 FROM h o WHERE o.query_id = h.query_id AND o.mu_id = other) GROUP BY ALL),
x AS (SELECT *, 'dense' AS source FROM h UNION ALL SELECT *, 'graph' FROM n), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mu_id) AS INTEGER) AS rank FROM x)
SELECT query_id, rank, mu_id, round(score, 6) AS score, source FROM r WHERE rank <= 8""")
def dense_with_neighbours(spark, d):
    units = _vectors(spark, d).select("mu_id", "conversation_id", F.when(F.col("mu_id") % 4 != 0, "active").otherwise("archived").alias("status"))
    return fusion.expanded_topk(_lane(spark, d, 10), _vector_edges(spark, d), units, 8).withColumn("score", F.round("score", 6))


@query(f"SELECT conversation_id, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'compressed') AS compressed, count(*) FILTER (status = 'archived') AS archived, count(*) FILTER (status = 'forgotten') AS forgotten, count(*) AS total FROM {Q.event_units()} GROUP BY 1")
def compression_stats(spark, d):
    return store.compression_stats(_units(spark, d))


@query(f"SELECT edge_type, count(*) AS n FROM {Q.event_edges()} GROUP BY 1")
def edge_counts(spark, d):
    return graph.edge_counts(_edges(spark, d))


# ---- chunks ----------------------------------------------------------------------------------------------------------
_SPOKEN = f"(SELECT * FROM {Q.turns()} WHERE lower(speaker) NOT IN ('summary', 'system_summary'))"
_CHUNK_ID = "conversation_id || '__{s}__' || substr(sha1(conversation_id || '|{s}|' || array_to_string(dia_ids, '_')), 1, 8)"


@query(f"""WITH t AS {_SPOKEN}, l AS (SELECT *, speaker || ': ' || text AS line FROM t),
x AS (SELECT *, [dia_id] AS dia_ids, lag(line) OVER w AS p1, lead(line) OVER w AS n1 FROM l WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_index))
SELECT {_CHUNK_ID.format(s='turn')} AS chunk_id, conversation_id, turn_index AS turn_index_start,
  '[Conversation: ' || conversation_id || ' | Session: ' || session_id || ' | Dialog IDs: ' || dia_id || ']' || chr(10) || coalesce('[Prior] ' || p1 || chr(10), '') || line || coalesce(chr(10) || '[Next] ' || n1, '') AS text FROM x""")
def chunk_turn_context(spark, d):
    return chunking.turn_chunks(_turns(spark, d), 1).select("chunk_id", "conversation_id", "turn_index_start", "text")


@query(f"""WITH t AS {_SPOKEN},
x AS (SELECT *, list(dia_id) OVER w AS dia_ids, list(speaker) OVER w AS s, list(speaker || ': ' || text) OVER w AS lines, max(turn_index) OVER w AS turn_index_end FROM t
  WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT {_CHUNK_ID.format(s='window3')} AS chunk_id, turn_index AS turn_index_start, turn_index_end, dia_ids, len(list_distinct(s)) AS n_speakers,
  '[Conversation: ' || conversation_id || ' | Session: ' || session_id || ' | Dialog IDs: ' || array_to_string(dia_ids, ',') || ']' || chr(10) || array_to_string(lines, chr(10)) AS text FROM x""")
def chunk_window3(spark, d):
    return chunking.window_chunks(_turns(spark, d)).select("chunk_id", "turn_index_start", "turn_index_end", "dia_ids", F.size("speakers").cast("long").alias("n_speakers"), "text")


@query(f"""WITH b AS (SELECT label, vec_id, coalesce(round({Q.dot('lag(embedding) OVER w', 'embedding')}, 9) < 0.65, false) AS brk FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, vec_id, CAST(sum(CAST(brk AS INTEGER)) OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS chunk_no FROM b""")
def chunk_semantic_lag(spark, d):
    v = T.read(spark, d, "embeddings")
    return chunking.semantic_breaks(v, vector="embedding", key="label", order="vec_id").select("label", "vec_id", "chunk_no")


@query(f"""WITH RECURSIVE v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
r AS (SELECT label, vec_id, i, x AS total, 1 AS held, CAST(0 AS BIGINT) AS chunk_no FROM v WHERE i = 1
  UNION ALL SELECT label, vec_id, i, CASE WHEN brk THEN x ELSE list_transform(list_zip(total, x), lambda p: p[1] + p[2]) END, CASE WHEN brk THEN 1 ELSE held + 1 END, chunk_no + CASE WHEN brk THEN 1 ELSE 0 END
  FROM (SELECT v.*, r.total, r.held, r.chunk_no, r.held >= 12 OR (r.held >= 2 AND list_inner_product(r.total, v.x) / sqrt(list_inner_product(r.total, r.total)) < 0.2) AS brk
    FROM r JOIN v ON v.label = r.label AND v.i = r.i + 1))
SELECT label, vec_id, chunk_no FROM r""")
def semantic_centroid(spark, d):
    v = T.read(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("vector"))
    return chunking.centroid_breaks(v, 0.2, most=12, least=2, key="label", order="vec_id")


# ---- claims ----------------------------------------------------------------------------------------------------------
_TEXTS = f"(SELECT mu_id AS id, claim FROM {X.claims_sql()} UNION ALL SELECT conv_id || ':' || turn, text FROM conversations)"


def _texts(spark, d):
    conv = T.read(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("claim"))
    return X.claims(spark).select(F.col("mu_id").alias("id"), "claim").unionByName(conv)


_SUB = Q.candidate("claim")


@query(f"""WITH s AS (SELECT id, {', '.join(f'{v} AS {k}' for k, v in _SUB.items())} FROM {_TEXTS})
SELECT id, {', '.join(f'round({k}, 6) AS {k}' for k in _SUB)}, round({' + '.join(f'CAST({w} AS DOUBLE) * "{k}"' for k, w in C.WEIGHTS.items())}, 5) AS score FROM s""")
def candidate_score(spark, d):
    sub = C.candidate_scores(F.col("claim"))
    return _texts(spark, d).select("id", *[F.round(sub[k], 6).alias(k) for k in C.WEIGHTS], F.round(sub["score"], 5).alias("score"))


@query(f"SELECT id, {Q.topic('claim')} AS topic, {Q.importance('claim')} AS importance, {Q.matches('claim', C.NEGATION_RE)} AS negated, {Q.matches('claim', C.UPDATE_RE)} AS updates, {Q.matches('claim', C.TEMPORAL_RE)} AS temporal FROM {_TEXTS}")
def topic_importance(spark, d):
    c = F.col("claim")
    return _texts(spark, d).select("id", C.topic(c).alias("topic"), C.importance(c).alias("importance"), C.has_negation(c).alias("negated"), C.has_update_verb(c).alias("updates"), C.is_temporal_claim(c).alias("temporal"))


@query(f"SELECT id, {Q.speculative('claim')} AS speculative, CASE WHEN {Q.speculative('claim')} THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence FROM {_TEXTS}")
def hedge_confidence(spark, d):
    c = F.col("claim")
    return _texts(spark, d).select("id", C.is_speculative(c).alias("speculative"), C.claim_confidence(c).alias("confidence"))


@query(f"SELECT id, list_sort({Q.entities('claim')}) AS entities FROM {_TEXTS}")
def claim_entities(spark, d):
    return _texts(spark, d).select("id", F.array_sort(C.entities(F.col("claim"))).alias("entities"))


@query(f"""WITH t AS (SELECT conv_id, turn, {Q.claim_tokens('text', W.DEDUP_STOP)} AS w FROM conversations)
SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, round({Q.jaccard('a.w', 'b.w')}, 6) AS jaccard FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn""")
def claim_jaccard(spark, d):
    t = T.read(spark, d, "conversations").select("conv_id", "turn", W.dedup_tokens(F.col("text")).alias("w"))
    pairs = t.alias("a").join(t.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") < F.col("b.turn")))
    return pairs.select("a.conv_id", F.col("a.turn").alias("turn_a"), F.col("b.turn").alias("turn_b"), F.round(W.jaccard(F.col("a.w"), F.col("b.w")), 6).alias("jaccard"))


@query(f"""SELECT conversation_id, turn_index, substr(sha256(conversation_id || '|' || dia_id || '|' || trim(text)), 1, 16) AS mu_id, speaker || ': ' || trim(text) AS claim
FROM {Q.turns()} WHERE length(trim(text)) >= 3 AND lower(speaker) NOT IN ('summary', 'system_summary')""")
def turn_claims(spark, d):
    return extraction.turn_claims(_turns(spark, d)).select("conversation_id", "turn_index", "mu_id", "claim")


_SEP = "chr(31)"


@query(f"""WITH t AS {_SPOKEN},
x AS (SELECT *, list(dia_id) OVER w AS dia_ids, list(speaker) OVER w AS s, list(speaker || ': ' || text) OVER w AS lines FROM t WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
c AS (SELECT {_CHUNK_ID.format(s='window3')} AS chunk_id, list_filter(s, lambda v, i: list_position(s, v) = i) AS speakers, string_split(array_to_string(lines, chr(10)), chr(10)) AS body FROM x),
l AS (SELECT chunk_id, speakers, unnest(range(len(body))) AS line_no, unnest(body) AS line FROM c),
h AS (SELECT *, trim(split_part(line, ':', 1)) AS head FROM l WHERE trim(line) <> ''),
p AS (SELECT chunk_id, speakers, line_no, CASE WHEN peels THEN split_part(head, ' ', 1) END AS named, CASE WHEN peels THEN trim(substr(line, instr(line, ':') + 1)) ELSE line END AS line
  FROM (SELECT *, contains(line, ':') AND head <> '' AND length(head) <= 80 AS peels FROM h)),
s AS (SELECT *, unnest(range(len(z))) AS sentence_no, unnest(z) AS sentence FROM (SELECT *, string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || {_SEP}, 'g'), {_SEP}) AS z FROM p)),
k AS (SELECT *, unnest(range(len(y))) AS clause_no, unnest(y) AS clause FROM (SELECT *, string_split(regexp_replace(sentence, '(?i)\\s+(?:and|but)\\s+(i\\s|my\\s|we\\s)', {_SEP} || '\\1', 'g'), {_SEP}) AS y FROM s)),
f AS (SELECT chunk_id, speakers, named, line_no, sentence_no, clause_no, substr(claim, 1, 300) AS claim FROM (SELECT *, regexp_replace(trim(clause), '\\.+$', '') AS claim FROM k)
  WHERE length(claim) >= 10 AND NOT ends_with(claim, '?') AND NOT regexp_matches(claim, {X.quoted(extraction.OPINION_PREFIX)})),
u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY chunk_id, regexp_replace(lower(claim), '\\s+', ' ', 'g') ORDER BY line_no, sentence_no, clause_no) = 1),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY line_no, sentence_no, clause_no) AS INTEGER) AS fact_no FROM u)
SELECT chunk_id, fact_no, claim, CASE WHEN {Q.speculative('claim')} THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence, {Q.topic('claim')} AS topic, {Q.importance('claim')} AS importance,
  CASE WHEN list_contains(speakers, named) THEN named ELSE array_to_string(speakers, ', ') END AS source_speaker FROM n WHERE fact_no <= 7""")
def heuristic_facts(spark, d):
    return extraction.extract_facts(chunking.window_chunks(_turns(spark, d))).select("chunk_id", "fact_no", "claim", "confidence", "topic", "importance", "source_speaker")


# ---- relations -------------------------------------------------------------------------------------------------------
def _rel(said: str) -> str:
    return f"""d AS (SELECT *, {Q.claim_tokens('claim')} AS w, {Q.topic('claim')} AS topic, list_transform({Q.entities('claim')}, lambda x: lower(x)) AS ents, {Q.matches('claim', C.NEGATION_RE)} AS neg,
  {Q.matches('claim', C.UPDATE_RE)} AS upd, {Q.matches('claim', C.TEMPORAL_RE)} AS tmp FROM {said}),
p AS (SELECT a.conversation_id, a.mu_id AS mu_a_id, b.mu_id AS mu_b_id, {Q.jaccard('a.w', 'b.w')} AS j, a.topic AS ta, a.topic = b.topic AND a.topic <> 'general' AS same, b.upd, b.tmp, b.neg, b.neg AND NOT a.neg AS turn,
  len(a.ents) > 0 AND len(b.ents) > 0 AND len(list_intersect(a.ents, b.ents)) = 0 AS apart FROM d a JOIN d b ON a.conversation_id = b.conversation_id AND a.seq < b.seq),
n AS (SELECT *, CASE WHEN turn AND j >= 0.25 THEN CAST(0.85 AS DOUBLE) WHEN j >= 0.6 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS con,
  CASE WHEN turn AND j >= 0.25 THEN CAST(0.05 AS DOUBLE) WHEN j >= 0.6 THEN round(0.75 + CAST(0.2 AS DOUBLE) * j, 4) ELSE CAST(0.1 AS DOUBLE) END AS ent FROM p),
k AS (SELECT *, CASE WHEN con >= 0.7 AND neg AND j >= 0.25 THEN 1 WHEN ent >= 0.7 AND NOT same THEN 2 WHEN ent >= 0.7 AND upd THEN 3 WHEN ent >= 0.7 THEN 4 WHEN upd AND same THEN 5
  WHEN same AND ta IN ('employment', 'location', 'relationships') AND j < 0.3 AND apart THEN 6 WHEN tmp AND same THEN 7 WHEN same OR j >= 0.1 THEN 8 ELSE 9 END AS rule FROM n),
c AS (SELECT conversation_id, mu_a_id, mu_b_id, ['contradiction', 'related', 'updated_fact', 'same_fact', 'updated_fact', 'updated_fact', 'temporal_change', 'related', 'unrelated'][rule] AS relationship,
  round(CASE rule WHEN 1 THEN con WHEN 2 THEN ent * 0.5 WHEN 3 THEN ent WHEN 4 THEN ent WHEN 5 THEN 0.75 WHEN 6 THEN CAST(0.68 AS DOUBLE) WHEN 7 THEN 0.7 WHEN 8 THEN greatest(j, CASE WHEN same THEN CAST(0.3 AS DOUBLE) ELSE 0 END) ELSE greatest(0, 1 - j) END, 6) AS confidence FROM k)"""


_REL_EDGES = """e AS (SELECT conversation_id, mu_a_id AS source_mu_id, mu_b_id AS target_mu_id, 'superseded_by' AS edge_type, confidence AS weight FROM c WHERE relationship IN ('same_fact', 'updated_fact', 'temporal_change')
  UNION ALL SELECT conversation_id, mu_a_id, mu_b_id, 'conflicts_with', confidence FROM c WHERE relationship = 'contradiction' UNION ALL SELECT conversation_id, mu_b_id, mu_a_id, 'conflicts_with', confidence FROM c WHERE relationship = 'contradiction'
  UNION ALL SELECT conversation_id, mu_a_id, mu_b_id, 'related_to', confidence FROM c WHERE relationship = 'related')"""


_SAID = f"""(SELECT * FROM {X.claims_sql()} UNION ALL SELECT CAST(conv_id AS VARCHAR) || ':' || turn, CAST(conv_id AS VARCHAR), turn, text,
  CASE WHEN {Q.speculative('text')} THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END FROM conversations)"""
_SAID_REL = _rel(_SAID)


def _said(spark, d):
    """All turns of ``conversations`` as claims, and the sentences of the fixture."""
    turns = _turns(spark, d).select(
        F.concat_ws(":", "conversation_id", F.col("turn_index").cast("string")).alias("mu_id"), "conversation_id", F.col("turn_index").alias("seq"), F.col("text").alias("claim"),
        C.claim_confidence(F.col("text")).alias("confidence"),
    )
    return X.claims(spark).unionByName(turns)


def _said_edges(spark, d):
    return relations.new_edges(relations.edges_for(relations.scan_conversations(_said(spark, d))))


@query(f"WITH {_SAID_REL} SELECT * FROM c")
def pairwise_relationships(spark, d):
    return relations.scan_conversations(_said(spark, d))


@query(f"WITH {_SAID_REL}, {_REL_EDGES} SELECT * FROM e")
def resolver_edges(spark, d):
    return _said_edges(spark, d).drop("metadata_json")


@query(f"""WITH {_SAID_REL} SELECT conversation_id, count(*) FILTER (relationship = 'contradiction') AS conflicts, count(*) FILTER (relationship IN ('same_fact', 'updated_fact', 'temporal_change')) AS updates,
count(*) FILTER (relationship = 'related') AS related, CAST(sum(CASE relationship WHEN 'contradiction' THEN 2 WHEN 'unrelated' THEN 0 ELSE 1 END) AS BIGINT) AS edges_created FROM c GROUP BY 1""")
def resolver_counters(spark, d):
    return relations.counters(relations.scan_conversations(_said(spark, d)))


@query(f"""WITH {_SAID_REL}, {_REL_EDGES}, u AS {_SAID} SELECT source_mu_id, target_mu_id, s.confidence AS source_confidence, t.confidence AS target_confidence
FROM e JOIN u s ON s.mu_id = source_mu_id JOIN u t ON t.mu_id = target_mu_id WHERE edge_type = 'superseded_by' AND round(t.confidence + CAST(0.2 AS DOUBLE), 9) >= s.confidence""")
def supersession_guard(spark, d):
    return relations.guarded_supersessions(_said_edges(spark, d), _said(spark, d))


# ---- salience, lifecycle, store --------------------------------------------------------------------------------------
_UNITS, _EDGES_SQL = Q.event_units(), Q.event_edges()
_SCORED = f"(SELECT u.*, {Q.salience('penalty')} AS salience FROM {_UNITS} u LEFT JOIN {Q.penalties(_EDGES_SQL)} p USING (mu_id))"
_CONFIG = lifecycle.Lifecycle(capacity=40)


@query(f"SELECT conversation_id, mu_id, salience, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY salience DESC, mu_id) AS INTEGER) AS rank FROM {_SCORED}")
def salience_scores(spark, d):
    return salience.ranked(salience.scored(_units(spark, d), T.now(), _edges(spark, d))).select("conversation_id", "mu_id", "salience", "rank")


@query(f"SELECT conversation_id, mu_id, salience, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY salience, mu_id) AS INTEGER) AS place FROM {_SCORED} WHERE NOT user_pinned AND salience < 0.4")
def compression_candidates(spark, d):
    return salience.compression_candidates(salience.scored(_units(spark, d), T.now(), _edges(spark, d))).select("conversation_id", "mu_id", "salience", "place")


@query(f"SELECT mu_id, penalty FROM {Q.penalties(_EDGES_SQL)}")
def graph_penalty(spark, d):
    return salience.graph_penalties(_edges(spark, d))


_EVICTED = f"""a AS (SELECT * FROM {_SCORED} WHERE status = 'active'), n AS (SELECT conversation_id, count(*) AS n FROM a GROUP BY 1 HAVING count(*) / CAST(40 AS DOUBLE) >= 0.9),
o AS (SELECT a.*, n, row_number() OVER (PARTITION BY conversation_id ORDER BY salience, coalesce(last_accessed, created_at), mu_id) AS place FROM a JOIN n USING (conversation_id) WHERE NOT user_pinned),
v AS (SELECT conversation_id, mu_id, salience, CAST(place AS INTEGER) AS place, CASE WHEN salience < 0.15 THEN 'forgotten' ELSE 'archived' END AS destination FROM o WHERE place <= n - 28)"""


@query(f"WITH {_EVICTED} SELECT * FROM v")
def lifecycle_eviction(spark, d):
    return lifecycle.evictions(_units(spark, d), T.now(), _CONFIG, _edges(spark, d))


@query(f"""WITH {_EVICTED}, g AS (SELECT conversation_id, count(*) FILTER (destination = 'forgotten') AS f, count(*) FILTER (destination = 'archived') AS c FROM v GROUP BY 1)
SELECT conversation_id, n AS n_scored, coalesce(f, 0) AS n_forgotten, coalesce(c, 0) AS n_compressed, round(n / CAST(40 AS DOUBLE), 6) AS pressure_before, round((n - coalesce(f, 0) - coalesce(c, 0)) / CAST(40 AS DOUBLE), 6) AS pressure_after FROM n LEFT JOIN g USING (conversation_id)""")
def lifecycle_batch_summary(spark, d):
    return lifecycle.batch_summary(_units(spark, d), T.now(), _CONFIG, _edges(spark, d))


@query(f"""WITH u AS {_UNITS}, s AS (SELECT conversation_id, CASE WHEN status = 'archived' AND compressed_label_id IS NOT NULL THEN 'compressed' ELSE status END AS status FROM u),
g AS (SELECT DISTINCT conversation_id, unnest(['active', 'compressed', 'archived', 'forgotten']) AS status FROM u)
SELECT conversation_id, status, count(s.status) AS n FROM g LEFT JOIN s USING (conversation_id, status) GROUP BY ALL""")
def status_counts_4layer(spark, d):
    return store.status_counts(_units(spark, d), layers=True)


@query(f"SELECT conversation_id, count(*) FILTER (status = 'active') AS n_active, round(count(*) FILTER (status = 'active') / CAST(40 AS DOUBLE), 6) AS pressure FROM {_UNITS} GROUP BY 1")
def storage_pressure(spark, d):
    return store.storage_pressure(_units(spark, d), 40)


@query(f"SELECT conversation_id, count(compressed_label_id) AS labelled, count(*) - count(compressed_label_id) AS superseded FROM {_UNITS} WHERE status = 'archived' GROUP BY 1")
def archived_by_type(spark, d):
    return store.archived_by_type(_units(spark, d))


@query(f"SELECT compressed_label_id AS label_id, mu_id FROM {_UNITS} WHERE compressed_label_id IS NOT NULL AND coalesce(last_accessed, created_at) < {Q.NOW} - INTERVAL 30 DAYS")
def label_decay(spark, d):
    labels = _units(spark, d).where("compressed_label_id IS NOT NULL").select(F.col("compressed_label_id").alias("label_id"), "mu_id", F.col("created_at").alias("compressed_at"), F.col("last_accessed").alias("last_label_match"))
    return store.idle_labels(labels, T.now()).select("label_id", "mu_id")


@query(f"""WITH u AS {_UNITS}, a AS (SELECT event_id // 2 AS mu_id, count(*) AS n, max(ts) AS t FROM events GROUP BY 1)
SELECT mu_id, CAST(least(retrieval_count + coalesce(n, 0), 1000000) AS BIGINT) AS retrieval_count, epoch_us(greatest(last_accessed, t)) AS last_accessed_us FROM u LEFT JOIN a USING (mu_id)""")
def access_counts(spark, d):
    log = T.read(spark, d, "events").select(F.floor(F.col("event_id") / 2).alias("mu_id"), F.col("ts").cast("timestamp").alias("ts"))
    return store.with_accesses(_units(spark, d), log).select("mu_id", "retrieval_count", F.unix_micros("last_accessed").alias("last_accessed_us"))


# ---- graph -----------------------------------------------------------------------------------------------------------
@query(f"""WITH e AS {_EDGES_SQL}, b AS (SELECT source_mu_id AS n, target_mu_id AS m FROM e UNION SELECT target_mu_id, source_mu_id FROM e),
s AS (SELECT mu_id FROM {_UNITS}), h1 AS (SELECT DISTINCT mu_id AS seed, m AS neighbour FROM s JOIN b ON n = mu_id),
h2 AS (SELECT DISTINCT seed, m AS neighbour FROM h1 JOIN b ON n = neighbour WHERE m <> seed)
SELECT seed, neighbour, CAST(1 AS INTEGER) AS hop FROM h1 UNION ALL SELECT seed, neighbour, 2 FROM h2 WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.seed = h2.seed AND h1.neighbour = h2.neighbour)""")
def graph_neighbors_2hop(spark, d):
    return graph.within_hops(_edges(spark, d), _units(spark, d), 2)


@query(f"""WITH e AS {_EDGES_SQL}, u AS {_UNITS}, b AS (SELECT source_mu_id AS n FROM e UNION ALL SELECT target_mu_id FROM e), g AS (SELECT n, count(*) AS degree FROM b GROUP BY 1), t AS (SELECT count(*) AS total FROM u)
SELECT mu_id, coalesce(degree, 0) AS degree, round(coalesce(degree, 0) / CAST(total - 1 AS DOUBLE), 6) AS centrality FROM u LEFT JOIN g ON n = mu_id CROSS JOIN t""")
def degree_centrality(spark, d):
    return graph.degrees(_units(spark, d), _edges(spark, d))


@query()
def betweenness_centrality(spark, d):
    return graph.betweenness(_said(spark, d), _said_edges(spark, d))


# ---- context and grounding -------------------------------------------------------------------------------------------
@query(f"""WITH {_SAID_REL}, {_REL_EDGES}, u AS {_SAID},
m AS (SELECT u.*, EXISTS (SELECT 1 FROM e WHERE source_mu_id = mu_id AND edge_type = 'superseded_by') AS sup, EXISTS (SELECT 1 FROM e WHERE edge_type = 'conflicts_with' AND (source_mu_id = mu_id OR target_mu_id = mu_id)) AS con FROM u)
SELECT conversation_id AS query_id, mu_id, seq AS rank, CASE WHEN seq % 7 = 0 THEN 'restored' WHEN sup THEN 'superseded' WHEN con THEN 'conflicted' ELSE 'active' END AS section FROM m WHERE seq <= 10""")
def context_sections(spark, d):
    hits = _said(spark, d).join(fusion.relation_meta(_said_edges(spark, d)), "mu_id", "left").withColumn("is_from_label", F.col("seq") % 7 == 0)
    return context.entries(hits.select(F.col("conversation_id").alias("query_id"), "mu_id", F.col("seq").alias("rank"), "is_from_label", "superseded_by", "conflicts_with")).select("query_id", "mu_id", "rank", "section")


_REPLIES = f"""(SELECT CAST(conv_id AS VARCHAR) || ':' || turn AS query_id, text AS answer,
  coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS shown, false AS conflicted FROM conversations
  UNION ALL SELECT CAST(query_id AS VARCHAR), answer, shown, conflicted FROM {X.answers_sql()})"""
_UNSURE = " OR ".join(f"contains(lower(t), {X.quoted(w)})" for w in context.UNCERTAIN)


@query(f"""WITH a AS (SELECT *, trim(answer) AS t, len(shown) AS n FROM {_REPLIES}), b AS (SELECT *, t = '' OR regexp_matches(t, '(?i)no\\s+information\\s+available') AS is_no_info, list_distinct({Q.retrieval_tokens('t')}) AS mine,
  list_distinct(flatten(list_transform(shown, lambda c: {Q.retrieval_tokens('c')}))) AS ev FROM a),
c AS (SELECT *, CASE WHEN is_no_info THEN 1.0 WHEN n = 0 THEN 0.0 ELSE round(len(list_intersect(mine, ev)) / CAST(greatest(len(mine), 1) AS DOUBLE), 6) END AS grounding_score FROM b)
SELECT query_id, is_no_info OR (n > 0 AND grounding_score >= 0.3) AS passed, CAST(grounding_score AS DOUBLE) AS grounding_score, is_no_info, CAST(CASE WHEN is_no_info THEN 0 ELSE len(mine) END AS INTEGER) AS n_answer,
  CAST(CASE WHEN is_no_info OR n = 0 THEN 0 ELSE len(list_intersect(mine, ev)) END AS INTEGER) AS n_overlap,
  list_filter([CASE WHEN is_no_info AND n > 0 THEN 'refusal despite evidence' END, CASE WHEN NOT is_no_info AND n = 0 THEN 'no evidence' END, CASE WHEN NOT is_no_info AND n > 0 AND grounding_score < 0.3 THEN 'low grounding' END,
    CASE WHEN NOT is_no_info AND n > 0 AND conflicted AND NOT ({_UNSURE}) THEN 'conflict not acknowledged' END], lambda w: w IS NOT NULL) AS warnings FROM c""")
def grounding_verdict(spark, d):
    """Every turn as an answer, with all turns before it in its conversation shown, and the answers of the fixture."""
    t = _turns(spark, d)
    name = F.concat_ws(":", "a.conversation_id", F.col("a.turn_index").cast("string"))
    before = t.alias("a").join(t.alias("b"), (F.col("a.conversation_id") == F.col("b.conversation_id")) & (F.col("b.turn_index") < F.col("a.turn_index")))
    a = X.answers(spark).withColumn("query_id", F.col("query_id").cast("string"))
    said = t.alias("a").select(name.alias("query_id"), F.col("a.text").alias("answer"))
    shown = before.select(name.alias("query_id"), F.col("b.text").alias("claim"), F.lit("active").alias("section"))
    of_fixture = a.select("query_id", F.explode("shown").alias("claim"), F.when(F.col("conflicted"), "conflicted").otherwise("active").alias("section"))
    shown = shown.unionByName(of_fixture).withColumn("label_summary", F.lit(None).cast("string"))
    return context.grounding(said.unionByName(a.select("query_id", "answer")), context.evidence(shown))


# ---- evaluation ------------------------------------------------------------------------------------------------------
@query(f"""WITH p AS (SELECT query_id, rank, doc_id, b.text AS gold, d.text AS answer FROM (WITH {Q.bm25('documents', '(SELECT item_id AS query_id, text FROM benchmark)')} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id FROM s WHERE score > 0) r
  JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id) WHERE rank <= 1), w AS (SELECT query_id, {Q.normal_words('gold')} AS g, {Q.normal_words('answer')} AS a FROM p),
c AS (SELECT query_id, sum(least(x.n, y.n)) AS both_n FROM (SELECT query_id, t, count(*) AS n FROM (SELECT query_id, unnest(a) AS t FROM w) GROUP BY ALL) x JOIN (SELECT query_id, t, count(*) AS n FROM (SELECT query_id, unnest(g) AS t FROM w) GROUP BY ALL) y USING (query_id, t) GROUP BY 1)
SELECT query_id, CASE WHEN len(a) = 0 AND len(g) = 0 THEN 1.0 WHEN len(a) = 0 OR len(g) = 0 THEN 0.0 ELSE round(2 * coalesce(both_n, 0) / CAST(len(a) + len(g) AS DOUBLE), 4) END AS f1,
  array_to_string(a, ' ') = array_to_string(g, ' ') AS exact_match FROM w LEFT JOIN c USING (query_id)""")
def qa_token_f1(spark, d):
    top = bm25_topk(spark, d).where("rank = 1")
    gold = T.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("gold"))
    docs = T.read(spark, d, "documents").select("doc_id", F.col("text").alias("answer"))
    return evaluation.token_f1_rows(top.join(gold, "query_id").join(docs, "doc_id"), "query_id", "answer", "gold")


_RECALL = f"""h AS (SELECT query_id, list(mu_id % 20) AS retrieved FROM {_lane_sql(5)} GROUP BY 1), h10 AS (SELECT query_id, list(mu_id % 20) AS deeper FROM {_lane_sql(10)} GROUP BY 1),
g AS (SELECT query_id, [query_id % 20, (query_id + 3) % 20, (query_id + 3) % 20] AS gold, 'c' || (query_id % 3) AS category, retrieved, deeper FROM h JOIN h10 USING (query_id)),
r AS (SELECT *, round(len(list_filter(gold, lambda x: list_contains(retrieved, x))) / CAST(len(gold) AS DOUBLE), 4) AS evidence_recall FROM g)"""


def _recall_rows(spark, d):
    q = F.col("query_id")
    near = lambda k, name: _lane(spark, d, k).groupBy("query_id").agg(F.collect_list(F.col("mu_id") % 20).alias(name))
    rows = near(5, "retrieved").join(near(10, "deeper"), "query_id")
    return rows.withColumns({"gold": F.array(q % 20, (q + 3) % 20, (q + 3) % 20), "category": F.concat(F.lit("c"), (q % 3).cast("string"))})


def _recalls(spark, d):
    return _recall_rows(spark, d).withColumn("evidence_recall", evaluation.evidence_recall(F.col("gold"), F.col("retrieved")))


@query(f"WITH {_RECALL} SELECT query_id, evidence_recall FROM r")
def evidence_recall(spark, d):
    return _recalls(spark, d).select("query_id", "evidence_recall")


_METRICS = "count(*) AS n, round(avg(f1), 4) AS avg_f1, round(avg(CAST(em AS INTEGER)), 4) AS avg_em, round(avg(evidence_recall), 4) AS avg_recall, count(*) FILTER (evidence_recall = 0) AS zero_recall, count(*) FILTER (evidence_recall = 1) AS perfect_recall"


def _predictions(spark, d):
    q = F.col("query_id")
    return _recalls(spark, d).withColumns({"f1": (q % 11) / 10.0, "exact_match": q % 11 == 10})


@query(f"WITH {_RECALL} SELECT {_METRICS} FROM (SELECT *, (query_id % 11) / CAST(10 AS DOUBLE) AS f1, query_id % 11 = 10 AS em FROM r)")
def run_metrics(spark, d):
    return evaluation.run_metrics(_predictions(spark, d))


@query(f"WITH {_RECALL} SELECT category, {_METRICS} FROM (SELECT *, (query_id % 11) / CAST(10 AS DOUBLE) AS f1, query_id % 11 = 10 AS em FROM r) GROUP BY category")
def category_metrics(spark, d):
    return evaluation.run_metrics(_predictions(spark, d), "category")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, round(avg(value), 4) AS mean, max(value) FILTER (i = greatest(1, floor(0.5 * n))) AS p50, max(value) FILTER (i = greatest(1, floor(0.95 * n))) AS p95 FROM r GROUP BY 1""")
def latency_percentiles(spark, d):
    return evaluation.latency_percentiles(T.read(spark, d, "events"), "value", "event_type")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, value AS p95 FROM r WHERE i = least(n, floor(n * 0.95) + 1)""")
def histogram_p95(spark, d):
    return evaluation.histogram_percentile(T.read(spark, d, "events"), "value", 0.95, "event_type")


@query(f"""WITH h AS (SELECT query_id, mu_id % 4 AS s FROM {_lane_sql(10)}), c AS (SELECT query_id, s, count(*) AS n FROM h GROUP BY ALL), m AS (SELECT query_id, max(n) / CAST(sum(n) AS DOUBLE) AS share FROM c GROUP BY 1)
SELECT round(avg(share), 4) AS session_density FROM m""")
def session_density(spark, d):
    return evaluation.session_density(_lane(spark, d, 10).withColumn("session_id", F.col("mu_id") % 4))


@query(f"""WITH h AS (SELECT query_id, list(mu_id % 4) AS x FROM {_lane_sql(10)} GROUP BY 1) SELECT round(avg(len(x) - len(list_distinct(x))), 4) AS avg_duplicates FROM h""")
def duplicate_turns(spark, d):
    hits = _lane(spark, d, 10).groupBy("query_id").agg(F.collect_list(F.array(F.col("mu_id") % 4)).alias("retrieved_dia_ids"))
    return evaluation.duplicate_turns(hits)


_FAIL = f"""{_RECALL}, v AS (SELECT *, list_distinct(gold) AS gs, CASE WHEN query_id % 2 = 0 THEN [query_id % 5] END AS covered, CASE WHEN query_id % 3 = 0 THEN 'When was it?' ELSE 'What is it?' END AS question FROM r),
x AS (SELECT *, len(list_intersect(gs, retrieved)) > 0 AS hit, evidence_recall >= 1 AS every_hit FROM v WHERE evidence_recall < 1),
y AS (SELECT *, NOT hit AND covered IS NOT NULL AND NOT list_has_any(gs, covered) AS extraction_miss, NOT hit AND (covered IS NULL OR list_has_any(gs, covered)) AS retrieval_miss, NOT hit AND list_has_any(gs, deeper) AS ranking_depth, hit AND NOT every_hit AS provenance, NOT hit AND question = 'When was it?' AS temporal FROM x)"""


@query(f"""WITH {_FAIL} SELECT query_id, category, CASE WHEN evidence_recall > 0 THEN 'partial' ELSE 'zero' END AS bucket, extraction_miss, retrieval_miss, ranking_depth, provenance, temporal,
CASE WHEN extraction_miss THEN 'extraction_miss' WHEN ranking_depth THEN 'ranking_depth' WHEN retrieval_miss THEN 'retrieval_miss' WHEN provenance THEN 'provenance' WHEN temporal THEN 'temporal' ELSE 'unknown' END AS primary_type FROM y""")
def failure_classification(spark, d):
    q = F.col("query_id")
    rows = _recall_rows(spark, d).withColumns({
        "conversation_id": q % 10, "covered": F.when(q % 2 == 0, F.array(q % 5)), "question": F.when(q % 3 == 0, "When was it?").otherwise("What is it?"),
    })
    return evaluation.failures(rows).drop("conversation_id")


@query(f"""WITH {_RECALL}, g2 AS (SELECT DISTINCT query_id, query_id % 10 AS conversation_id, category, unnest(gold) AS dia_id FROM g), k AS (SELECT DISTINCT vec_id % 10 AS conversation_id, vec_id % 20 AS dia_id FROM embeddings WHERE vec_id % 7 < 3)
SELECT category, count(*) AS n_gold, count(k.dia_id) AS n_covered, round(count(k.dia_id) / CAST(count(*) AS DOUBLE), 4) AS coverage FROM g2 LEFT JOIN k USING (conversation_id, dia_id) GROUP BY ROLLUP (category)""")
def coverage_by_category(spark, d):
    rows = _recall_rows(spark, d).withColumn("conversation_id", F.col("query_id") % 10)
    v = F.col("vec_id")
    covered = T.read(spark, d, "embeddings").where(v % 7 < 3).select((v % 10).alias("conversation_id"), (v % 20).alias("dia_id"))
    return evaluation.coverage(rows, covered)


# ---- turns as evidence -----------------------------------------------------------------------------------------------
@query(f"""SELECT conversation_id, dia_id, array_to_string(list(speaker || ': ' || text) OVER (PARTITION BY conversation_id ORDER BY turn_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ' ') AS context FROM {Q.turns()}""")
def turn_context(spark, d):
    return search.context_text(_turns(spark, d), 1)


@query(f"""WITH t AS (SELECT conversation_id, turn_index, list(dia_id) OVER (PARTITION BY conversation_id ORDER BY turn_index ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS ids FROM {Q.turns()}), x AS (SELECT conversation_id, turn_index AS mu_id, unnest(ids) AS dia_id FROM t)
SELECT conversation_id, dia_id, list_sort(list(DISTINCT mu_id)) AS mu_ids FROM x GROUP BY ALL""")
def turn_links(spark, d):
    w = Window.partitionBy("conversation_id").orderBy("turn_index").rowsBetween(0, 1)
    units = _turns(spark, d).select("conversation_id", F.col("turn_index").alias("mu_id"), F.collect_list("dia_id").over(w).alias("source_dia_ids"))
    return search.units_of_turns(units)


# ---- safety and operations -------------------------------------------------------------------------------------------
def _redacted(text: str) -> str:
    """SQL of ``safety.redact``, from its patterns."""
    for pattern, mark in ((r"((?i)sk-[a-z0-9])[a-z0-9-]{9,}", r"\1***"), (S.EMAIL, "[EMAIL]"), (S.PHONE, "[PHONE]"), (S.SSN, "[SSN]")):
        text = f"regexp_replace({text}, {X.quoted(pattern)}, '{mark}', '{'gi' if 'sk-' in pattern else 'g'}')"
    return text


_REDACT = _redacted("t")


@query(f"""WITH t AS (SELECT 'd' || doc_id AS id, text AS t FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages), r AS (SELECT id, t, {_REDACT} AS r FROM t)
SELECT id, sha256(r) AS redacted_sha256, CAST((length(r) - length(replace(r, '[EMAIL]', ''))) // 7 AS BIGINT) AS n_email FROM r""")
def redact_pii(spark, d):
    docs = T.read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("t"))
    pages = T.read(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("t"))
    r = docs.unionByName(pages).withColumn("r", S.redact(F.col("t")))
    return r.select("id", F.sha2("r", 256).alias("redacted_sha256"), F.floor((F.length("r") - F.length(F.replace("r", F.lit("[EMAIL]"), F.lit("")))) / 7).cast("long").alias("n_email"))


_IDS = "(SELECT id, claim AS v FROM (SELECT mu_id AS id, claim FROM " + X.claims_sql() + ") UNION ALL SELECT 'c' || conv_id || '_' || turn, role || '-' || conv_id FROM conversations)"


@query(f"""SELECT id, CASE WHEN v = '' THEN 'required' WHEN length(trim(v)) > 100 THEN 'long' WHEN NOT regexp_matches(trim(v), '^[A-Za-z0-9_-]+$') THEN 'invalid' END AS error FROM {_IDS}""")
def conversation_id_validation(spark, d):
    conv = T.read(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"), F.concat_ws("-", "role", F.col("conv_id").cast("string")).alias("v"))
    rows = X.claims(spark).select(F.col("mu_id").alias("id"), F.col("claim").alias("v")).unionByName(conv)
    return rows.select("id", S.checked_id(F.col("v"))["error"].alias("error"))


_ASKS = " OR ".join(f"starts_with(lower(trim(claim)), {X.quoted(s)})" for s in S.DEFINITE_QUESTIONS + S.LIKELY_QUESTIONS)


@query(f"SELECT id, CASE WHEN contains(claim, '?') OR {_ASKS} THEN 'question' ELSE 'statement' END AS intent FROM {_TEXTS}")
def message_intent(spark, d):
    return _texts(spark, d).select("id", S.intent(F.col("claim")).alias("intent"))


@query("SELECT doc_id, CASE WHEN length(c) > 200 THEN substr(c, 1, 200) || '...' ELSE c END AS shown FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS c FROM documents)")
def display_text(spark, d):
    return T.read(spark, d, "documents").select("doc_id", S.for_display(F.col("text")).alias("shown"))


@query("SELECT doc_id, substr(sha256('model|v1|' || sha256(text)), 1, 16) AS key FROM documents")
def cache_key(spark, d):
    return T.read(spark, d, "documents").select("doc_id", monitoring.cache_key(F.lit("model"), F.lit("v1"), F.col("text")).alias("key"))


@query("SELECT user_id, event_id, count(*) OVER w AS in_window, count(*) OVER w > 5 AS over_limit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW)")
def rate_window(spark, d):
    return monitoring.rate_window(T.read(spark, d, "events"), 3600, 5)


_NUMBERED = "e AS (SELECT user_id, event_id, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"""WITH RECURSIVE {_NUMBERED},
r AS (SELECT user_id, event_id, i, [t] AS taken, true AS accepted FROM e WHERE i = 1
  UNION ALL SELECT user_id, event_id, i, CASE WHEN len(held) < 2 THEN list_append(held, t) ELSE held END, len(held) < 2
  FROM (SELECT e.*, list_filter(r.taken, lambda x: x > e.t - 3600) AS held FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id, event_id, accepted FROM r""")
def sliding_limiter(spark, d):
    return monitoring.sliding_limiter(T.read(spark, d, "events"), 3600, 2)


@query(f"""WITH RECURSIVE {_NUMBERED},
r AS (SELECT user_id, event_id, i, t, CAST(2 AS DOUBLE) AS rest, true AS accepted FROM e WHERE i = 1
  UNION ALL SELECT user_id, event_id, i, t, rest - CASE WHEN rest >= 1 THEN 1 ELSE 0 END, rest >= 1
  FROM (SELECT e.*, least(CAST(3 AS DOUBLE), r.rest + (e.t - r.t) * (CAST(1 AS DOUBLE) / 3600)) AS rest FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id, event_id, accepted FROM r""")
def token_bucket(spark, d):
    return monitoring.token_bucket(T.read(spark, d, "events"), 1 / 3600, 3)


# ---- ingestion and questions -----------------------------------------------------------------------------------------
def _dialogue(spark, d):
    """Turns of ``conversations``, and the sentences of the fixture as one more message each."""
    said = X.claims(spark).select(
        "conversation_id", F.lit("S0").alias("session_id"), F.col("seq").cast("long").alias("turn_index"), F.concat(F.lit("D"), F.col("seq").cast("string")).alias("dia_id"), F.lit("user").alias("speaker"),
        F.col("claim").alias("text"), F.lit("").alias("timestamp"),
    )
    return _turns(spark, d).unionByName(said)


@query()
def replay_ingest(spark, d):
    return engine.replay_ingest(_dialogue(spark, d))


@query()
def bulk_ingest(spark, d):
    return engine.bulk_ingest(_dialogue(spark, d))[0].select("conversation_id", "mu_id", "turn_index", "claim", "confidence", "status")


@query()
def bulk_edges(spark, d):
    return engine.bulk_ingest(_dialogue(spark, d))[1].select("source_mu_id", "target_mu_id", "edge_type", "weight")


_CHUNKED = f"""t AS {_SPOKEN}, ck AS (SELECT {_CHUNK_ID.format(s='turn')} AS doc_id, conversation_id, dia_ids, '[Conversation: ' || conversation_id || ' | Session: S0 | Dialog IDs: ' || dia_id || ']' || chr(10) || speaker || ': ' || text AS text FROM (SELECT *, [dia_id] AS dia_ids FROM t)),
qa AS (SELECT conversation_id || ':' || turn_index AS query_id, conversation_id, text, speaker AS category, [dia_id] AS gold FROM {Q.turns()} WHERE speaker = 'user'),
hit AS (SELECT * FROM (WITH {Q.bm25('(SELECT conversation_id, doc_id, text FROM ck)', '(SELECT conversation_id, query_id, text FROM qa)', 'conversation_id')}
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5),
fd AS (SELECT query_id, arg_min(text, rank) AS answer, flatten(list(dia_ids)) AS got FROM hit JOIN ck USING (doc_id) GROUP BY 1),
w AS (SELECT qa.query_id, category, {Q.normal_words("coalesce(answer, '')")} AS a, {Q.normal_words('qa.text')} AS g, CASE WHEN list_contains(coalesce(got, []), gold[1]) THEN 1 ELSE 0 END AS recall FROM qa LEFT JOIN fd USING (query_id)),
bo AS (SELECT query_id, sum(least(x.n, y.n)) AS both_n FROM (SELECT query_id, t, count(*) AS n FROM (SELECT query_id, unnest(a) AS t FROM w) GROUP BY ALL) x JOIN (SELECT query_id, t, count(*) AS n FROM (SELECT query_id, unnest(g) AS t FROM w) GROUP BY ALL) y USING (query_id, t) GROUP BY 1),
pr AS (SELECT w.*, CASE WHEN len(a) = 0 AND len(g) = 0 THEN 1.0 WHEN len(a) = 0 OR len(g) = 0 THEN 0.0 ELSE round(2 * coalesce(both_n, 0) / CAST(len(a) + len(g) AS DOUBLE), 4) END AS f1, a = g AS em FROM w LEFT JOIN bo USING (query_id))"""


@query(f"""WITH {_CHUNKED} SELECT category, count(*) AS n, round(avg(f1), 4) AS avg_f1, round(avg(CAST(em AS INTEGER)), 4) AS avg_em, round(avg(CAST(recall AS DOUBLE)), 4) AS avg_recall,
count(*) FILTER (recall = 0) AS zero_recall, count(*) FILTER (recall = 1) AS perfect_recall FROM pr GROUP BY category""")
def chunk_experiment(spark, d):
    """Every turn of a user asked of its conversation's chunks."""
    turns = _turns(spark, d)
    asked = turns.where("speaker = 'user'").select(
        F.concat_ws(":", "conversation_id", F.col("turn_index").cast("string")).alias("qa_id"), "conversation_id", F.col("text").alias("question"), F.col("text").alias("answer"),
        F.col("speaker").alias("category"), F.array("dia_id").alias("gold_evidence_ids"),
    )
    return experiments.report(experiments.chunk_retrieval(turns, asked, experiments.Experiment()))[1]


from tidemark.plans import memory_queries  # noqa: E402, F401  registers its queries here
