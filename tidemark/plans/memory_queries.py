"""Queries over the memory as a whole: hybrid retrieval, answers, ingestion, the store's transitions, loading and reports, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import claims as C
from tidemark.functions import safety as S
from tidemark.functions import words as W
from tidemark.operators import chunking, context, evaluation, extraction, fusion, graph, index, lifecycle, monitoring, relations, search, store
from tidemark.plans import catalog as K
from tidemark.plans import engine, experiments
from tidemark.plans import fixtures as X
from tidemark.plans import sql as Q
from tidemark.sources import dialogues, sinks
from tidemark.sources import tables as T

query = K.query
NOW = Q.NOW

# ---- a memory made of all turns that users did not say, and the sentences of the fixture ---------------------------------
_SAID = f"""(SELECT mu_id, conversation_id, seq, claim, confidence, 'D' || seq AS dia_id, 'user' AS speaker, true AS kept FROM {X.claims_sql()}
  UNION ALL SELECT CAST(conv_id AS VARCHAR) || ':' || turn, CAST(conv_id AS VARCHAR), turn, text, CASE WHEN {Q.speculative('text')} THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END, 'D' || turn, role, role <> 'user' FROM conversations)"""
#: How the length of a claim decides about status, label and salience, so that every layer occurs.
_UNITS = f"""(SELECT mu_id, conversation_id, seq, claim, confidence, dia_id, CASE WHEN length(claim) % 11 < 7 THEN 'active' WHEN length(claim) % 11 < 9 THEN 'archived' ELSE 'forgotten' END AS status,
  CASE WHEN length(claim) % 11 = 7 THEN 'label_' || mu_id END AS compressed_label_id, (length(claim) % 10) / CAST(10 AS DOUBLE) AS salience FROM {_SAID} WHERE kept)"""


def said(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of ``conversations`` and every sentence of the fixture, with whether it is kept as a unit."""
    c = X.claims(spark).select("mu_id", "conversation_id", F.col("seq").cast("long").alias("seq"), "claim", "confidence", F.lit("user").alias("speaker"), F.lit(True).alias("kept"))
    t = T.turns(T.read(spark, d, "conversations"))
    t = t.select(
        F.concat_ws(":", "conversation_id", F.col("turn_index").cast("string")).alias("mu_id"), "conversation_id", F.col("turn_index").alias("seq"), F.col("text").alias("claim"),
        C.claim_confidence(F.col("text")).alias("confidence"), "speaker", (F.col("speaker") != "user").alias("kept"),
    )
    return c.unionByName(t).withColumn("dia_id", F.concat(F.lit("D"), F.col("seq").cast("string")))


def remembered(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("claim")
    status = F.when(n % 11 < 7, "active").when(n % 11 < 9, "archived").otherwise("forgotten")
    label = F.when(n % 11 == 7, F.concat(F.lit("label_"), F.col("mu_id")))
    return said(spark, d).where("kept").withColumns({"status": status, "compressed_label_id": label, "salience": (n % 10) / F.lit(10.0), "source_dia_ids": F.array("dia_id")}).drop("kept", "speaker")


def heard(spark: SparkSession, d: str) -> DataFrame:
    """All turns as the source of evidence."""
    return said(spark, d).select("conversation_id", F.lit("S0").alias("session_id"), F.col("seq").alias("turn_index"), "dia_id", "speaker", F.col("claim").alias("text"), F.lit("").alias("timestamp"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of a user, and every sentence of the fixture, as a question."""
    return said(spark, d).where("speaker = 'user'").select(F.concat(F.lit("q:"), F.col("mu_id")).alias("query_id"), "conversation_id", F.col("claim").alias("question"))


def linked(spark: SparkSession, d: str) -> DataFrame:
    return relations.new_edges(relations.edges_for(relations.scan_conversations(remembered(spark, d))))


def _hashed(text: str) -> str:
    """Hashed vectors as ``search.hashed_vector``, of a column ``w`` of tokens made from ``text``."""
    slot, sign = "CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64", "CASE WHEN CAST('0x' || substr(md5(w), 9, 1) AS BIGINT) < 8 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END"
    pairs = f"list_transform({Q.retrieval_tokens(text)}, lambda w: struct_pack(slot := {slot}, sign := {sign}))"
    return f"list_transform(range(64), lambda i: coalesce(list_sum(list_transform(list_filter({pairs}, lambda p: p.slot = i), lambda p: p.sign)), CAST(0 AS DOUBLE)))"


def _near(rows: str, text: str, k: int, lane: str) -> str:
    """The dense lane of rows (mu_id, conversation_id)."""
    unit = lambda raw: f"list_transform({raw}, lambda x: x / coalesce(nullif(sqrt(list_inner_product({raw}, {raw})), 0), 1))"
    return f"""(WITH a AS (SELECT mu_id, conversation_id, {_hashed(text)} AS r FROM {rows}), b AS (SELECT query_id, conversation_id, {_hashed('text')} AS r FROM qq),
    x AS (SELECT *, {unit('r')} AS v FROM a), y AS (SELECT *, {unit('r')} AS v FROM b), z AS (SELECT query_id, mu_id, round(list_inner_product(y.v, x.v), 6) AS score FROM y JOIN x USING (conversation_id))
    SELECT query_id, mu_id, rank, '{lane}' AS lane FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mu_id) AS rank FROM z) WHERE rank <= {k})"""


def _words(rows: str, k: int, lane: str) -> str:
    """The keyword lane of rows (mu_id, conversation_id, claim)."""
    return f"""(WITH {Q.bm25(f'(SELECT conversation_id, mu_id AS doc_id, claim AS text FROM {rows})', '(SELECT conversation_id, query_id, text FROM qq)', 'conversation_id')}
    SELECT query_id, doc_id AS mu_id, rank, '{lane}' AS lane FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k})"""


_LABEL_TEXT = f"{Q.topic('claim')} || ': ' || substr(claim, 1, {store.LABEL_CHARS}) || ' entities: ' || array_to_string(list_sort({Q.entities('claim')}), ', ')"
_RETRIEVED = f"""uu AS {_UNITS}, qq AS (SELECT 'q:' || mu_id AS query_id, conversation_id, claim AS text FROM {_SAID} WHERE speaker = 'user'), tt AS (SELECT conversation_id, dia_id, speaker, claim FROM {_SAID}),
{K._rel('uu')}, {K._REL_EDGES.replace('e AS', 'ee AS', 1)},
src AS (SELECT l.query_id, coalesce(u.mu_id, 'se_' || l.mu_id) AS mu_id, rank, 'source' AS lane
  FROM {_words('(SELECT conversation_id, dia_id AS mu_id, claim FROM tt)', 20, 'source')} l JOIN qq USING (query_id) LEFT JOIN uu u ON u.conversation_id = qq.conversation_id AND u.dia_id = l.mu_id),
dns AS (SELECT * FROM {_near("(SELECT * FROM uu WHERE status = 'active')", 'claim', 20, 'dense')}),
lanes AS (SELECT * FROM dns UNION ALL SELECT * FROM {_words("(SELECT * FROM uu WHERE status = 'active')", 20, 'bm25')} UNION ALL SELECT * FROM {_words("(SELECT * FROM uu WHERE status = 'forgotten')", 20, 'forgotten')}
  UNION ALL SELECT * FROM {_near("(SELECT mu_id, conversation_id, " + _LABEL_TEXT + " AS claim FROM uu WHERE compressed_label_id IS NOT NULL)", 'claim', 10, 'label')} UNION ALL SELECT * FROM src),
fz AS (SELECT query_id, mu_id, round(sum(1.0 / (CAST(60 AS DOUBLE) + rank)), 9) AS rrf_score, list_sort(list(DISTINCT lane)) AS sources, CAST(min(rank) AS INTEGER) AS best_rank FROM lanes GROUP BY ALL),
st AS (SELECT source_mu_id AS seed, target_mu_id AS mu_id FROM ee WHERE edge_type IN ('related_to', 'conflicts_with') UNION SELECT target_mu_id, source_mu_id FROM ee WHERE edge_type IN ('related_to', 'conflicts_with')),
gr AS (SELECT dns.query_id, st.mu_id, arg_min(st.seed, dns.rank) AS seed FROM dns JOIN st ON st.seed = dns.mu_id JOIN uu a ON a.mu_id = st.seed JOIN uu b ON b.mu_id = st.mu_id
  WHERE a.conversation_id = b.conversation_id AND b.status <> 'forgotten' AND NOT EXISTS (SELECT 1 FROM fz WHERE fz.query_id = dns.query_id AND fz.mu_id = st.mu_id) GROUP BY ALL),
al AS (SELECT * FROM fz UNION ALL SELECT gr.query_id, gr.mu_id, round(CAST(0.8 AS DOUBLE) * rrf_score, 9), ['graph'], 21 FROM gr JOIN fz ON fz.query_id = gr.query_id AND fz.mu_id = gr.seed),
hy AS (SELECT al.*, claim, status, salience, confidence, compressed_label_id FROM al JOIN uu USING (mu_id) WHERE status <> 'forgotten' OR list_contains(sources, 'forgotten')
  UNION ALL SELECT al.*, speaker || ': ' || claim, 'active', 0.5, 0.5, NULL FROM al JOIN qq USING (query_id) JOIN tt ON tt.conversation_id = qq.conversation_id AND 'se_' || tt.dia_id = al.mu_id),
pl AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score + CAST(0.0001 AS DOUBLE) * salience DESC, mu_id) AS INTEGER) AS rank FROM hy QUALIFY rank <= 5),
hh AS (SELECT *, status = 'archived' AND list_contains(sources, 'label') AS is_from_label FROM pl
  WHERE NOT EXISTS (SELECT 1 FROM ee JOIN pl o ON o.mu_id = ee.target_mu_id WHERE ee.source_mu_id = pl.mu_id AND ee.edge_type = 'superseded_by' AND o.query_id = pl.query_id))"""


def _inputs(spark, d):
    return questions(spark, d), remembered(spark, d), engine.staged(linked(spark, d), "linked"), heard(spark, d)


@query(f"""WITH {_RETRIEVED} SELECT query_id, rank, mu_id, round(rrf_score, 6) AS rrf_score, sources, best_rank, claim, status, round(salience, 6) AS salience, is_from_label,
CASE WHEN is_from_label THEN substr(claim, 1, {store.LABEL_CHARS}) END AS label_summary, is_from_label OR status = 'forgotten' AS promoted FROM hh""")
def hybrid_retrieve(spark, d):
    """All lanes, fused, hydrated and guarded, for every turn of a user."""
    hits = engine.retrieve(*_inputs(spark, d))
    return hits.select("query_id", "rank", "mu_id", F.round("rrf_score", 6).alias("rrf_score"), "sources", "best_rank", "claim", "status", F.round("salience", 6).alias("salience"), "is_from_label", "label_summary", "promoted")


_ASKED = f"""{_RETRIEVED},
bw AS (SELECT source_mu_id AS mu_id, target_mu_id AS other, edge_type FROM ee UNION SELECT target_mu_id, source_mu_id, edge_type FROM ee WHERE edge_type <> 'superseded_by'),
cl AS (SELECT bw.mu_id, edge_type, string_agg(claim, '; ' ORDER BY other) AS said FROM (SELECT DISTINCT mu_id, other, edge_type FROM bw) bw JOIN uu ON uu.mu_id = other GROUP BY ALL),
en AS (SELECT hh.*, s.said AS sup, c.said AS con, CASE WHEN is_from_label THEN 2 WHEN s.said IS NOT NULL THEN 3 WHEN c.said IS NOT NULL THEN 4 ELSE 1 END AS place
  FROM hh LEFT JOIN cl s ON s.mu_id = hh.mu_id AND s.edge_type = 'superseded_by' LEFT JOIN cl c ON c.mu_id = hh.mu_id AND c.edge_type = 'conflicts_with'),
tx AS (SELECT *, '[' || rank || '] ' || claim || chr(10) || '    Confidence: ' || printf('%.2f', confidence) || CASE place WHEN 3 THEN chr(10) || '    SUPERSEDED BY: ' || sup WHEN 4 THEN chr(10) || '    CONFLICTS WITH: ' || con
  WHEN 2 THEN chr(10) || '    Label matched: "' || substr(claim, 1, {store.LABEL_CHARS}) || '"' ELSE '' END AS said FROM en),
bl AS (SELECT query_id, place, {Q.listed(context.SECTIONS.values())}[place] || ':' || chr(10) || string_agg(said, chr(10) ORDER BY rank) AS block FROM tx GROUP BY query_id, place),
cx AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY place) AS context FROM bl GROUP BY 1),
tk AS (SELECT query_id, rank, claim, {Q.retrieval_tokens('claim')} AS w1, CASE WHEN is_from_label THEN {Q.retrieval_tokens(f'substr(claim, 1, {store.LABEL_CHARS})')} ELSE [] END AS w2 FROM hh),
an AS (SELECT query_id, arg_min(claim, rank) AS answer, flatten(list(w1)) AS w1, flatten(list(w2)) AS w2 FROM tk GROUP BY 1),
gd AS (SELECT query_id, trim(answer) = '' OR regexp_matches(trim(answer), '(?i)no\\s+information\\s+available') AS refuses, list_distinct({Q.retrieval_tokens('trim(answer)')}) AS mine, list_concat(w1, w2) AS ev FROM an)"""


@query(f"""WITH {_ASKED} SELECT qq.query_id, coalesce(answer, 'No information available.') AS answer, coalesce(context, {Q.quoted(context.NOTHING)}) AS context,
CASE WHEN answer IS NULL OR refuses THEN 1.0 ELSE round(len(list_intersect(mine, ev)) / CAST(greatest(len(mine), 1) AS DOUBLE), 6) END AS grounding_score FROM qq LEFT JOIN cx USING (query_id) LEFT JOIN an USING (query_id) LEFT JOIN gd USING (query_id)""")
def ask_turns(spark, d):
    """Every turn of a user answered from the memory, with the evidence shown and how far the answer rests on it."""
    return engine.ask(*_inputs(spark, d)).answers.select("query_id", "answer", "context", "grounding_score")


@query(f"""WITH {_RETRIEVED} SELECT mu_id, CASE WHEN bool_or(status = 'forgotten') THEN 'forgotten' ELSE 'label' END AS effect, CAST(1 AS BIGINT) AS n FROM hh WHERE is_from_label OR status = 'forgotten' GROUP BY mu_id
UNION ALL SELECT mu_id, 'used', count(*) FROM hh WHERE NOT starts_with(mu_id, 'se_') GROUP BY mu_id""")
def effects_of_asking(spark, d):
    """What a batch of questions changes: units brought back to active, and how often each was shown."""
    asked = engine.ask(*_inputs(spark, d))
    return asked.promotions.select("mu_id", F.col("reason").alias("effect"), F.lit(1).cast("long").alias("n")).unionByName(asked.accesses.groupBy("mu_id").agg(F.lit("used").alias("effect"), F.count("*").alias("n")))


@query(f"""WITH qq AS (SELECT 'q:' || mu_id AS query_id, conversation_id, claim AS text FROM {_SAID} WHERE speaker = 'user'), uu AS {_UNITS},
l AS (SELECT * FROM {_near("(SELECT * FROM uu WHERE status = 'active')", 'claim', 20, 'dense')} UNION ALL SELECT * FROM {_words("(SELECT * FROM uu WHERE status = 'active')", 20, 'bm25')}),
f AS (SELECT query_id, mu_id, round(sum(1.0 / (CAST(60 AS DOUBLE) + rank)), 9) AS rrf_score FROM l GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, mu_id) AS INTEGER) AS rank, mu_id, round(rrf_score, 6) AS rrf_score FROM f QUALIFY rank <= 5""")
def dense_with_keywords(spark, d):
    """The plain hybrid: a dense and a keyword lane of max(3 k, 20) hits each, fused."""
    return search_hybrid(questions(spark, d), remembered(spark, d).where("status = 'active'"), 5).withColumn("rrf_score", F.round("rrf_score", 6))


def search_hybrid(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    deep = max(3 * k, 20)
    vector = lambda df, text: search.embedded(df, F.col(text))
    lanes = {
        "dense": search.dense_topk(vector(asked, "question").select("query_id", "conversation_id", "vector"), vector(rows, "claim").select("mu_id", "conversation_id", "vector"), deep),
        "bm25": search.bm25_topk(rows, asked, deep, doc_id="mu_id", text="claim", question="question", scope="conversation_id").withColumnRenamed("doc_id", "mu_id"),
    }
    return fusion.top(fusion.rrf({n: engine.staged(x.select("query_id", "mu_id", "rank"), n) for n, x in lanes.items()}), k).select("query_id", "rank", "mu_id", "rrf_score")


# ---- ingestion -------------------------------------------------------------------------------------------------------
_DIALOGUE = f"(SELECT conversation_id, session_id, turn_index, dia_id, speaker, text FROM {Q.turns()} UNION ALL SELECT conversation_id, 'S0', seq, 'D' || seq, 'user', claim FROM {X.claims_sql()})"
_US = "chr(31)"
_BULK = f"""WITH RECURSIVE tn AS (SELECT * FROM {_DIALOGUE} WHERE lower(speaker) NOT IN ('summary', 'system_summary')),
ln AS (SELECT conversation_id, turn_index, speaker, dia_id, unnest(range(len(b))) AS line_no, unnest(b) AS line FROM (SELECT *, string_split(speaker || ': ' || text, chr(10)) AS b FROM tn)),
hd AS (SELECT *, trim(split_part(line, ':', 1)) AS head FROM ln WHERE trim(line) <> ''),
pe AS (SELECT conversation_id, turn_index, line_no, CASE WHEN contains(line, ':') AND head <> '' AND length(head) <= 80 THEN trim(substr(line, instr(line, ':') + 1)) ELSE line END AS line FROM hd),
se AS (SELECT *, unnest(range(len(z))) AS sentence_no, unnest(z) AS sentence FROM (SELECT *, string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || {_US}, 'g'), {_US}) AS z FROM pe)),
ce AS (SELECT *, unnest(range(len(y))) AS clause_no, unnest(y) AS clause FROM (SELECT *, string_split(regexp_replace(sentence, '(?i)\\s+(?:and|but)\\s+(i\\s|my\\s|we\\s)', {_US} || '\\1', 'g'), {_US}) AS y FROM se)),
fc AS (SELECT conversation_id, turn_index, line_no, sentence_no, clause_no, substr(claim, 1, 300) AS claim FROM (SELECT *, regexp_replace(trim(clause), '\\.+$', '') AS claim FROM ce)
  WHERE length(claim) >= 10 AND NOT ends_with(claim, '?') AND NOT regexp_matches(claim, {X.quoted(extraction.OPINION_PREFIX)})),
fu AS (SELECT * FROM fc QUALIFY row_number() OVER (PARTITION BY conversation_id, turn_index, regexp_replace(lower(claim), '\\s+', ' ', 'g') ORDER BY line_no, sentence_no, clause_no) = 1),
fn AS (SELECT *, CAST(row_number() OVER (PARTITION BY conversation_id, turn_index ORDER BY line_no, sentence_no, clause_no) AS INTEGER) AS fact_no FROM fu QUALIFY fact_no <= 7),
ms AS (SELECT conversation_id, turn_index, fact_no, substr(sha256(conversation_id || '|' || turn_index || '|' || fact_no || '|' || claim), 1, 16) AS mu_id, turn_index * 100 + fact_no AS seq, claim,
  CASE WHEN {Q.speculative('claim')} THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence, {Q.claim_tokens('claim', W.DEDUP_STOP)} AS dw FROM fn),
gr AS (SELECT conversation_id, turn_index, fact_no, [dw] AS kept, [mu_id] AS ids FROM ms WHERE fact_no = 1
  UNION ALL SELECT m.conversation_id, m.turn_index, m.fact_no, CASE WHEN same THEN kept ELSE list_append(kept, dw) END, CASE WHEN same THEN ids ELSE list_append(ids, mu_id) END
  FROM (SELECT ms.*, gr.kept, gr.ids, len(list_filter(gr.kept, lambda k: {Q.jaccard('k', 'ms.dw')} >= 0.6)) > 0 AS same FROM gr JOIN ms ON ms.conversation_id = gr.conversation_id AND ms.turn_index = gr.turn_index AND ms.fact_no = gr.fact_no + 1) m),
kp AS (SELECT unnest(ids) AS mu_id FROM (SELECT ids FROM gr QUALIFY row_number() OVER (PARTITION BY conversation_id, turn_index ORDER BY fact_no DESC) = 1)),
cm AS (SELECT ms.* FROM ms JOIN kp USING (mu_id)), {K._rel('(SELECT conversation_id, mu_id, seq, claim, confidence FROM cm)')}, {K._REL_EDGES},
kn AS (SELECT mu_b_id AS mu_id FROM c WHERE relationship = 'same_fact' UNION SELECT b.mu_id FROM cm a JOIN cm b ON a.conversation_id = b.conversation_id AND a.seq < b.seq WHERE {Q.jaccard('a.dw', 'b.dw')} >= 0.85),
nw AS (SELECT * FROM cm WHERE mu_id NOT IN (SELECT mu_id FROM kn)),
ed AS (SELECT e.* FROM e WHERE source_mu_id IN (SELECT mu_id FROM nw) AND target_mu_id IN (SELECT mu_id FROM nw)),
gn AS (SELECT DISTINCT source_mu_id AS mu_id FROM ed JOIN nw a ON a.mu_id = source_mu_id JOIN nw b ON b.mu_id = target_mu_id WHERE edge_type = 'superseded_by' AND round(b.confidence + CAST(0.2 AS DOUBLE), 9) >= a.confidence)"""
K.ORACLES["bulk_ingest"] = f"{_BULK} SELECT conversation_id, mu_id, turn_index, claim, confidence, CASE WHEN mu_id IN (SELECT mu_id FROM gn) THEN 'archived' ELSE 'active' END AS status FROM nw"
K.ORACLES["bulk_edges"] = f"{_BULK} SELECT source_mu_id, target_mu_id, edge_type, weight FROM ed"


@query(f"{_BULK} SELECT conversation_id, turn_index, mu_id, seq, claim, confidence FROM cm")
def message_claims(spark, d):
    """Claims of every message without those like one kept before them."""
    return engine.batch_deduped(engine.staged(engine.message_claims(K._dialogue(spark, d)), "messages")).select("conversation_id", F.col("turn_index").cast("long").alias("turn_index"), "mu_id", F.col("seq").cast("long").alias("seq"), "claim", "confidence")


@query(f"""{_BULK} SELECT conversation_id, count(*) AS n_units, count(*) FILTER (mu_id NOT IN (SELECT mu_id FROM gn)) AS n_active, count(*) FILTER (mu_id IN (SELECT mu_id FROM gn)) AS n_archived FROM nw GROUP BY 1""")
def processed_memory(spark, d):
    """The memory after all messages went through the whole pipeline, from an empty start and with room for all."""
    after = engine.processed(store.empty_memory(spark), K._dialogue(spark, d), T.now(), lifecycle.Lifecycle(10**6))
    n = lambda status: F.count_if(F.col("status") == status)
    return after.units.groupBy("conversation_id").agg(F.count("*").alias("n_units"), n("active").alias("n_active"), n("archived").alias("n_archived"))


@query(f"""{_BULK}, lv AS (SELECT * FROM nw WHERE mu_id NOT IN (SELECT mu_id FROM gn)), act AS (SELECT conversation_id, count(*) AS n FROM lv GROUP BY 1)
SELECT conversation_id, CASE WHEN n / CAST(4 AS DOUBLE) >= 0.9 THEN least(n, 2) ELSE n END AS n_active FROM act""")
def held_to_capacity(spark, d):
    """Active units of a memory of four: what is over the target leaves, lowest salience first."""
    after = engine.processed(store.empty_memory(spark), K._dialogue(spark, d), T.now(), lifecycle.Lifecycle(4))
    return after.units.where("status = 'active'").groupBy("conversation_id").agg(F.count("*").alias("n_active"))


@query(f"""SELECT conversation_id, turn_index, substr(sha256(conversation_id || '|' || dia_id || '|' || trim(text)), 1, 16) AS mu_id, CAST(0.8 AS DOUBLE) AS importance, 'active' AS status
FROM {Q.turns()} WHERE length(trim(text)) >= 3 AND lower(speaker) NOT IN ('summary', 'system_summary')""")
def fast_ingested(spark, d):
    return engine.fast_ingest(K._turns(spark, d)).select("conversation_id", "turn_index", "mu_id", "importance", "status")


@query(f"SELECT conversation_id, dia_id, 'S0' AS session_id, CAST(1 AS INTEGER) AS session_no FROM {Q.turns()}")
def session_numbers(spark, d):
    return engine.sessions(K._turns(spark, d)).select("conversation_id", "dia_id", "session_id", "session_no")


@query(f"SELECT id, claim AS text FROM {K._TEXTS} WHERE contains(claim, '?') OR {K._ASKS}")
def routed_questions(spark, d):
    rows = K._texts(spark, d).withColumnRenamed("claim", "text")
    return engine.routed(rows, S.intent(F.col("text")))[0]


# ---- the store -------------------------------------------------------------------------------------------------------
_MEM = f"""(SELECT mu_id, conversation_id, claim, {Q.topic('claim')} AS topic, list_sort({Q.entities('claim')}) AS entities, dia_id, confidence, (length(claim) % 10) / CAST(10 AS DOUBLE) AS salience, CAST(length(claim) % 13 AS BIGINT) AS retrieval_count,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(seq) AS created_at, CASE WHEN length(claim) % 7 < 5 THEN 'active' WHEN length(claim) % 7 = 5 THEN 'archived' ELSE 'forgotten' END AS status, length(claim) AS n FROM {_SAID})"""
_LABEL, _ARCHIVE = ("'{0}_' || substr(sha256('{0}|' || mu_id), 1, 16)".format(x) for x in ("label", "archive"))
_PACKED = f"m AS {_MEM}, p AS (SELECT *, status = 'active' AND salience < 0.4 AS packed FROM m)"


def memory(spark, d) -> store.Memory:
    c, n = F.col("claim"), F.length("claim")
    rows = said(spark, d).withColumns({
        "topic": C.topic(c), "entities": F.array_sort(C.entities(c)), "source_dia_ids": F.array("dia_id"), "salience": (n % 10) / F.lit(10.0), "retrieval_count": (n % 13).cast("long"), "importance": F.lit(0.5),
        "created_at": F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("seq") * 3_600_000_000), "user_pinned": F.lit(False), "needs_reindex": F.lit(False),
        "status": F.when(n % 7 < 5, "active").when(n % 7 == 5, "archived").otherwise("forgotten"),
    })
    empty = store.empty_memory(spark)
    units = rows.select([(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.units.schema.fields])
    edges = K._said_edges(spark, d).drop("conversation_id")
    return empty._replace(units=units, edges=edges.select(empty.edges.columns))


def _low(m: store.Memory) -> DataFrame:
    return m.units.where("salience < 0.4").select("mu_id")


def _packed(spark, d) -> store.Memory:
    m = memory(spark, d)
    return store.compressed(m, _low(m), T.now())


_STATE = ["mu_id", "status", "compressed_label_id", "archived_entry_id"]


@query(f"WITH {_PACKED} SELECT mu_id, CASE WHEN packed THEN 'archived' ELSE status END AS status, CASE WHEN packed THEN {_LABEL} END AS compressed_label_id, CASE WHEN packed THEN {_ARCHIVE} END AS archived_entry_id FROM p")
def compressed_units(spark, d):
    return _packed(spark, d).units.select(_STATE)


@query(f"WITH {_PACKED} SELECT {_LABEL} AS label_id, {_ARCHIVE} AS archived_pointer, mu_id, topic, substr(claim, 1, 120) AS short_summary, entities AS key_entities, [dia_id] AS original_dia_ids, '' AS time_range FROM p WHERE packed")
def compression_labels(spark, d):
    return _packed(spark, d).labels.select("label_id", "archived_pointer", "mu_id", "topic", "short_summary", "key_entities", "original_dia_ids", "time_range")


@query(f"WITH {_PACKED} SELECT mu_id, {_ARCHIVE} AS archived_entry_id, claim, topic, confidence, status FROM p WHERE packed")
def archived_snapshots(spark, d):
    """The archive read back: the whole unit as it was."""
    return store.archived_units(_packed(spark, d).archives).select("mu_id", "archived_entry_id", "unit.claim", "unit.topic", "unit.confidence", "unit.status")


@query(f"WITH {_PACKED} SELECT mu_id, status = 'active' AS ok, CASE WHEN status <> 'active' THEN 'status is not active' END AS error FROM p WHERE salience < 0.4 UNION ALL SELECT 'nobody', false, 'unit not found'")
def compression_outcomes(spark, d):
    m = memory(spark, d)
    return store.compression_results(m, _low(m).unionByName(spark.createDataFrame([("nobody",)], "mu_id string")))


@query(f"WITH {_PACKED} SELECT mu_id, packed AS valid, CASE WHEN packed THEN 0 WHEN status <> 'archived' THEN 1 ELSE 2 END AS n_issues FROM p")
def verified_compression(spark, d):
    after = _packed(spark, d)
    return store.verified(after, after.units).select("mu_id", "valid", F.size("issues").alias("n_issues"))


@query(f"WITH {_PACKED} SELECT mu_id, CASE WHEN packed AND NOT n % 2 = 0 THEN 'archived' WHEN (packed OR status = 'archived') AND n % 2 = 0 THEN 'active' ELSE status END AS status, packed AND n % 2 <> 0 AS has_label, (packed OR status = 'archived') AND n % 2 = 0 AS needs_reindex FROM p")
def restored_units(spark, d):
    """Units of even length back from the archive, with their labels gone."""
    after = _packed(spark, d)
    after = store.restored(after, after.units.where(F.length("claim") % 2 == 0), T.now())
    marked = store.looked_up(after.labels.select("mu_id"), after.units.select("mu_id")).select("mu_id", F.col("found").alias("has_label"))
    return after.units.join(marked, "mu_id").select("mu_id", "status", "has_label", "needs_reindex")


@query(f"WITH m AS {_MEM} SELECT mu_id, CASE WHEN status = 'forgotten' AND n % 3 <> 0 THEN 'active' WHEN n % 3 = 0 THEN 'forgotten' ELSE status END AS status FROM m")
def forgotten_and_back(spark, d):
    """Units of every third length forgotten; of the others those that were forgotten come back."""
    m = memory(spark, d)
    third = F.length("claim") % 3 == 0
    m = store.restored_from_forgotten(m, m.units.where(~third), T.now())
    return store.forgotten(m, m.units.where(third), T.now()).units.select("mu_id", "status")


@query(f"WITH m AS {_MEM} SELECT mu_id, conversation_id, [dia_id] AS source_dia_ids, 'user' AS deleted_by FROM m WHERE n % 5 = 0")
def deletion_audit(spark, d):
    m = memory(spark, d)
    after = store.deleted(m, m.units.where(F.length("claim") % 5 == 0), T.now())
    return store.audit_log(after.audit).select("mu_id", "conversation_id", "source_dia_ids", "deleted_by")


@query(f"""WITH m AS {_MEM}, g AS (SELECT mu_id FROM m WHERE n % 5 = 0), {K._SAID_REL}, {K._REL_EDGES}
SELECT edge_type, count(*) AS n FROM e WHERE source_mu_id NOT IN (SELECT mu_id FROM g) AND target_mu_id NOT IN (SELECT mu_id FROM g) GROUP BY 1""")
def edges_after_deletion(spark, d):
    m = memory(spark, d)
    return graph.edge_counts(store.deleted(m, m.units.where(F.length("claim") % 5 == 0), T.now()).edges)


@query(f"WITH {_PACKED} SELECT mu_id, CASE WHEN packed THEN 'forgotten' ELSE status END AS status, CAST(NULL AS VARCHAR) AS compressed_label_id FROM p")
def decayed_units(spark, d):
    """Labels that nothing matched for 30 days take their units along."""
    later = F.lit("2024-04-01 00:00:00").cast("timestamp")
    return store.decayed(_packed(spark, d), later).units.select("mu_id", "status", "compressed_label_id")


@query(f"WITH {_PACKED}, h AS (SELECT * FROM p WHERE packed) SELECT {_LABEL} AS label_id, CAST(n % 3 AS BIGINT) AS retrieval_count, n % 3 > 0 AS matched FROM h")
def label_access(spark, d):
    after = _packed(spark, d)
    times = after.labels.join(after.units.select("mu_id", (F.length("claim") % 3).alias("k")), "mu_id").where("k > 0").select("label_id", F.explode(F.sequence(F.lit(1), "k")).alias("i"))
    hits = times.select("label_id", T.now().alias("ts"))
    return store.label_hits(after.labels, hits).select("label_id", "retrieval_count", F.col("last_label_match").isNotNull().alias("matched"))


@query(f"WITH m AS {_MEM} SELECT mu_id, true AS found, claim FROM m WHERE n % 4 = 0 UNION ALL SELECT 'nobody', false, NULL")
def looked_up_units(spark, d):
    units = memory(spark, d).units
    ids = units.where(F.length("claim") % 4 == 0).select("mu_id").unionByName(spark.createDataFrame([("nobody",)], "mu_id string"))
    return store.looked_up(units, ids).select("mu_id", "found", "claim")


@query(f"WITH {_PACKED} SELECT mu_id, CASE WHEN packed THEN 'compressed' ELSE 'archived' END AS status FROM p WHERE packed OR status = 'archived'")
def listed_layers(spark, d):
    return store.listed(_packed(spark, d).units, ["archived", "compressed"], layers=True).select("mu_id", "status")


@query(f"WITH m AS {_MEM} SELECT mu_id, n % 2 = 0 AS user_pinned, n % 3 = 0 AS needs_reindex, CASE WHEN n % 5 = 0 THEN 'archived' ELSE status END AS status FROM m")
def marked_units(spark, d):
    """Pins, marks for the index and plain status changes."""
    units = memory(spark, d).units
    at = lambda k: units.where(F.length("claim") % k == 0)
    marked = store.with_status(store.pinned(units, at(2)), at(5), "archived", T.now())
    marked = store.overlaid(marked, at(3).select("mu_id", F.lit(True).alias("needs_reindex")))
    kept = store.needing_reindex(marked).select("mu_id").withColumn("due", F.lit(True))
    return marked.join(kept, "mu_id", "left").select("mu_id", "user_pinned", F.coalesce("due", F.lit(False)).alias("needs_reindex"), "status")


@query(f"WITH m AS {_MEM}, u AS (SELECT mu_id FROM m WHERE n % 2 = 0 UNION ALL SELECT mu_id FROM m) SELECT mu_id, count(*) AS n FROM u GROUP BY 1 HAVING count(*) > 1")
def repeated_inserts(spark, d):
    units = memory(spark, d).units
    return store.repeated_ids(store.inserted(units, units.where(F.length("claim") % 2 == 0)))


@query(f"WITH {K._SAID_REL}, {K._REL_EDGES}, u AS {_SAID} SELECT source_mu_id AS mu_id, list_sort(list(claim)) AS replaced_by FROM e JOIN u ON u.mu_id = target_mu_id WHERE edge_type = 'superseded_by' GROUP BY 1")
def replacing_claims(spark, d):
    return store.replaced_by(said(spark, d), K._said_edges(spark, d))


@query(f"""WITH {K._SAID_REL}, {K._REL_EDGES}, w AS (SELECT source_mu_id, target_mu_id, edge_type, source_mu_id < target_mu_id AS there FROM e)
SELECT CASE WHEN there THEN 'edge_exists' ELSE 'created' END AS outcome, edge_type, count(*) AS n FROM w GROUP BY ALL
UNION ALL SELECT 'edge_failed', 'related_to', count(*) FROM {_SAID}""")
def edge_outcomes(spark, d):
    """Edges asked for again where their ends are in order, and a loop at every unit."""
    e = K._said_edges(spark, d).select("source_mu_id", "target_mu_id", "edge_type")
    loops = said(spark, d).select(F.col("mu_id").alias("source_mu_id"), F.col("mu_id").alias("target_mu_id"), F.lit("related_to").alias("edge_type"))
    e = engine.staged(e, "edges")
    return relations.edge_outcomes(e.unionByName(loops), e.where("source_mu_id < target_mu_id")).groupBy("outcome", "edge_type").agg(F.count("*").alias("n"))


@query(f"WITH {K._SAID_REL}, {K._REL_EDGES}, s AS (SELECT mu_id FROM {_SAID} WHERE length(claim) % 4 = 0) SELECT source_mu_id, target_mu_id, edge_type FROM e WHERE target_mu_id IN (SELECT mu_id FROM s) AND edge_type = 'superseded_by'")
def edges_to_units(spark, d):
    ids = said(spark, d).where(F.length("claim") % 4 == 0)
    return store.edges_at(K._said_edges(spark, d), ids, "target", "superseded_by").select("source_mu_id", "target_mu_id", "edge_type")


@query(f"WITH n AS (SELECT conversation_id, count(*) AS n FROM {_MEM} WHERE status = 'active' GROUP BY 1) SELECT conversation_id, n AS n_active FROM n WHERE n / CAST(6 AS DOUBLE) >= 0.9")
def conversations_due(spark, d):
    return lifecycle.due(memory(spark, d).units, lifecycle.Lifecycle(6))


# ---- indexes ---------------------------------------------------------------------------------------------------------
@query(f"""WITH u AS {_UNITS} SELECT mu_id, CASE WHEN length(claim) % 2 = 0 THEN claim || '!' ELSE claim END AS text FROM u WHERE status = 'active' AND length(claim) % 3 <> 0""")
def maintained_index(spark, d):
    """An index built of active units, some replaced, some removed, then compacted."""
    units = remembered(spark, d)
    at = index.rebuilt(units, F.col("claim"))
    even = units.where((F.length("claim") % 2 == 0) & (F.col("status") == "active")).select("mu_id", "conversation_id", F.concat("claim", F.lit("!")).alias("text"))
    at = index.upserted(at, even)
    at = index.removed(at, units.where(F.length("claim") % 3 == 0))
    return index.compacted(at).select("mu_id", "text")


@query(f"WITH u AS {_UNITS} SELECT mu_id, claim AS text FROM u WHERE status = 'active' AND length(claim) % 4 <> 1 OR length(claim) % 4 = 1 AND status = 'active'")
def synced_index(spark, d):
    """An index that was built too early, brought up to date with the units that ask for it."""
    units = remembered(spark, d).withColumn("needs_reindex", F.length("claim") % 4 == 1)
    old = index.rebuilt(units.where("NOT needs_reindex"), F.col("claim"))
    return index.compacted(index.synced(old, units, F.col("claim"))).select("mu_id", "text")


@query(f"""WITH qq AS (SELECT 'q:' || mu_id AS query_id, conversation_id, claim AS text FROM {_SAID} WHERE speaker = 'user'), uu AS {_UNITS}
SELECT query_id, CAST(rank AS INTEGER) AS rank, mu_id FROM {_near("(SELECT * FROM uu WHERE status = 'active' AND length(claim) % 3 <> 0)", 'claim', 5, 'x')}""")
def index_search(spark, d):
    """Search of an index that leaves out what was removed."""
    units = remembered(spark, d)
    at = index.removed(index.rebuilt(units, F.col("claim")), units.where(F.length("claim") % 3 == 0))
    asked = search.embedded(questions(spark, d), F.col("question"))
    return index.searched(at, asked, 5).select("query_id", "rank", "mu_id")


# ---- datasets, chunks, texts -----------------------------------------------------------------------------------------
@query(f"""SELECT 's' || conversation_id AS sample_id, conversation_id, 'session_1' AS session_id, CAST(turn_index AS INTEGER) AS turn_index, dia_id, speaker, text, '' AS timestamp FROM {Q.turns()}""")
def loaded_turns(spark, d):
    """Conversations written as JSON of the plainest shape, and read by the loader."""
    turn = F.struct("turn_index", "dia_id", "speaker", "text")
    said_ = K._turns(spark, d).groupBy("conversation_id").agg(F.array_sort(F.collect_list(turn)).alias("conversation"))
    items = said_.select(F.to_json(F.array(F.struct("conversation_id", F.concat(F.lit("s"), F.col("conversation_id")).alias("sample_id"), "conversation"))).alias("value"))
    return dialogues.parsed(items)[0]


@query(f"""SELECT conversation_id || '_qa_0' AS qa_id, conversation_id, trim(text) AS question, 'a b' AS answer, speaker AS category, [dia_id, 'D9'] AS gold_evidence_ids FROM {Q.turns()} WHERE turn_index = 0 AND trim(text) <> ''""")
def loaded_questions(spark, d):
    """Questions with answers as lists and evidence in one string, as datasets have them: one of each conversation's opening."""
    first = K._turns(spark, d).where("turn_index = 0")
    qa = F.array(F.struct(F.col("text").alias("question"), F.array(F.lit("a"), F.lit("b")).alias("answer"), F.concat("dia_id", F.lit("; D9 ")).alias("evidence"), F.col("speaker").alias("category")))
    items = first.select(F.to_json(F.array(F.struct("conversation_id", qa.alias("qa")))).alias("value"))
    return dialogues.parsed(items)[1]


@query(f"""SELECT role AS category, count(*) AS n FROM conversations WHERE turn = 0 GROUP BY 1 UNION ALL SELECT '(conversations)', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT '(turns)', count(*) FROM conversations""")
def dataset_statistics(spark, d):
    t = K._turns(spark, d)
    return dialogues.statistics(t, t.where("turn_index = 0").withColumnRenamed("speaker", "category"))


@query(f"""SELECT conversation_id, turn_index AS turn_index_start, [dia_id] AS dia_ids, '[Conversation: ' || conversation_id || ' | Session: S0 | Dialog IDs: ' || dia_id || ']' || chr(10) || speaker || ': ' || text AS text FROM {K._SPOKEN}""")
def chunk_turn(spark, d):
    return chunking.build_chunks(K._turns(spark, d), "turn").select("conversation_id", "turn_index_start", "dia_ids", "text")


@query(f"""SELECT conversation_id || '__session_summary__' || substr(sha1(conversation_id || '|session_summary|' || dia_id), 1, 8) AS chunk_id, turn_index AS turn_index_start,
'[Conversation: ' || conversation_id || ' | Session: S0 | Dialog IDs: ' || dia_id || ']' || chr(10) || 'summary: ' || text AS text FROM {Q.turns()}""")
def chunk_summaries(spark, d):
    """Every turn taken as a session's summary."""
    return chunking.build_chunks(K._turns(spark, d).withColumn("speaker", F.lit("summary")), "session_summary").select("chunk_id", "turn_index_start", "text")


@query(f"""WITH b AS (SELECT label, vec_id, 'D' || vec_id AS dia_id, coalesce(round({Q.dot('lag(embedding) OVER w', 'embedding')}, 9) < 0.65, false) AS brk FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
n AS (SELECT *, sum(CAST(brk AS INTEGER)) OVER (PARTITION BY label ORDER BY vec_id) AS k FROM b)
SELECT CAST(label AS VARCHAR) || '#semantic#' || min(vec_id) || '-' || max(vec_id) AS chunk_id, list(dia_id ORDER BY vec_id) AS dia_ids, string_agg('ann: ' || dia_id, chr(10) ORDER BY vec_id) AS text FROM n GROUP BY label, k""")
def chunk_semantic(spark, d):
    dia = F.concat(F.lit("D"), F.col("vec_id").cast("string"))
    rows = T.read(spark, d, "embeddings").select(F.col("label").cast("string").alias("conversation_id"), F.lit("S0").alias("session_id"), F.col("vec_id").alias("turn_index"), dia.alias("dia_id"), F.lit("ann").alias("speaker"), dia.alias("text"), F.lit("").alias("timestamp"), F.col("embedding").alias("vector"))
    return chunking.semantic_chunks(rows).select("chunk_id", "dia_ids", "text")


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) AS n_tokens,
CASE WHEN trim(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) = '' THEN 'empty' END AS error, len(list_distinct(regexp_extract_all(lower(t), '[{W.WORD}]+'))) AS n_words FROM t""")
def text_checks(spark, d):
    """Token counts, checks of input and distinct words of all documents."""
    t = F.coalesce("text", F.lit(""))
    return T.read(spark, d, "documents").select("doc_id", W.approx_tokens(t).cast("long").alias("n_tokens"), S.checked_text(t)["error"].alias("error"), F.size(W.all_tokens(t)).cast("long").alias("n_words"))


@query("SELECT doc_id, ['a', text] AS tags, [] :: VARCHAR[] AS none FROM documents WHERE text IS NOT NULL")
def json_lists(spark, d):
    rows = T.read(spark, d, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", W.json_list(F.to_json(F.array(F.lit("a"), "text"))).alias("tags"), W.json_list(F.col("text")).alias("none"))


@query(f"""WITH t AS (SELECT * FROM {Q.turns()} WHERE length(trim(text)) >= 10) SELECT conversation_id || ':' || turn_index AS chunk_id, trim(text) AS claim, speaker, dia_id AS source_dia_id FROM t
UNION ALL SELECT conversation_id || ':' || turn_index, 'plain ' || dia_id, NULL, NULL FROM t""")
def model_facts(spark, d):
    """Answers of a model in a code fence, with facts as objects and as bare strings, read back."""
    t = K._turns(spark, d).where(F.length(F.trim("text")) >= 10)
    fact = F.to_json(F.struct(F.trim("text").alias("claim"), "speaker", F.col("dia_id").alias("source_dia_id")))
    payload = F.concat(F.lit("```json\n{\"facts\": ["), fact, F.lit(", \"plain "), F.col("dia_id"), F.lit("\"]}\n```"))
    read = t.select(F.concat_ws(":", "conversation_id", F.col("turn_index").cast("string")).alias("chunk_id"), F.explode(extraction.parse_facts(payload)).alias("f"))
    return read.select("chunk_id", "f.claim", "f.speaker", "f.source_dia_id")


# ---- reports ---------------------------------------------------------------------------------------------------------
@query(f"""WITH t AS (SELECT *, lag(text) OVER (PARTITION BY conversation_id ORDER BY turn_index) AS prior FROM {Q.turns()}) SELECT count(*) AS n, round(avg(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))), 1) AS avg_input_tokens,
round(avg(len(list_filter(regexp_split_to_array(coalesce(prior, ''), '\\s+'), lambda w: w <> ''))), 1) AS avg_output_tokens, round(avg(turn_index), 2) AS avg_chunks FROM t""")
def usage_metrics(spark, d):
    prior = F.lag("text").over(Window.partitionBy("conversation_id").orderBy("turn_index"))
    rows = K._turns(spark, d).select(W.approx_tokens(F.col("text")).alias("input_tokens"), W.approx_tokens(F.coalesce(prior, F.lit(""))).alias("output_tokens"), F.col("turn_index").alias("n_chunks"))
    return evaluation.usage_metrics(rows)


@query(f"WITH u AS {_UNITS} SELECT conversation_id, list_sort(list(DISTINCT dia_id)) AS covered FROM u GROUP BY 1")
def covered_turns(spark, d):
    return evaluation.covered_turns(remembered(spark, d))


_PREDICTED = f"""(SELECT 'q:' || mu_id AS qa_id, conversation_id, substr(claim, 1, 50) AS question, claim AS gold_answer, substr(claim, 1, 20) AS predicted_answer, [dia_id] AS ids, (length(claim) % 10) / CAST(10 AS DOUBLE) AS f1 FROM {_SAID})"""


def predictions(spark, d) -> DataFrame:
    c = F.col("claim")
    return said(spark, d).select(F.concat(F.lit("q:"), F.col("mu_id")).alias("qa_id"), "conversation_id", F.substring(c, 1, 50).alias("question"), c.alias("gold_answer"), F.substring(c, 1, 20).alias("predicted_answer"), F.array("dia_id").alias("ids"), ((F.length(c) % 10) / F.lit(10.0)).alias("f1"))


@query(f"SELECT qa_id, conversation_id, substr(question, 1, 200) AS question, substr(gold_answer, 1, 200) AS gold_answer, predicted_answer, array_to_string(ids, '|') AS ids, f1 FROM {_PREDICTED} WHERE f1 < 0.3 AND predicted_answer <> ''")
def low_answers(spark, d):
    return sinks.failure_cases(predictions(spark, d), answered_only=True)


@query(f"SELECT qa_id, conversation_id, gold_answer, f1 FROM {_PREDICTED}")
def predictions_read_back(spark, d):
    """Predictions written as JSON and read again."""
    path = f"{sinks.scratch.shared_root(spark)}/predictions-{sinks.uuid.uuid4().hex}"
    sinks.write_predictions(predictions(spark, d), path)
    return dialogues.read_predictions(spark, path).select("qa_id", "conversation_id", "gold_answer", "f1")


@query("""WITH s AS (SELECT event_type AS name, CASE WHEN max(value) > 1000000 THEN 'unhealthy' WHEN avg(value) > 0 THEN 'healthy' ELSE 'degraded' END AS status FROM events GROUP BY 1)
SELECT CASE WHEN bool_and(status = 'healthy') THEN 'healthy' WHEN bool_or(status = 'unhealthy') THEN 'unhealthy' ELSE 'degraded' END AS status FROM s""")
def service_health(spark, d):
    status = F.when(F.max("value") > 1_000_000, "unhealthy").when(F.avg("value") > 0, "healthy").otherwise("degraded")
    return monitoring.health(T.read(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(status.alias("status")))


@query(f"""WITH {K._RECALL}, g2 AS (SELECT DISTINCT query_id, query_id % 10 AS conversation_id, category, unnest(gold) AS dia_id FROM g), k AS (SELECT DISTINCT vec_id % 10 AS conversation_id, vec_id % 20 AS dia_id FROM embeddings WHERE label % 2 = 0)
SELECT category, conversation_id, dia_id FROM g2 WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conversation_id = g2.conversation_id AND k.dia_id = g2.dia_id) QUALIFY row_number() OVER (ORDER BY category, conversation_id, dia_id, query_id) <= 50""")
def missing_evidence(spark, d):
    """The first fifty gold turns that no unit quotes."""
    rows = K._recall_rows(spark, d).withColumn("conversation_id", F.col("query_id") % 10)
    v = F.col("vec_id")
    covered = T.read(spark, d, "embeddings").where("label % 2 = 0").select((v % 10).alias("conversation_id"), (v % 20).alias("dia_id"))
    return evaluation.missing(rows, covered)


@query(f"""WITH h AS (SELECT query_id, rank, mu_id FROM {K._lane_sql(10)}) SELECT query_id AS qa_id, list(mu_id ORDER BY rank) AS top10 FROM h GROUP BY 1""")
def top_ten(spark, d):
    return evaluation.top_index(K._lane(spark, d, 10).withColumnRenamed("query_id", "qa_id"), "mu_id", 10)


@query(f"""WITH t AS (SELECT doc_id, text AS t FROM documents) SELECT doc_id, sha256(r) AS nested_sha256 FROM (SELECT doc_id, {K._REDACT} AS r FROM t)""")
def redacted_nested(spark, d):
    """Redaction of whatever holds text, at any depth."""
    rows = T.read(spark, d, "documents").select("doc_id", F.struct(F.array("text").alias("list"), F.lit(1).alias("n")).alias("box"))
    return S.redacted(rows).select("doc_id", F.sha2(F.col("box.list")[0], 256).alias("nested_sha256"))


@query(f"""WITH t AS {_DIALOGUE} SELECT 'chunk_' || conversation_id || '_' || turn_index AS id, substr(sha256('m|v1|' || sha256(text)), 1, 16) AS key, 'echo: ' || text AS content, turn_index % 2 = 0 AS hit FROM t""")
def cached_completions(spark, d):
    """A cache that answers every other request; the rest is asked for once."""
    from tidemark.plans import models

    t = K._dialogue(spark, d)
    asked = models.requests(t.select(F.concat_ws("_", F.lit("chunk"), "conversation_id", F.col("turn_index").cast("string")).alias("id"), F.col("text").alias("prompt"), "turn_index"), "m", "v1")
    even = engine.staged(asked.where("turn_index % 2 = 0"), "even")
    cache = models.stored(models.empty_cache(spark), even.select("key", F.to_json(F.struct(F.concat(F.lit("echo: "), "prompt").alias("content"))).alias("payload")))
    answers, _ = models.completions(asked, cache, "echo: {}".format)
    return asked.select("id", "key", (F.col("turn_index") % 2 == 0).alias("hit")).join(answers, "id").select("id", "key", "content", "hit")


@query(f"""WITH t AS (SELECT *, lead(text) OVER (PARTITION BY conversation_id ORDER BY turn_index) AS nxt FROM {Q.turns()}), x AS (SELECT conversation_id || ':' || turn_index AS qa_id, CASE WHEN turn_index % 2 = 0 THEN 'even' ELSE 'odd' END AS category,
(length(text) % 11) / CAST(10 AS DOUBLE) AS f1, length(text) % 11 = 10 AS em, (length(text) % 3) / CAST(2 AS DOUBLE) AS rec, (length(text) % 5) / CAST(4 AS DOUBLE) AS gs, length(text) % 4 > 0 AS ok, length(text) % 50 AS ms, length(text) % 6 AS n FROM t)
SELECT category, count(*) AS n, round(avg(f1), 4) AS avg_f1, round(avg(CAST(em AS INTEGER)), 4) AS avg_em, round(avg(rec), 4) AS avg_recall, round(avg(gs), 4) AS avg_grounding, round(avg(CAST(ok AS INTEGER)), 4) AS guard_pass_rate, round(avg(n), 2) AS avg_units,
round(avg(ms), 4) AS mean_ms FROM x GROUP BY category""")
def memory_run_metrics(spark, d):
    """Metrics of a run of the memory by category, over every turn as a prediction."""
    n = F.length("text")
    rows = K._turns(spark, d).select(
        F.when(F.col("turn_index") % 2 == 0, "even").otherwise("odd").alias("category"), ((n % 11) / F.lit(10.0)).alias("f1"), (n % 11 == 10).alias("exact_match"), ((n % 3) / F.lit(2.0)).alias("evidence_recall"),
        ((n % 5) / F.lit(4.0)).alias("grounding_score"), (n % 4 > 0).alias("passed"), (n % 50).cast("double").alias("total_ms"), (n % 6).alias("n_units"),
    )
    return evaluation.memory_metrics(rows, "category").select("category", "n", "avg_f1", "avg_em", "avg_recall", "avg_grounding", "guard_pass_rate", "avg_units", "mean_ms")
