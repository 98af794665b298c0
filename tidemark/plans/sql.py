"""Pieces of DuckDB SQL with the meaning of the library's expressions, for the checks of its queries."""

from __future__ import annotations

from tidemark.functions import claims as C
from tidemark.functions import words as W
from tidemark.plans.fixtures import quoted


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern.replace('(?iu)', '(?i)'))})"


def _split(text: str, stop: list[str]) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '' AND NOT list_contains({listed(stop)}, w))"


def retrieval_tokens(text: str) -> str:
    return _split(f"translate(lower({text}), {quoted(W.PUNCTUATION)}, '')", W.RETRIEVAL_STOP)


def claim_tokens(text: str, stop: list[str] | None = None) -> str:
    bare = f"regexp_replace(lower({text}), '[^{W.WORD}\\s]', '', 'g')"
    return f"list_distinct({_split(bare, W.CLAIM_STOP if stop is None else stop)})"


def normal_words(text: str) -> str:
    return _split(f"translate(lower({text}), {quoted(W.PUNCTUATION)}, '')", W.ARTICLES)


def jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE), 0), 0)"


def topic(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {matches(text, W.bounded(p))} THEN '{t}'" for t, p in C.TOPICS.items()) + f" ELSE '{C.GENERAL}' END"


def importance(text: str) -> str:
    tiers = ((C.HIGH, 0.85), (C.MEDIUM, 0.55), (C.LOW, 0.30))
    return "CASE " + " ".join(f"WHEN {matches(text, W.bounded(p))} THEN CAST({v} AS DOUBLE)" for p, v in tiers) + " ELSE CAST(0.45 AS DOUBLE) END"


def speculative(text: str) -> str:
    return f"({matches(text, C.HEDGE_RE)} OR regexp_matches({text}, '\\?\\s*$'))"


def ascii_words(text: str) -> str:
    """Letters beyond ASCII as underscores, since RE2 doesn't take them for word characters."""
    return f"regexp_replace({text}, '[^\\x00-\\x7F]', '_', 'g')"


def entities(text: str) -> str:
    found = f"regexp_extract_all({ascii_words(text)}, '(^|[^.!?\\n\\w])([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*|[A-Z]{{2,}})\\b', 2)"
    return f"list_distinct(list_filter({found}, lambda w: length(w) >= 2 AND NOT list_contains({listed(dict.fromkeys(C.NOT_ENTITIES))}, w)))"


def dot(a: str, b: str) -> str:
    return f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def candidate(text: str) -> dict[str, str]:
    t = f"coalesce({text}, '')"
    words = f"list_filter(regexp_extract_all({t}, '[{W.WORD}]+'), lambda w: regexp_matches(w, '^[a-zA-Z]+$'))"
    count = lambda values: f"len(list_filter({words}, lambda w: list_contains({listed(values)}, lower(w))))"
    n, low = f"len({words})", f"lower(trim({t}))"
    capital = f"len(list_filter(regexp_extract_all({ascii_words(t)}, '\\b[A-Z][a-zA-Z''-]+\\b'), lambda w: NOT list_contains({listed(C.CAPITAL_STARTERS)}, w)))"
    opinions = f"len(list_filter(regexp_split_to_array({low}, '\\s+'), lambda w: list_contains({listed(C.OPINIONS)}, trim(w, '.,!'))))"
    starts = " OR ".join(f"starts_with({low}, {quoted(s)})" for s in C.QUESTION_STARTERS)
    d = "CAST({} AS DOUBLE)".format
    return {
        "entity": f"least(1.0, {d(capital)} / 3.0)",
        "verbs": f"CASE WHEN {n} > 0 THEN least(1.0, {d(count(C.ACTION_VERBS))} / {n} * 8.0) ELSE 0.0 END",
        "factual": f"CASE WHEN trim({t}) = '' OR ends_with(trim({t}), '?') OR {starts} THEN 0.0 ELSE greatest(0.0, 1.0 - {d(opinions)} * 0.3) END",
        "markers": f"least(1.0, {d(count(C.TOPIC_MARKERS))} / 2.0)",
        "length": f"CASE WHEN {n} < 5 THEN 0.0 WHEN {n} < 30 THEN {d(n)} / 30.0 WHEN {n} <= 150 THEN 1.0 WHEN {n} <= 300 THEN 1.0 - ({d(n)} - 150) / 150.0 ELSE 0.0 END",
        "number": f"CASE WHEN {matches(t, C.NUMBER_RE)} THEN 1.0 ELSE 0.0 END",
    }


def turns() -> str:
    return "(SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 'S0' AS session_id, turn AS turn_index, 'D' || turn AS dia_id, role AS speaker, text, '' AS timestamp FROM conversations)"


def event_units() -> str:
    return """(SELECT event_id AS mu_id, user_id AS conversation_id, event_id AS seq, ts AS created_at,
      CASE WHEN event_id % 3 <> 0 THEN ts + to_hours(event_id % 40) END AS last_accessed, event_id % 13 AS retrieval_count,
      round(value / (value + 20.0), 4) AS importance, round(CAST(0.3 AS DOUBLE) + (event_id % 7) / CAST(10 AS DOUBLE), 4) AS confidence, event_id % 17 = 0 AS user_pinned,
      CASE WHEN event_id % 11 < 8 THEN 'active' WHEN event_id % 11 < 10 THEN 'archived' ELSE 'forgotten' END AS status,
      CASE WHEN event_id % 11 = 8 THEN 'label_' || event_id END AS compressed_label_id FROM events)"""


def event_edges() -> str:
    return """(SELECT lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS source_mu_id, event_id AS target_mu_id,
      CASE event_id % 4 WHEN 0 THEN 'superseded_by' WHEN 1 THEN 'conflicts_with' ELSE 'related_to' END AS edge_type FROM events
      QUALIFY source_mu_id IS NOT NULL)"""


NOW = "TIMESTAMP '2024-02-10 00:00:00'"


def salience(penalty: str = "0.0") -> str:
    idle = f"greatest(0.0, (epoch_us({NOW}) - epoch_us(coalesce(last_accessed, created_at, {NOW}))) / CAST(86400000000 AS DOUBLE))"
    stability = "(CAST(2 AS DOUBLE) * pow(2.0, least(retrieval_count, 10)))"
    total = f"CAST(0.6 AS DOUBLE) * exp(-{idle} / {stability}) + CAST(0.4 AS DOUBLE) * greatest(0.0, least(1.0, importance)) - greatest(0.0, least(CAST(0.4 AS DOUBLE), coalesce({penalty}, 0.0)))"
    return f"round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {total})), 4)"


def penalties(edges: str) -> str:
    has = lambda kind, cost: f"max(CASE WHEN edge_type = '{kind}' THEN CAST({cost} AS DOUBLE) ELSE 0 END)"
    return f"(SELECT source_mu_id AS mu_id, least({has('superseded_by', 0.30)} + {has('conflicts_with', 0.10)}, CAST(0.4 AS DOUBLE)) AS penalty FROM {edges} GROUP BY 1)"


def bm25(docs: str, queries: str, scope: str | None = None) -> str:
    """CTEs ending in ``s`` (query_id, doc_id, score); docs (doc_id, text), queries (query_id, text), both with the scope."""
    g = f"{scope}, " if scope else ""
    on = lambda *pairs: " AND ".join([f"{a}.{scope} = {b}.{scope}" for a, b in pairs] if scope else ["true"])
    group = f"GROUP BY {scope}" if scope else ""
    return f"""
    d AS (SELECT {g}doc_id, {retrieval_tokens('text')} AS w FROM {docs}),
    q AS (SELECT {g}query_id, {retrieval_tokens('text')} AS w FROM {queries}),
    n AS (SELECT {g}count(*) AS n, avg(len(w)) AS avgdl FROM d {group}),
    df AS (SELECT {g}term, count(*) AS df FROM (SELECT {g}unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL),
    i0 AS (SELECT df.*, ln(n.n - df + 0.5) - ln(df + 0.5) AS idf FROM df JOIN n ON {on(('df', 'n'))}),
    m AS (SELECT {g}avg(idf) AS mean FROM i0 {group}),
    i AS (SELECT i0.* REPLACE (CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf) FROM i0 JOIN m ON {on(('i0', 'm'))}),
    qt AS (SELECT {g}query_id, term, count(*) AS times FROM (SELECT {g}query_id, unnest(w) AS term FROM q) GROUP BY ALL),
    tf AS (SELECT {g}doc_id, dl, term, count(*) AS tf FROM (SELECT {g}doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
    s AS (SELECT qt.query_id, tf.doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM tf JOIN qt ON tf.term = qt.term AND {on(('tf', 'qt'))} JOIN i ON tf.term = i.term AND {on(('tf', 'i'))} JOIN n ON {on(('tf', 'n'))}
      GROUP BY ALL)"""
