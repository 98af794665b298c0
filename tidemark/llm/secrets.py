"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Base patterns give the certain spans. The method weighs every candidate value by how many distinct owners and
repositories hold it: a value in many of either is a copied example, one that a single owner holds in few repositories
looks live. Long mixed tokens outside the base spans, parts of URLs apart, are candidates too, and become spans of kind
``owned`` only where their value looks live. Values are compared as hashes; those with most rows are judged where they
are read, so a value that a third of all rows hold is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import hot_join, possible, staged, text_key

# fixed values: the base patterns
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Least length of an assigned value.
ASSIGNED = 6
#: Long tokens that may be credentials of no known shape: mixed case and digits, not after ``:`` or ``.`` as within a URL.
LONG_TOKEN = r"(?<![A-Za-z0-9+/_.:-])[A-Za-z0-9+/_-]{20,}"
MIXED = r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"
#: Owners, and repositories, from which on a value counts as a widely copied example.
WIDE, WIDE_REPOSITORIES = 3, 3
#: Matches whose places are added up at a time.
RUN = 256
MASK = "[SECRET]"
KINDS = ["assign", "access", "hex", "owned"]
SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def found_spans(text: Column, pattern: str, kind: int, group: int = 0, like: str | None = None) -> Column:
    """Spans of all leftmost non-overlapping matches, in code points; ``value`` is the hash of the match or its group.

    One pass puts marks around the matches; the pieces between marks give the places, added up in runs, so that a text with
    very many matches takes no time with the square of their number. Matches whose value is not ``like`` are left out.
    """
    mark, least = "\x01", ASSIGNED if group else 0
    # a mark that the text itself holds becomes another character that no pattern names
    pieces = F.split(F.regexp_replace(F.translate(text, mark, "\x02"), F.lit(pattern), F.lit(f"{mark}$0{mark}${group}{mark}")), mark, -1)
    none = F.array().cast(f"array<{SPAN}>")

    def lengths(p: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / 3).cast("int") - 1)
        value = lambda i: F.get(p, 3 * i + 2)
        good = lambda i: (F.length(value(i)) >= least) & (value(i).rlike(like) if like else F.lit(True))
        return F.transform(numbers, lambda i: F.struct(F.length(F.get(p, 3 * i)).alias("gap"), F.length(F.get(p, 3 * i + 1)).alias("long"), F.when(good(i), F.sha2(value(i), 256)).alias("value")))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + part["gap"]
        stop = begin + part["long"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), part["value"].alias("value"))
        return F.struct(stop.alias("at"), F.when(part["value"].isNotNull(), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def placed(parts: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("runs"))
        runs = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int"))

        def run(state: Column, r: Column) -> Column:
            done = F.aggregate(F.slice(parts, r * RUN + 1, F.lit(RUN)), F.struct(state["at"].alias("at"), none.alias("spans")), step)
            return _with(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["runs"], F.array(d["spans"])).alias("runs")))

        return F.flatten(F.aggregate(runs, begin, run, lambda s: s["runs"]))

    # texts without a match skip the rest
    return F.when(text.rlike(pattern), _with(_with(pieces, lengths), placed)).otherwise(none)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in their order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _owners(docs: DataFrame) -> tuple[Column, Column]:
    source, lang = (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in ("source", "lang"))
    return source, F.concat_ws("/", source, lang)


def _judged(rows: DataFrame, wide: int, wide_repositories: int) -> DataFrame:
    """Rows (id, text, owner, repository) as ``id, base, places, n_live, n_examples, n_repositories``."""
    text = F.col("text")
    base = F.array_sort(F.concat(found_spans(text, ASSIGN, 0, group=2), found_spans(text, ACCESS, 1), found_spans(text, HEX, 2)))
    inside = lambda s, others: F.exists(others, lambda o: (o["start"] < s["stop"]) & (s["start"] < o["stop"]))
    found = staged(
        rows.withColumns({"base": base, "long": found_spans(text, LONG_TOKEN, 3, like=MIXED)})
        .withColumn("more", F.filter("long", lambda s: ~inside(s, F.col("base"))))
        .select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repository", "base", "more"),
        "secrets",
    )
    candidates = found.where((F.size("base") > 0) | (F.size("more") > 0)).select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("span"))
    value = F.col("span.value").alias("value")
    held = candidates.groupBy(value, "owner", "repository").agg(F.count("*").alias("n"))
    frequency = staged(held.groupBy("value").agg(F.countDistinct("owner").alias("n_owners"), F.count("*").alias("n_repositories"), F.sum("n").alias("n")), "frequency")
    judged = hot_join(candidates.select("row", "span", value), frequency, "value", "n")
    live = (F.col("n_owners") == 1) & (F.col("n_repositories") < wide_repositories)
    added = (F.col("span.kind") == 3) & live
    stays = (F.col("span.kind") < 3) | added
    verdicts = judged.groupBy("row").agg(
        F.collect_list(F.when(added, F.col("span"))).alias("owned"),
        F.count_if(stays & live).alias("n_live"),
        F.count_if(stays & ((F.col("n_owners") >= wide) | (F.col("n_repositories") >= wide_repositories))).alias("n_examples"),
        F.max(F.when(stays, F.col("n_repositories"))).alias("n_repositories"),
    )
    places = F.array_sort(F.concat("base", F.coalesce("owned", F.array().cast(f"array<{SPAN}>"))))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_live", "n_examples", "n_repositories")]
    return found.join(verdicts, "row", "left").select("id", "base", places.alias("places"), *counts)


def scan_secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, wide: int = WIDE, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """One row per document.

    ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_examples, n_repositories, places``. ``n_live``
    counts spans whose value one owner holds in fewer than ``wide_repositories`` repositories, ``n_examples`` those whose
    value at least ``wide`` owners or so many repositories hold; ``n_repositories`` is the most repositories that hold a
    value of the document, 0 without spans; ``places`` is the array of all spans (start, kind number, stop, hash of the
    value). Owner and repository default to ``source`` and to ``source/lang``, a repository belongs to its owner; where
    they are null the row counts as an owner named by the empty string. A null text counts as
    empty: it has no spans, and ``base_sha256`` is that of the empty string. Repeated rows each get their result; they
    add no owners. An empty table gives an empty result.
    """
    by_source, by_section = _owners(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        (by_source if owner is None else F.coalesce(owner.cast("string"), F.lit(""))).alias("owner"),
        (by_section if repository is None else F.coalesce(repository.cast("string"), F.lit(""))).alias("repository"),
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return _judged(rows, wide, wide_repositories).select(
        F.col("id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("places")).alias("spans"),
        (F.size("places") - F.size("base")).cast("long").alias("n_owned"),
        "n_live",
        "n_examples",
        "n_repositories",
        "places",
    )


def masked(text: Column, places: Column, mask: str = MASK) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        done = F.when(span["start"] >= state["at"], F.concat(state["done"], gap, F.lit(mask))).otherwise(state["done"])
        return F.struct(F.greatest(state["at"], span["stop"]).alias("at"), done.alias("done"))

    return F.aggregate(places, start, step, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.lit(2**31 - 1))))


def mask_secrets(docs: DataFrame, wide: int = WIDE, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """``docs`` with all secrets masked and ``n_chars``, if there, brought up to date.

    Spans are a matter of the text alone once ownership is counted, so they are brought back by the text's hash: rows
    without doc_id and repeated rows are masked like any other. Only rows that may have a secret are shuffled. Null texts
    stay null. No documents, no rows.
    """
    source, section = _owners(docs)
    rows = docs.select(text_key().alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), source.alias("owner"), section.alias("repository"))
    found = _judged(rows, wide, wide_repositories).where(F.size("places") > 0)
    places = staged(found.groupBy(F.col("id").alias("h")).agg(F.first("places").alias("places"), F.count("*").alias("n")), "places")
    keyed = docs.select(F.struct("*").alias("row"), text_key().alias("h"))
    maybe, sure = possible(keyed, F.xxhash64("h"), places.select(F.xxhash64("h").alias("key")))
    out = hot_join(maybe, places, "h", "n", "left")
    hit, text = F.col("places").isNotNull(), masked(F.col("row.text"), F.col("places"))
    new = {"text": F.when(hit, text).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    changed = out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
    return changed.unionByName(sure.select("row.*"))


def _matches_sql(kind: int, pattern: str, group: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT row, owner, repository, {kind} AS kind, unnest(range(len(regexp_split_to_array(text, {quoted})))) AS i, unnest(regexp_split_to_array(text, {quoted})) AS gap,
      unnest(regexp_extract_all(text, {quoted}, 0)) AS m, unnest(regexp_extract_all(text, {quoted}, {group})) AS v FROM t"""


# RE2 has no lookbehind; the leftmost match of a long run starts at its beginning anyway, after the last character of the gap
ORACLE_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat_ws('/', coalesce(source, ''), coalesce(lang, '')) AS repository FROM documents),
m AS ({" UNION ALL ".join([_matches_sql(0, ASSIGN, 2), _matches_sql(1, ACCESS, 0), _matches_sql(2, HEX, 0), _matches_sql(3, LONG_TOKEN[LONG_TOKEN.index(")") + 1 :], 0)])}),
p AS (
  SELECT *, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY row, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM m WINDOW w AS (PARTITION BY row, kind ORDER BY i)),
s AS (SELECT row, owner, repository, kind, v, start, start + length(m) AS stop FROM p WHERE m IS NOT NULL AND length(v) >= CASE kind WHEN 0 THEN {ASSIGNED} ELSE 0 END AND NOT (kind = 3 AND regexp_matches(gap, '[.:]$'))),
c AS (
  SELECT * FROM s WHERE kind < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM s b WHERE b.row = s.row AND b.kind < 3 AND b.start < s.stop AND s.start < b.stop))),
f AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM c GROUP BY v),
k AS (SELECT c.*, owners, repositories, owners = 1 AND repositories < {WIDE_REPOSITORIES} AS live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS said FROM c JOIN f USING (v) WHERE kind < 3 OR (owners = 1 AND repositories < {WIDE_REPOSITORIES})),
g AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_owned,
    count(*) FILTER (live) AS n_live, count(*) FILTER (owners >= {WIDE} OR repositories >= {WIDE_REPOSITORIES}) AS n_examples, max(repositories) AS n_repositories,
    string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY start, kind) AS spans
  FROM k GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples, coalesce(n_repositories, 0) AS n_repositories
FROM t LEFT JOIN g USING (row)
"""
