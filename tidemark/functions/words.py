"""Tokenisers and token-set measures as Column expressions.

Python's word characters are letters, digits and the underscore of any script; Java's ``\\w`` is ASCII only, so the
classes are spelt out. Keyword patterns are bounded by the same classes instead of ``\\b``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: ASCII punctuation and the three stoplists, which differ on purpose -------------------------------
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
RETRIEVAL_STOP = (
    "a an the is are was were be been being have has had do does did will would could should may might shall to of in for on "
    "with at by from as into through about and or but not what when where who which how this that these those it its i you he "
    "she we they my your his her our their"
).split()
CLAIM_STOP = (
    "a an the and or but in on at to for of with by from as is are be been have has had do does did will would could should "
    "may might shall can i you he she it we they me him her us them my his its our your their that this these those what which "
    "who when where how so very just also then than more most"
).split()
DEDUP_STOP = "a an the and or in on at to for of with by as is are be was were user speaker i my me he she it they we".split()
ARTICLES = ["a", "an", "the"]
# ----------------------------------------------------------------------------------------------------------------------

WORD = r"\p{L}\p{N}_"


def bounded(alternatives: str) -> str:
    """A pattern that finds any alternative as whole words, without case."""
    return rf"(?iu)(?:^|[^{WORD}])(?:{alternatives})(?:$|[^{WORD}])"


def words(text: Column) -> Column:
    """Split at white space; no empty words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _without(tokens: Column, stop: list[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(stop))


def retrieval_tokens(text: Column) -> Column:
    """Lower case, ASCII punctuation deleted, stoplist dropped; repeats stay."""
    return _without(words(F.translate(F.lower(text), PUNCTUATION, "")), RETRIEVAL_STOP)


def _bare(text: Column) -> Column:
    return words(F.regexp_replace(F.lower(text), rf"[^{WORD}\s]", ""))


def claim_tokens(text: Column) -> Column:
    """Distinct words of a claim; negations stay."""
    return F.array_distinct(_without(_bare(text), CLAIM_STOP))


def dedup_tokens(text: Column) -> Column:
    return F.array_distinct(_without(_bare(text), DEDUP_STOP))


def all_tokens(text: Column) -> Column:
    """Distinct runs of word characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"[{WORD}]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct-token arrays; 0 for two empty ones."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def entity_overlap(a: Column, b: Column) -> Column:
    low = lambda x: F.array_distinct(F.transform(x, F.lower))
    return F.size(F.array_intersect(low(a), low(b)))


def normal_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    return F.array_join(_without(words(F.translate(F.lower(text), PUNCTUATION, "")), ARTICLES), " ")


def approx_tokens(text: Column) -> Column:
    """Count of white-space separated words."""
    return F.size(words(text))


def json_list(col: Column) -> Column:
    """A JSON list of strings; null, bad JSON and anything else give an empty list."""
    return F.coalesce(F.from_json(col, "array<string>"), F.array().cast("array<string>"))
