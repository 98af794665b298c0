"""Redaction, validation and routing of texts. All are Column expressions."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# ---- fixed values ----------------------------------------------------------------------------------------------------
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
API_KEY = r"(?i)sk-[a-z0-9-]{10,}"
INJECTION = r"(?i)ignore\s+(previous|all)\s+instructions|system\s*:\s*you\s+are|<\s*script\s*>|javascript\s*:|\x00"
CONVERSATION_ID = r"^[A-Za-z0-9_-]+$"
INPUT_CHARS, CHUNK_CHARS, ID_CHARS, DISPLAY_CHARS = 2000, 4000, 100, 200
DEFINITE_QUESTIONS = [
    "what ", "who ", "where ", "when ", "how ", "why ", "which ", "tell me ", "remind me ", "recall ", "retrieve ", "show me ", "find ",
    "search ", "look up ", "fetch ", "do i ", "did i ", "have i ", "am i ", "is my ", "was my ", "are my ", "were my ", "what's my", "what is my",
    "who is my", "where is my", "do you know", "do you remember", "what do you know", "list my", "list all", "give me ",
]
LIKELY_QUESTIONS = ["can you ", "could you ", "would you ", "is there ", "are there ", "do you ", "have you ", "was there ", "were there "]
# ----------------------------------------------------------------------------------------------------------------------


def redact(text: Column) -> Column:
    """E-mail addresses, phone and social security numbers replaced by tags; of an API key its first four characters stay."""
    text = F.regexp_replace(text, rf"({API_KEY[:4]}sk-[a-z0-9])[a-z0-9-]{{9,}}", "$1***")
    text = F.regexp_replace(text, EMAIL, "[EMAIL]")
    text = F.regexp_replace(text, PHONE, "[PHONE]")
    return F.regexp_replace(text, SSN, "[SSN]")


def redacted_value(col: Column, kind: DataType) -> Column:
    """``col`` with every text in it redacted, at any depth of arrays, structs and maps; keys of maps stay."""
    if isinstance(kind, StringType):
        return redact(col)
    if isinstance(kind, ArrayType):
        return F.transform(col, lambda x: redacted_value(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(col, lambda _, v: redacted_value(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(col.isNotNull(), F.struct(*[redacted_value(col[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return col


def redacted(rows: DataFrame) -> DataFrame:
    """Rows with every text in every column redacted."""
    return rows.select(*[redacted_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields])


def for_display(text: Column, most: int = DISPLAY_CHARS) -> Column:
    """Without control characters but tab, line feed and carriage return; cut with three dots. Null gives an empty text."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]", "")
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("..."))).otherwise(clean)


def checked_text(text: Column, most: int = INPUT_CHARS) -> Column:
    """A struct (value, error): trimmed and cut to ``most``; null, blank and NUL-holding texts give an error."""
    value = F.substring(F.regexp_replace(text, r"^\s+|\s+$", ""), 1, most)
    error = F.when(text.isNull(), "none").when(value == "", "empty").when(value.contains("\x00"), "invalid")
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def is_safe(text: Column) -> Column:
    """No sign of an injected prompt."""
    return ~text.rlike(INJECTION)


def checked_id(conversation_id: Column) -> Column:
    """A struct (value, error) like :func:`checked_text` for conversation ids."""
    value = F.trim(conversation_id)
    error = F.when(F.coalesce(conversation_id, F.lit("")) == "", "required").when(F.length(value) > ID_CHARS, "long").when(~value.rlike(CONVERSATION_ID), "invalid")
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def intent(text: Column, said: Column | None = None) -> Column:
    """``question`` or ``statement``: a question mark anywhere, a sure beginning, what a model said, then a likely beginning.

    ``said`` is a model's answer, null where it gave none; it decides if it names one of the two.
    """
    low = F.lower(F.trim(text))
    starts = lambda words: reduce(lambda a, w: a | low.startswith(w), words, F.lit(False))
    word = F.lower(F.trim(said)) if said is not None else F.lit(None).cast("string")
    likely = F.when(starts(LIKELY_QUESTIONS), "question").otherwise("statement")
    return F.when(text.contains("?") | starts(DEFINITE_QUESTIONS), "question").when(word.isin("question", "statement"), word).otherwise(likely)


# ---- on the driver
def masked_key(key: str | None) -> str:
    """A key for logs: its first four characters, or nothing of a short one."""
    return f"{key[:4]}***" if key and len(key) > 8 else "***"


def within(base: str, path: str) -> bool:
    """Whether a path stays inside a folder once all links and dots are resolved."""
    root = Path(base).resolve()
    return root in (Path(base) / path).resolve().parents or (Path(base) / path).resolve() == root
