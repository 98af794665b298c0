"""Our own sentences, one or more for each branch of the keyword rules; the tables' invented words match none of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: mu_id, conversation_id, seq, claim, confidence
CLAIMS = [
    ("a1", "ann", 1, "Ann works at Globex in Paris", 0.9), ("a2", "ann", 2, "Ann no longer works at Globex in Paris", 0.9), ("a3", "ann", 3, "Ann joined Initech as an engineer", 0.6),
    ("a4", "ann", 4, "Ann lives in Lyon", 0.9), ("a5", "ann", 5, "Ann lives in Lyon now with a cat", 0.5), ("a6", "ann", 6, "Ann moved to Berlin", 0.9), ("a7", "ann", 7, "Ann previously lived in Madrid", 0.7),
    ("a8", "ann", 8, "Ann enjoys long walks", 0.9), ("a9", "ann", 9, "The weather was grey", 0.9), ("a10", "ann", 10, "Ann enjoys long walks", 0.9), ("a11", "ann", 11, "Ann left for Oslo", 0.9),
    ("b1", "ben", 1, "Ben is married to Cleo", 0.9), ("b2", "ben", 2, "Ben got divorced last year", 0.35), ("b3", "ben", 3, "Ben is now dating Dora", 0.8), ("b4", "ben", 4, "Maybe Ben will buy a car", 0.35),
    ("b5", "ben", 5, "Ben bought a car in 2021 for $4000", 0.9), ("b6", "ben", 6, "Ben thinks the car is slow", 0.9), ("b7", "ben", 7, "Ben graduated from college in May", 0.9),
    ("b8", "ben", 8, "Does Ben like jazz?", 0.35), ("b9", "ben", 9, "Ben plans to travel to Rome if it is warm", 0.35), ("b10", "ben", 10, "Ben had surgery at the hospital", 0.9),
    ("b11", "ben", 11, "Ben said that IBM and NASA called on 12/05/2023", 0.9), ("b12", "ben", 12, "Ben grew up in a small hometown", 0.9), ("b13", "ben", 13, "Ben is not fond of the slow car", 0.9),
    ("c1", "cy", 1, "été à l'île, x_1 is calm", 0.9), ("c2", "cy", 2, "été à l'île, x_1 is very calm", 0.9), ("c3", "cy", 3, "नमस्ते 😀 friend", 0.9), ("c4", "cy", 4, "'; DROP TABLE units; --", 0.9),
    ("c5", "cy", 5, "", 0.9), ("c6", "cy", 6, "Cy works for Acme Corp as a manager", 0.9), ("c7", "cy", 7, "Cy works for Umbrella Ltd as a scientist", 0.9), ("c8", "cy", 8, "Cy does not love music", 0.9), ("c9", "cy", 9, "Cy loves music", 0.9),
]
CLAIM_COLUMNS = "mu_id string, conversation_id string, seq int, claim string, confidence double"
#: query_id, answer, claims shown as evidence, whether they conflict
ANSWERS = [
    (1, "Ann lives in Lyon", ["Ann lives in Lyon", "Ann moved to Berlin"], True), (2, "No information available.", ["Ann lives in Lyon"], False), (3, "", [], False), (4, "Paris", [], False),
    (5, "Records conflict: Lyon or Berlin", ["Ann lives in Lyon", "Ann moved to Berlin"], True), (6, "Zanzibar trams glow", ["Ben bought a car in 2021"], False), (7, "Ben bought the car", ["Ben bought a car in 2021"], False),
]


def claims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLAIMS, CLAIM_COLUMNS)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def claims_sql() -> str:
    rows = ", ".join(f"({quoted(a)}, {quoted(b)}, {c}, {quoted(d)}, CAST({e} AS DOUBLE))" for a, b, c, d, e in CLAIMS)
    return f"(SELECT * FROM (VALUES {rows}) AS t(mu_id, conversation_id, seq, claim, confidence))"


def answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANSWERS, "query_id int, answer string, shown array<string>, conflicted boolean")


def answers_sql() -> str:
    rows = ", ".join(f"({q}, {quoted(a)}, [{', '.join(map(quoted, s))}]::VARCHAR[], {c})" for q, a, s, c in ANSWERS)
    return f"(SELECT * FROM (VALUES {rows}) AS t(query_id, answer, shown, conflicted))"
