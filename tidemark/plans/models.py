"""Calls to language models as a lookup with a fallback: a cache table first, then a backend for what it lacks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.monitoring import cache_key, with_cache

CACHE = "key string, payload string"
TRIES, FIRST_WAIT, LONGEST_WAIT = 3, 0.5, 8.0


class Backend(Protocol):
    """What answers a prompt; anything callable so does, an HTTP client or a stub alike."""

    def __call__(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class Client:
    """Providers by name, each with the backend that speaks for it, and one model and temperature.

    The key of an answer covers provider, model, temperature and the whole prompt, so a cache may serve many clients.
    """

    backends: dict[str, Backend]
    provider: str
    model: str
    temperature: float = 0.0

    def __post_init__(self):
        if self.provider not in self.backends:
            raise ValueError(f"unknown provider {self.provider!r}; known: {', '.join(sorted(self.backends))}")

    def requests(self, prompts: DataFrame) -> DataFrame:
        return requests(prompts, f"{self.provider}/{self.model}", repr(float(self.temperature)))

    def generate(self, prompts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(answers, new cache entries)`` of prompts (id, prompt)."""
        return completions(self.requests(prompts), cache, self.backends[self.provider])


def empty_cache(spark) -> DataFrame:
    return spark.createDataFrame([], CACHE)


def stored(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with entries (key, payload); keys that it has are replaced."""
    new = entries.select("key", "payload").dropDuplicates(["key"])
    return cache.join(new, "key", "left_anti").select("key", "payload").unionByName(new)


def without(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The cache without some keys."""
    return cache.join(keys.select("key"), "key", "left_anti").select("key", "payload")


def sound(cache: DataFrame) -> DataFrame:
    """The cache without entries that can't be read."""
    return cache.where(F.get_json_object("payload", "$.content").isNotNull())


def requests(prompts: DataFrame, model: str, template: str) -> DataFrame:
    """Prompts (id, prompt) with their cache key."""
    return prompts.withColumn("key", cache_key(F.lit(model), F.lit(template), F.col("prompt")))


def completions(asked: DataFrame, cache: DataFrame, backend: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """``(answers, new cache entries)`` of requests (id, key, prompt).

    ``backend`` is called once for each distinct missing key, on the executors, with retries; a call that fails for good
    gives a null answer and no entry.
    """

    def call(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = []
            for prompt in pdf["prompt"]:
                answer, wait = None, FIRST_WAIT
                for left in range(TRIES - 1, -1, -1):
                    try:
                        answer = backend(prompt)
                        break
                    except Exception:
                        if left:
                            time.sleep(wait)
                            wait = min(2 * wait, LONGEST_WAIT)
                out.append(None if answer is None else json.dumps({"content": answer}))
            yield pdf[["key"]].assign(payload=out)

    known = with_cache(asked, cache)
    missing = known.where(~F.col("hit")).select("key", "prompt").dropDuplicates(["key"])
    new = missing.mapInPandas(call, "key string, payload string").where("payload IS NOT NULL")
    return known.drop("content", "hit").join(cache.unionByName(new), "key", "left").select("id", F.get_json_object("payload", "$.content").alias("content")), new
