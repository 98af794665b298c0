"""The engine's upkeep as Structured Streaming: extensions of batch operators to event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans import engine


def access_counts(accesses: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """``window, mu_id, n, last_ts`` of an access stream (mu_id, ts), in event time."""
    return accesses.withWatermark("ts", late).groupBy(F.window("ts", every), "mu_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def rate(events: DataFrame, key: str = "user_id", late: str = "1 minute", size: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """Events of a key in sliding windows: what a rate limiter looks at, by steps rather than at each event."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), key).agg(F.count("*").alias("n"))


def first_seen(messages: DataFrame, text: Column, late: str = "1 day") -> DataFrame:
    """Messages without exact repeats of a conversation within the watermark."""
    keyed = messages.withColumn("_key", F.sha2(F.lower(F.trim(text)), 256)).withWatermark("ts", late)
    return keyed.dropDuplicatesWithinWatermark(["conversation_id", "_key"]).drop("_key")


def ingest(turns: DataFrame, write: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, known: Callable[[int], DataFrame | None] | None = None) -> StreamingQuery:
    """Each micro-batch of turns ingested in bulk; ``write`` gets its units, edges and number, and must be idempotent in it.

    ``known`` gives the units of all batches before a number (conversation_id, mu_id, seq, claim, confidence): new claims are
    compared with them, so that repeats and replaced claims are found across batches.
    """

    def batch(df: DataFrame, number: int) -> None:
        units, edges = engine.bulk_ingest(df, known(number) if known else None)
        write(units, edges, number)

    return turns.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def bucket_limiter(events: DataFrame, per_second: float, burst: float, key: str = "user_id") -> DataFrame:
    """``key, ts, accepted``: a token bucket whose state outlives the micro-batch."""

    def step(k, frames, state):
        import pandas as pd

        left, last = state.get if state.exists else (float(burst), -1.0)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for t in rows["ts"]:
            now = pd.Timestamp(t).timestamp()
            left = min(float(burst), left + (max(0.0, now - last) * per_second if last >= 0 else 0.0))
            last, ok = max(last, now), left >= 1
            left -= ok
            out.append(bool(ok))
        state.update((float(left), float(last)))
        yield pd.DataFrame({key: k[0], "ts": rows["ts"].to_numpy(), "accepted": out})

    kind = dict(events.dtypes)
    return events.select(key, "ts").groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, ts {kind['ts']}, accepted boolean", "left double, last double", "append", "NoTimeout")
