"""Operational measures over event logs: rate windows, token buckets, health, cache keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rate_window(events: DataFrame, seconds: int, most: int, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events with ``in_window``, the number of the key's events in the trailing window, and whether it is over ``most``."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return events.withColumn("_t", micros).select(key, tie, F.count("*").over(w).alias("in_window")).withColumn("over_limit", F.col("in_window") > most)


def _stretches(events: DataFrame, gap: float, key: str, ts: str, tie: str) -> DataFrame:
    """``key, tie, _t, _s``: seconds, and the name of the stretch of a key's history that no pause of ``gap`` seconds breaks.

    After such a pause nothing of before counts any more, so stretches are decided each by itself, and a key with a long
    history is many tasks. No pause fits into a span of one gap, so only the ends of the spans are looked at in order.
    """
    gap = max(gap, 1e-6)
    rows = events.select(key, tie, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_t"))
    rows = rows.withColumn("_b", F.floor(F.col("_t") / F.lit(gap)))
    by = Window.partitionBy(key).orderBy("_b")
    ends = rows.groupBy(key, "_b").agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"))
    ends = ends.withColumn("_a", F.coalesce(F.col("_low") - F.lag("_high").over(by) >= gap, F.lit(False)).cast("int"))
    ends = ends.withColumn("_s", F.sum("_a").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    named = ends.select(F.col(key).alias("_key"), F.col("_b").alias("_span"), F.to_json(F.struct(F.col(key).alias("k"), "_s")).alias("_s"))
    return rows.join(named, F.col(key).eqNullSafe(F.col("_key")) & F.col("_b").eqNullSafe(F.col("_span"))).select(key, tie, "_t", "_s")


def _decided(stretches: DataFrame, key: str, tie: str, fresh: Callable[[], Callable[[float], bool]]) -> DataFrame:
    """``key, tie, accepted``: each stretch in order of time through a decision of its own; a task holds one batch of rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, accept = None, None
        for batch in batches:
            out = []
            for s, t in zip(batch.column("_s").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                if s != at:
                    at, accept = s, fresh()
                out.append(t is not None and accept(t))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(tie), pa.array(out, pa.bool_())], names=[key, tie, "accepted"])

    kinds = T.StructType([stretches.schema[key], stretches.schema[tie], T.StructField("accepted", T.BooleanType())])
    return stretches.repartition("_s").sortWithinPartitions("_s", "_t", tie).mapInArrow(run, kinds)


def sliding_limiter(events: DataFrame, seconds: float, most: int, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``key, tie, accepted``: only accepted events take room in the window, so each decision depends on those before.

    Events of the same moment come in order of ``tie``, rows without a key share one window, and an event without a time
    is refused and takes no room.
    """

    def fresh():
        from collections import deque

        seen = deque()

        def accept(t):
            while seen and seen[0] <= t - seconds:
                seen.popleft()
            ok = len(seen) < most
            if ok:
                seen.append(t)
            return ok

        return accept

    return _decided(_stretches(events, seconds, key, ts, tie), key, tie, fresh)


def token_bucket(events: DataFrame, per_second: float, burst: float, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``key, tie, accepted``: a bucket of ``burst`` tokens refilled at ``per_second``; each event takes one.

    Ties, rows without a key and events without a time as in :func:`sliding_limiter`.
    """

    def fresh():
        left, last = float(burst), None

        def accept(t):
            nonlocal left, last
            left = min(float(burst), left + (0 if last is None else (t - last) * per_second))
            last, ok = t, left >= 1
            left -= ok
            return ok

        return accept

    # a bucket that had time to fill is as good as new; a margin, since times are rounded
    full = burst / per_second * (1 + 1e-9) if per_second > 0 else float("inf")
    return _decided(_stretches(events, full, key, ts, tie), key, tie, fresh)


def counters(events: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """``keys, n, total``: how often a metric was counted, and its sum."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def gauges(events: DataFrame, *keys: str, value: str = "value", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``keys, last``: the last value of a metric."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(ts, tie)).alias("last"))


def health(checks: DataFrame) -> DataFrame:
    """``status`` of all checks (name, status): healthy if all are, unhealthy if any is, else degraded."""
    s = F.col("status")
    return checks.agg(F.when(F.bool_and(s == "healthy"), "healthy").when(F.bool_or(s == "unhealthy"), "unhealthy").otherwise("degraded").alias("status"))


def cache_key(model: Column, template: Column, text: Column) -> Column:
    """The first 16 hex digits of sha256(model|template|sha256(text))."""
    return F.substring(F.sha2(F.concat_ws("|", model, template, F.sha2(text, 256)), 256), 1, 16)


def with_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key, ...) with ``content`` of the cache (key, payload JSON); unreadable entries are misses."""
    entry = F.from_json("payload", "struct<content:string,input_tokens:long,output_tokens:long>")
    return requests.join(cache.select("key", entry["content"].alias("content")), "key", "left").withColumn("hit", F.col("content").isNotNull())
