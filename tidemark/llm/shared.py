"""What the operators of this subpackage share: tables, texts, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import discard, passing, shared_root, staged

__all__ = ["bounded_batches", "discard", "hot_join", "passing", "possible", "row_key", "shared_root", "staged", "table", "text_key", "text_or_empty", "without"]

#: Bytes of an Arrow batch between JVM and Python; longer single texts still travel whole.
BATCH_BYTES = 8 << 20
#: Bits of a filter over row keys, as powers of two; the largest is 16 MB. A full filter costs a shuffle, never results.
LEAST_BITS, MOST_BITS = 20, 27
#: Most facts of frequent keys that are broadcast.
HOT = 1024


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ``BATCH_BYTES``, so that Python workers stay small beside the JVM.

    Lazy results need the setting when they run, so it stays set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def text_key(col: str = "text") -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(text_or_empty(col).cast("string").cast("binary")))


def row_key() -> tuple[Column, Column]:
    """``id, h`` of a row of documents: what tells it from rows with another doc_id or text."""
    return F.col("doc_id").cast("long").alias("id"), text_key().alias("h")


def possible(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose long ``key`` may be among ``keys`` (key), and those whose key surely isn't; nothing is shuffled.

    The keys become a bitmap of 16 bits a key, within the bounds above, that is broadcast.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
    place = lambda c: F.pmod(c, F.lit(1 << bits)) + 1
    slots = keys.select(place(F.col("key")).alias("slot"))
    bitmaps = slots.groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bitmap"))
    at = rows.withColumn("_slot", place(key)).withColumn("_bucket", F.bitmap_bucket_number("_slot")).withColumn("_at", F.bitmap_bit_position("_slot"))
    byte = F.conv(F.hex(F.substring("_bitmap", (F.shiftright("_at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, F.col("_at").bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    marked = at.join(F.broadcast(bitmaps), "_bucket", "left").withColumn("_found", found)
    return tuple(marked.where(c).select(rows.columns) for c in ("_found", "NOT _found"))


def without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``judged`` (id, h, drop) drops, and once each row that repeats doc_id and text.

    ``judged`` has one row a row of ``docs``. Of repeated rows with unequal other columns the one with the least hash
    stays. Only rows that may be dropped or repeated are shuffled; the others pass where they are read.
    """
    fates = staged(judged.groupBy("id", "h").agg(F.count("*").alias("n"), F.bool_or("drop").alias("drop")).where("n > 1 OR drop"), "fates")
    both = F.xxhash64("id", "h")
    maybe, sure = possible(docs.select(F.struct("*").alias("row"), *row_key()), both, fates.select(both.alias("key")))
    once = maybe.groupBy("id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    gone = fates.where("drop").select(F.col("id").alias("gone_id"), F.col("h").alias("gone_h"))
    kept = once.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left_anti")
    return sure.select("row.*").unionByName(kept.select("row.*"))


def hot_join(rows: DataFrame, facts: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the ``facts`` of their ``key``, of which there is one a key. The facts of the ``HOT`` heaviest keys are broadcast, so
    that no key with many rows goes to one task; the other rows are shuffled."""
    hot = staged(facts.orderBy(F.desc(weight), key).limit(HOT), "hot")
    named = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(named, key, "left_anti").join(facts.join(named, key, "left_anti"), key, how))
