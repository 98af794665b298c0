"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after deleting ASCII white space. A Misra-Gries pass finds the digests that may
be frequent, an exact count verifies them and rejects the others, and the verified winners (fewer than ``counters`` rows,
whatever the input) are broadcast: rows of a frequent digest are answered on the map side and never shuffled. The
remaining digests, none of which holds more than ``1 / counters`` of the rows, take the ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import row_key, staged, text_or_empty, without

SPACES = " \t\n\x0b\x0c\r"
#: Counters of the Misra-Gries summary, and so the largest number of broadcast winners.
COUNTERS = 1024


def normalised(col: str = "text"):
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(text_or_empty(col), SPACES, "")


def misra_gries(counters: int):
    """A mapInPandas function that summarises column ``digest`` of its partition in at most ``counters`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.Series(dtype="int64")
        for pdf in batches:
            kept = kept.add(pdf["digest"].value_counts(), fill_value=0).astype("int64")
            if len(kept) > counters:
                kept = kept - kept.nlargest(counters + 1).iloc[-1]
                kept = kept[kept > 0]
        if len(kept):
            yield pd.DataFrame({"digest": kept.index, "low": kept.to_numpy()})

    return run


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests: all that hold more than ``1 / counters`` of the rows are among them."""
    low = digests.select("digest").mapInPandas(misra_gries(counters), "digest binary, low long")
    return low.groupBy("digest").agg(F.sum("low").alias("low")).orderBy(F.desc("low"), "digest").limit(counters).select("digest")


def _judged(docs: DataFrame, counters: int) -> DataFrame:
    """Of each row ``id, h, digest``, the row of its group that stays (``best``: n_points, neg, h) and ``group_size``."""
    digests = staged(docs.select(*row_key(), F.unhex(F.sha2(normalised(), 256)).alias("digest"), F.length(text_or_empty()).alias("n_points")), "digests")
    # ~id falls as id grows and never overflows, so the largest struct is the row that stays
    best = F.max(F.struct("n_points", F.bitwise_not("id").alias("neg"), "h"))
    candidates = F.broadcast(frequent_digests(digests, counters))
    frequent = F.col("group_size") * counters > F.lit(digests.count())
    winners = staged(digests.join(candidates, "digest").groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).where(frequent), "winners")
    heavy = digests.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    light = (
        digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumns({"best": best.over(group), "group_size": F.count("*").over(group)})
    )
    return heavy.select(light.columns).unionByName(light)


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points in its original text stays, then that with the smallest doc_id.
    Null texts count as empty and so form one group with blank ones. A row without doc_id stays only where its whole
    group has none. Repeated rows are further members of their group: rows that repeat the kept id are kept as well.
    An empty table gives an empty result; columns other than doc_id and text are not read.
    """
    keep = F.bitwise_not(F.col("best.neg"))
    return _judged(docs, counters).select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        "group_size",
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    Which one stays is as in :func:`exact_dedup`, then by hash of the text and of the row; every row is judged by its own
    text, so one doc_id may name several texts. Rows without doc_id are judged like any other and stay where their
    group has no doc_id, one of each group. No documents, no rows.
    """
    stays = F.col("id").eqNullSafe(F.bitwise_not(F.col("best.neg"))) & (F.col("h") == F.col("best.h"))
    return without(docs, _judged(docs, counters).select("id", "h", (~stays).alias("drop")))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
