"""Best-fit packing of token sequences with a swap-based local search.

Documents are tokenised where they are read; only lengths and checksums travel. Pieces that fill a sequence by
themselves need no packing. The others are dealt by hash into groups of a fixed expected size, each packed best fit
first and then improved by a local search that moves documents between underfull bins and exchanges one for one, two
for one or one for two, always raising the sum of squared fills, until bins run empty. What stays in underfull bins is
dealt anew and packed once more across groups, so the waste of a group does not add up.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, staged

CAPACITY = 2048
#: Expected pieces of a packing group.
GROUP = 2000
#: The id that ends each document.
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(path: str):
    """The ids of the ``tokenizers`` file of the same vocabulary, by its rank file: equal ids at several times the speed."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cuts(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of a document; only the first may be shorter than ``capacity``."""
    first = (length - 1) % capacity + 1
    yield 0, first
    for start in range(first, length, capacity):
        yield start, capacity


def pieces_of(ranks_path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks_path)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = array("I", encode(text or ""))
                ids.append(END_ID)
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = (doc_id, piece, start, length, zlib.crc32(part.tobytes()))
                    rows.append((*row, part.tolist()) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"doc_id": "Int64"})

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of the tokenised documents: ``doc_id, piece, start, length, ids_crc32``, and ``ids`` if asked for."""
    bounded_batches(docs.sparkSession)
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(pieces_of(path, capacity, with_ids), PIECES + ", ids array<long>" * with_ids)


class Packing:
    """Bins of whole numbers with a capacity; ``bins[b]`` lists item numbers, ``free[b]`` is what is left of bin b."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0  # bit r is set while some bin has r left

    def _shift(self, b: int, free: int) -> None:
        old = self.free[b]
        self.by_free[old].discard(b)
        if not self.by_free[old]:
            self.mask &= ~(1 << old)
        self.free[b] = free
        self.by_free[free].add(b)
        self.mask |= 1 << free

    def tightest(self, length: int, but: int = -1) -> int:
        """The bin with the least room that takes ``length``, or -1."""
        mask = self.mask >> length
        while mask:
            low = (mask & -mask).bit_length() - 1
            for b in self.by_free[length + low]:
                if b != but:
                    return b
            mask &= mask - 1
        return -1

    def put(self, item: int, b: int) -> None:
        self.bins[b].append(item)
        self._shift(b, self.free[b] - self.lengths[item])

    def take(self, item: int, b: int) -> None:
        self.bins[b].remove(item)
        self._shift(b, self.free[b] + self.lengths[item])

    def best_fit(self) -> None:
        """Longest first, each into the bin that it fills best."""
        for item in sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i]):
            b = self.tightest(self.lengths[item])
            if b < 0:
                b = len(self.bins)
                self.bins.append([])
                self.free.append(self.capacity)
                self.by_free[self.capacity].add(b)
                self.mask |= 1 << self.capacity
            self.put(item, b)

    def underfull(self) -> list[int]:
        return [b for b, items in enumerate(self.bins) if items and self.free[b]]

    def improve(self) -> None:
        """The local search. Each step raises the sum of squared fills, so it ends; it stops early at the lower bound."""
        stuck: set[int] = set()
        while True:
            loose = [b for b in self.underfull() if b not in stuck]
            if not loose or sum(self.free[b] for b in self.underfull()) < self.capacity:
                return
            victim = max(loose, key=lambda b: (self.free[b], b))
            if not self._step(victim):
                stuck.add(victim)
            elif not self.bins[victim]:
                self._shift(victim, 0)  # an emptied bin takes nothing again

    def _step(self, victim: int) -> bool:
        fill = self.capacity - self.free[victim]
        for item in sorted(self.bins[victim], key=lambda i: -self.lengths[i]):
            b = self.tightest(self.lengths[item], victim)
            if b >= 0 and self.capacity - self.free[b] + self.lengths[item] > fill:
                self.take(item, victim)
                self.put(item, b)
                return True
        mine = self._parts(victim)
        for b in sorted(self.underfull(), key=lambda b: self.free[b]):
            if b == victim:
                continue
            theirs, best = self._parts(b), None
            for size, out in mine:
                for other, back in theirs:
                    gain = size - other
                    if 0 < gain <= self.free[b] and len(out) + len(back) <= 3 and self.free[b] <= self.free[victim] and (not best or gain > best[0]):
                        best = (gain, out, back)
            if best:
                for item in best[1]:
                    self.take(item, victim)
                for item in best[2]:
                    self.take(item, b)
                for item in best[1]:
                    self.put(item, b)
                for item in best[2]:
                    self.put(item, victim)
                return True
        return False

    def _parts(self, b: int) -> list[tuple[int, tuple[int, ...]]]:
        """Single items and pairs of a bin, one for each total length."""
        found = {}
        for k in (1, 2):
            for chosen in combinations(self.bins[b], k):
                found.setdefault((sum(self.lengths[i] for i in chosen), k), chosen)
        return [(total, chosen) for (total, _), chosen in found.items()]


def pack_group(capacity: int, stage: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        packing = Packing(pdf["length"].tolist(), capacity)
        packing.best_fit()
        packing.improve()
        base = (int(pdf["_group"].iloc[0]) * 2 + stage) << 24
        where, offset, left = [0] * len(pdf), [0] * len(pdf), [0] * len(pdf)
        for b, items in enumerate(packing.bins):
            at = 0
            for item in items:
                where[item], offset[item], left[item] = base + b, at, packing.free[b]
                at += packing.lengths[item]
        return pdf.drop(columns="_group").assign(sequence_id=where, offset=offset, _free=left)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless sequences of at most ``capacity`` tokens.

    ``pieces`` holds ``doc_id, piece, start, length, ids_crc32`` with lengths from 1 to ``capacity``. Ties in length go
    by doc_id and piece; repeated rows are packed like any other. An empty table gives an empty result.
    """
    columns = [f.name for f in pieces.schema]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, _free long"
    full = pieces.where(F.col("length") == capacity)
    short = pieces.where(F.col("length") < capacity)

    def dealt(rows: DataFrame, stage: int) -> DataFrame:
        groups = max(1, -(-rows.count() // group))
        key = F.pmod(F.xxhash64("doc_id", "piece", F.lit(stage)), F.lit(groups))
        return rows.select(*columns, key.alias("_group")).groupBy("_group").applyInPandas(pack_group(capacity, stage), out)

    first = staged(dealt(short, 0), "packed")
    # a bin that a short document could still join is opened once more, with those of all groups
    slack = capacity // 64
    again = dealt(first.where(F.col("_free") >= slack), 1)
    whole = full.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(first.where(F.col("_free") < slack).drop("_free")).unionByName(again.drop("_free"))


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, ranks_path: str | None = None) -> DataFrame:
    """All documents as pieces with their place in a packed sequence.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A document is its ids and the id 0, so a null or
    empty text is one piece of length 1. Only documents longer than ``capacity`` are cut. Special tokens' strings in a
    text are ordinary text. Null doc_ids are packed as well; columns other than doc_id and text are not read.
    """
    return pack(staged(token_pieces(docs, capacity, ranks_path), "pieces"), capacity, group)
