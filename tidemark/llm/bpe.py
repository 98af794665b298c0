"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves every pre-token that is itself a token. Second tier:
other pre-tokens are merged from linked bytes with a heap of pair ranks. Results of either tier are remembered in a
bounded two-generation memo, since few pre-tokens make up most of a text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches

#: Pre-tokens remembered by a worker, in each of two generations.
MEMO = 500_000
#: Unicode White_Space, which tiktoken's \s stands for; fixed values.
WHITE_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pre_token_pattern(pattern: str = public_tokenizers.PATTERN):
    """``pattern`` for the regex library, with White_Space spelt out (its own ``\\s`` also takes U+001C to U+001F)."""
    spelt = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
    return regex.compile(spelt)


class PerfectHash:
    """Minimal perfect hash of byte strings: keys fall into small buckets, each with the first shift that seats its keys."""

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        self.n = n = len(keys)
        self.buckets = max(1, n // per_bucket)
        split: list[list[int]] = [[] for _ in range(self.buckets)]
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            split[h % self.buckets].append(h)
        self.shift = [0] * self.buckets
        taken = bytearray(n)
        alone = []
        for b in sorted(range(self.buckets), key=lambda b: -len(split[b])):
            if len(split[b]) == 1:
                alone.append(b)
                continue
            d = 0
            while split[b]:
                seats = {self._seat(h, d) for h in split[b]}
                if len(seats) == len(split[b]) and not any(taken[s] for s in seats):
                    for s in seats:
                        taken[s] = 1
                    break
                d += 1
            self.shift[b] = d
        for b, s in zip(alone, (s for s in range(n) if not taken[s]), strict=True):
            self.shift[b] = -1 - s  # a key alone in its bucket is given a free seat
        self.keys: list[bytes] = [b""] * n
        for key in keys:
            self.keys[self.slot(key)] = key

    def _seat(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF) >> 20) % self.n if d >= 0 else -1 - d

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        return self._seat(h, self.shift[h % self.buckets])

    def find(self, key: bytes) -> int:
        """The slot of ``key``, or -1 if it is not one of the keys."""
        slot = self.slot(key)
        return slot if self.keys[slot] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece`` after merging its bytes by rank, the leftmost of equal ranks first."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        mid = end[i]
        if mid < 0 or mid >= n or end[mid] != stop or mid >= stop:
            continue  # one of its halves has been merged since
        end[i], end[mid] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if i and (r := get(piece[before[i] : stop])) is not None:
            heappush(heap, (r, before[i], stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, memo: int = MEMO):
        self.ranks = read_ranks(path)
        self.table = PerfectHash(list(self.ranks))
        self.slot_ids = [str(self.ranks[k]) for k in self.table.keys]
        self.bytes_of = {str(r): b for b, r in self.ranks.items()}
        self.split = pre_token_pattern(pattern).findall
        self.limit = memo
        self.memo = _Memo(self, {})

    def ids_of(self, pre_token: str) -> str:
        """Decimal ids of a pre-token, joined by one space."""
        piece = pre_token.encode("utf-8", "surrogatepass")
        slot = self.table.find(piece)
        return self.slot_ids[slot] if slot >= 0 else " ".join(map(str, merge_bytes(piece, self.ranks)))

    def encode(self, text: str) -> str:
        """Decimal ids of a text, joined by one space."""
        if len(self.memo) > self.limit:
            self.memo.old = {}
            self.memo = _Memo(self, dict(self.memo))
        return " ".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


class _Memo(dict):
    def __init__(self, codec: Codec, old: dict):
        super().__init__()
        self.codec, self.old = codec, old

    def __missing__(self, pre_token: str) -> str:
        found = self.old.get(pre_token) or self.codec.ids_of(pre_token)
        if len(pre_token) <= 64 and len(self) <= self.codec.limit:  # within one long text too
            self[pre_token] = found
        return found


@cache
def _codec(path: str, pattern: str) -> Codec:
    """One codec for all tasks of a worker process."""
    return Codec(path, pattern)


def _coder(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            counts, id_hashes, texts, ids_out = [], [], [], []
            for value in batch.column("text"):
                ids = codec.encode(value.as_py() or "")
                counts.append(ids.count(" ") + 1 if ids else 0)
                id_hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded = codec.decode(ids)
                texts.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids_out.append([int(i) for i in ids.split()])
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(texts, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(ids_out, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def bpe_round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """Every text encoded, then its ids decoded: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if asked for.

    A null text counts as empty and has no ids; the hashes are then those of the empty string. Texts are whole at any
    length, rows are independent (repeated rows repeat their result), and other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids
    return rows.mapInArrow(_coder(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern, with_ids), schema)
