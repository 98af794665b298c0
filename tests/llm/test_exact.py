"""Exact search, exact dedup, byte-level BPE, archives and packing against plain versions."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, exact_dedup, knn, packing, shared, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
HARD = [None, "", " ", "\n\t", "don't  stop\n\n  now ", "é😀 x\x1cy\u0085z", "<|endoftext|> ok", "a" * 5000, "日本語 テキスト 123 456", "İstanbul ǅ́"]


@pytest.fixture(scope="module")
def tik():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), memo=50)


# ---- BPE
def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slot(k) for k in keys) == list(range(3000)) and table.find(b"x") == -1


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoding_is_that_of_tiktoken(codec, tik, text):
    ids = codec.encode(text)
    assert [int(i) for i in ids.split()] == tik.encode_ordinary(text)
    assert codec.decode(ids).decode() == text


def test_round_trip_over_documents(spark, tik):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(1000 + i, t) for i, t in enumerate(HARD)]
    texts = {i: t or "" for i, t in rows}
    out = bpe.bpe_round_trip(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.bpe_round_trip(spark.createDataFrame([], DOCS)).count() == 0


def test_bpe_of_repeated_rows_clashing_columns_and_a_long_text(spark, tik):
    long = "many different words: " + " ".join(f"w{i}x" for i in range(60_000))
    rows = [(1, "twice", 5), (1, "twice", 6), (None, long, 7)]
    out = bpe.bpe_round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids long").withColumn("n_tokens", F.lit("clash")), with_ids=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, len(tik.encode_ordinary(long))), (1, len(tik.encode_ordinary("twice"))), (1, len(tik.encode_ordinary("twice")))]


def test_the_memo_stays_bounded_within_one_text(codec):
    codec.encode(" ".join(f"word{i}" for i in range(5000)))
    assert len(codec.memo) <= codec.limit + 1


# ---- dedup
def test_dedup_ties_and_heavy_digests(spark):
    rows = [(i, "same text") for i in range(5, 60)] + [(3, "same  text"), (4, "same text"), (61, None), (60, " "), (62, ""), (70, "x"), (70, "x"), (None, "x"), (None, "lonely")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS), counters=3).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[ \t-\r]", "", t or "")].append((i, t or ""))
    for r in got:
        key = next(k for k in by if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        best = sorted(by[key], key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0][0]
        assert (r.keep_id, r.group_size, r.kept) == (best, len(by[key]), r.doc_id == best)


def test_dropped_copies_are_rows_of_their_own(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "a quite different text"), (2, "x "), (3, "same"), (3, "same"), (None, "same"), (None, "lone"), (None, "lo ne"), (4, None), (5, " ")], DOCS)
    for counters in (3, 1024):
        got = sorted(((r.doc_id, r.text) for r in exact_dedup.drop_copies(docs.withColumn("row", F.lit("clash")), counters).collect()), key=str)
        assert got == sorted([(1, "a quite different text"), (2, "x "), (3, "same"), (None, "lo ne"), (5, " ")], key=str)
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0 and exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_infrequent_candidates_are_no_winners(spark):
    rows = [(i, f"text {i}" if i % 3 else "often") for i in range(300)]
    judged = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit("clash")), counters=16).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in judged} == {i: (i, 1) if i % 3 else (0, 100) for i in range(300)}
    long = [(1, "ab c" * 500_000), (2, "abc " * 500_000)]
    assert {r.keep_id for r in exact_dedup.exact_dedup(spark.createDataFrame(long, DOCS)).collect()} == {1}


def test_filter_of_keys_loses_none(spark):
    keys = spark.range(0, 4000, 7).select(F.xxhash64("id").alias("key"))
    maybe, sure = shared.possible(spark.range(4000), F.xxhash64("id"), keys)
    found, rest = ({r.id for r in x.collect()} for x in (maybe, sure))
    assert found >= set(range(0, 4000, 7)) and not found & rest and len(found) + len(rest) == 4000 and len(found) < 700
    none, all_ = shared.possible(spark.range(9), F.col("id"), spark.createDataFrame([], "key long"))
    assert none.count() == 0 and all_.count() == 9


def test_hot_keys_are_joined_like_others(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT", 2)
    rows = spark.createDataFrame([("a",)] * 50 + [("b",)] * 20 + [("c",), ("d",), (None,)], "k string")
    facts = spark.createDataFrame([("a", 50), ("b", 20), ("c", 1)], "k string, n long")
    assert shared.hot_join(rows, facts, "k", "n").count() == 71 and shared.hot_join(rows, facts, "k", "n", "left").count() == 73


def test_misra_gries_finds_every_frequent_digest(spark):
    values = [b"a"] * 400 + [b"b"] * 300 + [str(i).encode() for i in range(300)]
    random.Random(1).shuffle(values)
    found = exact_dedup.frequent_digests(spark.createDataFrame([(v,) for v in values], "digest binary").repartition(3), 4)
    assert {bytes(r.digest) for r in found.collect()} >= {b"a", b"b"}


# ---- search
def test_knn_against_all_pairs(spark):
    r = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in np.concatenate([r.normal(size=(120, 6)), np.tile(r.normal(size=6), (60, 1))])]
    rows = list(enumerate(vectors)) + [(500, None), (501, [1.0, None, 0, 0, 0, 0]), (502, [float("nan")] * 6), (503, []), (504, [1.0, 2.0]), (None, vectors[0]), (7, vectors[7])]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    got = knn.voronoi_knn(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0, k=5, pivots=8, block=4, share=16).collect()
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = set()
    for i, q in whole:
        if i % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)[:5]
            expected |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    assert {(x.query_id, x.rank, x.vec_id, x.score) for x in got} == expected and len(got) == len(expected)


def test_knn_without_rows_and_beyond_doubles(spark):
    kind = "vec_id long, embedding array<double>"
    assert knn.voronoi_knn(spark.createDataFrame([], kind), F.col("id") % 50 == 0).count() == 0
    big = spark.createDataFrame([(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 3.0])], kind)
    got = {(r.vec_id, r.score) for r in knn.voronoi_knn(big, F.col("id") == 0).collect()}
    assert got == {(1, (768_000_000) ** 2 + 256 * 512), (2, (768_000_000) ** 2 + 256 * 768)}


def test_knn_ships_only_what_may_answer(spark):
    """Clustered vectors, one of them a thousand times longer: of all rows times groups few travel, and answers are whole."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(60, 32)) * 4
    x = centres[r.integers(0, 60, 6000)] + r.normal(size=(6000, 32)) * 0.3
    x[7] *= 1000
    vectors = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("cell", F.lit(1))
    needed, asked, _, _ = knn.routed(vectors, F.col("id") % 50 == 0, 5, "vec_id", "embedding", 256.0, knn.PIVOTS, knn.BLOCK, knn.SHARE)
    groups = asked.select("g").distinct().count()
    assert groups > 10 and needed.count() < 0.1 * groups * len(x)
    whole = np.floor(256 * x)
    got = {(g.query_id, g.rank): (g.vec_id, g.score) for g in knn.voronoi_knn(vectors, F.col("id") % 50 == 0).collect()}
    for q in range(0, 6000, 50):
        score = whole @ whole[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(6000), -score))[:5]
        assert [got[q, n + 1] for n in range(5)] == [(int(b), int(score[b])) for b in best]


def test_knn_of_a_repeated_query_id(spark):
    axis = lambda *at: [float(i in at) for i in range(8)]
    # id 0 fills its own buckets with copies, id 10 lies in two places, id 20 is single in the cell of id 0
    rows = [(0, axis(0))] * 64 + [(i, axis(i)) for i in range(1, 6)] + [(10, axis(6))] * 9 + [(10, axis(7))] * 9 + [(20, axis(0))]
    got = knn.voronoi_knn(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0, k=5, pivots=8).collect()
    expected = set()
    for own, q in ((0, axis(0)), (10, axis(7)), (20, axis(0))):
        scored = sorted((-65536 * sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != own)[:5]
        expected |= {(own, n + 1, j, int(-s)) for n, (s, j) in enumerate(scored)}
    assert {(x.query_id, x.rank, x.vec_id, x.score) for x in got} == expected and len(got) == 15


# ---- archives
def test_archives(spark):
    rows = [(1, "http://a/x y\r\nEvil: 1", "p" * 200), (2, None, "p" * 200), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "é\r\n\r\nWARC/1.1\r\n" * 9), (0, "u", "é\r\n\r\nWARC/1.1\r\n" * 9), (7, "u", "z" * 600_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    bundles = warc.write_bundles(pages)
    got = {r.page_id: r for r in warc.read_bundles(bundles, with_payload=True).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("revisit", 0), 0: ("response", None), 7: ("response", None),
    }
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert got[i].payload == ((html or "") if got[i].record_type == "response" else "")
    for b in bundles.collect():
        for entry in b["index"]:
            headers, _ = warc.fetch_record(bytes(b["data"]), [x.asDict() for x in b["index"]], entry["record_id"])
            assert headers["WARC-Record-ID"] == entry["record_id"]
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


# ---- packing
def test_pieces_and_packing(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(1000 + i, x) for i, x in enumerate(HARD)] + [(2000, "long words " * 3000), (None, "no id")]
    got = packing.best_fit_packing(spark.createDataFrame(rows, DOCS), group=50).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    total = 0
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert len(pieces) == 1 if len(ids) <= 2048 else all(r.length == 2048 for r in pieces[1:])
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 2
    assert packing.best_fit_packing(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "same text", 9), (1, "same text", 8), (None, None, 7)]
    got = packing.best_fit_packing(spark.createDataFrame(rows, DOCS + ", piece int").withColumn("length", F.lit("clash"))).collect()
    assert sorted((r.doc_id or 0, r.piece) for r in got) == [(0, 0), (1, 0), (1, 0)] and len({(r.sequence_id, r.offset) for r in got}) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_local_search_keeps_bins_sound(lengths):
    p = packing.Packing(lengths, 60)
    p.best_fit()
    before = sum(1 for b in p.bins if b)
    p.improve()
    assert sorted(i for b in p.bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 60 for b in p.bins) and sum(1 for b in p.bins if b) <= before


def test_local_search_empties_a_bin():
    lengths, bins = [6, 3, 5, 4, 4, 3, 4], ([0, 1], [2, 3], [4, 5], [6])  # fills 9, 9, 7, 4 of 10: three bins would do
    p = packing.Packing(lengths, 10)
    for b, items in enumerate(bins):
        p.bins.append([])
        p.free.append(10)
        p.by_free[10].add(b)
        p.mask |= 1 << 10
        for i in items:
            p.put(i, b)
    p.improve()
    assert sorted(i for b in p.bins for i in b) == list(range(7))
    assert sum(1 for b in p.bins if b) == 3
