"""Near-deduplication against all pairs on full sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import near_dedup
from tidemark.llm.components import connected_components

DOCS = "doc_id long, text string"


def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed, groups=12, size=14):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=60)
    rows = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=r.choice([3, 30, 120, 300])) + passage * r.randint(0, 1)
        for _ in range(r.randint(1, size)):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 60))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(words).upper() if r.random() < 0.1 else "\n".join(words)))
    return rows + [(len(rows) + i, t) for i, t in enumerate([None, "", " \t\n ", "one", "ONE", "one two", "é é", "É é"])]


@pytest.mark.parametrize("small,depth", [(64, 8), (3, 1)])
def test_components_match_all_pairs(spark, small, depth):
    rows = corpus(small)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, DOCS), small=small, depth=depth).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_one_large_group(spark):
    r = random.Random(5)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(3):
            words[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, DOCS), small=8, depth=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)


def test_edges_of_input(spark):
    docs = spark.createDataFrame([(1, "a b c", 7), (1, "a b c", 8), (None, "a b c", 9)], DOCS + ", label int")
    got = sorted(tuple(r) for r in near_dedup.near_dedup(docs).na.fill(-1).collect())
    assert got == [(-1, 1, -1, True), (1, 1, 1, True), (1, 1, 1, True)]
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0
    assert near_dedup.drop_near_copies(docs.limit(0)).columns == docs.columns


def test_components(spark):
    links = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 9), (5, 5), (None, 4)] + [(i, i + 1) for i in range(20, 40)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 8: 7, 9: 7} | {i: 20 for i in range(21, 41)}


def test_more_trees_for_more_recall():
    assert near_dedup.trees_for(0.9999, 0.85) > near_dedup.trees_for(0.9, 0.85) >= 1


def test_recall_where_nodes_branch_deep(spark):
    """Pairs at exactly the threshold, all among documents with a common passage, so that nodes stay large for many levels."""
    r = np.random.default_rng(2)
    width, pairs, small = near_dedup.Forest.tokens(0.85, 0.9999, 8), 400, 8
    fresh = lambda: r.integers(-(2**31), 2**31, (pairs, width))
    one = np.where(r.random((pairs, width)) < 0.7, r.integers(-(2**31), 2**31, width), fresh())
    other = np.where(r.random((pairs, width)) < 0.85, one, fresh())
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([one, other]))]
    forest = near_dedup.Forest(spark.createDataFrame(rows, "cls long, sign array<int>"), 0.85, 0.9999, small, 8)
    assert len(forest.leaves) > 8 + near_dedup.SHALLOW and forest.leaves[7].count() > 0  # the further trees grew, and the first ones deep
    first, met = forest.leaves[0], set()
    for part in [*forest.leaves, *forest.stays]:
        met |= {x.p for x in part.groupBy("node", (F.col("cls") % pairs).alias("p")).agg(F.countDistinct("cls").alias("n")).where("n = 2").collect()}
    assert len(met) >= 0.99 * pairs and first.count() >= 0
    # trees are independent: knowing that a pair met in one of two trees says little about the other
    assert near_dedup.survival(0.85, 8) > 0.45


def test_repeated_ids_with_several_texts_and_rows_without_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    docs = spark.createDataFrame([(0, a, 1), (1, a, 2), (1, b, 3), (2, a + " x", 4), (3, b, 5), (None, b, 6), (None, "lone text", 7), (None, "lone text", 8), (4, "", 9), (5, None, 10), (5, "", 11)], DOCS + ", row int")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(docs).collect()}
    assert got == {(0, 0, True), (1, 0, False), (1, 1, True), (2, 0, False), (3, 1, False), (None, None, True), (4, 4, True), (5, 5, True)}
    kept = sorted(r.row for r in near_dedup.drop_near_copies(docs).collect())
    assert kept[:2] == [1, 3] and len(kept) == 5 and kept[2] in (7, 8) and kept[3] == 9 and kept[4] in (10, 11)


def test_very_long_text(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(400_000)]  # several stretches of words
    rows = [(1, " ".join(words)), (2, "\n".join(words[:-20])), (3, " ".join(words[: len(words) // 2]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    expected = brute(rows)
    assert got == {i: x[:2] for i, x in expected.items()} and [x[1] for x in got.values()].count(1) == 2


def test_large_nodes_dealt_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHARE_BYTES", 4096)
    monkeypatch.setattr(near_dedup, "CHUNK", 8)
    rows = corpus(9, groups=6, size=10)
    for small in (64, 2):
        got = near_dedup.near_dedup(spark.createDataFrame(rows, DOCS), small=small, depth=2).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)
