"""The pipeline's stages against plain Python on small documents, and over the smallest tables."""

from collections import defaultdict

import corpus_pipeline
from tidemark.llm.shared import staged

SF = "/root/testdata/sf0.001"


def squeezed(text):
    return "".join((text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}))


def test_stages_over_the_smallest_tables(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "secret_scans", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append({r.doc_id: r for r in docs.collect()})
    raw, good, once, apart, masked = seen
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len(bad & set(good)) <= 2 and len(good) >= 0.8 * len(raw)
    groups = defaultdict(list)
    for r in good.values():
        groups[squeezed(r.text)].append(r)
    assert set(once) == {sorted(g, key=lambda r: (-len(r.text), r.doc_id))[0].doc_id for g in groups.values()}

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(r.text) for i, r in once.items()}
    label = {i: i for i in sets}
    for _ in sets:  # labels settle in as many rounds as the longest chain
        before = dict(label)
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert set(apart) == {i for i in sets if label[i] == i}
    assert set(masked) == set(apart)
    for i, r in masked.items():
        assert "AKIA" not in r.text and "password=" not in r.text and (r.text == apart[i].text or r.n_chars == len(r.text))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == set(masked)


def test_run_gives_pieces(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, h string, places int"


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeats, ties, a long text, ids with several texts, and columns with the names that stages use."""
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    texts = [
        (None, None), (1, None), (2, ""), (3, " \n"), (4, words("a", 40)), (4, words("b", 40)), (4, words("b", 40)), (5, words("a", 40) + " "), (None, words("b", 40)), (None, words("c", 9)), (None, words("c", 9)),
        (6, words("d", 40)), (7, words("d", 40) + " x"), (8, words("e", 200_000)), (9, "password=0123456789abcdef0123456789 " + words("f", 20)), (9, "short one"),
    ]
    rows = [(i, t, None, None, None, "x", "y", None, n) for n, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [c.split()[0] for c in ODD.split(", ")]
        left.append(sorted(r.places for r in docs.collect()))
    good, once, apart, masked = left
    assert good == list(range(4, 16))
    assert [p for p in once if p not in (5, 6, 9, 10)] == [7, 11, 12, 13, 14, 15]  # the longer text of 4 and 7 stays
    assert len(set(once) & {5, 6}) == 1 and len(set(once) & {9, 10}) == 1 and len(once) == 8
    assert [p for p in apart if p not in once] == [] and len(set(apart) & {11, 12}) == 1 and len(apart) == 7
    assert masked == apart and "0123456789abcdef" not in next(r.text for r in docs.collect() if r.places == 14)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {None, 4, 5, 6, 8, 9} - ({4} if not {5, 6} & set(masked) else set())


def test_stages_without_rows(spark, tmp_path):
    spark.createDataFrame([], ODD).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_deletes_what_its_stages_wrote(spark):
    import os

    from tidemark.sources.scratch import shared_root

    before = set(os.listdir(shared_root(spark)))
    corpus_pipeline.run(spark, SF).count()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(shared_root(spark))) - before}
    assert "secret_scans" in left and not left & {"quality_classifier", "exact_dedup", "minhash_near_dedup", "features", "signed", "digests", "fates"}
