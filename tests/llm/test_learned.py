"""Learned operators by held-out accuracy, their inner parts by brute force."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid, licenses, quality

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- language
def test_grams_by_hand():
    codes, counts = langid.Grams()(["Ab  1c", "", "12", "é", "😀", "\U0001d400"])
    text = lambda c: "".join(chr((int(c) >> s) & 0xFFFF) for s in (48, 32, 16, 0))
    assert counts.tolist()[:5] == [5, 0, 0, 2, 0] and counts[5] > 0
    assert [text(c) for c in codes[:7]] == ["   a", "  ab", " ab ", "ab c", "b c ", "   é", "  é "]


def test_probabilities_add_up_and_follow_kneser_ney():
    import pandas as pd

    r = random.Random(1)
    words = " ".join("".join(r.choices("abcd", weights=[5, 3, 1, 1], k=r.randint(1, 5))) for _ in range(300))
    codes, _ = langid.Grams()([words])
    unique, n = np.unique(codes, return_counts=True)
    models = langid.Models(pd.DataFrame({"lang": "x", "gram": unique.view(np.int64), "n": n}))
    context = int(unique[len(unique) // 2]) >> 16
    symbols = sorted({int(c) & 0xFFFF for c in unique})
    p = np.exp(models.log_prob(np.array([(context << 16) | s for s in symbols], dtype=np.uint64))[:, 0])
    assert 0.95 < p.sum() <= 1.0001  # the rest is kept for letters never seen
    # the top order by its formula, over the lower orders as the model gives them
    follow = {int(c) & 0xFFFF: int(k) for c, k in zip(unique, n, strict=True) if int(c) >> 16 == context}
    total, d = sum(follow.values()), langid.DISCOUNT
    low = np.exp(models.log_prob(np.array([((context << 16) | s) & 0xFFFFFFFFFFFF for s in symbols], dtype=np.uint64), 3)[:, 0])
    mine = [max(follow.get(s, 0) - d, 0) / total + d * len(follow) / total * q for s, q in zip(symbols, low, strict=True)]
    assert np.allclose(p, mine, rtol=1e-3)
    singles = Counter()
    for c in {int(x) & 0xFFFFFFFF for x in unique}:
        singles[c & 0xFFFF] += 1
    lone = np.exp(models.log_prob(np.array(symbols, dtype=np.uint64), 1)[:, 0])
    best = max(singles.values())
    assert singles[symbols[int(lone.argmax())]] == best


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.accepted for r in held) >= 0.95 * len(held)


def test_languages_of_odd_rows(spark):
    odd = [(9, None, None, "s", 0), (8, "", "en", "s", 0), (7, "123 😀!", "en", "s", 0), (6, "the cat", None, "s", 0), (None, "le chat", "fr", "s", 0), (5, "x" * 300_000, "en", "s", 0)]
    taught = [(i, "the dog and the cat sat on the mat" if i % 2 else "le chien et le chat sont sur la table", "en" if i % 2 else "fr", "s", 0) for i in range(10, 60)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(odd + taught, DOCS + "").withColumn("costs", F.lit(1))).collect()}
    assert [got[i].lang_pred for i in (9, 8, 7, 6, None)] == ["und", "und", "und", "en", "fr"] and got[9].score == 0.0
    assert got[5].lang_pred in ("en", "fr")
    none = langid.identify(spark.createDataFrame(odd[:1], DOCS)).collect()
    assert [r.lang_pred for r in none] == ["und"] and langid.identify(spark.createDataFrame([], DOCS)).count() == 0


def test_calibration_rows_are_not_counted(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the dog number {i} sat", "en", "s", 0) for i in range(400)] + [(-1, "le chat", "fr", "s", 0), (-1, "le chat", "fr", "s", 0)], DOCS)
    seen, models = [], langid.Models
    monkeypatch.setattr(langid, "Models", lambda counts: seen.append(counts) or models(counts))
    got = langid.identify(docs).collect()
    taught = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    kept = [i for i in taught if zlib.crc32(f"kept {i}".encode()) % langid.KEPT == 0]
    grams = Counter(np.concatenate([langid.Grams()([f"the dog number {i} sat"])[0] for i in taught if i not in kept]).view(np.int64).tolist())
    english = seen[0][seen[0].lang == "en"]
    assert kept and dict(zip(english.gram, english.n, strict=True)) == grams and len(got) == 402
    assert {r.lang_pred for r in got if r.doc_id == -1} == {"fr"}  # too few to keep some


def test_ties_and_repeated_rows_of_languages(spark):
    docs = [(i, "same words", lang, "s", 0) for i, lang in enumerate(["en", "de"] * 6)] + [(50, "same words", None, "s", 0)] * 2
    got = langid.identify(spark.createDataFrame(docs, DOCS)).collect()
    taught = Counter(lang for i, _, lang, _, _ in docs[:12] if zlib.crc32(str(i).encode()) % 3 != 1)
    said = {r.lang_pred for r in got}
    assert len(got) == 14 and len(said) == 1 and (said == {"de"} or taught["de"] != taught["en"])


def test_every_gram_of_a_large_language_counts(spark, monkeypatch):
    # more 4-grams than the 2^18 a language once had: each text has its own four letters of an alphabet of thousands
    r = np.random.default_rng(5)
    texts = ["".join(chr(int(c)) for c in r.integers(0x4E00, 0x9FA5, 4000)) for _ in range(90)]
    rows = spark.createDataFrame([(t, "zh") for t in texts], "text string, lang string")
    expected = Counter(np.concatenate([langid.Grams()([t])[0] for t in texts]).view(np.int64).tolist())
    got = langid.count_grams(rows).agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).first()
    assert len(expected) > 1 << 18 and (got["kinds"], got["all"]) == (len(expected), sum(expected.values()))
    seen, models = [], langid.Models
    monkeypatch.setattr(langid, "Models", lambda counts: seen.append(len(counts)) or models(counts))
    docs = spark.createDataFrame([(i, t, "zh", "s", 0) for i, t in enumerate(texts * 2)], DOCS)
    assert langid.identify(docs).where("lang_pred = 'zh'").count() == 180 and seen[0] > 1 << 18


def test_joined_models_give_the_costs_of_held_ones(spark):
    odd = [(-1, None, None, "s", 0), (-2, "123", "en", "s", 0), (-3, "漢字 и ещё", None, "s", 0), (None, "le chat", "fr", "s", 0)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd, DOCS))
    whole = {r.doc_id: r for r in langid.identify(docs).collect()}
    for held in (0, 200_000):  # no gram in memory, and a part of them
        got = langid.identify(docs, held=held).collect()
        assert len(got) == docs.count()
        for r in got:
            w = whole[r.doc_id]
            assert r.lang_pred == w.lang_pred and abs((r.cross_entropy or 0) - (w.cross_entropy or 0)) < 1e-4 and abs(r.score - w.score) < 1e-3


# ---- quality
def test_quality_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.score_quality(docs, labels, labelled=1200).join(labels, "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) >= 0.95 * len(bad)
    assert all(0 <= x <= 1 for r in got for x in (r.score, r.p_content, r.p_metadata))


def test_exchange_over_a_table_is_that_in_memory(spark):
    """All documents without a label take part; the exact share, ties included, is that of a sort."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where("doc_id % 3 = 0")
    features = quality._features(docs)
    model, _ = quality.train(features, labels, handed=10**6)
    known = {r.doc_id for r in labels.where("quality IS NOT NULL").collect()}
    rows = sorted(features.where("NOT blank").collect(), key=lambda r: bytes(r.h))
    pool = quality._unpacked(*zip(*[(bytes(r.content), bytes(r.meta)) for r in rows if r.doc_id not in known], strict=True))
    models, cuts = model.exchange.rounds[0]
    n = len(pool[0])
    assert n == docs.count() - len({r.doc_id for r in rows} & known) - features.where("blank").count()
    for view, (low, high) in enumerate(cuts):
        steps = np.round(models[view].logit(pool[view]) * quality.STEPS)
        good = np.mean([model.good_share])
        sure = quality.SURE + abs(np.log(good / (1 - good))) * np.array([good < 0.5, good > 0.5])
        # the cut takes in the document at the end of the share, or starts where the view is sure
        at = np.sort(steps)[[max(1, round(0.05 * n * (1 - good))) - 1, -max(1, round(0.05 * n * good))]]
        assert np.allclose([low, high], [min(at[0], -sure[0] * quality.STEPS), max(at[1], sure[1] * quality.STEPS)])
    counted = quality.Stored(features.join(labels.select("doc_id"), "doc_id", "left_anti").where("NOT blank"), 10).histogram(quality.Exchange(), models)
    assert all((a == b).all() for a, b in zip(counted, quality.Held(pool).histogram(quality.Exchange(), models), strict=True)) and counted[0].sum() == n
    first = quality.Exchange()
    first.rounds = model.exchange.rounds[:1]
    said = first.said(pool)
    texts = {bytes(r.h) for r, x in zip([r for r in rows if r.doc_id not in known], said, strict=True) if x >= 0}
    assert sorted(quality.Stored(features.join(labels.select("doc_id"), "doc_id", "left_anti").where("NOT blank"), 10**6).handed(first)[1].tolist())[:1] == sorted(said[said >= 0].tolist())[:1]
    assert len(quality.Stored(features.join(labels.select("doc_id"), "doc_id", "left_anti").where("NOT blank"), 10**6).handed(first)[1]) == len(texts)


def test_metadata_teaches_where_it_knows(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices("abcdefgh", k=40)), "en", "spam" if i % 4 == 0 else "forum", 80) for i in range(800)] + [(0, "another text of id 0", "en", "spam", 20)] * 2
    got = quality.score_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 200)], "doc_id long, quality int")).collect()
    assert len(got) == 802 and sum(x.kept == (x.doc_id % 4 != 0) for x in got) >= 0.98 * len(got)


def test_one_odd_label_does_not_let_bad_documents_pass():
    r = np.random.default_rng(1)
    y = (np.arange(400) % 3 > 0).astype(float)
    views = [np.column_stack([y * 6 + r.normal(size=400)]) for _ in range(2)]
    y[3] = 1.0  # a bad document labelled good, among those kept aside
    assert quality.CoTrained().fit(views, y, [v[:0] for v in views]).limit > 0.05


def test_quality_of_very_long_texts(spark):
    rows = [(i, ("fine words " if i % 2 else "%%% ### ") * (60_000 if i < 2 else 20), "en", "s", None) for i in range(40)]
    got = quality.score_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")).collect()
    assert all(x.kept == (x.doc_id % 2 == 1) for x in got)


def test_quality_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, " \n", "en", "s", 2), (3, "fine words here", None, None, 3), (None, "no id", "en", "s", 5), (3, "fine words here", None, None, 3)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("good", F.lit("clash"))
    for labels in ([], [(3, 1)], [(3, 0)], [(None, 1), (3, None)]):
        got = quality.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        keep = not (labels and labels[0] == (3, 0))
        assert len(got) == 5 and {(r.doc_id, r.kept) for r in got} == {(1, False), (2, False), (3, keep), (None, keep)}
    assert quality.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int")).columns == docs.columns
    assert quality.score_quality(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).count() == 0


def test_views_teach_each_other():
    r = np.random.default_rng(0)
    y = (r.random(600) < 0.7).astype(float)
    views = [np.column_stack([y * 2 + r.normal(size=600), r.normal(size=600)]) for _ in range(2)]
    few = quality.CoTrained().fit([v[:40] for v in views], y[:40], [v[40:400] for v in views])
    p = few.score([v[400:] for v in views])
    assert ((p[2] > 0.5) == y[400:]).mean() > 0.85 and all(((0 <= x) & (x <= 1)).all() for x in p)


# ---- licences
FILES = [
    ("r/LICENSE", "Apache License Version 2.0, January 2004\nhttp://x"), ("r/a/one.py", "code only"), ("r/a/b/two.py", "code\nReleased under the MIT License."), ("r/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("r/a/b/c/three.py", None), ("q/four.py", "nothing about a driving license here at all, sorry"), ("five.py", ""), (None, "plain"), ("r/a/one.py", "code only"),
]


def test_licenses_inherit_from_the_nearest_directory(spark):
    rows = spark.createDataFrame([(i, t, p) for i, (p, t) in enumerate(FILES)], "doc_id long, text string, path string").withColumn("license", F.lit("clash"))
    got = {r.doc_id: (r.license, r.origin, r.license_from) for r in licenses.scan_licenses(rows, F.col("path")).collect()}
    assert got == {
        0: ("Apache-2.0", "own", None), 1: ("Apache-2.0", "inherited", "r"), 2: ("MIT", "own", None), 3: ("GPL-3.0", "own", None), 4: ("GPL-3.0", "inherited", "r/a/b"),
        5: (None, "none", None), 6: (None, "none", None), 7: (None, "none", None), 8: ("Apache-2.0", "inherited", "r"),
    }
    assert licenses.scan_licenses(rows.limit(0), F.col("path")).count() == 0


def test_cosines_by_brute_force(spark):
    import math
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, licenses.document_path()).collect()}
    words = lambda s: re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", s.lower())
    lines = {r.doc_id: [x for x in re.split(r"[\r\n]+", r.text or "") if x.strip() and re.search(licenses.CUE, x)] for r in docs.collect()}
    every = [x for v in lines.values() for x in v]
    vocabulary = {w for forms in licenses.TEMPLATES.values() for f in forms for w in words(f)}
    idf = lambda w: math.log((1 + len(every)) / (1 + (df[w] if w in vocabulary else 0))) + 1
    df = Counter(w for x in every for w in set(words(x)))
    vector = lambda s: {w: k * idf(w) for w, k in Counter(words(s)).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(f)) for name, forms in licenses.TEMPLATES.items() for f in forms]
    for i, found in lines.items():
        best = min(((-round(sum(w * v.get(k, 0) for k, w in t.items()) / (size(t) * size(v)), 6), name) for v in map(vector, found) for name, t in templates), default=(0, None))
        if -best[0] >= licenses.COSINE:
            assert (got[i].own_license, got[i].origin) == (best[1], "own") and abs(got[i].cosine + best[0]) < 2e-6
        else:
            assert got[i].own_license is None


def test_licenses_of_whole_texts_and_wrapped_notices(spark):
    wrap = lambda text, n: "\n".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    notice = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    code = "\n" + "\nimport os\n\ndef f(x):\n    return os.path.join(x, 'name')\n" * 12
    found = {
        "a/TERMS": ("Copyright (c) 2020 Jo Doe\n\n" + wrap(licenses.TEXTS["MIT"][0], 9), "MIT"), "b/gpl3.py": ("# " + notice.format(3).replace("\n", "\n# ") + code, "GPL-3.0"), "c/gpl2.c": ("/*\n" + notice.format(2) + "\n*/" + code, "GPL-2.0"),
        "d/TERMS": (wrap(licenses.TEXTS["BSD-3-Clause"][0], 11), "BSD-3-Clause"), "e/TERMS": (wrap(licenses.TEXTS["ISC"][0], 10), "ISC"), "f/mit.js": (wrap(licenses.TEXTS["MIT"][0], 9) + code, "MIT"),
    }
    plain = {"a/x/below.py": code, "b/next.py": code, "g/none.py": "we use the software and the terms of any person\n" + code}
    rows = [(i, t, p) for i, (p, t) in enumerate([(p, t) for p, (t, _) in found.items()] + list(plain.items()))]
    got = {r.path: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, path string"), F.col("path")).collect()}
    assert {p: got[p].own_license for p in found} == {p: name for p, (_, name) in found.items()}
    assert (got["a/x/below.py"].license, got["a/x/below.py"].license_from) == ("MIT", "a") and [got[p].origin for p in ("b/next.py", "g/none.py")] == ["none", "none"]


def test_licenses_of_a_very_long_file(spark):
    body = "def f(x): return x\n" * 40_000
    rows = [(1, body + licenses.TEXTS["MIT"][0] + "\n" + body, "a/long.py"), (2, body, "b/long.py"), (3, "Released under the MIT License.\n" * 3, "c/x"), (3, "Released under the MIT License.\n" * 3, "c/x")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, path string"), F.col("path")).collect()
    assert sorted((r.doc_id, r.own_license) for r in got if r.own_license) == [(1, "MIT"), (3, "MIT"), (3, "MIT")] and len(got) == 4
