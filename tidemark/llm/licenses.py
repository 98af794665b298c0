"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory; DataFrame functions only.

The header lines of a file are its lines with a licence cue. Their terms are weighted by how rare they are among all
header lines of the corpus; a term of no template is as rare as can be. A file's own licence is the template closest to
any of its header lines, of its windows of adjoining lines and paragraphs, and to the file as a whole. These wider
units need no cue; their terms are weighted by how rare they are among all files. A licence file (by its name, because at least half its lines are licence lines, or because it is a licence text as a whole) gives its
licence to its directory; files without a licence inherit from the nearest directory above them.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import hot_join, staged

# fixed values: short forms of licence statements
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "Licensed under the MIT license"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal public domain dedication", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
#: Full texts of short licences and the notices of long ones, whole and in the parts that stand alone; for units wider than a line.
TEXTS = {
    "Apache-2.0": [_APACHE],
    "BSD-2-Clause": [f"{_BSD}\n{_BSD_AS_IS}"],
    "BSD-3-Clause": [f"{_BSD}\n{_BSD_NAMES}\n{_BSD_AS_IS}", f"{_BSD}\n{_BSD_NAMES}"],
    "GPL-2.0": [_GNU.format("General Public License", 2)],
    "GPL-3.0": [_GNU.format("General Public License", 3)],
    "ISC": [f"{_ISC}\n{_ISC_AS_IS}", _ISC],
    "LGPL-3.0": [_GNU.format("Lesser General Public License", 3)],
    "MIT": [f"{_MIT}\n{_MIT_NOTICE}\n{_AS_IS}", _MIT],
}
#: Most adjoining lines of a window; paragraphs and files have no bound.
WINDOW = 4
CUE = r"(?i)licen[cs]e|copyright|spdx|public\x20domain|creative\x20commons"
LICENSE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
TERM = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
#: Least cosine to a template, and the least share of licence lines that makes a file a licence file.
COSINE, SHARE = 0.6, 0.5


def terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0))


def _by_template(spark, templates: dict[str, list[str]]) -> DataFrame:
    rows = [(name, i, text) for name, texts in templates.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "license string, form int, line string")


def _weights(terms_of: DataFrame, key: list[str], rarity: DataFrame, none_seen: Column) -> DataFrame:
    """Sparse vectors: one row (key, term, w) for each distinct term of a key."""
    counted = terms_of.groupBy(*key, "term").agg(F.count("*").alias("tf"))
    return counted.join(F.broadcast(rarity), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", none_seen))


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())


class Units:
    """The closest form of any unit of a text wider than a line: windows of adjoining lines, paragraphs, the whole."""

    def __init__(self, forms: list[tuple[str, str]], df: dict[str, int], n: int, least: float):
        self.rarest, self.least = math.log(1.0 + n) + 1, least
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for _, text in forms for w in _words(text)}
        self.forms = [(name, {w: k * self.idf[w] for w, k in Counter(_words(text)).items()}) for name, text in forms]

    def able(self, shared: Column) -> Column:
        """Whether a form may be close enough: a unit's cosine is at most the share of the form that its words cover."""
        each = []
        for _, form in self.forms:
            square = F.map_from_arrays(F.array(*map(F.lit, form)), F.array(*[F.lit(x * x) for x in form.values()]))
            each.append(F.struct(square.alias("square"), F.lit(self.least**2 * sum(x * x for x in form.values()) * (1 - 1e-9)).alias("bound")))
        if not each:
            return F.lit(False)
        # an array of one, so that the words are found once and not once a form
        covers = lambda words: F.exists(F.array(*each), lambda f: F.aggregate(words, F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(f["square"], x), F.lit(0.0))) >= f["bound"])
        return F.exists(F.array(shared), covers)

    def closest(self, texts: DataFrame) -> DataFrame:
        """``row, unit, whole`` of texts (row, text): the closest form, and whether the text as a whole is close to one."""
        spark = texts.sparkSession
        paragraphs = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n[^\\p{L}\\p{N}_\n]*\n", -1)
        lines = F.filter(F.split("text", "[\r\n]+", -1), lambda x: F.length(F.trim(x)) > 0)
        windows = F.transform(F.sequence(F.lit(1), F.size("lines") - 1), lambda at: F.array(*[F.array_join(F.slice("lines", at, F.lit(n)), "\n") for n in range(2, WINDOW + 1)]))
        parts = F.concat(F.array("text"), paragraphs, F.when(F.size("lines") > 1, F.flatten(windows)).otherwise(F.array().cast("array<string>")))
        parts = texts.withColumn("lines", lines).select("row", F.posexplode(parts).alias("unit", "line"))
        rarity = spark.createDataFrame(list(self.idf.items()), "term string, idf double")
        template = [(name, i, w, x, math.sqrt(sum(y * y for y in form.values()))) for i, (name, form) in enumerate(self.forms) for w, x in form.items()]
        template = F.broadcast(spark.createDataFrame(template, "license string, form int, term string, t_w double, t_norm double"))
        weighed = staged(_weights(parts.select("row", "unit", F.explode(terms(F.col("line"))).alias("term")), ["row", "unit"], rarity, F.lit(self.rarest)).select("row", "unit", "term", "w"), "units")
        norm = weighed.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        dots = weighed.join(template, "term").groupBy("row", "unit", "license", "form", "t_norm").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
        scored = dots.join(norm, ["row", "unit"]).select("row", "unit", "license", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6).alias("cosine"))
        return scored.where(F.col("cosine") >= self.least).groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("neg"), "license")).alias("unit"), F.max(F.col("unit") == 0).alias("whole"))


def scan_licenses(
    files: DataFrame, path: Column, templates: dict[str, list[str]] | None = None, least: float = COSINE, share: float = SHARE, texts: dict[str, list[str]] | None = None
) -> DataFrame:
    """One row per file: ``doc_id, path, own_license, cosine, license, license_from, origin``.

    ``path`` is a Column over ``files``, slash-separated; its directories are what precedes each slash. ``origin`` is
    ``own``, ``inherited`` or ``none``; ``license_from`` the directory inherited from. Of equally close templates the
    first name wins, of several licence files in a directory the smallest path. Null texts are empty files; a null path
    has no directory, so inherits nothing. Repeated rows each get their result. No files, no rows.
    """
    spark = files.sparkSession
    chosen = templates or TEMPLATES
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), path.cast("string").alias("path"))
    forms = [(name, form) for name, each in (TEXTS if texts is None else texts).items() for form in each]
    shared = F.array_intersect(terms(F.col("text")), F.array(*[F.lit(w) for w in sorted({w for _, form in forms for w in _words(form)})]).cast("array<string>"))
    df = {r["term"]: r["count"] for r in rows.select(F.explode(shared).alias("term")).groupBy("term").count().collect()}  # terms of the forms
    units = Units(forms, df, rows.count(), least)
    lines = F.filter(F.split("text", "[\r\n]+", -1), lambda x: F.length(F.trim(x)) > 0)
    cued = F.when(F.col("text").rlike(CUE), F.filter(lines, lambda x: x.rlike(CUE))).otherwise(F.array().cast("array<string>"))
    read = staged(
        rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", F.when(F.col("text").rlike(CUE), F.size(lines)).alias("n_lines"), cued.alias("headers"), F.when(units.able(shared), F.col("text")).alias("text")),
        "files",
    )
    # equal header lines, of which there may be very many, are scored once
    headers = read.select("row", F.explode("headers").alias("line"))
    counted = staged(headers.groupBy("line").agg(F.count("*").alias("n")), "headers")
    known = _by_template(spark, chosen).select("license", "form", F.explode(terms("line")).alias("term"))
    vocabulary = known.select("term").distinct()
    seen = counted.select("n", F.explode(F.array_distinct(terms(F.col("line")))).alias("term"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total"))
    # as many rows as the templates have terms
    rarity = (
        seen.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.sum("n").alias("df"))
        .join(vocabulary, "term", "right").crossJoin(F.broadcast(total))
        .select("term", (F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    )
    rarity = staged(rarity, "rarity")
    n_headers = total.first()["total"]
    unseen = F.log(F.lit(1.0 + n_headers)) + 1
    template = _weights(known, ["license", "form"], rarity, unseen)
    template = template.select("license", "form", "term", F.col("w").alias("t_w"))
    norms = template.groupBy("license", "form").agg(F.sqrt(F.sum(F.col("t_w") * F.col("t_w"))).alias("t_norm"))
    template = F.broadcast(template.join(norms, ["license", "form"]).where("t_norm > 0"))
    weighed = _weights(counted.select("line", F.explode(terms(F.col("line"))).alias("term")), ["line"], rarity, unseen)
    norm = weighed.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(template, "term").groupBy("line", "license", "form", "t_norm").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    scored = dots.join(norm, "line").select("line", "license", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6).alias("cosine"))
    # min over (-cosine, license): the closest, then the first name
    best_line = staged(scored.where(F.col("cosine") >= least).groupBy("line").agg(F.min(F.struct((-F.col("cosine")).alias("neg"), "license")).alias("best")).join(counted, "line"), "lines")
    best_file = hot_join(headers, best_line, "line", "n").groupBy("row").agg(F.min("best").alias("best"), F.count("*").alias("n_license_lines"))
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
    best_unit = units.closest(read.where("text IS NOT NULL").select("row", "text"))
    own = staged(
        read.join(best_file, "row", "left").join(best_unit, "row", "left").withColumn("best", F.least("best", "unit")).select(
            "row", "doc_id", "path", directory.alias("directory"), F.col("best.license").alias("own_license"), (-F.col("best.neg")).alias("cosine"),
            (F.coalesce(F.col("n_license_lines") / F.col("n_lines") >= share, F.lit(False)) | F.coalesce("whole", F.lit(False))).alias("mostly"),
        ),
        "own",
    )
    gives = own.where(F.col("own_license").isNotNull() & F.col("directory").isNotNull() & (F.col("mostly") | F.col("path").rlike(LICENSE_NAME)))
    given = staged(gives.groupBy("directory").agg(F.min(F.struct("path", "own_license")).alias("by")).select(F.col("directory").alias("above"), F.col("by.own_license").alias("given")), "given")
    parts = F.split("directory", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    directories = own.where(F.col("own_license").isNull() & F.col("directory").isNotNull()).groupBy("directory").agg(F.count("*").alias("n"))
    nearest = (
        directories.select("directory", "n", F.explode(above).alias("above")).join(given, "above")
        .groupBy("directory").agg(F.max_by(F.struct("above", "given"), F.length("above")).alias("near"), F.first("n").alias("n"))
    )
    # a directory may hold very many files
    lone = hot_join(own.where(F.col("own_license").isNull()), staged(nearest, "nearest"), "directory", "n", "left")
    columns = ["doc_id", "path", "own_license", "cosine"]
    inherited = lone.select(
        *columns, F.col("near.given").alias("license"), F.col("near.above").alias("license_from"), F.when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin")
    )
    direct = own.where(F.col("own_license").isNotNull()).select(*columns, F.col("own_license").alias("license"), F.lit(None).cast("string").alias("license_from"), F.lit("own").alias("origin"))
    return direct.unionByName(inherited)


def document_path() -> Column:
    """Documents have no paths; this one sorts them by source, language and thousands of doc_id."""
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FORMS = ", ".join(f"({_quoted(name)}, {i}, {_quoted(form)})" for name, forms in TEMPLATES.items() for i, form in enumerate(forms))
_TERMS = "regexp_extract_all(lower(line), " + _quoted(TERM) + ")"
ORACLE_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), CAST(floor(doc_id / 1000) AS BIGINT), doc_id) AS path,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\r\\n]+'), lambda x: length(trim(x)) > 0) AS lines FROM documents),
h AS (SELECT row, unnest(list_filter(lines, lambda x: regexp_matches(x, {_quoted(CUE)}))) AS line FROM t),
f AS (SELECT * FROM (VALUES {_FORMS}) AS f(license, form, line)),
ft AS (SELECT license, form, term, count(*) AS tf FROM (SELECT license, form, unnest({_TERMS}) AS term FROM f) GROUP BY ALL),
v AS (SELECT DISTINCT term FROM ft),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM h),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TERMS})) AS term FROM h) GROUP BY term),
idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM v CROSS JOIN n LEFT JOIN df USING (term)),
fw AS (SELECT license, form, term, tf * idf AS w FROM ft JOIN idf USING (term)),
fn AS (SELECT license, form, sqrt(sum(w * w)) AS norm FROM fw GROUP BY ALL),
d AS (SELECT DISTINCT line FROM h),
lw AS (SELECT line, term, tf * coalesce(idf, ln(1 + n) + 1) AS w FROM (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest({_TERMS}) AS term FROM d) GROUP BY ALL) CROSS JOIN n LEFT JOIN idf USING (term)),
ln AS (SELECT line, sqrt(sum(w * w)) AS norm FROM lw GROUP BY line),
c AS (SELECT lw.line, fw.license, round(sum(lw.w * fw.w) / (any_value(ln.norm) * any_value(fn.norm)), 6) AS cosine
  FROM lw JOIN fw USING (term) JOIN fn ON fn.license = fw.license AND fn.form = fw.form JOIN ln ON ln.line = lw.line GROUP BY lw.line, fw.license, fw.form),
b AS (SELECT line, license, cosine FROM c WHERE cosine >= {COSINE} QUALIFY row_number() OVER (PARTITION BY line ORDER BY cosine DESC, license) = 1),
r AS (SELECT row, license, cosine, count(*) OVER (PARTITION BY row) AS n_license_lines FROM h JOIN b USING (line) QUALIFY row_number() OVER (PARTITION BY row ORDER BY cosine DESC, license) = 1),
o AS (SELECT t.row, doc_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS directory, license AS own_license, cosine, n_license_lines / CAST(len(lines) AS DOUBLE) >= {SHARE} AS mostly FROM t LEFT JOIN r USING (row)),
g AS (SELECT directory AS above, own_license AS given FROM o WHERE own_license IS NOT NULL AND directory IS NOT NULL AND (mostly OR regexp_matches(path, {_quoted(LICENSE_NAME)}))
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY path, own_license) = 1),
a AS (SELECT directory, above, given FROM (SELECT DISTINCT directory FROM o) JOIN g ON directory = above OR starts_with(directory, above || '/') QUALIFY row_number() OVER (PARTITION BY directory ORDER BY length(above) DESC) = 1)
SELECT doc_id, path, own_license, cosine, coalesce(own_license, given) AS license, CASE WHEN own_license IS NULL THEN above END AS license_from,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM o LEFT JOIN a USING (directory)
"""
