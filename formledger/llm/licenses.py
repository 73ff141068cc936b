"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor.

The units of a text are the whole text, its lines and its paragraphs (between blank lines), those that contain a sign of a
licence; so headers meet the templates of headers, licence files those of whole licences.  Each unit is a sparse vector of its terms; a term weighs its count times its inverse document frequency in the
templates (a term of no template weighs as one of none of them, so unrelated words lower the cosine).  A document's licence is
the template of the highest cosine from ``LEAST`` on, of any of its units.  A document is a licence file if the unit of its licence has
at least ``FILE_SHARE`` of its words; the licence of a file holds for its folder and all below, unless a nearer one is there.
A document without a licence of its own takes the one of its nearest ancestor folder that has a licence file; of several
files in a folder the highest score counts, then the smaller licence name, then the smaller id.

SQL functions only.  The templates are a fixed table, so joining them is a broadcast of a known size; folders join by path,
one row for each ancestor of a document.

Defined results: null and empty texts have no licence of their own; a null path has no ancestors; rows may repeat (each gets
its result); ties of the cosine go to the smaller licence name; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 0.6
FILE_SHARE = 0.25
SIGNS = r"(?i)licen[sc]e|copyright|spdx|permission is hereby|redistribution and use|public domain|all rights reserved"
TERM = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"  #: it never goes back, so a term of any length needs no stack
# What licences say of themselves.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the 3-clause BSD License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain. CC0 1.0 Universal"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software is provided as is, without warranty of any kind, express or implied, "
        "including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. "
        "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. This software is provided by the copyright holders and contributors as is and any express or implied warranties, "
        "including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) "
        "however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    ),
    ("Proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
)


def weights() -> tuple[list[tuple[str, float]], float, list[tuple[int, str, str, float]]]:
    """idf by term; the idf of other terms; (template, licence, term, weight / length of the template's vector)."""
    terms = [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
    n = len(TEMPLATES)
    seen = Counter(t for c in terms for t in c)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in seen.items()}
    rows = []
    for i, ((name, _), c) in enumerate(zip(TEMPLATES, terms)):
        length = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        rows += [(i, name, t, k * idf[t] / length) for t, k in sorted(c.items())]
    return sorted(idf.items()), math.log(1 + n) + 1, rows


def units(text: Column) -> Column:
    both = F.concat(F.split(text, r"\n"), F.split(text, r"\n[\x20\x09\x0D]*\n"), F.array(text))
    return F.array_distinct(F.filter(both, lambda u: F.regexp_like(u, F.lit(SIGNS))))


def own(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """key, license, score, is_file for the texts that have a licence; the key is the text's hash with its length."""
    spark = docs.sparkSession
    idf, other, rows = weights()
    known = F.broadcast(spark.createDataFrame(idf, "term string, idf double"))
    templates = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, w double"))
    t = F.col(text)
    # what belongs to a whole text or unit is computed before its parts become rows
    texts = docs.where(F.regexp_like(t, F.lit(SIGNS))).select(_key(t), common.words(t).alias("words"), units(t).alias("units")).dropDuplicates(["key"])
    unit = texts.select("key", "words", F.explode("units").alias("unit"))
    terms = F.regexp_extract_all(F.lower("unit"), F.lit(TERM), F.lit(0))
    hit = unit.select("key", "words", F.xxhash64("unit").alias("u"), common.words(F.col("unit")).alias("unit_words"), terms.alias("terms"))
    hit = hit.select("key", "words", "u", "unit_words", F.explode("terms").alias("term"))
    counts = hit.groupBy("key", "words", "u", "unit_words", "term").agg(F.count("*").alias("c"))
    weighed = counts.join(known, "term", "left").withColumn("v", F.col("c") * F.coalesce("idf", F.lit(other)))
    length = weighed.groupBy("key", "u").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    dots = weighed.join(templates, "term").groupBy("key", "words", "u", "unit_words", "template", "license").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scored = dots.join(length, ["key", "u"]).withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("score") >= least)
    # the highest score, then the smaller name, then the longer unit
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("license"), (-F.col("unit_words")).alias("w"), F.col("words"))).alias("b")
    found = scored.groupBy("key").agg(best)
    return found.select("key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), (-F.col("b.w") >= FILE_SHARE * F.col("b.words")).alias("is_file"))


def _key(text: Column) -> Column:
    return F.concat_ws(":", F.xxhash64(text).cast("string"), F.length(text).cast("string")).alias("key")


def ancestors(path: Column) -> Column:
    """All folders above a path, the root of a relative path as ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = "path", least: float = LEAST) -> DataFrame:
    """id, path, own_license, score, license, origin (own, inherited, none) and from_folder for each row.

    The whole texts are read once for the scan; the joins carry ids, paths and text hashes only.
    """
    rows = common.settled(docs.select(F.col(id_col).alias("id"), F.col(path).alias("path"), F.when(F.regexp_like(F.col(text), F.lit(SIGNS)), _key(F.col(text))).alias("key")), "license-rows")
    mine = common.narrow(common.settled(own(docs, id_col, text, least), "license-own"))
    known = common.settled(rows.join(mine, "key", "left").drop("key"), "license-known")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), ""))
    files = known.where(F.col("is_file") & F.col("path").isNotNull()).select(folder.alias("folder"), "license", "score", "id")
    best = files.groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"), F.col("id"))).alias("b"))
    folders = common.narrow(common.settled(best.select("folder", F.col("b.license").alias("above")), "license-folders"))
    paths = known.where(F.col("license").isNull() & F.col("path").isNotNull()).select("path").distinct()
    steps = paths.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "folder")).join(folders, "folder")
    nearest = steps.groupBy("path").agg(F.max_by(F.struct("folder", "above"), "depth").alias("n"))
    out = known.join(nearest, "path", "left")
    return out.select(
        "id",
        "path",
        F.col("license").alias("own_license"),
        "score",
        F.coalesce("license", "n.above").alias("license"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNull(), F.col("n.folder")).alias("from_folder"),
    )


def oracle(path_sql: str) -> str:
    """The same in DuckDB's SQL over the table documents."""
    idf, other, rows = weights()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    space = r"'[^\x20\x09-\x0D]+'"
    return f"""
WITH idf(term, idf) AS (VALUES {", ".join(f"({q(t)}, {v!r}::DOUBLE)" for t, v in idf)}),
templates(template, license, term, w) AS (VALUES {", ".join(f"({i}, {q(n)}, {q(t)}, {w!r}::DOUBLE)" for i, n, t, w in rows)}),
docs AS (SELECT doc_id, {path_sql} AS path, text, CASE WHEN regexp_matches(text, {q(SIGNS)}) THEN text END AS key FROM documents),
texts AS (SELECT DISTINCT key FROM docs WHERE key IS NOT NULL),
lines AS (SELECT key, unnest(list_distinct(list_concat(string_split(key, chr(10)), regexp_split_to_array(key, '\\n[\\x20\\x09\\x0D]*\\n'), [key]))) AS unit FROM texts),
units AS (SELECT key, unit, len(regexp_extract_all(key, {space})) AS words, len(regexp_extract_all(unit, {space})) AS unit_words FROM lines WHERE regexp_matches(unit, {q(SIGNS)})),
terms AS (SELECT key, unit, words, unit_words, unnest(regexp_extract_all(lower(unit), {q(TERM.replace("++", "+").replace("*+", "*"))})) AS term FROM units),
counts AS (SELECT key, unit, words, unit_words, term, count(*) AS c FROM terms GROUP BY ALL),
weighed AS (SELECT c.*, c.c * coalesce(i.idf, {other!r}::DOUBLE) AS v FROM counts c LEFT JOIN idf i USING (term)),
lengths AS (SELECT key, unit, sqrt(sum(v * v)) AS length FROM weighed GROUP BY ALL),
dots AS (SELECT key, unit, words, unit_words, template, license, sum(v * w) AS dot FROM weighed JOIN templates USING (term) GROUP BY ALL),
scored AS (SELECT *, round(dot / length, 6) AS score FROM dots JOIN lengths USING (key, unit) WHERE round(dot / length, 6) >= {LEAST}),
mine AS (SELECT key, license, score, unit_words >= {FILE_SHARE} * words AS is_file FROM scored QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, license, unit_words DESC) = 1),
known AS (SELECT d.doc_id, d.path, m.license, m.score, m.is_file FROM docs d LEFT JOIN mine m USING (key)),
folders AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, license AS above FROM known WHERE is_file QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, license, doc_id) = 1),
steps AS (SELECT DISTINCT path, unnest(range(0, len(string_split(path, '/')))) AS depth FROM known WHERE license IS NULL),
above AS (SELECT s.path, s.depth, f.folder, f.above FROM steps s JOIN folders f ON f.folder = array_to_string(string_split(s.path, '/')[1:s.depth], '/') QUALIFY row_number() OVER (PARTITION BY s.path ORDER BY s.depth DESC) = 1)
SELECT doc_id, path, k.license AS own_license, k.score, coalesce(k.license, a.above) AS license,
CASE WHEN k.license IS NOT NULL THEN 'own' WHEN a.above IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
CASE WHEN k.license IS NULL THEN a.folder END AS from_folder
FROM known k LEFT JOIN above a USING (path)"""
