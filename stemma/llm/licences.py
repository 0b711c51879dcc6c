"""License scans: MinHash over overlapping text windows retrieves templates, exact shingle containment verifies them.

Words are runs of letters and digits in lower case; a template's shingles have five words, or all of its words if it has fewer.
Templates are classed by length. For a class of up to n words a text is cut into windows of 2 n words that begin every n, so a
template's passage lies whole in a window and its containment bounds their Jaccard similarity from below; the number of
bands of one row follows from that and RECALL. A collision makes a candidate; a candidate is a match if at least CONTAINMENT
of the template's shingles are in the text. Built-in SQL functions only.

Only windows with an anchor word are hashed. Anchors are words of the templates, chosen so that over 1 - CONTAINMENT of each
template's shingles hold one: a text or passage without any can't hold a template.

Defined results: null and empty texts hold no license. Texts of any length are scanned whole, window by window. Repeated rows each get rows. A text may hold several
templates, also where one is part of another. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bands_for, written

CONTAINMENT, RECALL, WIDTH = 0.8, 0.9999, 5
#: Window classes, in words.
CLASSES = (3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512)

# The wording of public license statements.
_MIT_PERMISSION = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software"
)
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_FREE_PROGRAM = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "agpl-3.0-header": _FREE_PROGRAM.format("GNU Affero General Public License", 3),
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-licensed": "Licensed under the BSD License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-tag-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-tag-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "This work is marked with CC0 1.0 Universal.",
    "gpl-2.0-header": _FREE_PROGRAM.format("GNU General Public License", 2),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": _FREE_PROGRAM.format("GNU General Public License", 3),
    "gpl-licensed": "Licensed under the GNU General Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0-header": _FREE_PROGRAM.format("GNU Lesser General Public License", 3),
    "mit": "Released under the MIT License.",
    "mit-distributed": "Distributed under the MIT License.",
    "mit-full": f"{_MIT_PERMISSION}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
    f"notice shall be included in all copies or substantial portions of the Software. {_NO_WARRANTY}",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-permission": _MIT_PERMISSION,
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "no-warranty": _NO_WARRANTY,
    "spdx-agpl-3.0": "SPDX-License-Identifier: AGPL-3.0",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd-2-clause": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-bsd-3-clause": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-cc0-1.0": "SPDX-License-Identifier: CC0-1.0",
    "spdx-gpl-2.0": "SPDX-License-Identifier: GPL-2.0",
    "spdx-gpl-3.0": "SPDX-License-Identifier: GPL-3.0",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-lgpl-3.0": "SPDX-License-Identifier: LGPL-3.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-mpl-2.0": "SPDX-License-Identifier: MPL-2.0",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_shingles(text: str) -> list[str]:
    w = words_of(text)
    k = min(WIDTH, len(w))
    return list(dict.fromkeys(" ".join(w[i : i + k]) for i in range(len(w) - k + 1)))


def anchors(templates: dict[str, str], containment: float = CONTAINMENT) -> list[str]:
    """Few words such that more than 1 - containment of each template's shingles hold one."""
    left = {name: (s := template_shingles(text), len(s) - math.ceil(containment * len(s) - 1e-9) + 1) for name, text in templates.items()}
    out: list[str] = []
    while left:
        gain: Counter[str] = Counter()
        for s, need in left.values():
            for word, n in Counter(x for y in s for x in set(y.split())).items():
                # Long words are rare in other texts.
                gain[word] += min(n, need) / need * (len(word) >= 5 or 0.05)
        best = max(sorted(gain), key=lambda x: gain[x])
        out.append(best)
        for name, (s, need) in list(left.items()):
            rest = [x for x in s if best not in x.split()]
            need -= len(s) - len(rest)
            left[name] = (rest, need)
            if need <= 0:
                del left[name]
    return sorted(out)


def _class_of(n: int) -> int:
    return next((c for c in CLASSES if c >= n), n)


def window_classes(templates: dict[str, str]) -> dict[tuple[int, int], int]:
    """Bands by window class: (words, shingle width)."""
    out: dict[tuple[int, int], int] = {}
    for text in templates.values():
        n, q = len(words_of(text)), len(template_shingles(text))
        size, width = _class_of(n), min(WIDTH, n)
        shared = math.ceil(CONTAINMENT * q - 1e-9)
        similarity = shared / (2 * size - width + 1 + q - shared)
        out[size, width] = max(out.get((size, width), 0), bands_for(min(similarity, 0.999), RECALL, 1))
    return out


def _normal(text: Column) -> Column:
    """The words, each between single spaces, with a space at either end."""
    return F.concat(F.regexp_replace(F.concat(F.lit(" "), F.lower(text)), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def _signature(words: Column, width: Column, bands: Column) -> Column:
    """The minima of the hashes of a window's shingles."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1)))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, width), " ")))
    return F.get(
        F.transform(F.array(hashes), lambda h: F.transform(F.sequence(F.lit(1), bands), lambda k: F.array_min(F.transform(h, lambda x: F.xxhash64(x, k))))), F.lit(0)
    )


def _table(spark, rows: list[Column]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*rows)))


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, n_shared, n_shingles and containment of each template in each document that holds it."""
    spark = documents.sparkSession
    marks = anchors(templates)
    classes = window_classes(templates)
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    possible = F.lit(False)
    for word in marks:
        possible = possible | F.contains(text, F.lit(word))
    rows = documents.select("doc_id", "text").where(possible).select(F.col("doc_id").cast("long").alias("doc_id"), _normal(F.col("text")).alias("words"))
    anchored = F.lit(False)
    for word in marks:
        anchored = anchored | F.contains("words", F.lit(f" {word} "))
    rows = written(rows.where(anchored).withColumn("_row", F.monotonically_increasing_id()), "licensed")

    known = _table(
        spark,
        [
            F.struct(
                F.lit(name).alias("license"),
                F.array(*map(F.lit, words_of(t))).alias("own"),
                F.array(*map(F.lit, template_shingles(t))).alias("shingles"),
                F.lit(_class_of(len(words_of(t)))).alias("size"),
                F.lit(min(WIDTH, len(words_of(t)))).alias("width"),
                F.lit(classes[_class_of(len(words_of(t))), min(WIDTH, len(words_of(t)))]).alias("bands"),
            )
            for name, t in templates.items()
        ],
    )
    signed = known.select("license", "size", "width", F.posexplode(_signature(F.col("own"), F.col("width"), F.col("bands"))).alias("band", "minimum"))

    kinds = F.array(*(F.struct(F.lit(size).alias("size"), F.lit(width).alias("width"), F.lit(n).alias("bands")) for (size, width), n in sorted(classes.items())))
    cut = rows.select("_row", F.split(F.btrim("words", F.lit(" ")), " ").alias("w")).withColumn("kind", F.explode(kinds)).select("_row", "w", "kind.*")
    cut = cut.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w"), F.col("size"))))
    cut = cut.select("_row", "size", "width", "bands", F.slice("w", F.col("at"), 2 * F.col("size")).alias("window"))
    cut = cut.where(F.arrays_overlap("window", F.array(*map(F.lit, marks))))
    hashed = cut.select("_row", "size", "width", F.posexplode(_signature(F.col("window"), F.col("width"), F.col("bands"))).alias("band", "minimum"))
    # The templates are a constant of this module or the caller's; both sides of these joins that are broadcast hold nothing else.
    candidates = hashed.join(F.broadcast(signed), ["size", "width", "band", "minimum"]).select("_row", "license").distinct()
    found = candidates.join(F.broadcast(known.select("license", "shingles")), "license").join(rows, "_row")
    shared = F.size(F.filter("shingles", lambda s: F.contains(F.col("words"), F.concat(F.lit(" "), s, F.lit(" ")))))
    found = found.select("doc_id", "license", shared.cast("long").alias("n_shared"), F.size("shingles").cast("long").alias("n_shingles"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("n_shared") >= F.lit(CONTAINMENT) * F.col("n_shingles"))


def op1_licences(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(name, s.replace("'", "''")) for name, t in TEMPLATES.items() for s in template_shingles(t))
    return f"""
WITH t(license, s) AS (VALUES {rows}),
n AS (SELECT license, count(*) AS n_shingles FROM t GROUP BY license),
d AS (SELECT row_number() OVER () AS r, doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS words FROM documents)
SELECT any_value(doc_id)::BIGINT AS doc_id, license, count(*)::BIGINT AS n_shared, any_value(n_shingles)::BIGINT AS n_shingles, count(*) / any_value(n_shingles)::DOUBLE AS containment
FROM d JOIN t ON contains(words, ' ' || s || ' ') JOIN n USING (license) GROUP BY r, license HAVING count(*) >= 0.8 * any_value(n_shingles)
"""


OP1_SQL = _sql()
