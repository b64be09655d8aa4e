"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are runs of a-z and 0-9 of the lower-cased text.  For a template of ``L`` words a text is cut into windows of
``2 L`` words that begin every ``L`` words, so any stretch of ``L`` words lies whole in one.  A template is found in a
window that holds at least ``num / den`` of the template's distinct five-word shingles (a template with fewer words is
one shingle).

A band is the smallest of a window's shingle hashes under one of many orders; window and template are compared if
they agree in any band.  The number of bands follows from the smallest similarity that a verified match can have
(a window holds words beside the template), so that a match is missed with a chance below ``MISSED``.  Before, texts
with too few of a template's words that share no shingle are left out, which loses nothing: they hold too few of its
shingles; so are windows without any of its *required* words.

The scan consists of Spark expressions and joins; templates are held ``MOST_TEMPLATES`` at a time.

Defined results: null and empty texts have no matches; rows of the same id (null included) are one text collection;
templates without words are never found; equal templates are found alike; without templates or rows the result is
empty; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
MISSED = 1e-6
MOST_TEMPLATES = 2_000

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
    and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
    and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
    IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
    CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
    OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
    NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(thing: str, name: str, version: str) -> str:
    return f"""This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by
        the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {thing} is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""


# Public licence notices.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "MIT line": "Released under the MIT License.",
    "MIT notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "all rights reserved": "All rights reserved.",
    "Apache-2.0 notice, whole": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
        and limitations under the License.""",
    "MIT notice, whole": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
        AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
        THE SOFTWARE.""",
    "BSD-2-Clause": f"{_BSD_START} {_BSD_END}",
    "BSD-3-Clause": f"""{_BSD_START} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. {_BSD_END}""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
        AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
        an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
        marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
        source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and
        to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
        following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
        following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
        unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language
        processor.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
        and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
        interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
        our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights
        to this software under copyright law.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "GPL-2.0 notice": _gnu("program", "General Public License", "2"),
    "GPL-3.0 notice": _gnu("program", "General Public License", "3"),
    "LGPL-2.1 notice": _gnu("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0 notice": _gnu("library", "Lesser General Public License", "3"),
    "AGPL-3.0 notice": _gnu("program", "Affero General Public License", "3"),
    **{f"CC-{k}-4.0 line": f"Licensed under CC {k} 4.0." for k in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    **{f"CC-{k}-4.0": f"This work is licensed under a Creative Commons Attribution{v} 4.0 International License."
       for k, v in {"BY": "", "BY-SA": "-ShareAlike", "BY-ND": "-NoDerivatives", "BY-NC": "-NonCommercial", "BY-NC-SA": "-NonCommercial-ShareAlike",
                    "BY-NC-ND": "-NonCommercial-NoDerivatives"}.items()},
    **{f"SPDX {k}": f"SPDX-License-Identifier: {k}" for k in (
        "MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
        "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0")},
}


def templates_frame(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(sorted(templates.items()), "license_id string, text string")


def words_of(text: str | None) -> list[str]:
    return re.findall("[a-z0-9]+", (text or "").lower())


def shingles_of(words: list[str]) -> set[str]:
    size = min(SHINGLE, len(words))
    return {" ".join(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def required_words(shingles: set[str], num: int, den: int) -> set[str]:
    """Long words such that a text with none of them holds too few of the shingles for a match."""
    need, left, chosen = -(-len(shingles) * num // den), set(shingles), set()
    for word in sorted({w for s in shingles for w in s.split()}, key=lambda w: (-len(w), w)):
        if len(left) < need:
            break
        if any(word in s.split() for s in left):
            chosen.add(word)
            left = {s for s in left if word not in s.split()}
    return chosen


def least_words(shingles: set[str], num: int, den: int) -> tuple[list[str], int]:
    """Long words that share no shingle, and how many of them any text that holds enough shingles must have."""
    lacks, chosen, costs = len(shingles) - -(-len(shingles) * num // den), [], []
    left = set(shingles)
    for word in sorted({w for s in shingles for w in s.split()}, key=lambda w: (-len(w), w)):
        mine = {s for s in shingles if word in s.split()}
        if mine <= left:
            left -= mine
            chosen.append(word)
            costs.append(len(mine))
    absent = sum(1 for i in range(len(costs)) if sum(sorted(costs)[:i + 1]) <= lacks)
    return chosen, len(chosen) - absent


def bands_for(length: int, shingles: int, num: int, den: int) -> int:
    """Bands that miss a match with a chance below ``MISSED``, at the smallest similarity of window and template."""
    size = min(SHINGLE, length)
    both = -(-shingles * num // den)
    similarity = both / (2 * length - size + 1 + shingles - both)
    return ceil(log(MISSED) / log(1 - similarity)) if similarity < 1 else 1


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _shingles(words: Column, size: Column) -> Column:
    """Distinct shingles of an array of words; fewer words than a shingle have none."""
    at = F.sequence(F.lit(1), F.size(words) - size + 1)
    found = F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, size), " ")))
    return F.when(F.size(words) >= size, found).otherwise(F.array().cast("array<string>"))


def _bands(hashes: Column, bands: int | Column) -> Column:
    """For each order the smallest hash, numbered.  An order hashes anew with its number, so each shingle is smallest alike often."""
    orders = F.sequence(F.lit(1), bands if isinstance(bands, Column) else F.lit(bands))
    return F.transform(orders, lambda i: F.xxhash64(i, F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, i)))))


def _hashes(shingles: Column) -> Column:
    return F.transform(shingles, lambda s: F.xxhash64(s))


def _strings(words) -> Column:
    return F.array(*(F.lit(w) for w in words)).cast("array<string>")


def scan(docs: DataFrame, templates: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, license_id, n_windows, first_word, containment) of the templates found in each text.

    ``first_word`` is the place of the first window that holds the template, ``containment`` the largest share of the
    template's shingles in a window.  Texts are read and split once, whatever the templates' lengths."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("scanned"))
    found = rows.limit(0).select("doc", F.lit("").alias("license_id"), F.lit(0).alias("first_word"), F.lit(0.0).alias("containment"))
    known = []
    for row in templates.select("license_id", "text").toLocalIterator():
        known.append((row[0], row[1]))
        if len(known) == MOST_TEMPLATES:  # a part is searched by itself, with a scan of the documents of its own
            found, known = found.unionByName(_retrieved(rows, known, num, den)), []
    if known:
        found = found.unionByName(_retrieved(rows, known, num, den))
    # a window is retrieved by several bands; rows of one id and place are one window
    return (found.groupBy("doc", "license_id", "first_word").agg(F.max("containment").alias("containment"))
            .groupBy("doc", "license_id").agg(F.count("*").alias("n_windows"), F.min("first_word").cast("long").alias("first_word"),
                                              F.max("containment").alias("containment")).withColumnRenamed("doc", id_col))


def _retrieved(rows: DataFrame, known: list[tuple[str, str]], num: int, den: int) -> DataFrame:
    """Rows (doc, license_id, first_word, containment) of the windows of ``rows`` (doc, scanned) that hold a template."""
    spark = rows.sparkSession
    by_length = defaultdict(list)
    for number, (name, text) in enumerate(known):
        words = words_of(text)
        if words:
            by_length[len(words)].append((number, name, shingles_of(words)))
    if not by_length:
        return rows.limit(0).select("doc", F.lit("").alias("license_id"), F.lit(0).alias("first_word"), F.lit(0.0).alias("containment"))
    # one class of windows for each length of a template; tests of a template: its words that share no shingle, how many a text needs
    classes, tests, table = [], [], []
    for number, (length, group) in enumerate(sorted(by_length.items())):
        bands = max(bands_for(length, len(t[2]), num, den) for t in group)
        required = sorted({w for t in group for w in required_words(t[2], num, den)})
        classes.append(F.struct(F.lit(length).alias("length"), F.lit(min(SHINGLE, length)).alias("size"), F.lit(bands).alias("bands"),
                                _strings(required).alias("required")))
        tests += [(number, *least_words(t[2], num, den)) for t in group]
        table += [(number, bands, n, name, sorted(t)) for n, name, t in group]
    needed = _strings(sorted({w for _, words, _ in tests for w in words}))
    several = F.array(*(F.struct(F.lit(k).alias("kind"), _strings(words).alias("words"), F.lit(least).alias("least")) for k, words, least in tests))
    may_hold = F.filter(several, lambda t: F.size(F.array_intersect("have", t["words"])) >= t["least"])
    held = rows.select("doc", _words(F.col("scanned")).alias("words")).withColumn("have", F.array_intersect("words", needed)).where(F.size("have") > 0)
    held = held.select("doc", "words", F.explode(F.array_distinct(F.transform(may_hold, lambda t: t["kind"]))).alias("kind"))
    held = held.withColumn("of", F.element_at(F.array(*classes), F.col("kind") + 1))
    length, size = F.col("of.length"), F.col("of.size")
    cut = F.transform(F.sequence(F.lit(0), F.size("words") - 1, length),
                      lambda at: F.struct(at.alias("first_word"), F.slice("words", at + 1, 2 * length).alias("window")))
    cut = F.filter(cut, lambda w: F.arrays_overlap(w["window"], F.col("of.required")))
    windows = (held.select("doc", "kind", "of", F.explode(cut).alias("w"))
               .select("doc", "kind", F.col("of.bands").alias("bands"), "w.first_word", _shingles(F.col("w.window"), size).alias("shingles"))
               .where(F.size("shingles") > 0))
    windows = windows.select("doc", "kind", "first_word", "shingles", F.explode(F.array_distinct(_bands(_hashes(F.col("shingles")), F.col("bands")))).alias("band"))
    mine = spark.createDataFrame(table, "kind int, bands int, template int, license_id string, wanted array<string>")
    keys = mine.select("kind", "template", F.explode(F.array_distinct(_bands(_hashes(F.col("wanted")), F.col("bands")))).alias("band"))
    # both tables are bounded: at most MOST_TEMPLATES * bands rows of three numbers, and each template's shingles once
    return (windows.join(F.broadcast(keys), ["kind", "band"]).join(F.broadcast(mine.select("template", "license_id", "wanted")), "template")
            .withColumn("both", F.size(F.array_intersect("shingles", "wanted")))
            .where(F.col("both") * den >= F.size("wanted") * num)
            .select("doc", "license_id", "first_word", (F.col("both") / F.size("wanted")).alias("containment")))


def sql(templates: dict[str, str] = TEMPLATES) -> str:
    """The same matches by comparing every window with every template, for DuckDB."""
    rows = ", ".join("('{}', '{}')".format(k.replace("'", "''"), " ".join(words_of(v))) for k, v in sorted(templates.items()))
    shingles = "list_distinct(list_transform(range(1, len({w}) - {s} + 2), lambda i: array_to_string({w}[i:i + {s} - 1], ' ')))"
    return f"""
WITH t AS (SELECT license_id, string_split(x, ' ') AS w, len(string_split(x, ' ')) AS n FROM (VALUES {rows}) AS v(license_id, x)),
tt AS (SELECT license_id, n, least(n, {SHINGLE}) AS s, {shingles.format(w="w", s=f"least(n, {SHINGLE})")} AS wanted FROM t),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
win AS (SELECT doc_id, n, s, first_word, w[first_word + 1:first_word + 2 * n] AS x
        FROM (SELECT doc_id, w, n, s, unnest(range(0, len(w), n)) AS first_word FROM d, (SELECT DISTINCT n, s FROM tt))),
sh AS (SELECT doc_id, n, first_word, CASE WHEN len(x) >= s THEN {shingles.format(w="x", s="s")} ELSE [] END AS shingles FROM win),
m AS (SELECT doc_id, license_id, first_word, len(list_intersect(shingles, wanted)) AS both_, len(wanted) AS all_ FROM sh JOIN tt USING (n)),
f AS (SELECT doc_id, license_id, first_word, max(both_ / all_) AS containment FROM m WHERE both_ * 100 >= all_ * 80 GROUP BY ALL)
SELECT doc_id, license_id, count(*) AS n_windows, min(first_word) AS first_word, max(containment) AS containment FROM f GROUP BY doc_id, license_id
"""
