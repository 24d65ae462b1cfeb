"""Licence scan by Dice coefficient over word bigrams, in DataFrame functions only.

A text is put in lower case, and every run of characters other than a-z, 0-9 and line ends becomes one space. Units are each
line, each paragraph of several lines (between lines without a letter or digit) and a whole text of several paragraphs; so a
notice is found where it has lines of its own, and a licence file as a whole, but no notice amid a longer line. A unit is
compared only to templates whose number of distinct bigrams allows the threshold: with n and m bigrams the coefficient is
2 c / (n + m) <= 2 min(n, m) / (n + m), so n is between m t / (2 - t) and m (2 - t) / t. All of a document is done within its
row: nothing is shuffled.

Before bigrams are made, units go that can't match: at least m t / (2 - t) of a template's bigrams must occur, so if fewer are
left without those that hold one of some words, one of these words must occur (marks). This loses nothing.

Defined results: null text counts as empty; a document without a match has count 0, empty names and coefficient 0; of equal
coefficients the name first in order wins; repeated rows repeat; an empty table gives no rows; texts of any length are done whole.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Licence notices and short licence texts, as published.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "bsd": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "reserved": ["All rights reserved."],
}


def template_bigrams(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(name, distinct bigrams) for each template text."""
    out = []
    for name, texts in sorted(templates.items()):
        for t in texts:
            w = re.sub("[^a-z0-9]+", " ", t.lower()).split()
            out.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})))
    return out


def size_bounds(m: int, threshold: float) -> tuple[int, int]:
    """The numbers of bigrams that a unit can have to reach the threshold against m bigrams."""
    fits = [n for n in range(1, int(m * (2 - threshold) / threshold) + 2) if 2 * min(n, m) / (n + m) >= threshold]
    return fits[0], fits[-1]


def marks(grams: list[str], threshold: float) -> set[str]:
    """Words of which any unit that reaches the threshold against these bigrams has one: the longest, until too few bigrams are without."""
    need, out = math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9), set()
    for w in sorted({w for g in grams for w in g.split()}, key=lambda w: (-len(w), w)):
        if sum(out.isdisjoint(g.split()) for g in grams) < need:
            break
        out.add(w)
    return out


def scan(documents: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_matches (units), licenses (distinct names, comma-joined, in order), best (name), best_dice for each row of documents (columns doc_id, text)."""
    known = [(name, grams, *size_bounds(len(grams), threshold)) for name, grams in template_bigrams(templates)]
    least, most = min(k[2] for k in known), max(k[3] for k in known)
    words = sorted(set().union(*(marks(g, threshold) for _, g, _, _ in known)))
    words = [w for w in words if not any(x != w and x in w for x in words)]
    marked = lambda t: F.greatest(*[t.contains(w) for w in words]) if len(words) > 1 else t.contains(words[0])
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g)).alias("m"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, g, a, b in known])
    rows = documents.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    rows = rows.select("doc_id", F.when(marked(F.col("text")), F.regexp_replace("text", "[^a-z0-9\n]+", " ")).otherwise(F.lit("")).alias("text"))
    paragraphs = F.filter(F.split("text", "\n *\n"), lambda p: p.contains("\n"))
    whole = F.when(F.col("text").rlike("\n *\n"), F.array("text")).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", F.filter(F.concat(F.split("text", "\n"), paragraphs, whole), marked).alias("units"))
    rows = rows.select("doc_id", F.transform("units", lambda u: F.filter(F.split(u, "[ \n]"), lambda x: x != "")).alias("units"))
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
    rows = rows.select("doc_id", F.filter(F.transform(F.filter("units", lambda w: F.size(w) > 1), lambda w: F.array_distinct(pairs(w))), lambda g: F.size(g).between(least, most)).alias("units"))

    def best_of(g: Column) -> Column:
        near = F.filter("templates", lambda t: F.size(g).between(t["a"], t["b"]))
        return F.filter(
            F.transform(near, lambda t: F.struct((F.lit(-2.0) * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["m"])).alias("minus"), t["name"].alias("name"))),
            lambda x: x["minus"] <= -threshold,
        )

    hits = rows.withColumn("templates", table).select("doc_id", F.filter(F.transform("units", lambda g: F.array_min(best_of(g))), lambda x: x.isNotNull()).alias("hits"))
    top = F.array_min("hits")
    return hits.select(
        "doc_id",
        F.size("hits").cast("long").alias("n_matches"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["name"])))).alias("licenses"),
        F.coalesce(top["name"], F.lit("")).alias("best"),
        F.coalesce(-top["minus"], F.lit(0.0)).alias("best_dice"),
    )


def oracle(threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES) -> str:
    """The scan in DuckDB's SQL."""
    values = ", ".join("(" + f"'{n}', [" + ", ".join(f"'{x}'" for x in g) + "])" for n, g in template_bigrams(templates))
    return rf"""
        WITH t(name, grams) AS (VALUES {values}),
        d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS text FROM documents),
        u AS (SELECT r, unnest(list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '\n *\n'), lambda p: contains(p, chr(10))),
              CASE WHEN regexp_matches(text, '\n *\n') THEN [text] ELSE [] END)) AS unit FROM d),
        w AS (SELECT r, row_number() OVER () AS i, list_filter(regexp_split_to_array(unit, '[ \n]'), lambda x: x <> '') AS w FROM u),
        g AS (SELECT r, i, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM w WHERE len(w) > 1),
        s AS (SELECT r, i, name, 2.0::DOUBLE * len(list_intersect(g.g, t.grams)) / (len(g.g) + len(t.grams)) AS dice FROM g, t
              WHERE 2.0 * least(len(g.g), len(t.grams)) / (len(g.g) + len(t.grams)) >= {threshold}),
        m AS (SELECT r, i, name, dice, row_number() OVER (PARTITION BY i ORDER BY dice DESC, name) AS n FROM s WHERE dice >= {threshold}),
        h AS (SELECT r, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(dice) AS best_dice, arg_min(name, struct_pack(a := -dice, b := name)) AS best FROM m WHERE n = 1 GROUP BY r)
        SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, coalesce(best, '') AS best, coalesce(best_dice, 0.0) AS best_dice FROM d LEFT JOIN h USING (r)"""
