"""Operator 3: licence notices found by the Dice coefficient of word bigrams, in DataFrame functions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence notices as they are commonly written, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("proprietary", "Copyright (c). All rights reserved."),
)
#: SPDX identifiers that tags name, and further notices of one line; compared with whole lines, numbered after the whole notices.
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "EUPL-1.2", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense", "Zlib", "BSL-1.0")
FURTHER = (
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or later."),
    ("EUPL-1.2", "This work is licensed under the European Union Public Licence, version 1.2."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD", "This project is licensed under the BSD 3-Clause License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
)
TAGS = (*((name, f"SPDX-License-Identifier: {name}") for name in SPDX), *FURTHER)
#: Whole notices, looked for in passages beside the templates; numbered after them.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)
#: What a copyright line says around years and holder, which do not count there.
RESERVED = "copyright(?: c)?(?: [a-z0-9]+){0,12}? all rights reserved"
#: Words too common in English to be of use as anchors; they are chosen last.
COMMON = ("a", "and", "any", "be", "by", "following", "general", "in", "is", "may", "not", "of", "or", "published", "subject", "the", "this", "to", "under", "with", "you")
NOT_WORD = "[^a-z0-9]+"


def normal(text: str) -> str:
    """The normal form of a template: ASCII lower case, other characters than a-z and 0-9 as single blanks."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.sub(NOT_WORD, " ", lower).strip(" ")


def bigrams(words: list[str]) -> list[str]:
    return sorted({" ".join(words[k : k + 2]) for k in range(max(1, len(words) - 1))}) if words else []


def anchors(templates, percent: int) -> list[str]:
    """Words of which any unit that reaches ``percent`` with some template holds one.

    A unit with Dice of ``percent`` or more shares at least ``need`` of a
    template's bigrams, ``need`` from the smallest size the bounds allow.  If
    all but ``need - 1`` of the bigrams hold a chosen word, one of the shared
    does.  Words are chosen
    by length, then name, common ones last.
    """
    chosen: set[str] = set()
    for _, text in templates:
        own = bigrams(normal(text).split(" "))
        smallest = -(-percent * len(own) // (200 - percent))
        need = -(-percent * (len(own) + smallest) // 200)
        left = [g for g in own if not chosen & set(g.split(" "))]
        for word in sorted({w for g in left for w in g.split(" ")}, key=lambda w: (w in COMMON, -len(w), w)):
            if len(left) < need:
                break
            if any(word in g.split(" ") for g in left):
                chosen.add(word)
                left = [g for g in left if word not in g.split(" ")]
    return sorted(chosen)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def passages(docs: DataFrame, templates=TEMPLATES, percent: int = 80, notices=NOTICES) -> DataFrame:
    """Notices of ``docs`` that no line holds as a whole, in the columns of ``lines``.

    The words of all lines in a row are compared in windows of a template's
    word count.  A pair of words that holds an anchor and stands in the template
    chooses the start, wherever else the template goes.  A copyright line is
    compared without its years and holder.  Windows that touch a line which
    ``lines`` finds are left out; of windows that meet, the one that shares most
    stays, then the better, the earlier template, the earlier place.  ``line``
    is the one where the window begins.
    """
    whole = [(k, name, normal(text).split(" ")) for k, (name, text) in enumerate((*templates, *notices)) if normal(text)]
    known = [(k, name, w, bigrams(w), set(anchors([(name, " ".join(w))], percent))) for k, name, w in whole]
    own_lines = [g for _, text in templates if (g := bigrams(normal(text).split(" ")))]
    every = sorted(set().union(*[t[4] for t in known]) | {"reserved"})
    found = docs.select("doc_id", ascii_lower(F.col("text")).alias("text")).filter(F.col("text").rlike(f"(?<![a-z0-9])(?:{'|'.join(every)})(?![a-z0-9])"))

    def words_in(unit: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(unit, NOT_WORD, " "), " "), lambda w: w != "")

    def pairs(w: Column) -> Column:
        n = F.size(w)
        return F.when(n == 1, w).when(n > 1, F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b)))

    def shared_with(own: Column, grams: list[str]) -> Column:
        return F.size(F.array_intersect(own, F.array(*map(F.lit, grams)))).cast("long")

    def reaches(unit: Column) -> Column:
        """Whether a line is found by itself."""
        def some(own: Column) -> Column:
            out = F.lit(False)
            for g in own_lines:
                out = out | (200 * shared_with(own, g) >= percent * (F.size(own) + len(g)))
            return out

        return F.exists(F.array(F.array_distinct(pairs(words_in(unit)))), lambda own: own.isNotNull() & some(own))

    # generators stand between the steps, so that no expression is copied into the next one
    split = F.split("text", "\n", -1)
    flat = F.flatten(F.transform(split, lambda unit, k: F.transform(words_in(unit), lambda w: F.struct(w.alias("w"), k.alias("line")))))
    once = found.select("doc_id", F.inline(F.array(F.struct(split.alias("units"), flat.alias("flat")))))
    once = once.select("doc_id", "units", F.inline(F.array(F.struct(F.col("flat.w").alias("w"), F.col("flat.line").alias("at"), pairs(F.col("flat.w")).alias("pairs")))))

    def hit(name: str, k: int, start: Column, n: Column, shared: Column, unit: Column, size: int) -> Column:
        row = {"s": -shared, "d": -F.floor(2_000_000 * shared / (unit + size)), "template": F.lit(k), "start": start, "end": start + n - 1, "license": F.lit(name), "shared": shared, "unit_size": unit, "template_size": F.lit(size)}
        return F.struct(*[c.cast("string" if x == "license" else "long").alias(x) for x, c in row.items()])

    def windows(k: int, name: str, own: list[str], grams: list[str], marks: set[str]) -> Column:
        n, size = len(own), len(grams)
        order = [" ".join(own[j : j + 2]) for j in range(max(1, n - 1))]
        held = [(j, g) for j, g in enumerate(order) if marks & set(g.split(" "))]
        places = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(g).alias("g")) for j, g in held])
        choose = F.array(*[F.lit(g) for g in sorted({g for _, g in held})])
        met = F.filter(F.transform("pairs", lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda x: F.array_contains(choose, x["g"]))
        starts = F.array_distinct(F.flatten(F.transform(met, lambda x: F.transform(F.filter(places, lambda y: y["g"] == x["g"]), lambda y: x["i"] - y["j"]))))
        starts = F.filter(starts, lambda i: (i >= 0) & (i + n <= F.size("w")))
        scored = F.transform(starts, lambda i: F.transform(F.array(F.array_distinct(F.slice("pairs", i + 1, F.lit(max(1, n - 1))))), lambda g: hit(name, k, i, F.lit(n), shared_with(g, grams), F.size(g), size))[0])
        return F.filter(scored, lambda h: 200 * h["shared"] >= percent * (h["unit_size"] + h["template_size"]))

    all_hits = [windows(*t) for t in known]
    for k, name, own, grams, _ in known:
        if " ".join(own) == "copyright c all rights reserved":
            text = F.transform(F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"] == "copyright"), lambda x: F.struct(
                x["i"].alias("i"), F.regexp_extract(F.array_join(F.slice("w", x["i"] + 1, F.lit(17)), " "), "^" + RESERVED, 0).alias("t")))
            all_hits.append(F.transform(F.filter(text, lambda x: x["t"] != ""), lambda x: hit(name, k, x["i"], F.size(F.split(x["t"], " ")), F.lit(len(grams)), F.lit(len(grams)), len(grams))))
    # one column for all templates; lines are looked at only where there are windows
    hits = once.select("doc_id", "units", "at", F.inline(F.array(F.struct(F.array_sort(F.concat(*all_hits)).alias("hits"))))).filter("size(hits) > 0")
    taken = F.transform("units", lambda u: reaches(u))
    hits = hits.select("doc_id", "at", "hits", F.inline(F.array(F.struct(taken.alias("taken")))))
    free = F.filter("hits", lambda h: ~F.exists(F.slice("taken", F.col("at")[h["start"]] + 1, F.col("at")[h["end"]] - F.col("at")[h["start"]] + 1), lambda x: x))
    hits = hits.select("doc_id", "at", F.inline(F.array(F.struct(free.alias("free")))))
    chosen = F.aggregate("free", F.slice("free", 1, 0), lambda got, h: F.when(F.exists(got, lambda g: (g["start"] <= h["end"]) & (h["start"] <= g["end"])), got).otherwise(F.concat(got, F.array(h))))
    return hits.select("doc_id", "at", F.inline(chosen)).select(
        "doc_id", F.col("at")[F.col("start").cast("int")].cast("long").alias("line"), "license", "template", "shared", "unit_size", "template_size", (-F.col("d")).alias("dice_1e6"),
    )


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = 80, notices=NOTICES) -> DataFrame:
    """Licence notices of ``docs``: the ``lines`` that are one, and the ``passages`` that hold one over, or in a part of, other lines."""
    return lines(docs, templates, percent).unionByName(passages(docs, templates, percent, notices))


def of_lines(templates, tags) -> list[tuple[int, str, str]]:
    """(number, license, normal form) of what lines are compared with."""
    return [(k, name, own) for first, some in ((0, templates), (len(templates) + len(NOTICES), tags)) for k, (name, text) in enumerate(some, first) if (own := normal(text))]


def lines(docs: DataFrame, templates=TEMPLATES, percent: int = 80, tags=TAGS) -> DataFrame:
    """Lines of ``docs`` (doc_id, text) that reach ``percent`` with a licence template, with the best template of each.

    Every line of a text is a unit.  Its normal form has ASCII letters in lower
    case and runs of other characters than a-z and 0-9 as one blank; its set is
    the distinct pairs of neighbouring words (a single word stands for itself).
    Dice is 2 * shared / (units + templates).  A template of b bigrams is
    compared only with units of b * p / (200 - p) to b * (200 - p) / p bigrams,
    outside which Dice cannot reach p percent, and only lines that hold an
    anchor word are split.  Ties go to the template listed first.
    Rows: doc_id, line (from 0), license, template (its place), shared,
    unit_size, template_size, dice_1e6 (whole millionths, rounded down).
    Null or empty text has no rows, repeated rows are scanned on their own.
    The templates are few and fixed, so they are literals of the expression.
    """
    known = [(k, name, g, len(g)) for k, name, own in of_lines(templates, tags) if (g := bigrams(own.split(" ")))]
    p = F.lit(percent)
    smallest, largest = min(t[3] for t in known), max(t[3] for t in known)
    words = f"(?<![a-z0-9])(?:{'|'.join(anchors((*templates, *tags), percent))})(?![a-z0-9])"
    found = docs.select("doc_id", ascii_lower(F.col("text")).alias("text")).filter(F.col("text").rlike(words))

    def grams_of(unit: Column) -> Column:
        """The bigram set of a line, null for lines without an anchor or with too few words.

        The words are a lambda's variable, which is evaluated once, not once for each place.
        """

        def of_words(w: Column) -> Column:
            n = F.size(w)
            pairs = F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))
            # repeats make a set smaller than its words, so only the lower bound can be put before it is built
            return F.when(n * (200 - p) >= p * smallest, F.array_distinct(F.when(n == 1, w).otherwise(pairs)))

        split = F.split(F.trim(F.regexp_replace(unit, NOT_WORD, " ")), " ")
        return F.when(unit.rlike(words), F.transform(F.array(split), of_words)[0])

    # a generator stands between the steps, so that no expression is copied into the next one
    units = F.filter(F.transform(F.split("text", "\n", -1), lambda unit, k: F.struct(k.alias("line"), grams_of(unit).alias("own"))), lambda u: u["own"].isNotNull())
    units = found.select("doc_id", F.inline(units)).withColumn("unit_size", F.size("own"))
    units = units.filter(F.col("unit_size") * p <= (200 - p) * largest)

    def against(k: int, name: str, grams: list[str], size: int) -> Column:
        """(-dice, template, ...) of one template, null outside its bounds or below the threshold."""
        shared = F.size(F.array_intersect("own", F.array(*map(F.lit, grams)))).cast("long")
        inside = (F.col("unit_size") * (200 - p) >= p * size) & (F.col("unit_size") * p <= (200 - p) * size)
        dice = F.floor(2_000_000 * shared / (F.col("unit_size") + size))
        row = F.struct((-dice).alias("d"), F.lit(k).cast("long").alias("template"), F.lit(name).alias("license"), shared.alias("shared"), F.lit(size).cast("long").alias("template_size"))
        return F.when(inside, F.when(200 * shared >= p * (F.col("unit_size") + size), row))

    best = F.filter(F.array(F.least(*[against(*t) for t in known])), lambda b: b.isNotNull())
    return units.select("doc_id", "line", "unit_size", F.inline(best)).select(
        "doc_id", F.col("line").cast("long").alias("line"), "license", "template", "shared",
        F.col("unit_size").cast("long").alias("unit_size"), "template_size", (-F.col("d")).alias("dice_1e6"),
    )


def scan_sql(templates=TEMPLATES, percent: int = 80, tags=TAGS) -> str:
    """``lines`` in DuckDB SQL, without anchors."""
    quoted = ", ".join(f"({k}, '{name}', '{own}')" for k, name, own in of_lines(templates, tags))
    return f"""
WITH known AS (
  SELECT template, license, w, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS grams
  FROM (SELECT template, license, string_split(t, ' ') AS w FROM (VALUES {quoted}) v(template, license, t))
), lines AS (
  SELECT doc_id, k - 1 AS line, trim(regexp_replace(translate(parts[k], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS unit
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) u(k)
), units AS (
  SELECT doc_id, line, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS own
  FROM (SELECT doc_id, line, string_split(unit, ' ') AS w FROM lines WHERE unit <> '')
), met AS (
  SELECT doc_id, line, license, template, len(list_intersect(own, grams)) AS shared, len(own) AS unit_size, len(grams) AS template_size
  FROM units, known WHERE len(own) * (200 - {percent}) >= {percent} * len(grams) AND len(own) * {percent} <= (200 - {percent}) * len(grams)
)
SELECT doc_id, line, license, CAST(template AS BIGINT) AS template, shared, unit_size, template_size, CAST(2000000 * shared // (unit_size + template_size) AS BIGINT) AS dice_1e6
FROM met WHERE 200 * shared >= {percent} * (unit_size + template_size)
QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY 2000000 * shared // (unit_size + template_size) DESC, template) = 1
"""
