"""Operator 7: licence scans by Dice coefficient over word bigrams, with DataFrame functions only."""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: A text is taken for a licence from this Dice coefficient on.
THRESHOLD = Fraction(8, 10)

#: Lines that name a holder aren't part of a licence.
HOLDER = r"(?im)^[ \t*#/;-]*copyright[ \t]+(?:\(c\)|©|[0-9]{4})[^\n]*$"

#: Notices and licence texts, one template each.
TEMPLATES = {
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
        "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated "
        "but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being "
        "the original software. This notice may not be removed or altered from any source distribution."
    ),
}


def _bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)})


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def word_bigrams(text: Column) -> Column:
    """Distinct bigrams of the words (runs of letters and digits, lower-cased), lines of holders left out."""
    words = F.array_remove(F.split(F.lower(F.regexp_replace(text, HOLDER, "")), "[^\\p{L}\\p{N}]+"), "")

    def pairs(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
        return F.when(F.size(w) > 1, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

    return _let(words, pairs)


def scan_licences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    threshold: Fraction = THRESHOLD,
) -> DataFrame:
    """(doc_id, line, licence, dice): lines, and whole texts of several lines, that match a template.

    ``line`` counts from 0; the whole text is line -1. A unit's licence is the
    template of greatest Dice coefficient, the first by name on ties. Units
    with fewer or more bigrams than a template allows at the threshold aren't
    compared with it, nor are units that share too few bigrams with all
    templates together: both bounds lose nothing. Lines that name a copyright
    holder are left out of a unit. Bigrams are counted once
    each, so a text of any length can match. No shuffle; templates are
    literals of the plan.

    Null and empty texts have no match. A null id keeps its rows; repeated rows
    each have theirs. Other columns are ignored.
    """
    grams = {name: _bigrams(t) for name, t in sorted((TEMPLATES if templates is None else templates).items())}
    grams = {name: g for name, g in grams.items() if g}
    t = Fraction(threshold)
    sizes = [len(g) for g in grams.values()] or [1]
    # Dice >= t needs sizes within a factor of (2 - t) / t, and t / 2 * (n + m) shared bigrams.
    low = [math.ceil(m * t / (2 - t)) for m in sizes]
    high = [math.floor(m * (2 - t) / t) for m in sizes]
    every = sorted(set().union(*grams.values())) if grams else [""]
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = plain.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "unit"))
    whole = plain.where(F.col("text").contains("\n"))
    units = lines.unionByName(whole.select("doc_id", F.lit(-1).alias("line"), F.col("text").alias("unit")))
    # n bigrams need n + 1 words and so 2 n + 1 characters.
    units = units.where(F.length("unit") > 2 * min(low)).withColumn("grams", word_bigrams(F.col("unit")))
    n = F.size("grams")
    shared = F.size(F.filter("grams", lambda g: g.isin(every)))
    units = units.where((n >= min(low)) & (n <= max(high)))
    units = units.where(shared * (2 * t.denominator) >= t.numerator * (n + min(sizes)))
    found = []
    for k, ((name, g), lo, hi) in enumerate(zip(grams.items(), low, high, strict=True)):
        both = F.size(F.array_intersect("grams", F.array(*map(F.lit, g))))
        match = F.struct((2.0 * both / (n + len(g))).alias("dice"), F.lit(-k).alias("rank"), F.lit(name).alias("licence"))
        close = 2 * t.denominator * both >= t.numerator * (n + len(g))
        found.append(F.when((n >= lo) & (n <= hi), F.when(close, match)))
    none = F.lit(None).cast("struct<dice: double, rank: int, licence: string>")
    units = units.withColumn("best", F.array_max(F.array_compact(F.array(none, *found))))
    return units.where("best is not null").select(
        "doc_id", F.col("line").cast("int").alias("line"), "best.licence", F.round("best.dice", 9).alias("dice")
    )


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence matches of every line and every whole text of ``documents``."""
    return scan_licences(read(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join(
        f"('{name}', [{', '.join(repr(g) for g in _bigrams(text))}])" for name, text in sorted(TEMPLATES.items())
    )
    return f"""
WITH t(licence, tg) AS (VALUES {rows}),
u AS (
  SELECT doc_id, (i - 1)::INTEGER AS line, l[i] AS unit
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  UNION ALL SELECT doc_id, -1, text FROM documents WHERE contains(text, chr(10))
),
h AS (SELECT doc_id, line, regexp_replace(unit, '{HOLDER}', '', 'g') AS unit FROM u),
w AS (SELECT doc_id, line, list_filter(string_split_regex(lower(unit), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM h),
g AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
m AS (SELECT doc_id, line, licence, len(list_intersect(g, tg)) AS b, len(g) + len(tg) AS s FROM g, t WHERE len(g) <= 1.5 * len(tg) AND len(tg) <= 1.5 * len(g)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY 2.0::DOUBLE * b / s DESC, licence) AS k FROM m WHERE 20 * b >= 8 * s)
SELECT doc_id, line, licence, round(2.0::DOUBLE * b / s, 9) AS dice FROM r WHERE k = 1
"""


SQL = _sql()
