"""Licence scans: stretches of words of a text against licence templates by Dice over word bigrams.

Native expressions only. Templates are notices, file headers, identifiers and bodies of licences. As they are
few, they are literals of the plan. A match cannot do without some bigrams of its template; wherever
one of them stands in a text, the template is laid over the words so that it would stand in its place. The stretch under it
is compared if its number of bigrams lies within the bounds that the Dice threshold allows. Lines,
comment marks and what stands around a notice play no role.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Notices, identifiers, headers and grants by licence.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
}
THRESHOLD = 0.8


def normal_words(text: str) -> list[str]:
    """Lower-case runs of letters and digits (ASCII)."""
    return re.findall("[a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)}))


def bigrams(words: list[str]) -> list[str]:
    """The distinct word bigrams."""
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(q: int, t: float) -> tuple[int, int]:
    """Numbers of bigrams that a stretch may have to reach Dice t with a template of q."""
    return ceil(q * t / (2 - t) - 1e-9), floor(q * (2 - t) / t + 1e-9)


@dataclass(frozen=True)
class Template:
    """``anchors``: (bigram, word number) wherever one of the bigrams stands that a match must share at least one of."""

    license: str
    words: int
    grams: list[str]
    bounds: tuple[int, int]
    anchors: list[tuple[str, int]]


def prepared(templates: Mapping[str, str | Sequence[str]], threshold: float) -> list[Template]:
    """Templates of two words or more, by name; the longest bigrams are the required ones, as they are rare in other texts."""
    out = []
    for name, texts in sorted(templates.items()):
        for text in [texts] if isinstance(texts, str) else texts:
            words = normal_words(text)
            grams = bigrams(words)
            if grams:
                low, high = size_bounds(len(grams), threshold)
                needed = sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - ceil(threshold / 2 * (len(grams) + low) - 1e-9) + 1]
                anchors = [(f"{a} {b}", o) for o, (a, b) in enumerate(zip(words, words[1:], strict=False)) if f"{a} {b}" in needed]
                out.append(Template(name, len(words), grams, (low, high), anchors))
    return out


def _pattern(grams: list[str]) -> str:
    """A pattern for any of the bigrams, whatever stands between their words; choices are grouped by initial and first word."""
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b in (g.split(" ") for g in grams):
        tree.setdefault(a[0], {}).setdefault(a[1:], []).append(b)
    choices = "|".join(f"{c}(?:{'|'.join(f'{a}[^a-z0-9]+(?:{chr(124).join(seconds)})' for a, seconds in firsts.items())})" for c, firsts in tree.items())
    return rf"(?i)(?=[{''.join(sorted(tree))}])(?<![a-z0-9])(?:{choices})(?![a-z0-9])"


def _text_words(text: Column) -> Column:
    """Words of a text as in ``normal_words``, by native expressions."""
    return F.filter(F.split(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _word_pairs(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda x, y: F.concat_ws(" ", x, y))


def _once(df: DataFrame, value: Column, name: str, *others: str) -> DataFrame:
    """Generates the value as a row of its own; else the planner repeats its expression wherever the next step names it."""
    return df.select(*others, F.explode(F.array(value)).alias(name))


def scan_licenses(docs: DataFrame, templates: Mapping[str, str | Sequence[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start_word, n_words, license, dice) of every stretch of every whole text that matches a template.

    Words are runs of ASCII letters and digits, numbered from 0; a stretch has the number of words of its template, less at the
    ends of a text. A stretch that starts in the first half of an earlier match, or lies within one, is the
    same find: of these the one that shares most bigrams counts, then the highest Dice, the least start and the first name.
    Templates of under two words match nothing. Null and blank texts match nothing; texts of any length
    are scanned whole; rows that repeat an id and a text are reported once, different texts of one id (or without one) each;
    other columns are ignored; an empty table gives no rows.
    """
    known = prepared(templates, threshold)
    if not known:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.lit(0).cast(t).alias(c) for c, t in (("start_word", "long"), ("n_words", "long"), ("license", "string"), ("dice", "double"))]).where("false")
    kinds, reach = len(known), max(t.words for t in known)
    # a template laid at word s is one number, (s + reach) * kinds + its place in the list
    places: dict[str, list[int]] = {}
    for k, t in enumerate(known):
        for gram, o in t.anchors:
            places.setdefault(gram, []).append((reach - o) * kinds + k)
    laid = F.expr("map({})".format(", ".join(f"'{gram}', array({', '.join(f'{x}L' for x in codes)})" for gram, codes in sorted(places.items()))))
    grams_of = F.expr("array({})".format(", ".join("array({})".format(", ".join(f"'{g}'" for g in t.grams)) for t in known)))
    of = lambda value, kind, k: F.get(F.array(*[value(t) for t in known]), k.cast("int")).cast(kind)

    text = F.col("text").cast("string")
    held = docs.where(text.rlike(_pattern(sorted(places)))).select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("print"), text.alias("text"))
    worded = _once(held, _text_words(F.col("text")), "w", "doc_id", "print")
    hits = F.filter(F.transform(_word_pairs(F.col("w")), lambda g, i: F.struct(g.alias("g"), i.cast("long").alias("i"))), lambda h: h["g"].isin(sorted(places)))
    codes = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.try_element_at(laid, h["g"]), lambda c: h["i"] * kinds + c))))

    def stretch(c: Column) -> Column:
        at, k = (F.floor(c / kinds) - reach).cast("int"), c % kinds
        start = F.greatest(at, F.lit(0))
        return F.struct(k.cast("int").alias("k"), start.cast("long").alias("start_word"), F.slice("w", start + 1, F.least(at + of(lambda t: F.lit(t.words), "int", k), F.size("w")) - start).alias("words"))

    tried = worded.select("doc_id", "print", F.explode(F.transform(codes, stretch)).alias("s")).select("doc_id", "print", "s.k", "s.start_word", F.size("s.words").cast("long").alias("n_words"), "s.words")
    tried = _once(tried, F.array_distinct(_word_pairs(F.col("words"))), "grams", "doc_id", "print", "k", "start_word", "n_words")
    k, size = F.col("k"), F.size("grams")
    tried = tried.where(size.between(of(lambda t: F.lit(t.bounds[0]), "int", k), of(lambda t: F.lit(t.bounds[1]), "int", k)))
    tried = _once(tried, F.struct(F.size(F.array_intersect("grams", F.get(grams_of, k))).alias("shared"), (size + of(lambda t: F.lit(len(t.grams)), "int", k)).alias("both")), "n", "doc_id", "print", "k", "start_word", "n_words")
    found = tried.select("doc_id", "print", "start_word", "n_words", of(lambda t: F.lit(t.license), "string", k).alias("license"), "n.shared", (2 * F.col("n.shared") / F.col("n.both")).alias("dice")).where(F.col("dice") >= threshold - 1e-12)

    one = Window.partitionBy("doc_id", "print")
    earlier = one.orderBy("start_word", F.desc("n_words")).rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce((F.col("start_word") >= F.max(F.col("start_word") + F.ceil(F.col("n_words") / 2)).over(earlier)) & (F.col("start_word") + F.col("n_words") > F.max(F.col("start_word") + F.col("n_words")).over(earlier)), F.lit(True))
    finds = found.withColumn("apart", apart).withColumn("find", F.sum(F.col("apart").cast("int")).over(one.orderBy("start_word", F.desc("n_words")).rowsBetween(Window.unboundedPreceding, 0)))
    first = Window.partitionBy("doc_id", "print", "find").orderBy(F.desc("shared"), F.desc("dice"), "start_word", "license", "n_words")
    return finds.withColumn("place", F.row_number().over(first)).where("place = 1").select("doc_id", "start_word", "n_words", "license", "dice")
