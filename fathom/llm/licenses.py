"""Licence scans: texts, their lines and runs of lines against templates, by Dice over word bigrams.

Text is normalised to lower-cased runs of letters and digits. Dice is
2 |A & B| / (|A| + |B|) over sets of adjacent word pairs. It can't reach the threshold t
unless |A| lies between |B| t / (2 - t) and |B| (2 - t) / t, so templates outside these
bounds are pruned before anything is compared, as are texts that hold too few bigrams of
every template. Everything is done within a row; only matches are grouped by document.

Null and empty texts match nothing; a text or line of one word has no bigrams.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

# Public licence wording.
#: Short notices, licence openings and whole short licences, by SPDX-like id.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights": "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
    "all-rights-notice": "All rights reserved.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-project": "This project is licensed under the MIT License.",
    "BSD-licensed": "Licensed under the BSD License.",
    "GPL-licensed": "Licensed under the GNU General Public License.",
    "MPL-2.0-licensed": "Licensed under the Mozilla Public License, Version 2.0.",
    "CC-BY-4.0-licensed": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-licensed": "Licensed under CC BY-SA 4.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-license": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
THRESHOLD = 0.8


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """The least and greatest set size that can reach the threshold against `size` bigrams."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def _strings(items: list[str]) -> Column:
    """An array of bigrams, as one parsed literal: thousands of single ones take the driver seconds."""
    return F.expr(f"array({', '.join(f"'{x}'" for x in items)})")


def _words(col: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "), " "), "")


def _passages(texts: DataFrame, grams: dict[str, list[str]], threshold: float) -> DataFrame:
    """doc_id, scope "lines", dice and license of templates that a run of lines fits best.

    One row for each row and template of which a run of two or more lines reaches the
    threshold and more than the text and each line do; lines without words don't count.
    """
    # A passage of that dice shares at least the lower size bound with the template, and so
    # does the text around it, which few texts do. As in scan, no filter stands on what is
    # computed here, nor does a plain explode, as that infers one.
    wanted = F.array(*[F.struct(F.lit(k).alias("license"), _strings(g).alias("b"), F.lit(size_bounds(len(g), threshold)[0]).alias("low"), F.lit(size_bounds(len(g), threshold)[1]).alias("high")) for k, g in grams.items()])
    known = _strings(sorted({x for g in grams.values() for x in g}))
    whole = texts.where(F.col("text").contains("\n")).select("doc_id", "text", _words(F.col("text")).alias("all"))
    pairs = lambda w: F.filter(F.array_distinct(F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))), lambda p: p.contains(" "))
    held = whole.select("doc_id", "text", F.array_intersect(pairs(F.col("all")), known).alias("held"))
    near = held.select("doc_id", "text", F.when(F.size("held") > 0, F.filter(wanted, lambda t: F.size(F.array_intersect("held", t["b"])) >= t["low"])).alias("near"))
    some = near.select("doc_id", F.when(F.size("near") > 0, F.filter(F.transform(F.split("text", "\n"), _words), lambda w: F.size(w) > 0)).alias("lines"), F.explode_outer("near").alias("t"))
    dice = lambda shared, size: 2.0 * shared / (size + F.size("t.b"))
    alone = F.transform(F.concat(F.array(F.flatten("lines")), F.col("lines")), lambda w: F.transform(F.array(pairs(w)), lambda g: dice(F.size(F.array_intersect(g, F.col("t.b"))), F.size(g)))[0])
    left = some.select("doc_id", "lines", "t", F.array_max(alone).alias("alone"))
    words = F.flatten(F.transform("lines", lambda w, i: F.transform(w, lambda x, k: F.struct(x.alias("w"), i.alias("line"), (k == 0).alias("first")))))
    placed = left.select("doc_id", "t", "alone", F.when((F.size("lines") > 1) & (F.col("alone") < 1), words).alias("words"))
    after = lambda i: F.get("words", i + 1)
    steps = F.filter(
        F.transform("words", lambda x, i: F.struct(F.concat_ws(" ", x["w"], after(i)["w"]).alias("g"), x["line"].alias("line"), x["first"].alias("first"), after(i)["line"].alias("end"))),
        lambda x: x["end"].isNotNull(),
    )
    back = placed.select("doc_id", "t", "alone", F.transform(F.reverse(steps), lambda x: F.struct(x["g"].alias("g"), x["line"].alias("line"), x["first"].alias("first"), x["end"].alias("end"), F.array_contains("t.b", x["g"]).cast("int").alias("hit"))).alias("steps"))

    # Going back from the last bigram, seen holds the distinct bigrams from here on in order
    # of their first place, with the line of that, up to one more than can match. Runs from
    # the present line end where one of these is the last of its line.
    def best(seen: Column, line: Column) -> Column:
        value = lambda s: F.when(s["end"] > line, dice(s["hits"], s["n"])).otherwise(0.0)
        return F.aggregate(
            seen,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("hits"), line.alias("end"), F.lit(0.0).alias("best")),
            lambda s, y: F.struct((s["n"] + 1).alias("n"), (s["hits"] + y["hit"]).alias("hits"), y["end"].alias("end"), F.when(y["end"] > s["end"], F.greatest(s["best"], value(s))).otherwise(s["best"]).alias("best")),
            lambda s: F.greatest(s["best"], value(s)),
        )

    def step(acc: Column, x: Column) -> Column:
        mine = F.struct(x["g"].alias("g"), x["end"].alias("end"), x["hit"].alias("hit"))
        seen = F.slice(F.concat(F.array(mine), F.filter(acc["seen"], lambda y: y["g"] != x["g"])), F.lit(1), F.col("t.high") + 1)
        return F.transform(F.array(seen), lambda s: F.struct(s.alias("seen"), F.when(x["first"], F.greatest(acc["best"], best(s, x["line"]))).otherwise(acc["best"]).alias("best")))[0]

    start = F.struct(F.expr("cast(array() as array<struct<g: string, end: int, hit: int>>)").alias("seen"), F.lit(0.0).alias("best"))
    found = back.select("doc_id", "t.license", "alone", F.aggregate("steps", start, step, lambda acc: acc["best"]).alias("dice"))
    fits = (F.col("dice") >= threshold - 1e-12) & (F.col("dice") > F.col("alone") + 1e-12)
    return found.select("doc_id", F.lit("lines").alias("scope"), F.explode_outer(F.when(fits, F.array(F.struct("dice", "license")))).alias("m")).where("m is not null")


def _likely(texts: DataFrame, grams: dict[str, list[str]], threshold: float) -> DataFrame:
    """The texts that hold enough bigrams of some template for a part of them to match it.

    A part's bigrams are the text's, so one that reaches the threshold shares at least the
    template's lower size bound with the text, too. Bigrams are compared as 64-bit hashes
    here: equal ones have equal hashes, and what is let through is compared in full.
    """
    known = sorted({x for g in grams.values() for x in g})
    row = texts.sparkSession.range(1).select(F.transform(_strings(known), lambda x: F.xxhash64(F.substring_index(x, " ", 1), F.substring_index(x, " ", -1))).alias("h")).first()
    code = {x: f"{h}L" if h > -(2**63) else "(-9223372036854775807L - 1L)" for x, h in zip(known, row.h, strict=True)}
    held = F.expr(f"array_distinct(filter(transform(words, (w, i) -> xxhash64(w, get(words, i + 1))), h -> h in ({', '.join(code.values())})))")
    some = texts.select("doc_id", "text", _words(F.col("text")).alias("words")).select("doc_id", "text", held.alias("held"))
    near = F.lit(False)
    for g in grams.values():
        near = near | (F.size(F.array_intersect("held", F.expr(f"array({', '.join(code[x] for x in g)})"))) >= size_bounds(len(g), threshold)[0])
    # As elsewhere here, no filter stands on what is computed, as it would be computed again.
    kept = some.select(F.explode_outer(F.when((F.size("held") > 0) & near, F.array(F.struct("doc_id", "text")))).alias("x"))
    return kept.where("x is not null").select("x.doc_id", "x.text")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, license, dice, scope, n_matches.

    Units are the whole text, each of its lines, and for each template the run of two or more
    lines that is nearest to it, if it is nearer than the text and every line are. license is
    that of the best match (by dice, then the whole text first, then id), with its dice and
    scope ("text", "line" or "lines"); n_matches counts pairs of a unit and a template of at
    least the threshold. license, dice and scope are null, and n_matches 0, where nothing
    matches. Rows of one doc_id are scanned as one document.
    """
    grams = {k: bigrams(normal_words(t)) for k, t in (templates or TEMPLATES).items()}
    grams = {k: g for k, g in grams.items() if g}
    bounds = {k: size_bounds(len(g), threshold) for k, g in grams.items()}
    least, most = min(b[0] for b in bounds.values()), max(b[1] for b in bounds.values())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = saved(_likely(texts, grams, threshold), "licences")
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("line").alias("scope"), x.alias("unit")))
    units = texts.select("doc_id", F.explode(F.concat(F.array(F.struct(F.lit("text").alias("scope"), F.col("text").alias("unit"))), lines)).alias("u")).select("doc_id", "u.scope", "u.unit")
    # A set of s bigrams takes s + 1 words and, at one letter a word, 2 s + 1 characters; d
    # distinct words make d - 1 distinct bigrams at least. These bounds stand in conditional
    # expressions: as filters they would be pushed below the columns that they test, which
    # would then be computed over again for every use.
    words = units.select("doc_id", "scope", F.when(F.length("unit") > 2 * least, _words(F.col("unit"))).alias("words"))
    pairs = F.array_distinct(F.transform("words", lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1))))
    fits = (F.size("words") > least) & (F.size(F.array_distinct("words")) <= most + 1)
    sets = words.select("doc_id", "scope", F.when(fits, F.filter(pairs, lambda p: p.contains(" "))).alias("g"))
    found = []
    for k, g in grams.items():
        low, high = bounds[k]
        dice = 2.0 * F.size(F.array_intersect("g", _strings(g))) / (F.size("g") + len(g))
        found.append(F.when(F.size("g").between(low, high), F.struct(dice.alias("dice"), F.lit(k).alias("license"))))
    known = _strings(sorted({x for g in grams.values() for x in g}))
    near = F.when(F.size("g").between(least, most) & F.arrays_overlap("g", known), F.array_compact(F.array(*found)))
    hits = sets.select("doc_id", "scope", F.explode(near).alias("m")).where(F.col("m.dice") >= threshold - 1e-12)
    hits = hits.union(_passages(texts, grams, threshold))
    best = F.min(F.struct((-F.col("m.dice")).alias("d"), (F.col("scope") != "text").alias("s"), F.col("m.license").alias("license"), F.col("scope").alias("scope")))
    per_doc = hits.groupBy("doc_id").agg(best.alias("b"), F.count("*").alias("n_matches"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(per_doc, "doc_id", "left").select("doc_id", "b.license", (-F.col("b.d")).alias("dice"), "b.scope", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"))
