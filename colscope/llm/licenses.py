"""Licence scans by Dice coefficient over word bigrams, in native expressions.

Segments are every line, paragraph (lines up to a blank one) and whole text; runs of neighbouring lines, paragraphs and
sentences; and windows of as many words as a template and more, wherever they start.  Runs and windows go up to ``reach``
bigrams, half as many again as the template at 0.8, so a licence with foreign words in between is found.  A segment is normalised (lower
case, runs of other characters than a-z and 0-9 as one space) and its distinct word bigrams are compared with
those of the licence templates: 2 * common / (size + size).  Two bounds spare nearly all of that work and lose nothing:

* A coefficient of t needs t / (2 - t) of a template's bigrams at least.  ``marker_words`` finds a few words that
  touch so many bigrams of every template that a segment without any of them cannot reach it.
* The sizes of both sides can differ by the factor t / (2 - t) at most, so a segment joins, by its size, only the templates
  whose range holds it; the table of sizes is as large as the templates' texts together, whatever the corpus.
* A text can hold a run or window that reaches t only if it holds that share of the template's bigrams, and only near a place
  where so many stand within ``reach``.  A run begins with a part that holds such a place, a window begins there: what stands before adds
  nothing in common.  From each start one walk over the next ``reach`` bigrams counts distinct and common ones up to every end.

Defined results: NULL and empty texts match nothing; a segment of one word has no bigram and matches nothing; a
document that holds a licence in several segments gives one row with its best coefficient; rows that
share a doc_id count together; NULL doc_id gives rows with NULL doc_id; empty in, empty out.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Public licence notices and short licence texts.
TEMPLATES = {
    "MIT (notice)": "Released under the MIT License.",
    "MIT (licensed)": "Licensed under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0 (notice)": "Licensed under CC BY-ND 4.0.",
    "All rights reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0 (header)": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0 (header)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0 (header)": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0 (header)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD (redistribution)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}


def template_bigrams(text: str) -> set[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def size_range(size: int, threshold: float) -> tuple[int, int]:
    """Sizes of the other side that can reach the threshold."""
    share = threshold / (2 - threshold)
    return math.ceil(round(size * share, 9)), math.floor(round(size / share, 9))


def marker_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every segment that reaches the threshold with any template holds one (greedy, long words first)."""
    left = {name: template_bigrams(text) for name, text in templates.items()}
    need = {name: len(grams) * threshold / (2 - threshold) for name, grams in left.items()}
    chosen: list[str] = []
    while any(len(grams) >= need[name] for name, grams in left.items()):
        gains: dict[str, int] = {}
        for name, grams in left.items():
            if len(grams) >= need[name]:
                for gram in grams:
                    for word in gram.split():
                        gains[word] = gains.get(word, 0) + 1
        best = max(gains, key=lambda w: (len(w) >= 6, gains[w], w))
        chosen.append(best)
        left = {name: {g for g in grams if best not in g.split()} for name, grams in left.items()}
    return sorted(chosen)


def bigrams(segment: Column) -> Column:
    """Distinct word bigrams of a segment."""
    words = F.split(F.trim(F.regexp_replace(F.lower(segment), "[^a-z0-9]+", " ")), " ")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


#: Stands for the end of a line or sentence among the words.
_END = "\x01"


def reach(length: int, threshold: float) -> int:
    """Bigrams (repeats counted) of the longest run or window that is compared with a template of ``length`` bigrams."""
    return math.floor(round(length / (threshold / (2 - threshold)), 9))


def inner_segments(rows: DataFrame, templates: list[tuple[str, list[str], int, int, int]], threshold: float) -> DataFrame:
    """doc_id, license, dice of the best run of lines or sentences or window (below the threshold or NULL, too), for texts that hold enough of a template's bigrams.

    ``templates``: name, bigrams, bigrams with repeats, least common bigrams, reach.  They are one literal of the plan.
    """
    table = F.array(*(F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(length).alias("length"),
                               F.lit(least).alias("least"), F.lit(far).alias("reach")) for name, grams, length, least, far in templates))
    every = F.array(*(F.lit(g) for g in sorted({g for _, grams, *_ in templates for g in grams})))

    def best(first: Column, allowed) -> Column:
        """Best coefficient of the bigrams from ``first`` to any allowed last one; a bigram is new if it does not stand between."""
        def step(so_far: Column, m: Column) -> Column:
            new = m["before"] < first
            size, common = so_far["size"] + new.cast("int"), so_far["common"] + (new & m["hit"]).cast("int")
            dice = (2 * common).cast("double") / (size + F.size("template.grams"))
            return F.struct(size.alias("size"), common.alias("common"), F.when(allowed(m), F.greatest(so_far["best"], dice)).otherwise(so_far["best"]).alias("best"))
        nothing = F.struct(F.lit(0).alias("size"), F.lit(0).alias("common"), F.lit(0.0).alias("best"))
        return F.aggregate(F.slice("marks", first + 1, F.col("template.reach")), nothing, step, lambda end: end["best"])

    ended = F.regexp_replace(F.lower("text"), r"\n|(?<=[.!?:;])\s", f" {_END} ")
    tokens = F.split(F.trim(F.regexp_replace(ended, f"[^a-z0-9{_END}]+", " ")), " ")
    cut = rows.select("doc_id", tokens.alias("tokens"))
    at = F.filter(F.transform("tokens", lambda w, i: F.when(w == _END, i)), lambda i: i.isNotNull())
    # A mark's place without the marks before it is the number of words before it.
    cut = cut.select("doc_id", F.filter("tokens", lambda w: (w != _END) & (w != "")).alias("words"), F.transform(at, lambda i, k: i - k).alias("ends"))
    pairs = F.zip_with(F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    cut = cut.select("doc_id", pairs.alias("grams"), F.array_distinct(F.concat(F.array(F.lit(0)), "ends", F.array(F.size("words")))).alias("ends"))
    # Where the line or sentence of each word begins.
    begins = F.flatten(F.transform("ends", lambda a, k: F.array_repeat(a, F.coalesce(F.get("ends", k + 1) - a, F.lit(0)))))
    held = cut.select("doc_id", "grams", begins.alias("begins"), F.array_intersect("grams", every).alias("known"))
    held = held.select("doc_id", "grams", "begins", F.explode(F.filter(table, lambda t: (F.size("known") >= t["least"])
                                                                      & (F.size(F.array_intersect(t["grams"], F.col("known"))) >= t["least"]))).alias("template"))
    held = held.withColumn("hits", F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains("template.grams", g), i)), lambda i: i.isNotNull()))
    held = held.withColumn("starts", F.filter("hits", lambda h, k: F.get("hits", k + F.col("template.least") - 1) < h + F.col("template.reach")))
    held = held.withColumn("ordered", F.when(F.size("starts") > 0, F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("gram"), i.alias("place"))))))
    held = held.withColumn("marks", F.array_sort(F.transform("ordered", lambda x, k: F.struct(
        x["place"].alias("place"),
        F.when(F.get("ordered", k - 1)["gram"] == x["gram"], F.get("ordered", k - 1)["place"]).otherwise(-1).alias("before"),
        F.array_contains("template.grams", x["gram"]).alias("hit"),
        # The bigram's second word ends a line or sentence, or the text.
        F.coalesce(F.get("begins", x["place"] + 2) == x["place"] + 2, F.lit(True)).alias("ends")))))
    windows = F.transform(
        F.array_distinct(F.transform("starts", lambda h: F.greatest(F.lit(0), F.least(h, F.size("grams") - F.col("template.length"))))),
        lambda a: best(a, lambda m: m["place"] - a + 1 >= F.col("template.length")))
    runs = F.transform(F.array_distinct(F.transform("starts", lambda h: F.get("begins", h))), lambda a: best(a, lambda m: m["ends"]))
    # No filter on dice here: Spark would push it, with all that it is made of, into every step above.
    return held.select("doc_id", "template.license", F.array_max(F.concat(windows, runs)).alias("dice"))


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and licence: doc_id, license, dice (best of its segments)."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    marks = marker_words(templates, threshold)
    sizes = [(n, name, len(grams), sorted(grams)) for name, body in templates.items() if (grams := template_bigrams(body))
             for n in range(size_range(len(grams), threshold)[0], size_range(len(grams), threshold)[1] + 1)]
    ranges = spark.createDataFrame(sizes, "size int, license string, template_size int, template array<string>")

    def marked(body: Column) -> Column:
        # An array of one: its element is lower-cased once, not once a marker.
        return F.exists(F.array(F.lower(body)), lambda lowered: reduce(or_, (F.contains(lowered, F.lit(mark)) for mark in marks), F.lit(False)))

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(marked(F.col("text")))
    parts = F.concat(F.array("text"), F.split("text", r"\n[ \t\r]*\n", -1), F.split("text", "\n", -1))
    segments = rows.select("doc_id", F.explode(F.array_distinct(parts)).alias("segment")).where(marked(F.col("segment")))
    grams = segments.select("doc_id", bigrams(F.col("segment")).alias("grams"))
    sized = grams.select("doc_id", "grams", F.size("grams").alias("size"))
    common = F.size(F.array_intersect("grams", "template"))
    dice = (2 * common).cast("double") / (F.col("size") + F.col("template_size"))
    lengths = [(name, sorted(grams), n, size_range(len(grams), threshold)[0], reach(n, threshold)) for name, body in templates.items()
               if (grams := template_bigrams(body)) and (n := len(re.sub(r"[^a-z0-9]+", " ", body.lower()).split()) - 1)]
    found = sized.join(F.broadcast(ranges), "size").select("doc_id", "license", dice.alias("dice")).where(F.col("dice") >= threshold)
    if lengths:
        found = found.unionByName(inner_segments(rows, lengths, threshold))
    return (found
            .groupBy("doc_id", "license").agg(F.max("dice").alias("best")).where(F.col("best") >= threshold)
            .select("doc_id", "license", F.round("best", 6).alias("dice")))
