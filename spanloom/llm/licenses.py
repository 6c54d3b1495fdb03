"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies. DataFrame functions only.

Texts are read as the runs of ASCII letters and digits of their lower case. A template of ``n`` five-word shingles looks at windows of
``ceil(1.5 n)`` shingles, one every ``ceil(n / 2)``, so that one window holds any occurrence whole; templates of the same
``n`` share windows. With containment 0.8 or more in such a window the Jaccard similarity is at least
``0.8 / (1.5 + 1 - 0.8) = 0.47`` (less for rounding: 0.4), and ``BANDS`` = 32 bands of one value collide with
probability ``1 - 0.6 ** 32``, above 0.9999999.

A band of one value collides only in windows that hold the template's smallest shingle under that band's hash. Windows
without any of these at most ``templates * BANDS`` shingles are left out before sketching: this loses nothing, and leaves one
hash and one look-up a word for ordinary texts. Candidates are verified on the shingles as strings: a window must hold
0.8 or more of the template's.

A template of under five words is one shingle, its whole word sequence, and goes the same way with shingles of its own
number of words, in texts that hold its longest word. Each window leaves its text before it is one row, so that a text of nothing
but license lines costs no more than its words.

Defined results: null, blank and shorter texts match nothing; templates without words are refused; equal rows give one
result a license; rows with a null id are scanned and keep the null; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import text_of

K, BANDS, THRESHOLD = 5, 32, 0.8
#: Public license notices, as their owners word them.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT-line": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    # The condition that BSD-3-Clause adds: it tells the two apart.
    "BSD-3-Clause-condition": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "All-rights-reserved-line": "All rights reserved.",
    "BSL-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
}


def normal_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def shingles(text: str) -> tuple[int, list[str]]:
    """(words of a shingle, the distinct shingles of a template, sorted)."""
    w = normal_words(text)
    k = min(K, len(w))
    return k, sorted({" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}) if k else []


def window_of(n: int) -> tuple[int, int]:
    """(shingles of a window, step) for templates of n shingles."""
    return math.ceil(1.5 * n), math.ceil(n / 2)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _hash(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[words[i + j] for j in range(k)])


def _windows(texts: DataFrame, k: int, anchors: dict[int, list[int]]) -> DataFrame:
    """(id, h, n, first_word, part, held) of the windows of texts (id, h, w) that hold an anchor: their shingles' hashes and their words."""
    g = F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: _hash(F.col("w"), i, k))).otherwise(F.array().cast("array<long>"))
    df = texts.withColumn("g", g)
    every = sorted({x for own in anchors.values() for x in own})
    hits = F.filter(F.transform("g", lambda x, i: F.when(x.isin(every), i)), lambda x: x.isNotNull())
    hits = F.when(F.arrays_overlap("g", F.array(*map(F.lit, every))), hits).otherwise(F.array().cast("array<int>"))
    # The row number keeps the optimiser from pushing the condition, with all it is made of, down into the lambdas above.
    df = df.select("id", "h", "w", "g", hits.alias("hits"), F.monotonically_increasing_id().alias("row")).where((F.col("row") >= 0) & (F.size("hits") > 0))

    def one(n: int) -> Column:
        width, step = window_of(n)
        own = F.filter("hits", lambda p: F.col("g")[p].isin(anchors[n]))
        return F.struct(F.lit(n).alias("n"), F.lit(width).alias("width"), F.lit(step).alias("step"), own.alias("own"))

    df = df.withColumn("x", F.explode(F.filter(F.array(*map(one, sorted(anchors))), lambda x: F.size(x["own"]) > 0))).select("id", "h", "w", "g", "x.*")
    lowest = lambda p: F.greatest(F.lit(0), F.ceil((p - F.col("width") + 1) / F.col("step")).cast("int"))
    at = F.array_distinct(F.flatten(F.transform("own", lambda p: F.sequence(lowest(p), F.floor(p / F.col("step")).cast("int")))))
    start = lambda j: j * F.col("step")
    pieces = F.transform(at, lambda j: F.struct(start(j).alias("first_word"), F.slice("g", start(j) + 1, F.col("width")).alias("part"), F.slice("w", start(j) + 1, F.col("width") + (k - 1)).alias("held")))
    return df.select("id", "h", "n", F.explode(pieces).alias("x")).select("id", "h", "n", "x.*")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = BANDS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, n_shared, n_shingles, first_word): the window of each text that holds most of each license's shingles."""
    spark = docs.sparkSession
    known = {name: shingles(text) for name, text in (templates or TEMPLATES).items()}
    if empty := [name for name, (_, s) in known.items() if not s]:
        raise ValueError(f"templates without words: {empty}")
    found = []
    for k in sorted({k for k, _ in known.values()}):
        # The templates are constants: their sketches are a table of templates * bands rows.
        own = spark.createDataFrame([(name, len(s), s) for name, (c, s) in known.items() if c == k], "license string, n int, own array<string>")
        hashed = own.withColumn("g", F.transform("own", lambda x: _hash(F.split(x, " "), F.lit(0), k)))  # noqa: B023
        least = lambda g, band: F.array_min(F.transform(g, lambda x: F.struct(F.xxhash64(x, band).alias("v"), x.alias("x"))))
        sketches = hashed.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).withColumn("low", least(F.col("g"), F.col("band")))
        sketches = sketches.select("license", "n", "own", "band", F.col("low.v").alias("value"), F.col("low.x").alias("anchor")).collect()
        anchors: dict[int, set[int]] = {}
        for r in sketches:
            anchors.setdefault(r["n"], set()).add(r["anchor"])
        table = spark.createDataFrame([(r["license"], r["n"], r["own"], r["band"], r["value"]) for r in sketches], "license string, n int, own array<string>, band int, value long")

        texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
        if k < K:
            longest = sorted({max(s[0].split(), key=len) for c, s in known.values() if c == k})
            texts = texts.where(reduce(or_, [F.contains(F.lower("t"), F.lit(x)) for x in longest]))
        texts = texts.select("id", F.xxhash64("t").alias("h"), _words(F.col("t")).alias("w"))
        windows = _windows(texts, k, {n: sorted(x) for n, x in anchors.items()})
        sketched = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.array_min(F.transform("part", lambda x: F.xxhash64(x, j))))
        windows = windows.select("id", "h", "n", "first_word", "held", F.posexplode(sketched).alias("band", "value"))
        text = F.transform(F.sequence(F.lit(0), F.size("held") - k), lambda i: F.array_join(F.slice("held", i + 1, k), " "))  # noqa: B023
        met = windows.join(F.broadcast(table), ["n", "band", "value"]).withColumn("n_shared", F.size(F.array_intersect("own", text)))
        found.append(met.select("id", "h", "license", "n", "n_shared", "first_word"))
    every = reduce(DataFrame.unionByName, found).where(F.col("n_shared") * 1000 >= F.col("n") * round(threshold * 1000))
    best = every.groupBy("id", "h", "license").agg(F.max(F.struct("n_shared", (-F.col("first_word")).alias("first"), "n")).alias("b"))
    return best.select(F.col("id").alias(id_col), "license", F.col("b.n_shared").cast("long").alias("n_shared"), F.col("b.n").cast("long").alias("n_shingles"), (-F.col("b.first")).cast("long").alias("first_word"))
