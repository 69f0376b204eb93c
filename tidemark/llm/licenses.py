"""License scans by MinHash bands over overlapping text windows, in SQL functions only.

Templates are license notices. A template of n five-word shingles belongs to the size class of the
next bound c >= n; documents are read in windows of c + c/4 shingles, a new one every c/4, so that
any passage of c shingles lies whole in a window, wherever it begins. Window and template that
share 0.8 of the template have a Jaccard similarity of at least ``least_jaccard``, and a class has as
many bands of ``ROWS`` hash functions as make a collision likelier than 1 - ``MISS`` at that
similarity. Windows that collide with a template are verified by exact containment.

The bands alone retrieve: any library goes by a join on their keys. A library of up to ``INLINE_BYTES`` is
also written into the plan, which spares signatures that can't collide: those of windows without a
single shingle of a template of their class, and of texts without any of the ``probe_words``, which are
not even split into words. Both conditions are necessary for a match and far from sufficient, so
results don't depend on them. Documents are read once; with a small library nothing is shuffled but the
matches, and those combine before the shuffle.

Cases: null, empty and short texts match nothing; templates of fewer than five words match nothing;
repeated rows and rows of one doc_id, null among them, are one document in the result; of equal
containments the first window counts; without templates or documents there are no matches; other columns
are ignored. A very long text is one row in memory with 8 bytes a word. Rows of one license name are
templates of their own; the document has the name if it holds any.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

SHINGLE, THRESHOLD = 5, 0.8
ROWS, MISS = 2, 1e-6
#: Bytes of a library that is written into the plan and broadcast.
INLINE_BYTES = 64_000

# Names and texts of public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
}


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; one empty word if there are none."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ", -1)


def shingle_hashes(w: Column) -> Column:
    """Hash of each run of five words, in order; null if there is none."""
    n = F.size(w) - SHINGLE + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)])))


def longs(numbers: Iterable[int]) -> Column:
    return F.expr(f"array({', '.join(f'{n}L' for n in numbers)})")


def bounds(most: int) -> list[int]:
    """Upper bounds of the size classes, a quarter apart, up to the class of ``most`` shingles."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


def stride(bound: int) -> int:
    return max(1, bound // 4)


def needed(shingles: int, threshold: float = THRESHOLD) -> int:
    """Shingles of a template that a match holds at least."""
    return max(1, math.ceil(threshold * shingles - 1e-9))


def least_jaccard(smallest: int, bound: int, threshold: float = THRESHOLD) -> float:
    """Of a window of the class and a template that it holds, if the template has ``smallest`` shingles or more."""
    own = needed(smallest, threshold)
    return own / (bound + stride(bound) + smallest - own)


def bands(smallest: int, bound: int, threshold: float = THRESHOLD, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(least_jaccard(smallest, bound, threshold) ** rows)))


def signature(shingles: Column, n: int, rows: int = ROWS) -> Column:
    """Keys of ``n`` bands; a hash function is the hash of the shingle with a mask of its own."""
    rng = random.Random(5)
    masks = F.array(*[longs(rng.getrandbits(63) for _ in range(rows)) for _ in range(n)])
    least = lambda mask: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, mask)))
    return F.transform(masks, lambda band, j: F.xxhash64(j, *[least(F.get(band, F.lit(r))) for r in range(rows)]))


def probe_words(templates: Iterable[Sequence[str]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every text that holds a template has one: fewer shingles of a template are without them than a match holds."""
    chosen: set[str] = set()
    for w in templates:
        own = {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
        for word in sorted(set(w), key=lambda x: (x not in chosen, -len(x), x)):
            if len(left := [s for s in own if not chosen & set(s)]) < needed(len(own), threshold):
                break
            if any(word in s for s in left):
                chosen.add(word)
    return sorted(chosen)


def find_licenses(docs: DataFrame, templates: DataFrame | Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", inline: int = INLINE_BYTES) -> DataFrame:
    """(doc_id, license, containment, first_word) of every document and template that it holds.

    ``templates``: names and texts, or a table (license, text). ``containment`` is the most that a window
    holds; ``first_word`` is where the first window that matches begins, in words of the document from 0.
    """
    spark = docs.sparkSession
    given = templates if isinstance(templates, DataFrame) else spark.createDataFrame(list(templates.items()), "license string, text string")
    library = given.select("license", F.octet_length("text").alias("bytes"), words(F.col("text")).alias("w"))
    library = library.withColumn("t_own", F.array_distinct(shingle_hashes(F.col("w")))).where("t_own IS NOT NULL").withColumn("n", F.size("t_own"))
    whole = library.agg(F.max("n"), F.sum("bytes")).first()
    kind = docs.select(F.col(doc_id).cast("long").alias("doc_id")).schema
    if not whole[0]:
        return spark.createDataFrame([], kind).select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"))
    limits = F.array(*map(F.lit, bounds(whole[0])))
    library = library.withColumn("t_class", F.array_min(F.filter(limits, lambda b: b >= F.col("n"))))
    smallest = dict(library.groupBy("t_class").agg(F.min("n")).collect())  # a row for each class, so few
    hashed = F.transform(F.array(words(F.col(text))), shingle_hashes)  # bound by lambdas and generators, so that no filter makes Spark work them out again
    some: dict[int, Column] = {}
    if small := whole[1] <= inline:
        own = library.select("t_class", "w", "t_own").collect()
        some = {c: longs({h for r in own if r["t_class"] == c for h in r["t_own"]}) for c in smallest}
        known = longs({h for r in own for h in r["t_own"]})
        probes = probe_words([r["w"] for r in own], threshold)
        docs = docs.where(F.exists(F.array(F.lower(F.col(text))), lambda t: reduce(or_, [F.contains(t, F.lit(p)) for p in probes])))
        hashed = F.filter(hashed, lambda h: F.arrays_overlap(h, known))
    hashed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.explode(hashed).alias("h")).where("h IS NOT NULL")

    def windows(bound: int) -> Column:
        step = stride(bound)
        whole = lambda x: F.floor(x).cast("int")
        starts = F.sequence(F.lit(0), whole((F.size("h") - 1) / step))
        if bound in some:
            places = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains(some[bound], x), i)), lambda i: i.isNotNull())
            starts = F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(F.greatest(F.lit(0), whole((i - bound) / step)), whole(i / step)))))
        out = F.transform(starts, lambda k: F.struct(F.lit(bound).alias("class"), (k * step).alias("start"), F.array_distinct(F.slice("h", k * step + 1, bound + step)).alias("own")))
        return F.when(F.arrays_overlap("h", some[bound]), out) if bound in some else out

    def keys(own: Column, of: Column) -> Column:
        out = F.lit(None).cast("array<bigint>")
        for bound, n in smallest.items():
            out = F.when(of == bound, signature(own, bands(n, bound, threshold))).otherwise(out)
        return out

    wins = hashed.select("doc_id", F.explode(F.flatten(F.array_compact(F.array(*map(windows, smallest))))).alias("win")).select("doc_id", "win.*")
    wins = wins.select("doc_id", "class", "start", "own", F.explode(keys(F.col("own"), F.col("class"))).alias("key"))
    library = cut(library.select("license", "t_class", "t_own", F.monotonically_increasing_id().alias("t")))  # written, so that numbers stay
    index = library.select("t", "t_class", F.explode(keys(F.col("t_own"), F.col("t_class"))).alias("t_key"))
    texts = library.select(F.col("t").alias("of_t"), "license", "t_own")
    if small:
        index, texts = F.broadcast(index), F.broadcast(texts)
    met = wins.join(index, (F.col("class") == F.col("t_class")) & (F.col("key") == F.col("t_key"))).join(texts, F.col("t") == F.col("of_t"))
    share = F.size(F.array_intersect("own", "t_own")) / F.size("t_own")
    found = met.select("doc_id", "license", "start", share.alias("containment")).where(F.col("containment") >= threshold)
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("start").alias("first_word"))
