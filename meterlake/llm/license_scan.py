"""License scan: sparse TF-IDF cosine of notices and whole texts to templates, then inheritance from directories.

Every text is cut into terms and these into units: lines and, with wrapped lines joined, sentences (a line without
terms ends one), both also ended by ``.``, ``!`` or ``?`` before white space; and the whole text. A unit is a TF-IDF vector:
term counts times ``ln((1 + N) / (1 + df)) + 1``, df being the number of documents, of all N, with
that template term (terms outside the templates weigh as if in one document). Lines and sentences are compared with notices
and titles, whole texts with whole licences, each by the terms of those; the best template by cosine, if ``least`` or more, counts. A document's licence is its whole
text's, else its best notice's. A licence file (a name like LICENSE or COPYING, a whole text found, one that opens with a
title, or one that is mostly notice) gives its licence to its directory; documents without one of their own take that of
the nearest ancestor directory, found by joining paths with directories.

No unit is left out before it is compared but by an exact bound: a cosine is at most the square root of the share that
template terms have of the squared length.

Defined results: null and empty texts have no notice of their own but inherit; a null path has no ancestors;
of equal cosines the template of the smaller name wins, of several licence files in one directory the one of
the largest cosine, then of the smallest path; rows of one id are one document, repeated rows count once; null ids are left out; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import Scratch
from .text_arrays import Run, runs, span_hashes, spans

LEAST = 0.7
MOSTLY = 0.5
#: Usual notices, titles and short whole texts of public licences.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "Licensed under the ISC License"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
TITLES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
WHOLE = [
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]
#: Long licences as published, one file each, named by the licence.
WHOLE += [(f.stem, f.read_text()) for f in sorted(Path(__file__).with_name("licenses").glob("*.txt"))]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DIGIT, _TERM, _STOP, _BLANK = (np.isin(np.arange(256), [ord(c) for c in x]) for x in ("0123456789", "0123456789abcdefghijklmnopqrstuvwxyz", ".!?", " \t\n\r\x0b\x0c"))


def terms(r: Run):
    """(start, hash, text) of the run's terms: lower-cased letters and digits, with a dot between them before a digit (``2.0``)."""
    data = _LOWER[r.data]
    inside = _TERM[data]
    starts = np.zeros(len(data) + 1, bool)
    starts[r.bounds] = True
    if len(data) > 2:
        inside[1:-1] |= (data[1:-1] == 46) & inside[:-2] & _DIGIT[data[2:]] & ~starts[1:-2] & ~starts[2:-1]
    start, end = spans(r, inside)
    return start, span_hashes(data, start, end), np.searchsorted(r.bounds, start, "right") - 1


def units(r: Run, start: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Ascending unit numbers of the terms: by line, by sentence, by text."""
    follows = np.ones(len(r.data), bool)
    follows[:-1] = _BLANK[r.data[1:]]
    stop, line = np.flatnonzero(_STOP[r.data] & follows), np.flatnonzero(r.data == 10)
    bare = np.diff(np.searchsorted(start, line), prepend=0) == 0
    return [np.searchsorted(np.sort(np.concatenate([stop, b])), start) + text for b in (line, line[bare])] + [text]


def _of(texts: list[str]):
    (r,) = runs(pa.array(texts), 1 << 30)
    return terms(r)[1:]


class Templates:
    """Templates of one sort (name, whether a title, text), in order, and the terms that they are made of."""

    def __init__(self, templates: list[tuple[str, bool, str]]):
        self.of = sorted(templates)
        self.hash, self.text = _of([text for *_, text in self.of])
        self.vocabulary = np.unique(self.hash)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term in the vocabulary, -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def matrix(self, idf: np.ndarray) -> np.ndarray:
        """The templates' unit vectors as columns."""
        weight = np.zeros((len(self.vocabulary), len(self.of)))
        np.add.at(weight, (self.places(self.hash), self.text), 1.0)
        weight *= idf[:, None]
        return weight / np.sqrt((weight * weight).sum(axis=0))


#: Lines and sentences are compared with the first, whole texts with the second; each has its own terms.
PARTS = Templates([(name, title, text) for title, of in ((False, NOTICES), (True, TITLES)) for name, text in of])
LICENCES = Templates([(name, False, text) for name, text in WHOLE])
SORTS = (PARTS, LICENCES)


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, n): how many texts hold each term of the first sort, then of the second; -1 with the number of texts."""
    df, n_docs = np.zeros(sum(len(t.vocabulary) for t in SORTS), np.int64), 0
    for batch in batches:
        for r in runs(batch["text"]):
            _, hashes, text = terms(r)
            n_docs += len(r)
            begin = 0
            for sort in SORTS:
                place, size = sort.places(hashes), len(sort.vocabulary)
                both = np.unique(text[place >= 0] * size + place[place >= 0])
                df[begin : begin + size] += np.bincount(both % size, minlength=size)
                begin += size
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int32()), pa.array([*df[some].tolist(), n_docs], pa.int64())], names=["place", "n"])


def best_templates(unit: np.ndarray, hashes: np.ndarray, place: np.ndarray, idf: np.ndarray, rare: float, matrix: np.ndarray, least: float):
    """(unit, column of ``matrix``, cosine) of the units with a cosine of ``least`` or more."""
    n, size = int(unit[-1]) + 1 if len(unit) else 0, len(idf)
    known = place >= 0
    both, tf = np.unique(unit[known] * size + place[known], return_counts=True)
    u, v = both // size, both % size
    w = tf * idf[v]
    inner = np.bincount(u, w * w, n)
    outer = np.bincount(unit[~known], minlength=n) * rare**2  # at least: a term that recurs weighs more
    maybe = (inner > 0) & (inner >= least**2 * (inner + outer))
    some = np.flatnonzero(maybe)
    if not len(some):
        return some, some, np.zeros(0)
    rest = np.flatnonzero(~known & maybe[unit])
    rest = rest[np.lexsort((hashes[rest], unit[rest]))]
    new = np.ones(len(rest), bool)
    new[1:] = (unit[rest[1:]] != unit[rest[:-1]]) | (hashes[rest[1:]] != hashes[rest[:-1]])
    head = np.flatnonzero(new)
    times = np.diff(np.append(head, len(rest)))
    norm = np.sqrt(inner + np.bincount(unit[rest[head]], (times * rare) ** 2, n))[some]
    row, keep = np.searchsorted(some, u), maybe[u]
    top, score = np.zeros(len(some), np.int64), np.zeros(len(some))
    for lo in range(0, len(some), 256):
        own = keep & (row >= lo) & (row < lo + 256)
        dense = np.zeros((min(256, len(some) - lo), size))
        dense[row[own] - lo, v[own]] = w[own]
        cosine = np.round(dense @ matrix / norm[lo : lo + 256, None], 6)
        top[lo : lo + 256], score[lo : lo + 256] = cosine.argmax(axis=1), cosine.max(axis=1)
    ok = score >= least
    return some[ok], top[ok], score[ok]


FOUND = "id long, whole boolean, line boolean, at int, opens boolean, n_words int, n_total int, license string, score double"


def scan(idf: list[np.ndarray], rare: float, least: float):
    names = [c.split()[0] for c in FOUND.split(", ")]
    matrix = [sort.matrix(x) for sort, x in zip(SORTS, idf, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in runs(batch["text"]):
                start, hashes, text = terms(r)
                place = [sort.places(hashes) for sort in SORTS]
                total = np.bincount(text, minlength=len(r))
                for kind, unit in enumerate(units(r, start, text)):
                    new = np.ones(len(unit), bool)
                    new[1:] = unit[1:] != unit[:-1]
                    first = np.flatnonzero(new)
                    k = int(kind == 2)
                    found, top, score = best_templates(np.cumsum(new) - 1, hashes, place[k], idf[k], rare, matrix[k], least)
                    if not len(found):
                        continue
                    owner = text[first[found]]
                    begins = first[found] - np.searchsorted(text, owner)
                    picked = [SORTS[k].of[j] for j in top]
                    columns = [
                        batch["id"].slice(r.first, len(r)).take(pa.array(owner)), pa.array([kind == 2] * len(found)), pa.array([kind == 0] * len(found)), pa.array(begins, pa.int32()),
                        pa.array([title and b == 0 for (_, title, _), b in zip(picked, begins.tolist(), strict=True)]),
                        pa.array(np.diff(np.append(first, len(unit)))[found], pa.int32()), pa.array(total[owner], pa.int32()), pa.array([x[0] for x in picked]), pa.array(score),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", least: float = LEAST) -> DataFrame:
    """(id, license, score, origin, directory): origin is file, header, directory or null."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(path_col).alias("path")).where("id is not null")
    # One row a template term, and -1 with the number of texts.
    df = dict(rows.select("text").mapInArrow(document_counts, "place int, n long").groupBy("place").agg(F.sum("n")).collect())
    n_docs = df.get(-1, 0)
    every = np.array([math.log((1 + n_docs) / (1 + max(1, df.get(k, 0)))) + 1 for k in range(sum(len(t.vocabulary) for t in SORTS))])
    idf = np.split(every, [len(PARTS.vocabulary)])
    units_found = rows.select("id", "text").mapInArrow(scan(idf, math.log((1 + n_docs) / 2) + 1, least), FOUND).distinct()
    best = lambda which: F.min(F.when(which, F.struct((-F.col("score")).alias("minus"), "license")))
    own = units_found.groupBy("id").agg(
        best(F.col("whole")).alias("w"),
        best(~F.col("whole")).alias("x"),
        ((F.sum(F.when(F.col("line"), F.col("n_words")).otherwise(0)) >= MOSTLY * F.max("n_total")) | F.bool_or("opens") | F.bool_or("whole")).alias("file"),
    )
    own = scratch.table(own.select("id", F.coalesce("w.license", "x.license").alias("license"), (-F.coalesce("w.minus", "x.minus")).alias("score"), "file"))

    paths = rows.groupBy("id").agg(F.min("path").alias("path"))
    named = paths.join(own, "id", "left")
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    is_file = F.lower(base).rlike(r"^(licen[sc]e|copying|notice)") | F.col("file")
    directories = (
        named.where(F.col("license").isNotNull() & is_file & F.col("path").isNotNull())
        .withColumn("directory", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1))
        .groupBy("directory")
        .agg(F.min(F.struct((-F.col("score")).alias("minus"), "path", "license")).alias("x"))
        .select("directory", F.col("x.license").alias("dir_license"), (-F.col("x.minus")).alias("dir_score"))
    )
    directories = scratch.table(directories)
    parts = F.split("path", "/", -1)
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i > 0, F.lit("/")).otherwise(F.lit(""))))
    without = named.where("license is null and path is not null").select("id", F.explode(ancestors).alias("directory"))
    inherited = without.join(directories, "directory").groupBy("id").agg(F.max(F.struct(F.length("directory").alias("depth"), "directory", "dir_license", "dir_score")).alias("x"))
    out = named.join(inherited, "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("license", "x.dir_license").alias("license"),
        F.coalesce("score", "x.dir_score").alias("score"),
        F.when(F.col("license").isNotNull(), F.when(is_file, "file").otherwise("header")).when(F.col("x").isNotNull(), "directory").alias("origin"),
        F.col("x.directory").alias("directory"),
    )
