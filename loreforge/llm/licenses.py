"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies them.

Texts are lower-cased and cut into runs of letters and digits; shingles are five words in a row. Templates are
grouped by length, and each group has windows that are long enough to hold any of its templates whole, wherever it
begins: they start at multiples of a stride, and longest template + stride - 1 is rounded up to a multiple of it, so that
the minima of a window are those of its blocks. A window that holds a share of ``containment`` of a template's m
shingles has a Jaccard similarity of at least s / (window's shingles + m - s) with it, s = ceil(c*m), so the number of bands, of
``rows`` MinHashes each, follows from the probability ``sure`` with which such a window must collide. A template is
reported where the share of its shingles, counted exactly in the window, reaches ``containment``.

Hits of a template in overlapping windows are one hit, the best of them. Texts are scanned whole, whatever their
length. Templates go to each task: the list below, or texts of a folder (:func:`read_templates`), of ``MOST`` characters
in all at most. Null and blank texts, and texts of fewer than five words,
hold nothing. Rows that repeat an id are each scanned; an empty table gives an empty result; other columns are not read.
"""

import math
import re
import zlib
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices and texts of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT-whole": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause-whole": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-whole": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-whole": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-whole": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
#: Characters of a folder's templates at most.
MOST = 8 << 20
_WORD = re.compile(r"[^\W_]+")
WIDTH = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _order(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    """One of the orders by which minima are taken. Shingle hashes are mixed, so an odd factor permutes them well."""
    return (h ^ (seed >> np.uint64(7))) * seed


class _Words(dict):
    def __missing__(self, word):
        if len(self) > 1_000_000:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        value = self[word] = zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1], 1)
        return value


def shingle_hashes(words: list[str], memo: dict) -> np.ndarray:
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(h) < WIDTH:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - WIDTH + 1, np.uint64)
    for k in range(WIDTH):
        out = _mix(out * _ODD + h[k : len(h) - WIDTH + 1 + k])
    return out


class _Group:
    """Templates of about one length, their windows and bands."""

    def __init__(self, names, sets, containment, sure, rows):
        self.names, self.sets, self.rows = names, sets, rows
        longest, least = max(map(len, sets)), min(map(len, sets))
        self.stride = max(1, least // 2)
        self.blocks = -(-(longest + self.stride - 1) // self.stride)
        self.window = self.blocks * self.stride  # in shingles
        self.steps, span = [], 1
        while span < self.blocks:
            self.steps.append(min(span, self.blocks - span))
            span += self.steps[-1]
        shared = [math.ceil(containment * len(s) - 1e-9) for s in sets]
        jaccard = min(c / (self.window + len(s) - c) for c, s in zip(shared, sets, strict=True))
        self.bands = math.ceil(math.log(1 - sure) / math.log(1 - min(jaccard**rows, 1 - 1e-9)))
        self.seeds = _mix(np.arange(1, self.bands * rows + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
        self.keys = [self._bands(np.array([[m] for m in self.minima(s)]))[:, 0] for s in sets]

    def minima(self, h):
        return [_order(h, s).min() for s in self.seeds]

    def _bands(self, minima):
        """minima: hashes x windows. bands x windows."""
        x = minima.reshape(self.bands, self.rows, -1)
        key = np.zeros((self.bands, x.shape[2]), np.uint64)
        for r in range(self.rows):
            key = _mix(key * _ODD + x[:, r])
        return key

    def candidates(self, h: np.ndarray):
        """(start of window, place of template) of all pairs that share a band. Windows end with the text at the latest."""
        starts = np.arange(0, len(h), self.stride)
        rows = np.empty((len(self.seeds), len(starts)), np.uint64)
        for i, seed in enumerate(self.seeds):
            low = _order(h, seed)
            if self.stride > 1:
                low = np.minimum.reduceat(low, starts)  # of each block
            for step in self.steps:  # of a window: its first blocks' minimum spreads over ever more of them
                low[:-step] = np.minimum(low[:-step], low[step:])
            rows[i] = low
        keys = self._bands(rows)
        for t, own in enumerate(self.keys):
            for k in np.flatnonzero((keys == own[:, None]).any(0)):
                yield int(starts[k]), t


def read_templates(spark: SparkSession, path: str, most: int = MOST) -> dict[str, str]:
    """Templates of a folder of text files, named by their files without the ending. More than ``most`` characters are an error, as all tasks hold them."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    if (n := files.agg(F.sum(F.length("value"))).first()[0] or 0) > most:
        raise ValueError(f"templates of {n} characters, {most} at most")
    return {re.sub(r"\.txt$", "", unquote(r["name"])): r["value"] for r in files.collect()}


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, containment: float = 0.8, sure: float = 0.999, rows: int = 1):
        self.containment, self.memo = containment, _Words()
        sets = sorted(((np.unique(shingle_hashes(_WORD.findall(t.lower()), self.memo)), n) for n, t in (TEMPLATES if templates is None else templates).items()), key=lambda x: (len(x[0]), x[1]))
        self.groups, held = [], []
        for s, n in (x for x in sets if len(x[0])):
            if held and len(s) > 1.5 * len(held[0][0]):
                self.groups.append(_Group([x[1] for x in held], [x[0] for x in held], containment, sure, rows))
                held = []
            held.append((s, n))
        if held:
            self.groups.append(_Group([x[1] for x in held], [x[0] for x in held], containment, sure, rows))

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, first word, words, containment) of each hit."""
        h = shingle_hashes(_WORD.findall(text.lower()), self.memo)
        out = []
        for group in self.groups if len(h) else ():
            hits: dict[int, list] = {}
            for start, t in group.candidates(h):
                there = np.flatnonzero(np.isin(h[start : start + group.window], group.sets[t]))
                share = len(np.unique(h[start + there])) / len(group.sets[t]) if len(there) else 0.0
                if share >= self.containment:
                    hits.setdefault(t, []).append((start + int(there[0]), start + int(there[-1]) + WIDTH, share))
            for t, found in hits.items():
                best = None
                for a, b, share in sorted(found):
                    if best and a < best[1]:
                        best = max(best, (a, b, share), key=lambda x: (x[2], x[0] - x[1], -x[0]))
                    else:
                        if best:
                            out.append((group.names[t], best[0], best[1] - best[0], best[2]))
                        best = (a, b, share)
                out.append((group.names[t], best[0], best[1] - best[0], best[2]))
        return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, sure: float = 0.999, rows: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, license, first_word (from 0), n_words, containment: a row per hit."""

    def each(batches):
        scanner = Scanner(templates, containment, sure, rows)
        for batch in batches:
            hits = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in scanner.scan(text)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], kind) for k, kind in enumerate(kinds)], names=[id_col, "license", "first_word", "n_words", "containment"])

    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    return texts.mapInArrow(each, f"{id_col} long, license string, first_word long, n_words long, containment double")
