"""Op 1: license scan by MinHash bands over overlapping text windows.

A template of t word shingles is looked for in windows of 3 t shingles, one starting every t: each
occurrence that spreads over no more than 2 t shingles lies in one. A window that contains a share c of
the template has a Jaccard similarity of at least c / (4 - c) with it, so the number of bands (of one MinHash
each) that lets such a window be missed with at most `miss` odds is known beforehand. Windows that agree with
a template in a band are then verified: the share of the template's shingles that they hold is counted exactly.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

# Notices, headers and short texts of public licenses, as they are written in files.
WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
TEMPLATES = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": f"{BSD_CONDITIONS}: 1. {BSD_SOURCE} 2. {BSD_BINARY} {BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{BSD_CONDITIONS}: 1. {BSD_SOURCE} 2. {BSD_BINARY} 3. {BSD_NAME} {BSD_DISCLAIMER}",
    "BSD-conditions": BSD_CONDITIONS,
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-header": MIT_GRANT,
    "MIT-text": f"{MIT_GRANT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {WARRANTY}",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BATCH_BYTES = 8_000_000


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits in lower case, and of bytes beyond ASCII."""
    return WORD.findall(text.translate(LOWER))


def bands_for(containment: float, miss: float) -> int:
    """Bands of one MinHash that miss a window of the given containment with at most the odds `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - containment / (4 - containment)))


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    x = sum((hashes[j : j + n] * np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1)) % (1 << 64) | 1) for j in range(k)), np.uint64(0))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _min_hash(shingles: np.ndarray, band: int) -> np.ndarray:
    seed = np.uint64((0xA0761D6478BD642F * (2 * band + 1)) % (1 << 64) | 1)
    return ((shingles ^ (seed >> np.uint64(7))) * seed) >> np.uint64(16)


def _shortest(values: list[int], places: list[int]) -> tuple[int, int]:
    """First and last place of the shortest stretch that holds every value, the first of these."""
    held: dict[int, int] = defaultdict(int)
    every, low, found = len(set(values)), 0, (places[0], places[-1])
    for high, v in enumerate(values):
        held[v] += 1
        while held[values[low]] > 1:
            held[values[low]] -= 1
            low += 1
        if len(held) == every and places[high] - places[low] < found[1] - found[0]:
            found = places[low], places[high]
    return found


@dataclass
class Template:
    name: str
    shingles: np.ndarray  # distinct
    mins: list[int]  # of each band


class Scanner:
    def __init__(self, templates: dict[str, str], shingle: int, containment: float, miss: float):
        self.containment, self.bands = containment, bands_for(containment, miss)
        self.classes: dict[tuple[int, int], list[Template]] = defaultdict(list)
        for name, text in templates.items():
            words = words_of(text.encode())
            if not words:
                raise ValueError(f"template {name} has no words")
            k = min(shingle, len(words))
            s = np.unique(_shingles(np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64), k))
            self.classes[k, len(s)].append(Template(name, s, [int(_min_hash(s, b).min()) for b in range(self.bands)]))
        # Of each class and band the values of its templates, in order, and whose they are.
        self.index: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        for (k, t), group in self.classes.items():
            for band in range(self.bands):
                values = np.array([x.mins[band] for x in group], dtype=np.uint64)
                order = np.argsort(values, kind="stable")
                self.index[k, t, band] = values[order], order

    def scan(self, texts: list[bytes]) -> list[tuple[int, str, float, int, int, bool]]:
        """(text, template, containment, first word, words, whether no better template is at the place) of the best window of each pair that reaches the containment."""
        known: dict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        ids = [np.fromiter(map(known.__getitem__, ws), dtype=np.int64, count=len(ws)) for ws in map(words_of, texts)]
        sizes = np.array([len(i) for i in ids], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        table = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))
        hashes = table[np.concatenate(ids)] if len(known) else np.zeros(0, dtype=np.uint64)
        best: dict[tuple[int, str], tuple[float, int, int]] = {}
        for k in sorted({k for k, _ in self.classes}):
            shingles = _shingles(hashes, k)
            rows = np.flatnonzero(sizes >= k)
            if not len(rows):
                continue
            crossing = (np.repeat(first[1:], k - 1) - np.tile(np.arange(1, k), len(first) - 1)) if k > 1 else np.zeros(0, dtype=np.int64)
            crossing = crossing[(crossing >= 0) & (crossing < len(shingles))]  # shingles of two texts: in no block
            classes = {t: group for (kk, t), group in self.classes.items() if kk == k}
            layout = {}
            for t in classes:
                counts = -(-(sizes[rows] - k + 1) // t)
                row = np.repeat(rows, counts)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                # Blocks of t shingles; those that run over the end of a text are cut there.
                start = first[row] + nth * t
                end = np.minimum(start + t, first[row] + sizes[row] - k + 1)
                layout[t] = (row, start, end)
            hits: dict[tuple[int, int], set[int]] = defaultdict(set)
            for band in range(self.bands):
                mins = _min_hash(shingles, band)
                mins[crossing] = np.iinfo(np.uint64).max
                for t in classes:
                    row, start, end = layout[t]
                    block = mins[start] if t == 1 else np.minimum.reduceat(mins, start)
                    values, owners = self.index[k, t, band]
                    low, high = np.searchsorted(values, block, side="left"), np.searchsorted(values, block, side="right")
                    for found in np.flatnonzero(high > low).tolist():
                        for n in owners[low[found] : high[found]].tolist():
                            hits[t, n].add(found)
            for (t, n), blocks in hits.items():
                row, start, end = layout[t]
                template = classes[t][n]
                at = np.array(sorted(blocks))
                # A window is three blocks of one text: those that begin up to two blocks earlier hold this one.
                for w in np.unique(np.concatenate([at, at - 1, at - 2])):
                    if w < 0:
                        continue
                    last = min(w + 2, len(row) - 1)
                    while row[last] != row[w]:
                        last -= 1
                    inside = shingles[start[w] : end[last]]
                    matched = np.flatnonzero(np.isin(inside, template.shingles))
                    share = len(np.unique(inside[matched])) / len(template.shingles)
                    if share >= self.containment:
                        a, b = _shortest(inside[matched].tolist(), matched.tolist())
                        begin = int(start[w] + a - first[row[w]])
                        here = (share, -begin, b - a + k)
                        pair = (int(row[w]), template.name)
                        best[pair] = max(best.get(pair, (0.0, 0, 0)), here)
        size = {x.name: len(x.shingles) for group in self.classes.values() for x in group}
        by_text: dict[int, list[tuple]] = defaultdict(list)
        for (i, name), (share, begin, n) in best.items():
            by_text[i].append((share, size[name], name, -begin, n))
        out = []
        for i, found in sorted(by_text.items()):
            for m in sorted(found, key=lambda m: m[2]):
                beaten = any(o[:3] > m[:3] and 2 * (min(o[3] + o[4], m[3] + m[4]) - max(o[3], m[3])) > min(o[4], m[4]) for o in found)
                out.append((i, m[2], m[0], m[3], m[4], not beaten))
        return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, shingle: int = 5, containment: float = 0.8, miss: float = 1e-4) -> DataFrame:
    """doc_id, license, containment, first_word (from 0), n_words, best: what each row of docs holds of the templates.

    One row for a document and template: the window with the highest containment, the first of these. Of
    templates found at places that share half of the shorter one, only one is `best`: that of the highest containment, then the longest. A
    template of fewer words than a shingle is one shingle. Null and empty texts, and texts with no match,
    give no row; rows that repeat give theirs each time. Nothing is shuffled: templates go to the documents.
    """
    scanner = Scanner(templates, shingle, containment, miss)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["doc_id"].to_list(), [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_BYTES):
                    size += len(texts[end])
                    end += 1
                found = [(ids[at + i], *rest) for i, *rest in scanner.scan(texts[at:end])]
                yield pd.DataFrame(found, columns=["doc_id", "license", "containment", "first_word", "n_words", "best"])
                at = end

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, license string, containment double, first_word long, n_words long, best boolean")
