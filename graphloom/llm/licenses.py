"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams.

A template is a short notice or a licence's text. It is compared with every window of a document's words, across lines
and empty lines. Bigrams are counted as multisets. A window of n bigrams that holds c of a template's B has at most
2c / (n + B), so one that reaches a coefficient t holds at least t / (2 - t) * B of them within (2 - t) / t * B places, and
the best begin and end on one. Starts that allow this are followed exactly. Of windows that overlap, the best counts.

Nulls and edge cases: a null or empty text matches nothing; a text of one word has no bigrams and matches nothing; the
better of two templates wins, on ties the smaller name; repeated rows each give a row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import normal_words
from .ngram_join import mix
from .tokenstore import slices

THRESHOLD = 0.8

#: Notices and licence texts in their public wording.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def bigrams(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(3) ^ mix(words[1:])) if len(words) > 1 else np.empty(0, np.uint64)


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Matcher:
    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        flat = [(name, text) for name, texts in sorted(templates.items()) for text in texts]
        words, bounds = normal_words(pa.array([t for _, t in flat], pa.string()))
        grams = [bigrams(words[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        self.templates = [(name, Counter(g.tolist()), len(g)) for (name, _), g in zip(flat, grams) if len(g)]
        self.known = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)
        self.holds = [np.isin(self.known, g) for g in grams if len(g)]
        self.t = threshold

    def scan(self, texts: pa.Array) -> list[list[tuple[float, str]]]:
        """For each text, coefficient and template of every window that matches and overlaps no better one."""
        out: list[list[tuple[float, str]]] = [[] for _ in range(len(texts))]
        words, bounds = normal_words(texts)
        g = bigrams(words)
        if not len(g) or not len(self.known):
            return out
        code = np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)
        hit = self.known[code] == g
        edges = bounds[1:-1]
        hit[edges[(edges > 0) & (edges <= len(g))] - 1] = False  # from one text to the next
        at = np.flatnonzero(hit)
        code, doc = code[at], np.searchsorted(bounds, at, side="right") - 1
        found: dict[int, list[tuple[float, str, int, int]]] = {}
        for (name, own, size), holds in zip(self.templates, self.holds):
            mine = np.flatnonzero(holds[code])
            for w in self._windows(at[mine], g[at[mine]], doc[mine], own, size):
                found.setdefault(w[0], []).append((w[1], name, w[2], w[3]))
        for d, windows in found.items():
            taken: list[tuple[int, int]] = []
            for x, name, a, b in sorted(windows, key=lambda w: (-w[0], w[1], w[2], w[3])):
                if all(b < c or e < a for c, e in taken):
                    taken.append((a, b))
                    out[d].append((x, name))
        return out

    def _windows(self, at: np.ndarray, grams: np.ndarray, doc: np.ndarray, own: Counter, size: int) -> Iterator[tuple[int, float, int, int]]:
        """(text, coefficient, first, last bigram): the best window from each start that reaches the threshold."""
        least = math.ceil(self.t / (2 - self.t) * size - 1e-9)
        most = math.floor((2 - self.t) / self.t * size + 1e-9)
        if len(at) < least:
            return
        ahead = len(at) - least + 1
        starts = np.flatnonzero((at[least - 1 :] - at[:ahead] < most) & (doc[least - 1 :] == doc[:ahead]))
        for i in starts.tolist():
            stop = min(int(np.searchsorted(at, at[i] + most)), int(np.searchsorted(doc, doc[i], side="right")))
            left, held, best = dict(own), 0, (0.0, 0)
            for x, p in zip(grams[i:stop].tolist(), (at[i:stop] - at[i]).tolist()):
                if left[x] > 0:
                    left[x] -= 1
                    held += 1
                    best = max(best, (2 * held / (p + 1 + size), -p))
            if best[0] >= self.t:
                yield int(doc[i]), best[0], int(at[i]), int(at[i]) - best[1]


def license_report(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_units (windows that match, none overlapping), licenses (names, sorted, comma-joined), best (name or null), dice (0 without one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(templates, threshold)
        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            for i, j in slices(texts):
                found = m.scan(texts.slice(i, j - i))
                top = [min(f, key=lambda x: (-x[0], x[1]), default=(0.0, None)) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(i, j - i), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(sorted({n for _, n in f})) for f in found], pa.string()),
                        pa.array([n for _, n in top], pa.string()), pa.array([d for d, _ in top], pa.float64()),
                    ],
                    names=["doc_id", "n_units", "licenses", "best", "dice"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_units long, licenses string, best string, dice double")
