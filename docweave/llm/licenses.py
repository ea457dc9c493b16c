"""Licences in texts, by Dice coefficient over word bigrams.

Texts and templates are normalised to lower-case words.  A template of m words is
compared to every stretch of m words of a text (to the whole text, if it is shorter).
Sizes prune first: a text with fewer bigrams than ``t / (2 - t)`` of the template's can't
reach the threshold ``t``, nor can one with too few bigrams of the template anywhere.
For the others the overlap of all stretches with a template is summed up at once, from the ends
between which each place of a bigram counts.  Of stretches that overlap the one with the highest
coefficient stays; ties go to the earlier one, then to the template named first.

``licenses`` compares to the templates below and to those of ``license_texts``: notices, headers and
whole texts of the common licences in their versions, so that the nearest gives the name.

Defined cases: null and empty texts have no licence; repeated rows are scanned row by row; no templates give no
findings; an empty table gives an empty result; other columns aren't read.  Memory for a long text is in proportion to its words:
nothing is held for a word and a template at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.llm import license_texts
from docweave.llm.license_texts import WORD
from docweave.llm.wordcache import Remembered

FOUND = "array<struct<license: string, start: int, end: int, dice: double>>"

#: Texts of public licences and of usual notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program.""",
}


def normal_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Scanner:
    def __init__(self, templates: dict[str, str] | Iterable[tuple[str, str]], threshold: float = 0.8):
        pairs = list(templates.items() if isinstance(templates, dict) else templates)
        self.threshold, self.names = threshold, [name for name, _ in pairs]
        words = [normal_words(t) for _, t in pairs]
        self.codes = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for t in words for w in t))}
        self.sizes = np.array([len(t) for t in words], np.int64)
        self.base = len(self.codes) + 1
        ids: dict[int, int] = {}  # of each bigram of the templates
        self.own: list[tuple[np.ndarray, np.ndarray]] = []  # each template's bigrams, and how often it has them
        for t in words:
            c = [self.codes[w] for w in t]
            own = Counter(ids.setdefault(x * self.base + y, len(ids)) for x, y in zip(c, c[1:]))
            self.own.append((np.array(sorted(own), np.int64), np.array([own[x] for x in sorted(own)], np.int64)))
        self.keys = np.array(sorted(ids), np.int64)
        self.of_key = np.array([ids[x] for x in sorted(ids)], np.int64)
        self.has = np.zeros((len(ids), len(pairs)), bool)  # which templates have a bigram
        for k, (own, _) in enumerate(self.own):
            self.has[own, k] = True
        self.parts = Remembered(self._codes, 150_000)

    def _codes(self, part: str) -> bytes:
        return np.array([self.codes.get(w, 0) for w in normal_words(part)], np.uint32).tobytes()

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the bigrams that templates have, and their ids."""
        both = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
        pair = codes[both].astype(np.int64) * self.base + codes[both + 1]
        k = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        found = self.keys[k] == pair
        return both[found], self.of_key[k[found]]

    def enough(self, u: np.ndarray, count: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Templates of whose bigrams (u, with their counts in the text) there are enough."""
        total = np.zeros(len(self.names), np.float32)
        for k in range(0, len(u), 512):
            total += count[k : k + 512].astype(np.float32) @ self.has[u[k : k + 512]].astype(np.float32)
        return np.flatnonzero(total >= least - 1e-3)

    def find(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """Template number, first word, end and coefficient of each finding, in order of words."""
        if not text or not len(self.keys):
            return []
        codes = np.frombuffer(b"".join(map(self.parts.__getitem__, text.split())), np.uint32)
        if len(codes) < 2:
            return []
        at, ids = self.hits(codes)
        if not len(at):
            return []
        widths = np.minimum(self.sizes, len(codes))  # words of the stretches
        least = self.threshold * (widths - 1 + self.sizes - 1) / 2
        may = (self.sizes >= 2) & (widths - 1 >= self.threshold / (2 - self.threshold) * (self.sizes - 1) - 1e-9) & (len(at) >= least - 1e-9)
        if not may.any():
            return []
        order = np.argsort(ids, kind="stable")
        pos = at[order]  # places by id, in order
        u, first, count = np.unique(ids[order], return_index=True, return_counts=True)
        found = []
        for k in self.enough(u, count, np.where(may, least, np.inf)).tolist():
            own, times = self.own[k]
            j = np.minimum(np.searchsorted(u, own), len(u) - 1)
            there = u[j] == own
            j, times = j[there], times[there]
            if int(np.minimum(count[j], times).sum()) < least[k] - 1e-9:
                continue
            starts, both = self.overlaps(pos, first[j], count[j], times, int(widths[k]) - 1, len(codes) - int(widths[k]), least[k])
            dice = 2.0 * both / (int(widths[k]) - 1 + int(self.sizes[k]) - 1)
            good = dice >= self.threshold - 1e-12
            found.append((-dice[good], starts[good], np.full(int(good.sum()), k), starts[good] + int(widths[k])))
        if not found:
            return []
        dice, starts, ks, ends = (np.concatenate(c) for c in zip(*found))
        best = np.lexsort((ks, starts, dice))
        taken, out = np.zeros(len(codes), bool), []
        for d, start, k, end in zip(*(c[best].tolist() for c in (dice, starts, ks, ends))):
            if not (taken[start] or taken[end - 1] or taken[start:end].any()):
                taken[start:end] = True
                out.append((k, start, end, -d))
        return sorted(out, key=lambda x: x[1])

    @staticmethod
    def overlaps(pos: np.ndarray, first: np.ndarray, count: np.ndarray, times: np.ndarray, pairs: int, latest: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the stretches of ``pairs`` bigrams that have at least ``least`` in common with a template, and how many.

        The template has bigram j ``times[j]`` times; its places in the text are ``count[j]`` from ``first[j]`` on.
        A place counts for the stretches that it lies in and that begin behind the place of the same
        bigram so many times before; sums of these ends give the overlap of all stretches at once.
        """
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(first, count) + nth
        often = np.repeat(times, count)
        before = np.where(nth >= often, pos[np.maximum(place - often, 0)], -1)
        p = pos[place]
        low = np.maximum(np.maximum(before + 1, p - pairs + 1), 0)
        some = low <= np.minimum(p, latest)
        edges = np.concatenate([low[some], p[some] + 1])
        change = np.repeat([1, -1], int(some.sum()))
        order = np.argsort(edges, kind="stable")
        edges, upto = edges[order], np.cumsum(change[order])
        ends = np.minimum(np.append(edges[1:], edges[-1:]), latest + 1)
        good = (upto >= least - 1e-9) & (ends > edges)
        sizes = (ends - edges)[good]
        starts = np.repeat(edges[good], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return starts, np.repeat(upto[good], sizes)


def licenses(text: Column, templates: dict[str, str] | None = None, threshold: float = 0.8) -> Column:
    """An array of license, start, end (in words) and dice for each text."""
    own = [*TEMPLATES.items(), *license_texts.common()] if templates is None else list(templates.items())

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(own, threshold)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("dice", pa.float64())]))
        for texts in batches:
            rows = ([{"license": scanner.names[k], "start": a, "end": b, "dice": d} for k, a, b, d in scanner.find(t.as_py())] for t in texts)
            yield pa.array(rows, kind)

    return scan(text)
