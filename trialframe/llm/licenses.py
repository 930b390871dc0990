"""License scan: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates are parameters; ``TEMPLATES`` are the usual short notices and the full texts of short
licences. Of each template's ``GRAM``-word hashes, the smallest of every ``WINNOW`` neighbours are its
fingerprints, and the inverted index lists the templates and places of each. Equal runs of
GRAM + WINNOW - 1 = 4 words share a fingerprint, and where 80 % of a template's words match there
is such a run, which is why no wider window is used. Hashes of a document that are in the
index vote for a template and a diagonal (place in the document less place in the
template); around them, template and text are aligned in a band of ``BAND`` words to either
side (match 2, mismatch -1, gap -1), all hits of a template at once, and the words matched are
the coverage.

Templates have at most ``MOST_WORDS`` words, which bounds what is sent to the
executors. Defined cases: null or empty text has no license; a text of any length is scanned
whole; a template with fewer words than a fingerprint is matched whole; repeated rows return a
row each; of overlapping matches the one with more words, then with more of its
template, then the first, is kept; empty tables
give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, plain, slices, text_rows, windows

#: Identifiers and notices as licences prescribe or as they are usually worded.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "reserved": "All rights reserved",
    "MIT-text": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause-text": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-text": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-text": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-text": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
}
GRAM, WINNOW, BAND, MOST_WORDS = 3, 2, 4, 1_000_000
#: Cells of alignments that are held at once.
CELLS = 4_000_000
#: Share of a template's words that must match, in percent.
PERCENT = 80
SPANS = "doc_id long, license string, start_word long, end_word long, n_matched long, n_template_words long, start long, end long"


def folded(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]{}<>*#")


def winnowed(grams: np.ndarray, size: int = WINNOW) -> list[int]:
    """Places of the fingerprints: in each run of ``size`` hashes the smallest, the last of equals."""
    n = len(grams)
    return sorted({i + len(w) - 1 - int(np.argmin(w[::-1])) for i in range(max(1, n - size + 1)) if len(w := grams[i : i + size])})


def aligned(template: np.ndarray, words: np.ndarray, begin: np.ndarray, end: np.ndarray, diagonal: np.ndarray, band: int = BAND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words matched, first, after the last, of the best alignment of ``template`` to each of the texts ``words[begin:end]`` near its ``diagonal``. Words of the template before the text's begin or behind its end are left out at no cost."""
    width, n, hits = 2 * band + 1, len(template), np.arange(len(begin))
    column, low = np.arange(width), -(1 << 30)
    start, stop = np.clip(-diagonal - band, 0, n), np.clip(end - begin - diagonal + band, 0, n)
    score, final, back, equal = np.zeros((len(hits), width), np.int32), np.zeros((len(hits), width), np.int64), np.zeros((n + 1, len(hits), width), np.int8), np.zeros((n + 1, len(hits), width), bool)
    for i in range(1, n + 1):
        j = (i + diagonal - band)[:, None] + column  # words of the text used
        valid = (j >= 1) & (j <= (end - begin)[:, None])
        equal[i] = valid & (words[np.where(valid, begin[:, None] + j - 1, 0)] == template[i - 1])
        left_out = np.column_stack([score[:, 1:] - 1, np.full(len(hits), low)])
        both = np.where(valid, score + np.where(equal[i], 2, -1), low)
        best = np.maximum(left_out, both)
        # words of the text between: the best of the columns before, less one for each step
        score = np.maximum(np.where(valid, np.maximum.accumulate(best + column, axis=1) - column, low), best)
        back[i] = np.where(score > best, 3, np.where(both >= left_out, 2, 1))
        score = np.where((start >= i)[:, None], 0, score)
        final = np.where((stop == i)[:, None], score, final)
    k = np.argmax(final * (2 * width) - np.abs(column - band), axis=1)
    i, matched, first, last = stop.copy(), np.zeros(len(hits), np.int64), np.zeros(len(hits), np.int64), np.zeros(len(hits), np.int64)
    on = hits[i > start]
    while len(on):
        step, j = back[i[on], on, k[on]], i[on] + diagonal[on] - band + k[on]
        hit = on[(step == 2) & equal[i[on], on, k[on]]]
        j = i[hit] + diagonal[hit] - band + k[hit]
        matched[hit] += 1
        first[hit] = j - 1
        last[hit] = np.where(last[hit] == 0, j, last[hit])
        k[on] += (step == 1).astype(np.int64) - (step == 3)
        i[on] -= step != 3
        on = on[(i[on] > start[on]) & (k[on] >= 0) & (k[on] < width)]
    return matched, first, last


class Index:
    """The templates' words and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str]):
        w = Words(pa.array(list(templates.values()), pa.string()))
        if len(w.codes) > MOST_WORDS:
            raise ValueError(f"templates have {len(w.codes)} words; at most {MOST_WORDS} are sent to the executors")
        h = w.hashes(folded)
        self.names = list(templates)
        self.words = [h[a:b] for a, b in zip(w.offsets[:-1], w.offsets[1:])]
        self.index: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            size = min(GRAM, len(words))
            grams = windows(words, size) if size else []
            for at in winnowed(grams) if size else []:
                self.index.setdefault((size, int(grams[at])), []).append((t, at))
        self.sizes = sorted({s for s, _ in self.index})
        self.keys = {s: np.array(sorted(h for k, h in self.index if k == s), np.uint64) for s in self.sizes}

    def found(self, text: pa.Array, percent: int = PERCENT) -> list[tuple]:
        """(row, template, first word, after the last, words matched, words of the template, start, end)."""
        w = Words(text)
        h, hits = w.hashes(folded), {}
        for size in self.sizes:
            grams, keys = windows(h, size), self.keys[size]
            at = np.flatnonzero(np.isin(grams, keys))
            docs = np.searchsorted(w.offsets, at, "right") - 1
            for x, d in zip(at.tolist(), docs.tolist()):
                if x + size <= w.offsets[d + 1]:
                    for t, place in self.index[size, int(grams[x])]:
                        hits.setdefault((d, t), set()).add(x - int(w.offsets[d]) - place)
        by_doc: dict[int, list[tuple]] = {}
        by_template: dict[int, list[tuple[int, int]]] = {}
        for (d, t), diagonals in sorted(hits.items()):
            by_template.setdefault(t, []).extend((d, x) for x in sorted(diagonals))
        for t, places in by_template.items():
            words, step = self.words[t], max(1, CELLS // (len(self.words[t]) * (2 * BAND + 1)))
            for at in range(0, len(places), step):
                docs, diagonal = np.array(places[at : at + step]).T
                for d, matched, first, last in zip(docs.tolist(), *(x.tolist() for x in aligned(words, h, w.offsets[docs], w.offsets[docs + 1], diagonal))):
                    if 100 * matched >= percent * len(words):
                        by_doc.setdefault(d, []).append((-matched, -matched / len(words), first, last, t))
        out = []
        for d, spans in sorted(by_doc.items()):
            kept, places = [], _places(text[d].as_py())
            for span in sorted(spans):
                if all(span[3] <= k[2] or span[2] >= k[3] for k in kept):
                    kept.append(span)
            out += [(d, self.names[t], first, last, -m, len(self.words[t]), places[first][0], places[last - 1][1]) for m, _, first, last, t in sorted(kept, key=lambda k: k[2])]
        return out


def _places(text: str) -> list[tuple[int, int]]:
    import re

    return [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """One row for each template found at a place of a row of ``docs``: words and code points covered."""
    index = docs.sparkSession.sparkContext.broadcast(Index(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = index.value.found(plain(b.column(1)), percent)
            cells = [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(2, 8))]
            yield pa.RecordBatch.from_arrays(cells, [x.split()[0] for x in SPANS.split(", ")])

    return text_rows(docs).mapInArrow(run, SPANS)
