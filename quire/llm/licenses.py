"""License scans: MinHash bands over overlapping windows of words retrieve templates, exact containment verifies.

Words are lower-cased and stripped of outer ASCII punctuation. A template of t words is looked for in windows of
2 t words at steps of t, so each occurrence lies in one window whole. Where a window holds at
least ``CONTAINMENT`` of a template's word pairs, the Jaccard similarity of the two sets is at least 0.36; with 36
bands of 2 rows such a window collides with the template with probability 0.99. A length whose templates repeat word
pairs, or a lower share, takes as many bands more as that needs. A window with fewer places of the
word pairs of the templates of that length than the share needs can't contain one and is not hashed. Retrieved pairs are verified on the sets
themselves: the share of the template's word pairs that the window holds. A window counts for a template if all
its word pairs are there, or some that no template of a larger share has in a window that overlaps: a notice isn't also
taken for a sister licence that differs in a word, two notices side by side give two rows, and a
longer text that holds a shorter template whole gives both. Templates have no greatest length; the registered ones are notices,
standard headers and whole licence texts.

Cases: null, empty and one-word texts match nothing; a text shorter than the window is one window; a template of one
word has that word as its only shingle and is an error; ties between windows of one template go to the first; rows
are scanned one by one, so repeated rows repeat their results; an empty table or no templates give an empty result;
other columns are not read.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

CONTAINMENT = 0.8
BANDS = 36
ROWS = 2

#: name -> (SPDX identifier, notice)
TEMPLATES: dict[str, tuple[str, str]] = {
    "mit-notice": ("MIT", "Released under the MIT License."),
    "mit-licensed": ("MIT", "Licensed under the MIT License."),
    "apache-notice": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "gpl3-notice": ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    "gpl2-notice": ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    "lgpl3-notice": ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    "agpl3-notice": ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    "mpl2-notice": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "cc-by-notice": ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    "cc-by-sa-notice": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    "cc-by-nc-notice": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "cc-by-nd-notice": ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    "cc-by-long": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "bsd-clause": ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
}

# whole texts and standard headers
TEMPLATES |= {
    "mit-text": ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    "isc-text": ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    "bsd2-text": ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    "bsd3-text": ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    "apache-header": ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "mpl2-header": ("MPL-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'),
}
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU %s as published by "
    "the Free Software Foundation, either version %s of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU %s for more details."
)
for _name, _spdx, _kind, _version in (
    ("gpl2", "GPL-2.0-or-later", "General Public License", 2),
    ("gpl3", "GPL-3.0-or-later", "General Public License", 3),
    ("lgpl3", "LGPL-3.0-or-later", "Lesser General Public License", 3),
    ("agpl3", "AGPL-3.0-or-later", "Affero General Public License", 3),
):
    TEMPLATES[f"{_name}-header"] = (_spdx, _GNU_HEADER % (_kind, _version, _kind))
for _name, _spdx, _file in (
    ("apache-text", "Apache-2.0", "Apache-2.0"),
    ("gpl2-text", "GPL-2.0-only", "GPL-2"),
    ("gpl3-text", "GPL-3.0-only", "GPL-3"),
    ("lgpl21-text", "LGPL-2.1-only", "LGPL-2.1"),
    ("lgpl3-text", "LGPL-3.0-only", "LGPL-3"),
    ("mpl2-text", "MPL-2.0", "MPL-2.0"),
):
    TEMPLATES[_name] = (_spdx, pkgutil.get_data("quire.llm", f"license_texts/{_file}.txt").decode())

#: Windows of one length are laid out in blocks of about this many word pairs; one longer window is a block by itself.
_BLOCK = 1 << 18
_SEEDS = C.mix(np.arange(1, 4097, dtype=np.uint64) + np.uint64(99))
_PUNCT = np.zeros(128, bool)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def scan_words(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts, the text of each word, and its number in the text (by white space)."""
    start, end, doc = C.spans(cp, off)
    place = np.arange(len(start)) - np.searchsorted(doc, doc, side="left")
    solid = np.concatenate([[0], np.cumsum(~((cp < 128) & _PUNCT[np.minimum(cp, 127)]))])
    some = solid[end] > solid[start]
    start, end, doc, place = start[some], end[some], doc[some], place[some]
    # the first and the last character of each word that is no punctuation
    first = np.searchsorted(solid, solid[start], side="right") - 1
    last = np.searchsorted(solid, solid[end], side="left")
    return C.word_hashes(cp, first, last), doc, place


def _pairs(h: np.ndarray) -> np.ndarray:
    return C.mix(h[:-1] * np.uint64(3) + C.mix(h[1:]))


def signature(sets: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) minima of k hashes over the valid entries of each row."""
    out = np.empty((len(sets), k), np.uint64)
    for i in range(k):
        h = C.mix(sets ^ _SEEDS[i])
        h[~valid] = np.uint64(0xFFFFFFFFFFFFFFFF)
        out[:, i] = h.min(axis=1)
    return out


class Index:
    """Templates by length in words, with their shingles and signatures."""

    def __init__(self, templates: Mapping[str, tuple[str, str]], bands: int, rows: int, least: float = CONTAINMENT):
        self.rows = rows
        self.bands: dict[int, int] = {}
        self.classes: dict[int, list[tuple[str, str, np.ndarray, np.ndarray]]] = {}
        for name, (spdx, text) in sorted(templates.items()):
            h, _, _ = scan_words(*C.codes(pa.array([text.lower()])))
            if len(h) < 2:
                raise ValueError(f"template {name} needs two words")
            shingles = np.unique(_pairs(h))
            both = np.ceil(least * len(shingles) - 1e-9)
            worst = (both / (2 * len(h) - 1 + len(shingles) - both)) ** rows
            many = min(len(_SEEDS) // rows, int(np.ceil(np.log(0.012) / np.log1p(-worst)))) if 0 < worst < 1 else 1
            self.bands[len(h)] = max(bands, many, self.bands.get(len(h), 0))
            self.classes.setdefault(len(h), []).append((name, spdx, shingles))
        for size, held in self.classes.items():
            k = self.bands[size] * rows
            self.classes[size] = [(*x, signature(x[2][None, :], np.ones((1, len(x[2])), bool), k)[0]) for x in held]
        held = [np.unique(np.concatenate([x[2] for x in c])) for _, c in sorted(self.classes.items())]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]))
        self.of = np.array([np.isin(self.pairs, x) for x in held], bool).reshape(len(held), len(self.pairs))

    def matches(self, cp: np.ndarray, off: np.ndarray, least: float) -> list[tuple[int, str, str, float, int, int]]:
        """(text, name, spdx, containment, first word of the best window, windows) of every template in every text."""
        h, doc, place = scan_words(cp, off)
        best: dict[tuple[int, str], list] = {}
        hits: dict[int, list[tuple[float, str, str, int, int, np.ndarray]]] = {}
        if len(h) < 2 or not self.classes:
            return []
        g = _pairs(h)
        inside = doc[1:] == doc[:-1]
        number = np.arange(len(h)) - np.searchsorted(doc, doc, side="left")
        end = np.searchsorted(doc, doc, side="right") - 1
        at = np.minimum(np.searchsorted(self.pairs, g), len(self.pairs) - 1)
        known = np.flatnonzero(inside & (self.pairs[at] == g))
        for kind, (step, held) in enumerate(sorted(self.classes.items())):
            wide, bands = 2 * step, self.bands[step]
            hit = known[self.of[kind, at[known]]]
            if not len(hit):
                continue
            base, win = hit - number[hit], number[hit] // step
            starts = np.unique(np.concatenate([base + win * step, base + np.maximum(win - 1, 0) * step]))
            # places of known pairs in each window, which no template's share can exceed
            places = np.searchsorted(hit, np.minimum(starts + wide - 1, end[starts])) - np.searchsorted(hit, starts)
            starts = starts[places >= least * min(len(x[2]) for x in held) - 1e-9]
            rows = max(1, _BLOCK // wide)
            for lo in range(0, len(starts), rows):
                part = starts[lo : lo + rows]
                cols = part[:, None] + np.arange(wide - 1)[None, :]
                ok = cols < len(g)
                cols = np.minimum(cols, len(g) - 1)
                ok &= inside[cols] & (doc[cols] == doc[part][:, None])
                sets = g[cols]
                sig = signature(sets, ok, bands * self.rows).reshape(len(part), bands, self.rows)
                for t, (_, _, shingles, own) in enumerate(held):
                    near = (sig == own.reshape(1, bands, self.rows)).all(axis=2).any(axis=1)
                    for r in np.flatnonzero(near):
                        found = np.isin(shingles, sets[r][ok[r]])
                        if found.mean() >= least - 1e-9:
                            at0 = int(part[r])
                            hits.setdefault(int(doc[at0]), []).append((float(found.mean()), *held[t][:2], at0, at0 + wide, shingles[found]))
        for d, several in hits.items():
            taken: list[tuple[str, int, int, set[int]]] = []
            for share, name, spdx, lo, hi, found in sorted(several, key=lambda x: (-x[0], x[1], x[3])):
                # a template is there if it is whole or has word pairs that no better one around there explains
                own = set(found.tolist())
                others = set().union(*(x for n, a, b, x in taken if n != name and a < hi and lo < b))
                if share < 1 and own <= others:
                    continue
                taken.append((name, lo, hi, own))
                now = best.setdefault((d, name), [spdx, -1.0, 0, 0])
                now[3] += 1
                if share > now[1]:
                    now[1], now[2] = share, int(place[lo])
        return [(d, name, *v) for (d, name), v in sorted(best.items())]


def scan(
    docs: DataFrame,
    templates: Mapping[str, tuple[str, str]] | None = None,
    containment: float = CONTAINMENT,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, template, license, containment, word_start, n_windows); one pass, no shuffle."""
    index = Index(TEMPLATES if templates is None else templates, bands, rows, containment)
    read = docs.select(F.col(id_col).alias("__id"), F.lower(F.col(text_col)).alias("__text"))
    schema = T.StructType(
        [
            T.StructField("__id", read.schema["__id"].dataType),
            T.StructField("template", T.StringType()),
            T.StructField("license", T.StringType()),
            T.StructField("containment", T.DoubleType()),
            T.StructField("word_start", T.LongType()),
            T.StructField("n_windows", T.LongType()),
        ]
    )
    kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole, 1):
                got = index.matches(*C.codes(b.column(1)), containment)
                if got:
                    cols = [pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(cols[0]), *cols[1:]], names=schema.names)

    return read.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
