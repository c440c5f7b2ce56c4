"""License scans: shared word runs of templates pick candidates, banded alignment decides.

Every run of K words of a template, or of SHORT_K words of one with fewer than SHORT, is a key of an inverted index to
(template, position), which is as large as the templates, which are fixed. A run that a document shares proposes a
diagonal. If enough of the template's words are there at all, a banded alignment of the words around the diagonal gives
matched coverage and spans. A place of 0.8 of a template without words in
between always shares such a run; a place with words put in is found if a run is left whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoline.llm.words import Words, by_bytes, normal, texts_of
from isoline.session import prepare

K = 3
#: Templates of fewer words than SHORT are looked for by runs of SHORT_K.
SHORT, SHORT_K = 10, 2
COVERAGE = 0.8
_BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(what: str, name: str, version: str, mark: str) -> str:
    return (
        f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
        f"Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        f"PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}. If not, see"
    )


#: Names and wording of public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": _gnu("program", "General Public License", "3", ":"),
    "GPL-2.0-header": _gnu("program", "General Public License", "2", ";"),
    "LGPL-3.0-header": _gnu("program", "Lesser General Public License", "3", ":"),
    "LGPL-2.1-header": _gnu("library", "Lesser General Public License", "2.1", ";"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": _BSD_CLAUSES + _BSD_THIRD + _BSD_DISCLAIMER,
    "BSD-2-Clause": _BSD_CLAUSES + _BSD_DISCLAIMER,
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
FOUND = "doc_id long, license string, coverage double, n_matched int, template_start int, template_end int, word_start int, word_end int, matched_text string"


#: A cell's score and matches as one number, so that the larger one has the better score, then more matches.
_ONE = 1 << 20


def align(template: list[bytes], words: list[bytes], shift: int, band: int) -> tuple[int, int, int, int, int]:
    """Best local alignment of the template with words, where word j faces template word j - shift, within band.

    A match scores 2, anything else costs 1. Returns matches and half-open spans (template start, end, word start, end).
    A row of the band is computed at once: what comes from the row before cell by cell, what comes along the row as a
    running maximum.
    """
    best, top = (0, 0, 0, 0, 0), 0
    width, low = 2 * band + 1, shift - band
    number = {w: k for k, w in enumerate(template)}
    a, e = max(low, 0), max(min(low + len(template) + width, len(words)), low, 0)
    have, inside = np.full(len(template) + width, -1), np.zeros(len(template) + width, bool)
    have[a - low : e - low] = [number.get(w, -1) for w in words[a:e]]
    inside[a - low : e - low] = True
    place = np.arange(width)
    cost = place * _ONE
    cell, at, of = np.zeros(width + 1, np.int64), np.full(width + 1, -1), np.full(width + 1, -1)  # a guard at the end
    for i, want in enumerate(template):
        pair = cell[:-1] + np.where(have[i : i + width] == number[want], 2 * _ONE + 1, -_ONE)
        skip = cell[1:] - _ONE  # the template word has no partner
        fresh = at[:-1] < 0
        first_at, first_of = np.where(fresh, i, at[:-1]), np.where(fresh, i + low + place, of[:-1])
        up = skip > pair
        first_at, first_of = np.where(up, at[1:], first_at), np.where(up, of[1:], first_of)
        ahead = np.where(inside[i : i + width], np.maximum(pair, skip), 0) + cost
        run = np.maximum.accumulate(ahead)  # the document word has no partner
        source = np.maximum.accumulate(np.where(ahead == run, place, 0))
        now = run - cost
        now[~inside[i : i + width] | (now < _ONE)] = 0
        cell[:-1] = now
        at[:-1], of[:-1] = np.where(now > 0, first_at[source], -1), np.where(now > 0, first_of[source], -1)
        score = now // _ONE
        k = int(score.argmax())
        if score[k] > top:
            top, best = int(score[k]), (int(now[k] % _ONE), int(at[k]), i + 1, int(of[k]), i + low + k + 1)
    return best


class TemplateIndex:
    """Inverted index from word run to (template, position), and each template's words."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.words = [normal(templates[n]).split() for n in self.names]
        self.runs = []
        for k in (K, SHORT_K):
            entries = []
            for t, name in enumerate(self.names):
                if k == (SHORT_K if len(self.words[t]) < SHORT else K):
                    entries += [(int(x), t, p) for p, x in enumerate(Words([templates[name]]).shingles(k)[0])]
            entries.sort()
            keys = np.array([e[0] for e in entries], np.uint64)
            bits = np.zeros(1 << 20, bool)
            bits[keys >> np.uint64(44)] = True
            self.runs.append((k, keys, [e[1:] for e in entries], bits))

    def scan(self, words: Words) -> dict[int, dict[int, set[int]]]:
        """For each document, the diagonals (document position less template position) of each template hit."""
        out: dict[int, dict[int, set[int]]] = {}
        for k, keys, at, bits in self.runs:
            h, first, count = words.shingles(k)
            hot = np.flatnonzero(bits[h >> np.uint64(44)])
            hot = hot[np.isin(h[hot], keys)]
            owner = np.searchsorted(first + count, hot, side="right")
            lo, hi = (np.searchsorted(keys, h[hot], side=side) for side in ("left", "right"))
            for p, d, a, b in zip(hot.tolist(), owner.tolist(), lo.tolist(), hi.tolist(), strict=True):
                for t, q in at[a:b]:
                    out.setdefault(d, {}).setdefault(t, set()).add(p - int(first[d]) - q)
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, license and place that holds at least `coverage` of the template's words in order.

    Spans are half-open and count words: template_start/end in the template, word_start/end in the document.
    Of overlapping places, of whichever templates, the one with the most matched words stays, then the larger coverage,
    the shorter, the first. Templates need SHORT_K words at least. Null and empty texts hold nothing; very long texts are
    read whole. Repeated rows and ids each give their rows, a null id stays null; other columns are ignored. One pass,
    no shuffle.
    """
    prepare(docs.sparkSession)
    index = TemplateIndex(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            words = Words(texts_of(b))
            keys, rows = b.column("doc_id").to_pylist(), []
            for d, hits in sorted(index.scan(words).items()):
                text = words.docs[d].split()
                rows += [(keys[d], *r) for r in _places(index, hits, text, coverage)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FOUND)


_ARROW = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int32()), *((n, pa.int32()) for n in ("template_start", "template_end", "word_start", "word_end")), ("matched_text", pa.string())])


def _places(index: TemplateIndex, hits: dict[int, set[int]], text: list[bytes], coverage: float) -> list[tuple]:
    found = []
    for t, shifts in sorted(hits.items()):
        template = index.words[t]
        band = max(2, len(template) // 5)
        need, want = coverage * len(template) - 1e-9, Counter(template)
        for s in sorted(shifts):
            if (want & Counter(text[max(0, s - band) : max(0, s + len(template) + band)])).total() < need:
                continue  # the words that the band can match are too few in any order
            n, a, e, lo, hi = align(template, text, s, band)
            if n >= need:
                found.append((index.names[t], n / len(template), n, a, e, lo, hi, b" ".join(text[lo:hi]).decode("utf-8", "replace")))
    found.sort(key=lambda r: (-r[2], -r[1], r[6] - r[5], r[5], r[0]))
    out: list[tuple] = []
    for r in found:
        if all(r[6] <= o[5] or r[5] >= o[6] for o in out):
            out.append(r)
    return sorted(out, key=lambda r: r[5])
