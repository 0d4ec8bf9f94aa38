"""License scans by patience alignment.

A template and a stretch of text are aligned on words that occur once in both. The
longest increasing run of such anchors stays, and the gaps between them are aligned
in the same way; a gap without anchors is aligned by longest common subsequence.
Coverage is the share of the template's words that are aligned. In a place no two
aligned words are further apart than in the template by more than ``GAP`` words.

Licenses differ by few words, so coverage alone does not name one. Templates of fewer
than ``NOTICE_WORDS`` words need all of them. Words of ``TELLING`` and version numbers
that a template has must be aligned, and so must those of ``ASKED``. A text is cut at
such a word, or such a number after ``version`` and the like, that a template does not
have: a place of "CC BY 4.0" never runs over an "SA". Templates without any such word
are not cut. ``0`` tells nothing, as version 3 is version 3.0.

A text is first looked at word by word, all texts of a batch at once: positions of
template words, with no more than ``GAP`` other words between two of them, form
stretches, and a stretch is aligned with a template only if its words could cover
``COVERAGE`` of it, within no more words than a place can take. That bound is exact, so
what is aligned is a small part of the corpus, and whole texts are read whatever their
length. What is left is cut in places by longest chains of template words with no wider
gap than that, and each place is aligned by itself; the chain stands where it has more.

Words are runs of ASCII letters, digits and bytes beyond ASCII, in lower case.

Defined cases: a null text holds nothing; texts that hold several licenses give a
row for each, and a license that occurs several times gives its best place (ties:
the first) and the number of places; rows are kept for each input row; a null doc_id
is kept; an empty table or no templates give an empty result; further columns are
not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from martlet.llm.common import mix, pick
from martlet.llm.words import Sums, _byte_codes, chunks

COVERAGE, GAP = 0.8, 6
#: Templates with fewer words than this are notices, which need full coverage.
NOTICE_WORDS = 20
#: Gaps without anchors are aligned word by word up to this many cells; beyond that, split where nothing is lost.
CELLS = 1 << 16

#: License texts, the headers of the long ones, and notices that name a license.
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
    "GNU General Public License for more details."
)
_BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CC_TERMS = {"NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
_CC = ["BY", "BY-NC", "BY-ND", "BY-SA", "BY-NC-ND", "BY-NC-SA"]

TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-notice": "under the MIT License",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-notice": "under the Apache License, Version 2.0",
    "GPL-2.0": _GPL.replace("version 3", "version 2"),
    "GPL-2.0-notice": "under the GNU General Public License, version 2",
    "GPL-3.0": _GPL,
    "GPL-3.0-notice": "under the GNU General Public License, version 3",
    "AGPL-3.0": _GPL.replace("GNU General", "GNU Affero General"),
    "AGPL-3.0-notice": "under the GNU Affero General Public License, version 3",
    "LGPL-2.1-notice": "under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0-notice": "under the GNU Lesser General Public License, version 3",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "ISC-notice": "under the ISC License",
    "BSD-2-Clause": _BSD_CLAUSES + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD_CLAUSES + _BSD_THIRD + _BSD_DISCLAIMER,
    **{f"CC-{code}-4.0-notice": f"under CC {code} 4.0" for code in _CC},
    **{
        f"CC-{code}-4.0-deed": "under Creative Commons "
        + "-".join(["Attribution", *(_CC_TERMS[k] for k in code.split("-")[1:])])
        + " 4.0 International License"
        for code in _CC
    },
}
#: Words that tell licenses apart, words before a version number, and words that relatives of a text lack.
TELLING = frozenset(
    "mit isc bsd apache gnu mozilla eclipse creative cc cc0 lesser library affero nc noncommercial commercial "
    "sa sharealike alike nd noderivatives noderivs derivatives".split()
)
BEFORE_VERSION = frozenset("version v by nc nd sa attribution noncommercial noderivatives sharealike".split())
ASKED = {"MIT": "conditions", "ISC": "appear", "BSD-2-Clause": "reproduce", "BSD-3-Clause": "endorse"}
_DIGITS = "1 2 3 4 5 6 7 8 9".split()

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: str) -> list[bytes]:
    return [w.lower() for w in _WORDS.findall(text.encode())]


def _longest_increasing(values: Sequence[int]) -> list[int]:
    """Positions of a longest increasing run of distinct values."""
    tails: list[int] = []
    at: list[int] = []
    before = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _common(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """A longest common subsequence of two short sequences."""
    rows = [[0] * (len(b) + 1)]
    for x in reversed(a):
        last = rows[-1]
        row = [0] * (len(b) + 1)
        for j in range(len(b) - 1, -1, -1):
            row[j] = last[j + 1] + 1 if x == b[j] else max(last[j], row[j + 1])
        rows.append(row)
    rows.reverse()
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _split(a: Sequence, b: Sequence) -> tuple[int, int]:
    """Where a longest common subsequence of two long sequences passes the middle of the first."""
    half = len(a) // 2
    number = {x: k for k, x in enumerate(dict.fromkeys(b))}
    codes = np.array([number[x] for x in b])

    def scores(part: Sequence, codes: np.ndarray) -> np.ndarray:
        row = np.zeros(len(codes) + 1, np.int64)
        for x in part:
            row[1:] = np.maximum(row[1:], row[:-1] + (codes == number.get(x, -1)))
            np.maximum.accumulate(row, out=row)
        return row

    return half, int(np.argmax(scores(a[:half], codes) + scores(a[half:][::-1], codes[::-1])[::-1]))


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in enumerate(b[b0:b1], b0) if once_b[x] == 1}
        anchors = [(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if once_a[x] == 1 and x in where]
        if not anchors:
            if (a1 - a0) * (b1 - b0) <= CELLS or a1 - a0 == 1:
                out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            else:
                i, j = _split(a[a0:a1], b[b0:b1])
                todo += [(a0, a0 + i, b0, b0 + j), (a0 + i, a1, b0 + j, b1)]
            continue
        run = [anchors[k] for k in _longest_increasing([j for _, j in anchors])]
        i, j = a0, b0
        for x, y in run:
            todo.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        todo.append((i, a1, j, b1))
    return sorted(out)


def _candidates(template: list[int], own: list[int], position: list[int], need: float) -> list[tuple[int, int]]:
    """Parts of a stretch outside which no window as wide as a place can be has enough words of the template."""
    caps, have, total, a = Counter(template), Counter(), 0, 0
    wide = (len(template) - 1) * (GAP + 1)
    parts: list[tuple[int, int]] = []
    for b, x in enumerate(own):
        have[x] += 1
        total += have[x] <= caps[x]
        while position[b] - position[a] > wide:
            total -= have[own[a]] <= caps[own[a]]
            have[own[a]] -= 1
            a += 1
        if total >= need:
            if parts and a <= parts[-1][1]:
                parts[-1] = parts[-1][0], b + 1
            else:
                parts.append((a, b + 1))
    return parts


def _chains(template: list[int], own: list[int], position: list[int], need: float) -> list[list[tuple[int, int]]]:
    """Longest chains of aligned words, no two of which share a word of the text, without a jump of over
    ``GAP`` words more than in the template; the longest first, then the tightest, then the first."""
    where: dict[int, list[int]] = {}
    for i, x in enumerate(template):
        where.setdefault(x, []).append(i)
    hit = [j for j, x in enumerate(own) for _ in where.get(x, ())]
    index = np.array([i for x in own for i in where.get(x, ())], np.int64)
    at = np.array([position[j] for j in hit], np.int64)
    shift, n = at - index, len(hit)
    score, before, begin = np.ones(n, np.int64), np.full(n, -1, np.int64), at.copy()
    low = np.searchsorted(at, at - len(template) - GAP)
    high = np.searchsorted(at, at)
    for q in range(n):
        a, b = low[q], high[q]
        fits = np.flatnonzero((index[a:b] < index[q]) & (shift[a:b] >= shift[q] - GAP))
        if len(fits):
            p = a + fits[len(fits) - 1 - np.argmax(score[a:b][fits][::-1])]
            score[q], before[q], begin[q] = score[p] + 1, p, begin[p]
    ends = np.flatnonzero(score >= need)
    used: set[int] = set()
    out = []
    for q in ends[np.lexsort((at[ends], at[ends] - begin[ends], -score[ends]))].tolist():
        chain = []
        while q >= 0 and hit[q] not in used:
            chain.append((int(index[q]), hit[q]))
            q = int(before[q])
        if q < 0:
            used.update(j for _, j in chain)
            out.append(chain[::-1])
    return out


class _Scanner:
    def __init__(self, templates: Mapping[str, str], coverage: float, notice_words: int):
        self.names = sorted(templates)
        self.words = [words(templates[n]) for n in self.names]
        if not all(self.words):
            raise ValueError("a template has at least one word")
        telling, before, digits = ({w.encode() for w in x} for x in (TELLING, BEFORE_VERSION, _DIGITS))
        known = sorted({w for t in self.words for w in t} | telling | before | digits)
        data = np.frombuffer(b" ".join(known) + b" ", np.uint8)
        ends = np.cumsum([len(w) + 1 for w in known], dtype=np.int64) - 1
        codes = _codes(data, ends - np.array([len(w) for w in known], np.int64), ends)
        order = np.argsort(codes)
        self.codes = codes[order]
        number = {known[k]: i for i, k in enumerate(order)}
        self.lists = [[number[w] for w in t] for t in self.words]
        self.counts = np.zeros((len(known), len(self.names)), np.int32)
        for t, own in enumerate(self.lists):
            np.add.at(self.counts[:, t], own, 1)
        self.needed = np.array([len(t) * (coverage if len(t) >= notice_words else 1.0) for t in self.lists])
        self.telling, self.before, self.digit = (
            np.array([w in x for w in sorted(number, key=number.get)]) for x in (telling, before, digits)
        )
        # Per template: its telling words, and where in it those stand first that must be aligned.
        self.own, self.asked = [], []
        for name, t in zip(self.names, self.lists, strict=True):
            codes = np.array(t)
            own = set(codes[self.telling[codes] | self._versions(codes, np.arange(len(t)))].tolist())
            self.own.append(own)
            more = {number[w] for w in words(ASKED.get(name, "")) if w in number}
            self.asked.append({t.index(x) for x in own | more if x in t})

    def _versions(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which of the words are the first or second number of a version."""
        next_ = np.zeros(len(number), bool)
        next_[1:] = np.diff(place) == 1
        first = self.digit[number] & next_
        first[1:] &= self.before[number[:-1]]
        second = self.digit[number] & next_
        second[1:] &= first[:-1]
        return first | second

    def scan(self, data: np.ndarray, at: np.ndarray):
        """For each text and template found: text, template, coverage, first and last word, places."""
        n = len(data)
        inside = _WORD[data]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = at[(at > 0) & (at < n)]
        starts[cuts], ends[cuts - 1] = inside[cuts], inside[cuts - 1]
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        first = np.searchsorted(start, at)
        code = _codes(data, start, end)
        number = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[number] == code)
        if not len(hit):
            return
        number, text = number[hit], np.searchsorted(first, hit, "right") - 1
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) > GAP + 1) | (np.diff(text) != 0)
        stretch = np.cumsum(new) - 1
        # Which template words each stretch has, and how much of each template they could cover.
        pairs = np.unique(stretch * len(self.codes) + number)
        could = np.zeros((stretch[-1] + 1, len(self.names)), np.int32)
        np.add.at(could, pairs // len(self.codes), self.counts[pairs % len(self.codes)])
        heads = np.append(np.flatnonzero(new), len(hit))
        rival = self.telling[number] | self._versions(number, hit + text)
        best: dict[tuple[int, int], list] = {}
        for s, t in zip(*np.nonzero(could >= self.needed[None, :]), strict=True):
            a, b = heads[s], heads[s + 1]
            d = int(text[a])
            found = best.setdefault((d, int(t)), [0, 0, 0, 0])
            cuts = []
            if self.own[t]:
                cuts = [k for k in (np.flatnonzero(rival[a:b]) + a).tolist() if int(number[k]) not in self.own[t]]
            for c, e in zip([a, *(k + 1 for k in cuts)], [*cuts, b], strict=True):
                for matched, x, y in self._places(int(t), number[c:e].tolist(), (hit[c:e] - first[d]).tolist()):
                    found[3] += 1
                    if matched > found[0] or matched == found[0] and x < found[1]:
                        found[:3] = [matched, x, y]
        for (d, t), (matched, x, y, places) in best.items():
            if places:
                yield d, t, matched / len(self.lists[t]), x, y, places

    def _places(self, t: int, own: list[int], position: list[int]):
        """Places of the template in one stretch; what a place used is cut out before the next."""
        template, need, asked = self.lists[t], self.needed[t], self.asked[t]
        while parts := _candidates(template, own, position, need):
            used: set[int] = set()
            for a, b in parts:
                for chain in _chains(template, own[a:b], position[a:b], need):
                    c, d = a + chain[0][1], a + chain[-1][1] + 1
                    free = [j for j in range(c, d) if j not in used]
                    run = self._dense(patience(template, [own[j] for j in free]), [position[j] for j in free])
                    pairs = [(i, free[j]) for i, j in run] if len(run) >= len(chain) else [(i, a + j) for i, j in chain]
                    places = [j for _, j in pairs]
                    if used.isdisjoint(places):
                        used.update(places)
                        if asked <= {i for i, _ in pairs}:
                            yield len(places), position[places[0]], position[places[-1]]
            if not used:
                return
            keep = [j for j in range(len(own)) if j not in used]
            own, position = [own[j] for j in keep], [position[j] for j in keep]

    def _dense(self, run: list[tuple[int, int]], position: list[int]) -> list[tuple[int, int]]:
        """The longest part of an alignment without a jump of over ``GAP`` words more than in the template."""
        best: list[tuple[int, int]] = []
        begin = 0
        for k in range(1, len(run) + 1):
            if k == len(run) or position[run[k][1]] - position[run[k - 1][1]] > run[k][0] - run[k - 1][0] + GAP:
                if k - begin > len(best):
                    best = run[begin:k]
                begin = k
        return best


def _codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(Sums.of(_byte_codes(8)[_LOWER[data]]).stretch(start, end), 8)


def _scan(templates: Mapping[str, str], coverage: float, notice_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(templates, coverage, notice_words)
        for batch in batches:
            for part, data, at in chunks(batch, "text"):
                rows = list(scanner.scan(data, at))
                d, t, share, first, last, places = zip(*rows, strict=True) if rows else ((),) * 6
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id").take(pa.array(d, pa.int64())),
                        "license": pa.array([scanner.names[k] for k in t], pa.string()),
                        "coverage": pa.array(share, pa.float64()),
                        "first_word": pa.array(first, pa.int32()),
                        "last_word": pa.array(last, pa.int32()),
                        "places": pa.array(places, pa.int32()),
                    }
                )

    return run


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    *,
    coverage: float = COVERAGE,
    notice_words: int = NOTICE_WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word (places of the aligned words), places."""
    rows = pick(docs, doc_id=(id_column, "bigint"), text=(text_column, "string"))
    schema = "doc_id long, license string, coverage double, first_word int, last_word int, places int"
    if not templates:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_scan(dict(templates), coverage, notice_words), schema)
