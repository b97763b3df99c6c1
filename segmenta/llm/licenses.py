"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Words are runs of ASCII letters and digits, A-Z lower-cased.  From the k-word grams of a template winnowing selects the least hash of
every window of ``WINDOW`` grams, so every passage of ``WINDOW + K - 1`` words of it has a selected gram (a template with
fewer has one).  The inverted index maps a selected gram to its places in templates.  Every gram of a text is looked up;
a hit that no report of its template has yet is a candidate, which is aligned in a band with the text around it that is free of such
reports, so that notices right after each other are all found (local alignment: 1 for an equal word, -1 for another word or a gap).  A candidate
is reported if enough of the template's words are matched, and all that tell its license from others (``TELLING``, numbers): with coverage, matched words, and the span of
characters.  Of overlapping reports the one with most
matched words stays."""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import bounded_batches

K, WINDOW = 3, 4
#: Least half width of the band; it is that of the words that a report of the template may lack.
BAND = 8
MIN_COVERAGE = 0.8

# Public license notices and texts by identifier.
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU = (
    "This {what} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
)
_GNU_WARRANTY = (
    " This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)


def _gnu(what: str, name: str, version: str) -> list[str]:
    """The line, the notice, and the notice with its warranty clause."""
    words = {"what": what, "name": name, "version": version, "stop": ":" if version == "3" else ";", "comma": "," if version == "3" else ";"}
    return [f"This work is licensed under the GNU {name}, version {version}.", _GNU.format(**words), (_GNU + _GNU_WARRANTY).format(**words)]


def _cc(short: str, long: str, version: str = "4.0") -> list[str]:
    return [f"Licensed under CC {short} {version}.", f"This work is licensed under a Creative Commons {long} {version} International License."]


TEMPLATES: dict[str, list[str]] = {
    "0BSD": ["Released under the Zero-Clause BSD License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY],
    "AGPL-3.0": _gnu("program", "Affero General Public License", "3"),
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD, f"{_BSD} {_BSD_WARRANTY}"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", f"{_BSD} {_BSD_3}", f"{_BSD} {_BSD_3} {_BSD_WARRANTY}"],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") '
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is "
        "furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
        "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are "
        "solely in the form of machine-executable object code generated by a source language processor.",
    ],
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": _gnu("program", "General Public License", "2"),
    "GPL-3.0": _gnu("program", "General Public License", "3"),
    "ISC": ["Released under the ISC License.", _ISC, f"{_ISC} {_ISC_WARRANTY}"],
    "LGPL-2.1": _gnu("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("library", "Lesser General Public License", "3"),
    "MIT": ["Released under the MIT License.", _MIT, f"{_MIT} {_MIT_WARRANTY}"],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this "
        "software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
        "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "This notice may not be removed or altered from any source distribution.",
    ],
    "all-rights-reserved": ["All rights reserved."],
}

#: Words that tell licenses apart, as numbers do: a report has all of them that its template has, and no other of these words.
TELLING = frozenset("apache mit isc bsd boost gnu lesser affero mozilla cc cc0 by nc sa nd noncommercial sharealike noderivatives neither endorse zero".split())

_WORD = re.compile(r"[A-Za-z0-9]+")
_BYTES = re.compile(rb"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def winnow(hashes: list[int], window: int) -> list[int]:
    """Positions of the least hash of each window (the last of equal ones), each once."""
    if len(hashes) <= window:
        return [min(range(len(hashes)), key=lambda k: (hashes[k], -k))] if hashes else []
    picked = []
    for at in range(len(hashes) - window + 1):
        k = min(range(at, at + window), key=lambda k: (hashes[k], -k))
        if not picked or picked[-1] != k:
            picked.append(k)
    return picked


def _free(spans: list[tuple[int, int]], start: int, end: int, size: int) -> tuple[int, int] | None:
    """The gap between the sorted ``spans`` in 0 .. size that holds all of start .. end, or None."""
    k = bisect_right(spans, (start, size))
    low, high = spans[k - 1][1] if k else 0, spans[k][0] if k < len(spans) else size
    return (low, high) if low <= start and end <= high else None


class Scanner:
    """The index of the templates and the scan of a text."""

    def __init__(self, templates: dict[str, list[str]] | None = None, k: int = K, window: int = WINDOW, band: int = BAND, min_coverage: float = MIN_COVERAGE):
        self.k, self.band, self.min_coverage = k, band, min_coverage
        self.templates = [(name, n, words_of(t)) for name, texts in sorted((templates or TEMPLATES).items()) for n, t in enumerate(texts)]
        self.telling = [sum(1 << p for p, w in enumerate(words) if w in TELLING or w.isdigit()) for _, _, words in self.templates]
        self.vocabulary: dict[bytes, int] = {}
        self.index: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for t, (_, _, words) in enumerate(self.templates):
            if len(words) < k:
                raise ValueError("a template is shorter than a gram")
            ids = [self.vocabulary.setdefault(w.encode(), len(self.vocabulary) + 1) for w in words]
            grams = [tuple(ids[p : p + k]) for p in range(len(ids) - k + 1)]
            hashes = [xxhash.xxh64_intdigest(" ".join(words[p : p + k]), 42) for p in range(len(grams))]
            for p in winnow(hashes, window):
                self.index[grams[p]].append((t, p))

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(template, place in it, word in the text) of every gram in the index."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in _BYTES.findall(text.encode("utf-8", "surrogatepass").lower())], np.int64)
        if len(ids) < self.k:
            return []
        ok = ids[: len(ids) - self.k + 1] > 0
        for j in range(1, self.k):
            ok &= ids[j : len(ids) - self.k + 1 + j] > 0
        out = []
        for at in np.flatnonzero(ok).tolist():
            for t, p in self.index.get(tuple(ids[at : at + self.k].tolist()), ()):
                out.append((t, p, at))
        return out

    def scan(self, text: str | None) -> list[tuple[str, int, float, int, int, int]]:
        """(license, number of the template, coverage, matched words, start, end) of what is found, by start."""
        if not text or not (hits := self.hits(text)):
            return []
        found = list(_WORD.finditer(text))
        words = [m.group().lower() for m in found]
        reports = []
        by_template: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for t, p, at in hits:
            by_template[t].add((at - p, at))
        for t, places in by_template.items():
            name, n, template = self.templates[t]
            spans: list[tuple[int, int]] = []  # words of the text that reports of this template have
            tried = set()
            for d, at in sorted(places):
                # until a report has the hit, or what is free about it holds none
                while (free := _free(spans, at, at + self.k, len(words))) and (d, free) not in tried:
                    tried.add((d, free))
                    r = self._align(t, d, words, *free)
                    if r is None or r[0].bit_count() < self.min_coverage * len(template):
                        break
                    matched, first, final = r[0].bit_count(), *r[1:]
                    insort(spans, (first, final + 1))
                    others = TELLING.difference(template, ("by",)).intersection(words[first : final + 1])
                    if others or r[0] & self.telling[t] != self.telling[t]:
                        continue  # another license; what is beside it is still looked at
                    reports.append((name, n, matched / len(template), matched, found[first].start(), found[final].end()))
        reports.sort(key=lambda r: (-r[3], -r[2], r[4], r[0], r[1]))
        kept: list[tuple] = []
        taken: list[tuple[int, int]] = []
        for r in reports:
            if _free(taken, r[4], r[5], len(text)):
                kept.append(r)
                insort(taken, (r[4], r[5]))
        return sorted(kept, key=lambda r: r[4])

    def _align(self, t: int, diagonal: int, words: list[str], low: int, high: int) -> tuple[int, int, int] | None:
        """Best local alignment of the template about a diagonal, with the words from low to high (excluded): matched words of the
        template as bits, first and last word of the text."""
        template = self.templates[t][2]
        band = max(self.band, -int(-(1 - self.min_coverage) * len(template) // 1))  # words that a report may lack shift the rest so far
        best: tuple[int, int, int, int] | None = None
        before: dict[int, tuple[int, int, int]] = {}  # by text word: score, matched (bits), first word
        for p, w in enumerate(template):
            now: dict[int, tuple[int, int, int]] = {}
            for at in range(max(low, p + diagonal - band), min(high, p + diagonal + band + 1)):
                s, m, first = before.get(at - 1, (0, 0, -1))
                cell = (s + 1, m | 1 << p, at if first < 0 else first) if words[at] == w else (s - 1, m, first)
                for s, m, first in (before.get(at, (0, 0, -1)), now.get(at - 1, (0, 0, -1))):
                    if s - 1 > cell[0]:
                        cell = (s - 1, m, first)
                if cell[0] > 0:
                    now[at] = cell
                    if words[at] == w and (best is None or (cell[0], cell[1].bit_count()) > (best[0], best[1].bit_count())):
                        best = (*cell, at)
            before = now
        return None if best is None else (best[1], best[2], best[3])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row for each report: ``(key, license, template, coverage, matched_words, span_start, span_end)``, characters from 0.

    Texts without a license, null and empty ones have no row.  Keys are integers; a null key is kept; repeated rows report
    again; columns other than the two aren't looked at.  No shuffle: the index is a constant of the program."""
    bounded_batches(docs.sparkSession)
    names = ["key", "license", "template", "coverage", "matched_words", "span_start", "span_end"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def run(rows):
        scanner = Scanner(templates, min_coverage=min_coverage)
        for batch in rows:
            out = [(k.as_py(), *r) for k, t in zip(batch.column(0), batch.column(1), strict=True) for r in scanner.scan(t.as_py())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    schema = "key long, license string, template int, coverage double, matched_words long, span_start long, span_end long"
    made = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return made.withColumnRenamed("key", key)
