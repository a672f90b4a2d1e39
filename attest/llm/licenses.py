"""License scans by patience alignment.

A text and a template are aligned on words that are unique in both: the longest increasing subsequence of these anchors
is kept, and the gaps between anchors are aligned again, where other words have become unique. Coverage is the share of
the template's words that are aligned. Where in a text a template may stand is found first, by pairs of neighbouring
words that occur once in the template: pairs that imply nearly the same start belong to one occurrence.
"""
from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import flat
from .common import per_row, table
from .winnow import WORD, kgrams

# Short notices and published license headers.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}

_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. ")
TEMPLATES |= {
    "BSD-2-Clause": _BSD + _AS_IS,
    "BSD-3-Clause": _BSD + (
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission. ") + _AS_IS,
    "0BSD": TEMPLATES["ISC"].replace(
        ", provided that the above copyright notice and this permission notice appear in all copies.", "."),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        "software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and "
        "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
        "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language "
        "processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR "
        "ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "GPL-2.0-header": TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2"),
    "AGPL-3.0-header": TEMPLATES["GPL-3.0-header"].replace("GNU General", "GNU Affero General"),
    "LGPL-3.0-header": TEMPLATES["GPL-3.0-header"].replace("GNU General", "GNU Lesser General"),
    "LGPL-2.1-header": TEMPLATES["GPL-3.0-header"].replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
    "GPL-2.0-notice": TEMPLATES["GPL-3.0-notice"].replace("version 3", "version 2"),
    "AGPL-3.0-notice": TEMPLATES["GPL-3.0-notice"].replace("GNU General", "GNU Affero General"),
    "LGPL-3.0-notice": TEMPLATES["GPL-3.0-notice"].replace("GNU General", "GNU Lesser General"),
    "LGPL-2.1-notice": TEMPLATES["GPL-3.0-notice"].replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
} | {f"CC-{kind}-{v}-notice": f"Licensed under CC {kind} {v}." for v in ("3.0", "4.0") for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")}
# Names of licenses and of their variants: one that stands between aligned words is of another license.
OTHER = "mit bsd isc apache gpl lgpl agpl gfdl affero lesser mozilla mpl eclipse epl zlib boost unlicense cc0 nc sa nd".split()
TELLING = "affero lesser by nc sa nd".split()  # and numbers; those of a template must align


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence of distinct values."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = at[k - 1] if k else -1
        tails[k: k + 1] = [v]
        at[k: k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _unique(words: list[int], start: int, end: int) -> dict[int, int]:
    """Place of each word that occurs once between start and end."""
    found: dict[int, int] = {}
    for i in range(start, end):
        found[words[i]] = -1 if words[i] in found else i
    return {w: i for w, i in found.items() if i >= 0}


def align(text: list[int], template: list[int], start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of a patience alignment of text[start:end] with the whole template.

    In each gap equal words at both ends are matched first; a gap without words that are unique in both ends there.
    """
    out: list[tuple[int, int]] = []
    stack = [(start, len(text) if end is None else end, 0, len(template))]
    while stack:
        a, a_end, b, b_end = stack.pop()
        while a < a_end and b < b_end and text[a] == template[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and text[a_end - 1] == template[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            out.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        there = _unique(template, b, b_end)
        anchors = sorted((i, there[w]) for w, i in _unique(text, a, a_end).items() if w in there)
        kept = [anchors[i] for i in increasing([j for _, j in anchors])]
        if not kept:
            continue
        for (i, j), (k, m) in zip([(a - 1, b - 1), *kept], [*kept, (a_end, b_end)]):
            if i + 1 < k and j + 1 < m:
                stack.append((i + 1, k, j + 1, m))
        out += kept
    return sorted(out)


@dataclass(frozen=True)
class Template:
    name: str
    words: list[int]
    pairs: np.ndarray  # sorted hashes of pairs of words that occur once
    place: np.ndarray
    telling: frozenset[int]  # places of words that must align
    other: frozenset[int]  # hashes of words that must not stand between aligned ones

    @staticmethod
    def of(name: str, text: str) -> Template:
        data = np.frombuffer(text.encode(), np.uint8)
        t = flat.Tokens(data, np.array([0, len(data)]), WORD, flat.LOWER)
        words = t.hashes
        pairs, place, times = np.unique(kgrams(words, 2), return_index=True, return_counts=True)
        said = [data[a:b].tobytes().decode().lower() for a, b in zip(t.starts, t.ends)]
        variant = len(said) < 20 or "gnu" in said  # in long texts "by" and the numbers of clauses tell nothing
        version = {i for i, w in enumerate(said) if w.isdigit() and (variant or i and said[i - 1] in ("version", "v"))}
        telling = {i for i, w in enumerate(said) if w in TELLING and (w != "by" or "cc" in said)} | version
        other = " ".join(w for w in OTHER if w not in said).encode()
        other = flat.Tokens(np.frombuffer(other, np.uint8), np.array([0, len(other)]), WORD, flat.LOWER).hashes
        return Template(name, words.tolist(), pairs[times == 1], place[times == 1], frozenset(telling), frozenset(other.tolist()))

    def told(self, matched: list[tuple[int, int]], text: list[int]) -> bool:
        """Whether the words align that tell the license from its variants, and no other license is named between."""
        aligned = dict(matched)
        return self.telling <= set(aligned.values()) and all(
            i in aligned or text[i] not in self.other for i in range(matched[0][0], matched[-1][0]))

    def regions(self, places: np.ndarray, at: np.ndarray, first: int, last: int) -> list[tuple[int, int]]:
        """Where the template may stand in one text (words first .. last), from its pairs found: where, and which."""
        n = len(self.words)
        slack, least = max(2, n // 4), max(1, n // 10)
        starts = np.sort(places - at)
        out = []
        for group in np.split(starts, np.flatnonzero(np.diff(starts) > slack) + 1):
            if len(group) >= least:
                out.append((max(first, int(group[0]) - slack), min(last, int(group[-1]) + n + slack)))
        return out


@dataclass(frozen=True)
class Finding:
    row: int
    name: str
    coverage: float
    start: int  # words of the row
    end: int


def scan_tokens(t: flat.Tokens, templates: list[Template], least: float) -> list[Finding]:
    """Findings of all rows, of overlapping ones the one that aligns more words."""
    found: dict[int, list[tuple[int, float, str, int, int]]] = {}
    pairs = kgrams(t.hashes, 2)
    row_of = None
    for template in templates:
        at = np.searchsorted(template.pairs, pairs)
        at[at == len(template.pairs)] = 0
        places = np.flatnonzero(template.pairs[at] == pairs) if len(template.pairs) else np.zeros(0, np.int64)
        if not len(places):
            continue
        row_of = t.row_of() if row_of is None else row_of
        places = places[row_of[places] == row_of[places + 1]]
        rows = row_of[places]
        for group in np.split(np.arange(len(places)), np.flatnonzero(np.diff(rows)) + 1):
            if not len(group):
                continue
            row = int(rows[group[0]])
            first, last = int(t.rows[row]), int(t.rows[row + 1])
            for a, b in template.regions(places[group], template.place[at[places[group]]], first, last):
                text = t.hashes[a:b].tolist()
                matched = align(text, template.words)
                coverage = len(matched) / len(template.words)
                if coverage >= least and template.told(matched, text):
                    found.setdefault(row, []).append((len(matched), coverage, template.name, a + matched[0][0] - first, a + matched[-1][0] + 1 - first))
    out = []
    for row in sorted(found):
        kept: list[Finding] = []
        for n, coverage, name, start, end in sorted(found[row], key=lambda x: (-x[0], -x[1], x[2], x[3])):
            if all(end <= k.start or start >= k.end for k in kept):
                kept.append(Finding(row, name, coverage, start, end))
        out += sorted(kept, key=lambda k: k.start)
    return out


def scan(df: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, keep: str = "doc_id long", text_col: str = "text") -> DataFrame:
    """One row for each license found: the kept columns, license_id, coverage, start_word and end_word.

    Words are runs of letters and digits, A-Z lower-cased. A license stands where at least `least` of its words align,
    with all that tell versions and variants apart, and of overlapping findings the one with more aligned words stays (then higher coverage, then the first by name).
    Texts that are null, empty or without a license give no row; repeated rows give their findings each.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast([Template.of(n, x) for n, x in sorted((templates or TEMPLATES).items())])
    names = [c.strip().split(" ")[0] for c in keep.split(",")]

    def scanner():
        ready = held.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = flat.texts(batch.column("__text"))
            found: list[Finding] = []
            for a, b in flat.pieces(offsets):
                t = flat.Tokens(data, offsets[a: b + 1], WORD, flat.LOWER)
                found += [Finding(x.row + a, x.name, x.coverage, x.start, x.end) for x in scan_tokens(t, ready, least)]
            rows = pa.array([x.row for x in found], pa.int64())
            return pa.RecordBatch.from_arrays([
                *(batch.column(n).take(rows) for n in names), pa.array([x.name for x in found], pa.string()),
                pa.array([x.coverage for x in found], pa.float64()), pa.array([x.start for x in found], pa.int64()), pa.array([x.end for x in found], pa.int64())],
                [*names, "license_id", "coverage", "start_word", "end_word"])
        return f

    return per_row(df.select(*names, F.col(text_col).alias("__text")), scanner,
                   f"{keep}, license_id string, coverage double, start_word long, end_word long")


def op5_licenses(spark: SparkSession, d: str) -> DataFrame:
    return scan(table(spark, d, "documents"))
