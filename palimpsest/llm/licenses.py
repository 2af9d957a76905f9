"""Licence scans by conditional compression.

A licence that a block of text repeats makes the block compress better if the compressor has seen the licence before. So
each candidate block's words are compressed with zstandard alone and with each template as a raw dictionary, and
templates are ranked by how much they save. Templates that save fewer than LEAST_SAVED bytes are out: no wording that a block holds
saves less. Of the others, those that save nearly as much as the best are compared with the block word by word, and the
one with the fewest differing words wins; if none of them is confirmed, the others follow by rank. A full template is
found if at most a fifth of its words differ; a notice, a single sentence that names a licence, only if none does. What
lies before and after a licence found is a block again.

Candidate blocks are an anchor word and, on both sides of it, as many words as the longest wording may take; those that
meet are one, and are ranked a window of bounded length at a time. So a licence is whole in its window wherever its
anchor stands and however its lines are wrapped. Full templates are looked for first; in what they leave, notices, with
windows as narrow as notices are short, for in a wide one what a short wording saves is lost. Only texts with an anchor
reach Python.

Nulls and odd cases: a null or empty text has no block; sentences and lines play no part; a text of thousands of notices
takes a window after the other; repeated rows are scanned each for itself; an empty table gives no rows; other columns of
the input are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of which a licence has one at least; a line's end and its mark of a comment may stand between two.
ANCHOR = r"(?i)licen[sc]|copyright|spdx|warrant|permission\W+is|redistribut|public\W+domain|creative\W+commons|\bCC(?:\W+BY|\W*0)|\bunder\W+(?:the\W+)?(?:terms\W+of\W+)?(?:the\W+)?(?:[AL]?GPL|GNU|MPL|MIT|BSD|ISC|Apache|Mozilla|Unlicense)\b"
#: Names by which notices call licences.
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "MIT": ("the MIT License", "MIT License", "MIT"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License", "BSD-3-Clause"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU GPL v2", "GPL-2.0"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU GPL v3", "GPL-3.0"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "AGPL-3.0"),
    "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "ISC": ("the ISC License", "ISC"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"),
    "Unlicense": ("the Unlicense", "Unlicense"),
}
#: How notices begin.
OPENINGS = ("Licensed under", "Released under", "is licensed under", "is released under", "available under", "distributed under", "published under", "under the terms of", "SPDX-License-Identifier:")
#: The wording of licences' short forms.
FULL = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: The disclaimers of the BSD licences, and the licences' whole wordings.
BSD_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
WHOLE = {
    "MIT": FULL["MIT"] + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": FULL["ISC"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": f"{BSD_CLAUSES} {BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{BSD_CLAUSES} {BSD_THIRD} {BSD_DISCLAIMER}",
    "Apache-2.0": FULL["Apache-2.0"] + " See the License for the specific language governing permissions and limitations under the License.",
    "GPL": FULL["GPL"].replace("Free Software Foundation.", "Free Software Foundation, either version 3 of the License, or (at your option) any later version.") + " See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Unlicense": FULL["Unlicense"] + " In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: Further templates than the above, as {licence: wording}, may be given to scan() and find().
MOST_DIFFERENT = 0.2
LEVEL = 19
#: Whole licences are looked for first, with wide windows; notices in what is left, with narrow ones.
KINDS = ("full", "notice")
#: Bytes that a template must save at least. The shortest wording, of 12 characters or more, saves as much.
LEAST_SAVED = 4
#: Templates that save this part of what the best one saves are compared with it by wording.
NEARLY = 0.8
#: Words in a row by which places that may hold a wording are told.
ROW = 3
STOP = re.compile(r"[.!?][\"')\]]*\s|\n\s*\n")
WORD = re.compile(r"\w+(?:[.-]\w+)*")


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def plain_form(words: list[tuple[str, int, int]]) -> str:
    """What is compressed: words without case, signs and line ends."""
    return " ".join(w for w, _, _ in words)


class Templates:
    """The known wordings as words, each with a compressor that has seen it."""

    def __init__(self, more: tuple[tuple[str, str], ...] = ()):
        import zstandard

        notices = [(name, "notice", [f"{o} {c}" for o in OPENINGS for c in called]) for name, called in NAMES.items()]
        fulls = [(name, "full", [text]) for name, text in [*FULL.items(), *WHOLE.items(), *more]]
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.known = []
        for name, kind, wordings in [*notices, *fulls]:
            seen = zstandard.ZstdCompressionDict("\n".join(plain_form(words_of(x)) for x in wordings).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            seen.precompute_compress(level=LEVEL)
            wordings = sorted(([w for w, _, _ in words_of(x)] for x in wordings), key=len, reverse=True)
            self.known.append((name, kind, wordings, zstandard.ZstdCompressor(dict_data=seen, level=LEVEL, write_content_size=False)))
        #: Words that the longest wording of each kind may take with what may differ in it.
        self.reach = {kind: math.ceil((1 + MOST_DIFFERENT) * max(len(w) for _, k, wordings, _ in self.known if k == kind for w in wordings)) for kind in KINDS}


templates = lru_cache(8)(Templates)


def blocks(text: str, a: int, b: int, reach: int) -> list[tuple[int, int]]:
    """Stretches of text[a:b] that `reach` words on both sides of each anchor make up, none longer than a window of 3 *
    reach words; windows that cut a stretch overlap by `reach` words."""
    found = [m.span() for m in re.finditer(ANCHOR, text[a:b])]
    if not found:
        return []
    words, out = words_of(text[a:b]), []
    starts, ends = [w[1] for w in words], [w[2] for w in words]
    for x, y in found:
        first = max(0, bisect_right(ends, x) - reach)
        last = min(len(words), bisect_left(starts, y) + reach)
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    cut = [(k, min(y, k + 3 * reach)) for x, y in out if x < y for k in range(x, max(x + 1, y - reach), 2 * reach)]
    return [(a + starts[x], a + ends[y - 1]) for x, y in cut]


def places(words: list[str], wording: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of words that share enough rows of ROW words with the wording to hold it, likely ones first."""
    n, slack = len(wording), math.ceil(MOST_DIFFERENT * len(wording))
    rows = {tuple(wording[k : k + ROW]) for k in range(n - ROW + 1)}
    hits = [k for k in range(len(words) - ROW + 1) if tuple(words[k : k + ROW]) in rows]
    shared = sorted((k - bisect_left(hits, hits[k] + n + slack), hits[k]) for k in range(len(hits)))
    tried: list[int] = []
    for less, at in shared:
        if -less < n - ROW + 1 - ROW * slack:
            return
        if all(abs(at - x) > slack // 2 for x in tried):
            tried.append(at)
            yield max(0, at - slack), min(len(words), at + n + 2 * slack)


def sentences(block: str, own: list[tuple[str, int, int]]) -> str:
    """The words with a space around each, and a full stop as a word of its own where a sentence or paragraph ends."""
    after = [x[1] for x in own[1:]]
    return " " + "".join(f"{w} . " if STOP.search(block[e:x]) else f"{w} " for (w, _, e), x in zip(own, [*after, len(block)], strict=True))


def notices(told: str, wordings: list[list[str]]) -> list[tuple[int, int, int]]:
    """(first word, word after the last, 0) of each place of any of the wordings, the longest there."""
    found: list[tuple[int, int, int]] = []
    for wording in wordings:  # longest first
        text = f" {' '.join(wording)} "
        at = told.find(text)
        while at >= 0:
            k = told.count(" ", 0, at) - told.count(" . ", 0, at + 1)
            if all(k + len(wording) <= a or k >= b for a, b, _ in found):
                found.append((k, k + len(wording), 0))
            at = told.find(text, at + len(text) - 1)
    return found


def full(words: list[str], wordings: list[list[str]]) -> list[tuple[int, int, int]]:
    """(first word, word after the last, words that differ) of the place that fits best, if one fits."""
    best = None
    for wording in wordings:
        for low, high in places(words, wording):
            same = [m for m in SequenceMatcher(None, words[low:high], wording, autojunk=False).get_matching_blocks() if m.size]
            for i in range(len(same)):
                matched = 0
                for last in same[i:]:  # words met by chance before and after the wording don't belong to it
                    matched += last.size
                    a, b = low + same[i].a, low + last.a + last.size
                    different = max(len(wording), b - a) - matched
                    if different <= MOST_DIFFERENT * len(wording) and (best is None or different < best[2]):
                        best = (a, b, different)
            if best:
                break
    return [best] if best else []


def winner(block: str, own: list[tuple[str, int, int]], known: Templates, kind: str) -> tuple[str, float, list[tuple[int, int, int]]] | None:
    """(licence, part saved, places) of the template that compression ranks first and wording confirms."""
    raw, told, words = plain_form(own).encode("utf-8", "surrogatepass"), sentences(block, own), [w for w, _, _ in own]
    alone = len(known.plain.compress(raw))
    ranked = sorted(((alone - len(c.compress(raw)), name, wordings) for name, k, wordings, c in known.known if k == kind), key=lambda x: (-x[0], x[1], len(x[2][0])))
    ranked = [x for x in ranked if x[0] >= LEAST_SAVED]
    best: list[tuple[int, float, str, list[tuple[int, int, int]]]] = []
    for saved, name, wordings in ranked:
        if best and saved < NEARLY * ranked[0][0]:
            break
        if hits := notices(told, wordings) if kind == "notice" else full(words, wordings):
            best.append((min(h[2] for h in hits), -saved / alone, name, hits))
            if saved < NEARLY * ranked[0][0]:
                break
    if not best:
        return None
    _, saved, name, hits = min(best, key=lambda x: x[:3])
    return name, round(-saved, 6), hits


def settled(found: list[tuple]) -> list[tuple]:
    """found (differing words, -length, start, end, ...) without those that overlap a better one, by start: windows
    overlap, so a place may be met twice."""
    taken: list[tuple[int, int]] = []
    kept = []
    for x in sorted(found):
        k = bisect_left(taken, x[2:4])
        if not (k and taken[k - 1][1] > x[2] or k < len(taken) and taken[k][0] < x[3]):
            insort(taken, x[2:4])
            kept.append(x)
    return sorted(kept, key=lambda x: x[2])


def find_in(text: str, known: Templates) -> Iterator[tuple[int, int, str, str, float, int]]:
    """The licences in a text: in each window the winner's places, then what lies before, between and after them."""
    whole = [(0, len(text))]
    for kind in KINDS:
        found: list[tuple] = []
        left = [w for a, b in whole for w in blocks(text, a, b, known.reach[kind])]
        while left:
            a, b = left.pop()
            own = words_of(text[a:b])
            if not (won := winner(text[a:b], own, known, kind)):
                continue
            name, saved, hits = won
            at = a
            for first, after, different in sorted(hits):
                start, end = a + own[first][1], a + own[after - 1][2]
                found.append((different, start - end, start, end, name, saved))
                left += blocks(text, at, start, known.reach[kind])
                at = end
            left += blocks(text, at, b, known.reach[kind])
        found, at, between = settled(found), 0, []
        for different, _, start, end, name, saved in found:
            yield start, end, name, kind, saved, different
            between.append((at, start))
            at = end
        whole = [*between, (at, len(text))] if len(whole) == 1 else whole


def find(text: str | None, more: dict[str, str] | None = None) -> list[tuple[int, int, str, str, float, int]]:
    """(start, end, licence, kind, part of the size saved, words that differ) of each licence, in code points."""
    return sorted(find_in(text, templates(tuple(sorted((more or {}).items()))))) if text else []


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", more: dict[str, str] | None = None) -> DataFrame:
    """A row per document: doc_id, licenses: array of (start, end, license, kind, saved, differences)."""
    kind = "array<struct<start:long,end:long,license:string,kind:string,saved:double,differences:long>>"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("start", "end", "license", "kind", "saved", "differences")
        for batch in batches:
            found = [[dict(zip(names, x, strict=True)) for x in find(t, more)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "licenses": found})

    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(F.col(text).rlike(ANCHOR), F.col(text)).alias("text"))
    return held.mapInPandas(work, f"doc_id long, licenses {kind}")
