"""License scan: patience alignment of each text with license templates.

Words that are unique to both sides anchor the alignment: the longest increasing subsequence of anchors is kept, and
the gaps between them are aligned the same way; a gap without unique words is aligned by the longest increasing
subsequence of all its equal word pairs. Coverage is the share of the template's words that are aligned.

Texts are aligned window by window: windows of four template lengths, one apart, so a notice is found the same wherever
it begins as long as it spans no more than three template lengths, that is, with up to twice its own length of other
words in between. A window is skipped only if the words it has in common with the template, however ordered, could not
reach the coverage asked for. Nothing is shuffled; the templates are a fixed few.

Licenses differ from each other in a few words, which a share of the words does not see. So a template may have
required phrases (its name, version or terms), which must stand in the aligned span, word by word. A template that is
part of a longer one's text is not reported where the longer one is found.

Defined results: a null or empty text has no license. Ties between templates go to the first by name, between
windows to the first. Texts of any length are scanned whole. Repeated rows are scanned each; null ids are allowed. An empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Words, chunks, lut

WORDS = lut(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
COVERAGE = 0.8
#: Template lengths of a window.
STRETCH = 4

# fixed values: license notices as their texts give them
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC0-1.0": "CC0 1.0 Universal",
    # the full texts begin so
    "Apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
}
#: Phrases of a template that must stand in the text as they are.
REQUIRED: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License Version 2.0",),
    "Apache-2.0-header": ("Apache License Version 2.0",),
    "Apache-2.0-text": ("Apache License Version 2.0 January 2004",),
    "GPL-3.0": ("GNU General Public License version 3",),
    "GPL-3.0-header": ("GNU General Public License", "version 3 of"),
    "ISC": ("provided that the above copyright notice", "appear in all copies"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License v 2.0",),
    "Unlicense": ("free and unencumbered software",),
    "CC0-1.0": ("CC0 1.0 Universal",),
}
#: Templates that are part of another's text, and the other.
PART_OF = {"BSD-2-Clause": "BSD-3-Clause", "BSD-2-Clause-full": "BSD-3-Clause-full", "MIT-text": "MIT-full", "ISC": "ISC-full", "Unlicense": "Unlicense-full"}

# fixed values: what follows in the whole texts
_MIT = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = (
    " In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
    "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
    "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
)
TEMPLATES["Zlib"] = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software. 3. This notice may not be removed or altered from any source distribution."
)
REQUIRED["Zlib"] = ("altered source versions must be plainly marked",)
TEMPLATES["BSL-1.0"] = (
    "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a "
    'copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
    "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so."
)
REQUIRED["BSL-1.0"] = ("Boost Software License",)

TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"] + (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission."
)
REQUIRED["BSD-3-Clause"] = ("endorse or promote products derived from this software",)
for _name, _rest in (("MIT-text", _MIT), ("BSD-2-Clause", _BSD), ("BSD-3-Clause", _BSD), ("ISC", _ISC), ("Unlicense", _UNLICENSE)):
    _full = _name.replace("-text", "") + "-full"
    TEMPLATES[_full], REQUIRED[_full] = TEMPLATES[_name] + _rest, REQUIRED.get(_name, ())
for _name in ("BSD 2-Clause", "BSD 3-Clause", "ISC"):
    TEMPLATES[f"{_name.replace(' ', '-')}-notice"] = f"Released under the {_name} License"
    REQUIRED[f"{_name.replace(' ', '-')}-notice"] = (f"{_name} License",)
_KINDS = {"": "", "-NC": "NonCommercial", "-SA": "ShareAlike", "-ND": "NoDerivatives", "-NC-SA": "NonCommercial-ShareAlike", "-NC-ND": "NonCommercial-NoDerivatives"}
for _kind, _words in _KINDS.items():
    _long = f"Attribution{'-' * bool(_words)}{_words} 4.0"
    for _name, _text, _must in (
        (f"CC-BY{_kind}-4.0" + "-notice" * (not _kind), f"Licensed under CC BY{_kind} 4.0", f"CC BY{_kind} 4.0"),
        (f"CC-BY{_kind}-4.0" + "-text" * bool(_kind), f"This work is licensed under a Creative Commons {_long} International License", f"Creative Commons {_long}"),
    ):
        TEMPLATES[_name], REQUIRED[_name] = _text, (_must,)
for _name, _kind, _version, _date in (
    ("GPL-2.0", "General", "2", "June 1991"),
    ("GPL-3.0", "General", "3", "29 June 2007"),
    ("LGPL-2.1", "Lesser General", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser General", "3", "29 June 2007"),
    ("AGPL-3.0", "Affero General", "3", "19 November 2007"),
):
    _own = f"GNU {_kind} Public License"
    TEMPLATES[_name] = f"This work is licensed under the {_own}, version {_version}"
    REQUIRED[_name] = (f"{_own} version {_version}",)
    TEMPLATES[f"{_name}-header"] = TEMPLATES["GPL-3.0-header"].replace("GNU General Public License", _own).replace("version 3", f"version {_version}")
    REQUIRED[f"{_name}-header"] = (_own, f"version {_version} of")
    TEMPLATES[f"{_name}-text"] = f"{_own} Version {_version}, {_date} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    REQUIRED[f"{_name}-text"] = (f"{_own} Version {_version} {_date}",)


def split_words(text: str) -> list[bytes]:
    for chunk in chunks(pa.array([text])):
        words = Words(chunk, WORDS)
        return [words.norm[a:b].tobytes() for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
    return []


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by ascending first place, whose second places ascend too."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back[k] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[at], piles[at] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Aligned (text, template) places, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        anchors = increasing(sorted((place[w], j) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in place))
        if not anchors:
            where: dict[bytes, list[int]] = {}
            for j in range(d - 1, c - 1, -1):
                where.setdefault(template[j], []).append(j)
            out += increasing([(i, j) for i in range(a, b) for j in where.get(text[i], ())])
            continue
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Templates:
    def __init__(self, texts: dict[str, str], coverage: float, required: dict[str, tuple[str, ...]], part_of: dict[str, str]):
        self.coverage, self.part_of = coverage, part_of
        self.names = sorted(texts)
        self.words = [split_words(texts[n]) for n in self.names]
        vocabulary = sorted({w for ws in self.words for w in ws})
        row = pa.array([b" ".join(vocabulary)], pa.binary())
        self.hashes = next(iter(Words(c, WORDS).hashes() for c in chunks(row)))
        order = np.argsort(self.hashes)
        self.hashes = self.hashes[order]
        number = {vocabulary[o]: k for k, o in enumerate(order.tolist())}
        self.counts = np.zeros((len(self.names), len(vocabulary)), np.int64)
        for t, ws in enumerate(self.words):
            for w in ws:
                self.counts[t, number[w]] += 1
        phrases = [[split_words(x) for x in required.get(n, ())] for n in self.names]
        self.phrases = [[b" %b " % b" ".join(x) for x in own] for own in phrases]
        self.needed = np.zeros(self.counts.shape, bool)
        for t, own in enumerate(phrases):
            self.needed[t, [number[w] for x in own for w in x]] = True

    def scan(self, words: Words, text: int, known: np.ndarray) -> list[dict]:
        """Each template's best window in a text: license, coverage, first and stop word."""
        first, stop = int(words.first[text]), int(words.first[text + 1])
        own = known[first:stop]
        have = np.bincount(own[own >= 0], minlength=self.counts.shape[1])
        out = []
        enough = np.minimum(have[None, :], self.counts).sum(axis=1) >= self.coverage * np.array([len(w) for w in self.words])
        for t in np.flatnonzero(enough & ~(self.needed & (have == 0)).any(axis=1)).tolist():
            template, best = self.words[t], (0.0, 0, 0)
            n = len(template)
            hits = np.flatnonzero(own >= 0)
            for w in np.unique(np.concatenate([np.maximum(hits // n - k, 0) for k in range(STRETCH)])).tolist():
                a, b = w * n, min(len(own), (w + STRETCH) * n)
                part = own[a:b]
                if np.minimum(np.bincount(part[part >= 0], minlength=self.counts.shape[1]), self.counts[t]).sum() < self.coverage * n:
                    continue
                own_words = [words.norm[words.start[k] : words.end[k]].tobytes() for k in range(first + a, first + b)]
                pairs = align(own_words, template)
                span = b" %b " % b" ".join(own_words[pairs[0][0] : pairs[-1][0] + 1]) if pairs else b""
                if len(pairs) / n > best[0] and all(x in span for x in self.phrases[t]):
                    best = (len(pairs) / n, a + pairs[0][0], a + pairs[-1][0] + 1)
            if best[0] >= self.coverage:
                out.append({"license": self.names[t], "coverage": best[0], "first": best[1], "stop": best[2]})
        found = {m["license"] for m in out}
        return [m for m in out if self.part_of.get(m["license"]) not in found]


def scan_licenses(docs: DataFrame, keep: dict[str, Column], templates: dict[str, str] | None = None, coverage: float = COVERAGE, text_col: str = "text", required: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """`keep`, then matches (all templates found), license (the best covered, longest first) and coverage; own templates come with their `required` phrases."""
    given = Templates(TEMPLATES, coverage, REQUIRED, PART_OF) if templates is None else Templates(templates, coverage, required or {}, {})
    shared = docs.sparkSession.sparkContext.broadcast(given)
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).cast("string").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    match = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        least = min((len(w) for w in own.words), default=0) * own.coverage
        for batch in batches:
            found: list[list[dict]] = []
            for chunk in chunks(batch.column(batch.num_columns - 1)):
                words = Words(chunk, WORDS)
                h = words.hashes()
                at = np.minimum(np.searchsorted(own.hashes, h), len(own.hashes) - 1)
                known = np.where(own.hashes[at] == h, at, -1)
                known_so_far = np.concatenate(([0], np.cumsum(known >= 0)))[words.first]
                found += [own.scan(words, i, known) if n >= least else [] for i, n in enumerate(np.diff(known_so_far).tolist())]
            size = {n: len(w) for n, w in zip(own.names, own.words, strict=True)}
            best = [max(m, key=lambda x: (x["coverage"] * size[x["license"]], x["coverage"]), default=None) for m in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.list_(match)), pa.array([b and b["license"] for b in best], pa.string()), pa.array([b["coverage"] if b else 0.0 for b in best], pa.float64())],
                [*batch.schema.names[:-1], "matches", "license", "coverage"],
            )

    return rows.mapInArrow(run, schema + "matches array<struct<license:string,coverage:double,first:int,stop:int>>, license string, coverage double")
