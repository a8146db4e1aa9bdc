"""Operator 2: licence scans by a generalised suffix automaton over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Identifiers of the SPDX list; what follows of them, a version or "or later", does not change the label.
SPDX = {"mit": "MIT", "isc": "ISC", "apache-2.0": "Apache-2.0", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause", "zlib": "Zlib", "unlicense": "Unlicense", "bsl-1.0": "BSL-1.0", "gpl": "GPL", "lgpl": "LGPL", "agpl": "AGPL", "mpl-2.0": "MPL-2.0", "epl-2.0": "EPL-2.0", "cc0": "CC0"}
#: Conditions of the Creative Commons licences, short and in full.
SHARING = [("sa", "SA", "ShareAlike"), ("nc", "NC", "NonCommercial"), ("nd", "ND", "NoDerivatives"), ("nc-sa", "NC SA", "NonCommercial ShareAlike"), ("nc-nd", "NC ND", "NonCommercial NoDerivatives")]
#: Licences and the notices that they ask for, and their labels; years and names left out.
TEMPLATES = [
    ("mit", "released under the MIT license"),
    ("mit", "licensed under the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("apache-2.0", "licensed under the Apache License version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("gpl", "licensed under the GNU General Public License version 2"),
    ("gpl", "licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("cc-by", "licensed under CC BY"),
    ("cc-by", "licensed under a Creative Commons Attribution license"),
    *[(f"cc-by-{label}", f"{lead} {words}") for label, words, long in SHARING for lead, words in (("CC BY", words), ("under CC BY", words), ("Creative Commons Attribution", long), ("under a Creative Commons Attribution", long))],
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "all rights reserved"),
    ("mit", "the MIT license"),
    ("mit", "the MIT licence"),
    ("mit", "under MIT license"),
    ("mit", "under MIT licence"),
    ("apache-2.0", "licensed under Apache 2.0"),
    ("apache-2.0", "Apache License 2.0"),
    *[(label, f"SPDX-License-Identifier: {name}") for label, name in SPDX.items()],
]
#: Templates of fewer words must stand whole.
SHORT = 12
LEAST_MATCH, COVERED, GAP = 3, 0.8, 40


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.translate(_LOWER)) if text else []


class Automaton:
    """Suffix automaton of several word sequences; matches carry their places in the templates.

    ``phrases`` are sequences of their own, so each is the longest string of its state: a text place ends a
    phrase exactly if the phrase's state is on the suffix-link path of the place's state and the match is as
    long as the phrase.
    """

    def __init__(self, templates: list[tuple[str, list[str]]], phrases: dict[str, str]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.words: dict[str, int] = {}
        self.templates = templates
        number = lambda ws: [self.words.setdefault(w, len(self.words)) for w in ws]
        sequences = [number(ws) for _, ws in templates]
        phrase_ids = [(number(tokens(p)), label) for p, label in phrases.items()]
        for seq in sequences + [p for p, _ in phrase_ids]:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        # ends of each state's strings in the templates, for strings of that state; the templates they are in
        self.places: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for t, seq in enumerate(sequences):
            state = 0
            for end, c in enumerate(seq):
                state = self.next[state][c]
                self.places[state].add((t, end))
        own: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for seq, label in phrase_ids:
            state = 0
            for c in seq:
                state = self.next[state][c]
            own[state].append((len(seq), label))
        order = sorted(range(1, len(self.next)), key=lambda s: self.len[s])
        for s in reversed(order):
            self.places[self.link[s]] |= self.places[s] if self.link[s] else set()
        self.phrases = own
        for s in order:
            self.phrases[s] = own[s] + self.phrases[self.link[s]]
        # a string of ``LEAST_MATCH`` words or more of a state is in the templates of its shortest such suffix
        self.touched: list[frozenset[int]] = [frozenset()] * len(self.next)
        for s in order:
            if self.len[s] >= LEAST_MATCH:
                up = self.link[s]
                self.touched[s] = self.touched[up] if self.len[up] >= LEAST_MATCH else frozenset(t for t, _ in self.places[s])
        self.single: dict[int, Automaton] = {}

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.len[q] == self.len[last] + 1:
                return q
            return self._clone(last, q, c)
        new = self._state({}, self.len[last] + 1, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return new

    def _state(self, out: dict[int, int], length: int, link: int) -> int:
        self.next.append(out)
        self.len.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        made = self._state(dict(self.next[q]), self.len[p] + 1, self.link[q])
        self.link[q] = made
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        return made

    def statistics(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(place, length, state) of the longest match that ends at each place that has one."""
        nxt, link, length, get = self.next, self.link, self.len, self.words.get
        state = size = 0
        before = -2
        for i, c in [(i, c) for i, c in enumerate(map(get, words)) if c is not None]:
            if i != before + 1:
                state = size = 0
            before = i
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            yield i, size, state

    def scan(self, words: list[str], least: int = LEAST_MATCH, gap: int = GAP) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, float]]]:
        """(phrase starts with labels, covered spans) of a text.

        The matching statistics tell the phrases, and the templates with which the text shares ``least`` words in a row.
        Against each of these alone the text is then matched again, so that a template inside another, longer
        match counts too. A span is (template, first word, last word, share of the template covered), see ``_chains``.
        """
        starts, touched = [], set()
        for i, size, state in self.statistics(words):
            for n, label in self.phrases[state]:
                if size >= n:
                    starts.append((i - n + 1, label))
            if size >= least:
                touched |= self.touched[state]
        spans = []
        for t in touched:
            if t not in self.single:
                self.single[t] = Automaton([self.templates[t]], {})
            n = len(self.templates[t][1])
            spans += [(t, first, last, covered / n) for first, last, covered in self.single[t]._chains(words, min(least, n), gap)]
        return starts, sorted(spans, key=lambda s: (s[1], s[2], s[0]))

    def _chains(self, words: list[str], least: int, gap: int) -> list[tuple[int, int, int]]:
        """(first word, last word, words covered) of the best chains of an automaton of one template.

        Matches of ``least`` words or more that cannot be extended, in rising order of text and template with at most
        ``gap`` words between them in the text; one chain for each end of a best one.
        """
        blocks, last = [], None
        for i, size, state in self.statistics(words):
            if last and not (last[0] + 1 == i and last[1] + 1 == size):
                blocks.append(last)
            last = (i, size, state) if size >= least else None
        if last:
            blocks.append(last)
        open_: list[list] = []  # [first, last, template end, covered, extended]
        for i, size, state in blocks:
            at, before = i - size + 1, len(open_)
            for _, end in sorted(self.places[state]):
                best, most = None, size
                for chain in reversed(open_[:before]):
                    if chain[1] < at - gap - 1:
                        break
                    if chain[2] < end and chain[1] < i and (n := chain[3] + min(size, end - chain[2], i - chain[1])) > most:
                        best, most = chain, n
                if best is not None:
                    best[4] = True
                open_.append([best[0] if best else at, i, end, most, False])
        return [(c[0], c[1], c[3]) for c in open_ if not c[4]]


def automaton(templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> Automaton:
    return Automaton([(label, tokens(text)) for label, text in templates or TEMPLATES], BASE if phrases is None else phrases)


def told_apart(spans: list[tuple], templates: list[tuple[str, list[str]]]) -> list[tuple]:
    """Of spans (template, first, last, covered) over the same words the one that matches most of them.

    Notices of one family share most words, and a short name lies inside a longer one: from the most words matched down (of
    equals from the one that ends last) a span is kept unless more than half of it, or of one kept before under another label, is common to both.
    """
    kept: list[tuple] = []
    for t, first, last, covered in sorted(spans, key=lambda s: (-s[3] * len(templates[s[0]][1]), -s[3], -s[2], s[0])):
        shared = lambda k, a=first, b=last: min(b, k[2]) - max(a, k[1]) + 1
        label = templates[t][0]
        if not any(templates[k[0]][0] != label and 2 * shared(k) > min(last - first, k[2] - k[1]) + 1 for k in kept):
            kept.append((t, first, last, covered))
    return sorted(kept, key=lambda s: (s[1], s[2], s[0]))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,covered:double>>"


def _scan(templates, phrases, covered):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(templates, phrases)
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), kind]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text)
                starts, spans = made.scan(words)
                base = sorted({label for _, label in starts})
                found = told_apart([s for s in spans if s[3] >= (covered if len(made.templates[s[0]][1]) >= SHORT else 1)], made.templates)
                labels = sorted({*base, *(made.templates[t][0] for t, *_ in found)})
                score = max((s[3] for s in spans), default=0.0)
                at = [i for i, _ in starts]
                told = [{"label": made.templates[t][0], "first": a, "last": b, "covered": c} for t, a, b, c in found]
                rows.append((doc_id, len(words), len(starts), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), min(score, 1.0), told))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, covered: float = COVERED) -> DataFrame:
    """Licence notices of each text: word counts, phrase places, labels, score and covered spans.

    One pass, row by row, without a shuffle; the automaton is built in every task from the templates. Labels
    are those of phrases found and of templates of which a chain covers ``covered`` or more (those under ``SHORT``
    words whole), of templates over the same words only the one that matches most; the score is the largest share of any template, also where it is too small for a label. Null and empty texts have no words, empty label lists and score 0.
    Repeated rows give repeated results; extra columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(templates, phrases, covered), SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("spans")
