"""License scans by template markup.

A template is text with regions ``<<beginOptional>> ... <<endOptional>>`` and
``<<var;name;original;match>>`` (match: a regular expression for the replaced word,
``.{0,N}`` for up to N words). It is compiled into a token automaton; a text is
accepted, at any place, if the mandatory wording stands there word for word, with
optional regions present or not and replaceable ones filled. Templates of whole licenses
hold all of their mandatory wording, so that a text with a clause changed or left out is
not accepted; others are the notices by which a work names its license.

Words are runs of 0-9, a-z and anything beyond ASCII after lower-casing A-Z. The base
count finds three phrases at every place. An automaton starts only around its anchors,
the literal words that can come first, however many replaced words may stand before
them; templates with a label of their own add it to the base labels. The score is
n / (n + 4) for the n mandatory words of the longest template accepted, or the words of
the longest base phrase found, whichever are more: a whole license is near 1, a bare name
under 0.5, nothing 0.

A null or empty text has no words, no labels and score 0; a very long one is read whole,
and only texts with an anchor are walked word by word. Of acceptances of a template that
overlap the earliest counts, and of those from one word the longest. Repeated rows are
returned as often as they come; null ids stay null; an empty table gives an empty result;
columns other than doc_id and text are not looked at. ``matches`` gives the spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, in_batches
from .textkit import NOT_ALNUM, Words, chunks, one_hash

# The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public license texts and notices as templates, with their labels.
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
_ARISING = "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
_INFRINGEMENT = ("NONINFRINGEMENT", "NON-INFRINGEMENT")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "<<beginOptional>>3.<<endOptional>> Neither the name of <<var;owner;the copyright holder;.{1,8}>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY <<var;provider;THE COPYRIGHT HOLDERS AND CONTRIBUTORS;.{1,8}>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL <<var;holder;THE COPYRIGHT HOLDER OR CONTRIBUTORS;.{1,8}>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND <<var;author;THE AUTHOR;.{1,8}>> <<var;verb;DISCLAIMS;disclaims?>> ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;holder;THE AUTHOR;.{1,8}>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"
)
_GNU = "GNU <<beginOptional>><<var;kind;Lesser;lesser|library|affero>><<endOptional>> General Public License"
TEMPLATES = (
    ("mit", "<<beginOptional>>Released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    *[("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. "
     + _WARRANTY + spelled + ". IN NO EVENT SHALL <<var;holder;THE AUTHORS OR COPYRIGHT HOLDERS;.{1,8}>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, " + _ARISING) for spelled in _INFRINGEMENT],
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this <<var;work;file;.{1,4}>> except in compliance with the License. You may obtain a copy of the License at <<var;place;http://www.apache.org/licenses/LICENSE-2.0;.{1,12}>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("gpl", "<<var;work;This work;.{1,6}>> is licensed under the <<beginOptional>>terms of the<<endOptional>> " + _GNU + " <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version <<var;version;3;[23]>>"),
    ("gpl", "<<var;work;This program;.{1,6}>> is free software <<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the " + _GNU + " as published by the Free Software Foundation <<beginOptional>>; either version <<var;version;3;[23]>> <<beginOptional>><<var;minor;0;[01]>><<endOptional>> of the License <<beginOptional>>, or (at your option) any later version<<endOptional>><<endOptional>> "
     + "<<beginOptional>><<var;again;This program;.{1,6}>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the " + _GNU + " for more details<<endOptional>>"),
    ("cc-by-nc", "Licensed under <<beginOptional>>a Creative Commons<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC <<var;version;4.0;.{0,2}>>"),
    ("cc-by-sa", "Licensed under <<beginOptional>>the<<endOptional>> CC BY-SA <<var;version;4.0;.{0,2}>>"),
    ("cc-by", "Licensed under <<beginOptional>>the<<endOptional>> CC BY <<var;version;4.0;[0-9]>>"),
    ("bsd-2-clause", _BSD + _BSD_END),
    ("bsd-3-clause", _BSD + _BSD_NAMES + _BSD_END),
    ("isc", "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the <<var;who;authors;authors?>> be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     "<<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
     "<<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution"),
    *[("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
     "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
     + _WARRANTY.removesuffix(" AND ") + ", TITLE AND " + spelled + ". IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, " + _ARISING) for spelled in _INFRINGEMENT],
    *[("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
     "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
     + _WARRANTY + spelled + ". IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, " + _ARISING) for spelled in _INFRINGEMENT],
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0 <<beginOptional>>If a copy of the MPL was not distributed with this file, You can obtain one at <<var;place;https://mozilla.org/MPL/2.0/;.{1,8}>><<endOptional>>"),
    ("all-rights-reserved", "Copyright <<beginOptional>>(c)<<endOptional>> <<var;owner;2020 Owner;.{1,8}>> All rights reserved"),
    ("proprietary", "<<var;work;This document;.{1,4}>> is proprietary and confidential"),
)
MARK = re.compile(r"<<beginOptional>>|<<endOptional>>|<<var;[^;]*;[^;]*;[^>]*>>")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """States are numbers; edges are (word test, target), skips are targets reached without a word."""

    def __init__(self, label: str, markup: str):
        self.label, self.edges, self.skips, self.mandatory = label, [[]], [[]], 0
        now, opened, at = 0, [], 0
        for m in [*MARK.finditer(markup), None]:
            for word in TOKEN.findall(markup[at : m.start() if m else len(markup)].lower()):
                now = self.step(now, ("is", word.encode()))
                self.mandatory += not opened
            if m is None:
                break
            at = m.end()
            if m[0].startswith("<<begin"):
                opened.append(now)
            elif m[0].startswith("<<end"):
                if not opened:
                    raise ValueError("an optional region ends that did not begin")
                self.skips[opened.pop()].append(now)
            else:
                rule = m[0][2:-2].split(";", 3)[3]
                if span := re.fullmatch(r"\.\{(\d+),(\d+)\}", rule):
                    least, most = map(int, span.groups())
                    begin = []
                    for k in range(most):
                        if k >= least:
                            begin.append(now)
                        now = self.step(now, ("any", None))
                    for s in begin:
                        self.skips[s].append(now)
                else:
                    now = self.step(now, ("like", re.compile(rule.encode())))
        if opened:
            raise ValueError("an optional region does not end")
        self.final = now
        self.reach = [self.closed({s}) for s in range(len(self.edges))]

    def step(self, state: int, test: tuple) -> int:
        self.edges.append([])
        self.skips.append([])
        self.edges[state].append((test, len(self.edges) - 1))
        return len(self.edges) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return frozenset(states)

    def longest(self, words: list[bytes], at: int) -> int | None:
        """The word after the longest acceptance that begins at a word; None without one."""
        states, found = self.reach[0], None
        while True:
            if self.final in states:
                found = at
            if at >= len(words) or not states:
                return found
            word, after = words[at], set()
            for s in states:
                for (kind, what), t in self.edges[s]:
                    if kind == "any" or (word == what if kind == "is" else what.fullmatch(word)):
                        after |= self.reach[t]
            states, at = frozenset(after), at + 1

    def anchors(self) -> dict[bytes, int]:
        """Literal words that can be the first literal one of an acceptance, and how many replaced words may stand before each at most."""
        found, states, back = {}, self.reach[0], 0
        while states:
            if self.final in states:
                raise ValueError("a template needs a word of its own")
            after = set()
            for s in states:
                for (kind, what), t in self.edges[s]:
                    if kind == "is":
                        found[what] = back
                    else:
                        after |= self.reach[t]
            states, back = frozenset(after), back + 1
        return found


def compiled(templates=TEMPLATES) -> list[tuple[Automaton, dict[bytes, int]]]:
    return [(a, a.anchors()) for a in (Automaton(label, markup) for label, markup in templates)]


def spans_of(words: list[bytes], places: list[int], machines) -> list[tuple[str, int, int, int]]:
    """(label, first word, word after the last, mandatory words) of every acceptance; the longest from the earliest start, without overlaps in a template."""
    found = []
    for a, first in machines:
        done = 0
        for p in places:
            if words[p] not in first:
                continue
            for at in range(max(done, p - first[words[p]]), p + 1):
                end = a.longest(words, at)
                if end is not None:
                    found.append((a.label, at, end, a.mandatory))
                    done = end
                    break
    return found


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the templates' matches of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,end_word:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        cache: dict = {}
        machines = compiled(templates)
        anchors = np.array(sorted({one_hash(w) for _, first in machines for w in first}), np.uint64)
        phrases = [(np.array([one_hash(w) for w in p.split()], np.uint64), label) for p, label in PHRASES]
        length = {label: len(p.split()) for p, label in PHRASES}
        for b in batches:
            n_words, n_base, first, last, base, labels, score, matches = [], [], [], [], [], [], [], []
            for lo, hi, data, at in chunks(b.column(1)):
                w = Words(data, at, NOT_ALNUM, lower=True)
                h = w.hash(cache)
                hits: dict[int, list] = {}
                for want, label in phrases:
                    k = len(want)
                    if len(h) < k:
                        continue
                    ok = np.ones(len(h) - k + 1, bool)
                    for j in range(k):
                        ok &= h[j : len(h) - k + 1 + j] == want[j]
                    for p in np.flatnonzero(ok).tolist():
                        if w.text[p] == w.text[p + k - 1]:
                            hits.setdefault(int(w.text[p]), []).append((p - int(w.first[w.text[p]]), label))
                near = np.flatnonzero(np.isin(h, anchors))
                cuts = np.searchsorted(near, w.first)
                for i in range(hi - lo):
                    own = hits.get(i, [])
                    found = []
                    if cuts[i] < cuts[i + 1]:
                        found = spans_of(w.of(i), (near[cuts[i] : cuts[i + 1]] - w.first[i]).tolist(), machines)
                    n_words.append(int(w.counts[i]))
                    n_base.append(len(own))
                    first.append(min(p for p, _ in own) if own else None)
                    last.append(max(p for p, _ in own) if own else None)
                    known = {x for _, x in own}
                    base.append(",".join(sorted(known)))
                    labels.append(",".join(sorted(known | {x[0] for x in found})))
                    n = max([x[3] for x in found] + [length[x] for x in known], default=0)
                    score.append(n / (n + 4))
                    matches.append([{"label": x[0], "first_word": x[1], "end_word": x[2]} for x in found])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())])))
            columns = [pa.array(x, t) for x, t in zip((n_words, n_base, first, last, base, labels, score, matches), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def op7_license_templates(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
