"""Licence scans by a generalised suffix automaton of licence tokens.

All templates and phrases are fed, word by word, into one automaton. A file's words stream through it and give matching
statistics: for each word, the longest run ending there that stands in some template. Maximal runs become anchors
(template, place in it, place in the file), which are chained in order with small gaps; a chain that covers enough of its
template gives the label. A phrase counts wherever the statistics reach its length and its last words are the phrase.

Words between which no template has a neighbouring pair can't be in a run of two, so only runs of such pairs, found with
arrays, are streamed.

Defined cases. Null text: as an empty one, no words, no labels, score 0. Null doc_id: kept as null. Rows that share a
doc_id are scanned each by itself. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAPS = np.ones(256, bool)
GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Phrases of the contract and their labels (fixed values).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Public licence texts and notices, and our labels for them; :func:`licences` takes any others.
TEMPLATES = (
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "licensed under the mit license"),
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2.0-notice", "licensed under the apache license version 2.0"),
    ("apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-3-notice", "licensed under the GNU General Public License version 3"),
    ("gpl-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("bsd-2-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3-clause", """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("isc-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib-text", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense-text", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("mpl-2.0-header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("cc-by-4.0-notice", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0-notice", "licensed under CC BY 4.0"),
)
#: Shortest anchor in words, widest gap in a chain, and the share of a template that a chain must cover.
ANCHOR, GAP, COVER = 3, 12, 0.7


def tokens(text: str) -> list[str]:
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


class Automaton:
    """The generalised suffix automaton of integer sequences. ``where`` has, for a state, the places at which its runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.where: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                self.where[last].add((k, at + 1))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.where[self.link[state]] |= self.where[state]
        self.where[0] = set()

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.where.append(set())
        return len(self.link) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if (q := self.next[last].get(token)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    def statistics(self, sequence: list[int]) -> list[tuple[int, int]]:
        """(state, length of the longest run ending there) for every item of ``sequence``."""
        out, state, length = [], 0, 0
        for token in sequence:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            out.append((state, length))
        return out


@dataclass(frozen=True)
class Found:
    label: str
    first: int
    end: int
    cover: float


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        words = [tokens(t) for _, t in templates]
        self.sizes = [len(w) for w in words]
        said = [tokens(p) for p, _ in phrases]
        vocabulary = sorted({w for ws in words + said for w in ws})
        number = {w: i for i, w in enumerate(vocabulary)}
        raw = [w.encode() for w in vocabulary]
        offsets = np.concatenate(([0], np.cumsum([len(w) for w in raw]))).astype(np.int64)
        hashes = tx.spans(tx.prefix(np.frombuffer(b"".join(raw), np.uint8), tx.LOWER_BYTE), offsets[:-1], offsets[1:])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        sequences = [[number[w] for w in ws] for ws in words]
        self.phrases = [([number[w] for w in ws], label) for ws, (_, label) in zip(said, phrases, strict=True)]
        self.automaton = Automaton(sequences + [s for s, _ in self.phrases])
        self.size = len(vocabulary)
        self.pairs = np.unique(np.concatenate([np.array(s[:-1], np.int64) * self.size + np.array(s[1:], np.int64) for s in sequences + [s for s, _ in self.phrases]]))

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vocabulary number or -1, text index) of every word."""
        starts, ends, owner = tx.words(data, offsets, GAPS)
        h = tx.hashed(data, starts, ends, tx.LOWER_BYTE)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1), owner

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[list[tuple[int, str]], list[Found]]]]:
        """Words of each text, and of each its phrases (place, label) and covered templates."""
        number, owner = self.numbers(data, offsets)
        n = len(offsets) - 1
        words = np.bincount(owner, minlength=n)
        first = np.concatenate(([0], np.cumsum(words)))
        out: list[tuple[list, list]] = [([], []) for _ in range(n)]
        if len(number) > 1:
            a, b = number[:-1], number[1:]
            paired = (owner[1:] == owner[:-1]) & (a >= 0) & (b >= 0)
            code = (a * self.size + b)[paired]
            paired[paired] = self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code
            edge = np.diff(np.concatenate(([0], paired.view(np.int8), [0])))
            anchors: dict[int, list[tuple[int, int, int, int]]] = {}
            for start, end in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                doc = int(owner[start])
                self._run(number[start : end + 1].tolist(), int(start - first[doc]), out[doc][0], anchors.setdefault(doc, []))
            for doc, found in anchors.items():
                out[doc][1].extend(self.chains(found))
        return words, out

    def _run(self, run: list[int], base: int, phrases: list, anchors: list) -> None:
        stats = self.automaton.statistics(run)
        for j, (state, length) in enumerate(stats):
            for phrase, label in self.phrases:
                if length >= len(phrase) and run[j + 1 - len(phrase) : j + 1] == phrase:
                    phrases.append((base + j + 1 - len(phrase), label))
            if length >= ANCHOR and (j + 1 == len(stats) or stats[j + 1][1] != length + 1):  # a maximal run ends here
                anchors.extend((k, at - length, base + j + 1 - length, length) for k, at in self.automaton.where[state] if k < len(self.labels))

    def chains(self, anchors: list[tuple[int, int, int, int]]) -> list[Found]:
        """Of each template, the chains that cover enough of it, the best first, none in the place of a better one."""
        found = []
        for k in sorted({a[0] for a in anchors}):
            by_end: dict[int, deque] = {}  # template end -> chains (file end, file start, covered), those out of reach left out
            chains: list[tuple[int, int, int]] = []
            for _, at, place, length in sorted((a for a in anchors if a[0] == k), key=lambda a: (a[2], a[1])):
                best = None
                for end in range(at - GAP, at + 1):
                    line = by_end.get(end)
                    while line and line[0][0] < place - GAP:  # places only grow, so it is out of reach for good
                        line.popleft()
                    for c in line or ():
                        if place - GAP <= c[0] <= place and (best is None or c[2] > best[2]):
                            best = c
                chain = (place + length, best[1] if best else place, (best[2] if best else 0) + length)
                by_end.setdefault(at + length, deque()).append(chain)
                if chain[2] >= COVER * self.sizes[k]:
                    chains.append(chain)
            taken: list[tuple[int, int]] = []
            for end, start, covered in sorted(chains, key=lambda c: (-c[2], c[1], c[0])):
                if all(end <= a or start >= b for a, b in taken):
                    taken.append((start, end))
                    found.append(Found(self.labels[k], start, end, min(1.0, covered / self.sizes[k])))
        return found


_scanners: dict[tuple, Scanner] = {}


def licences(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the covered spans (in words) of every row.

    ``templates`` and ``phrases`` are (label, text) and (text, label) pairs; a worker builds their automaton once.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    key = tuple(templates), tuple(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scanners:
            _scanners[key] = Scanner(*key)
        scanner = _scanners[key]
        for batch in batches:
            for at, n, data, offsets in tx.chunks(batch.column("text")):
                words, found = scanner.scan(data, offsets)
                rows = []
                for phrases, covered in found:
                    base = {label for _, label in phrases}
                    places = [p for p, _ in phrases]
                    own = {f.label for f in covered}
                    spans = ",".join(f"{f.label}:{f.first}:{f.end}" for f in sorted(covered, key=lambda f: (f.first, f.label, f.end)))
                    rows.append((len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), max([f.cover for f in covered] + [1.0] * bool(base), default=0.0), spans))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
                made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                yield pa.record_batch([batch.column("doc_id").slice(at, n), pa.array(words.astype(np.int64)), *made], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op8_automaton_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
