"""License scans by conditional compression.

Every word that names licensing lines the text up with each template that has this word: the words where the template
would stand are a candidate block. A block is compressed on its own and with its template as zstandard raw dictionary.
Those that save too little go; the others are ranked by how many bytes that saves, and confirmed, or refused, by the exact
differences in wording. Of confirmed ones that overlap, that which saves the most bytes of their common words stays; only where
these are equal, that with the fewest differences. Each license of an SPDX expression is judged on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.texts import held, slices, whole_text

# Wordings of public licenses and notices, by SPDX name or notice.
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_MIT_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License 2.0.",
        "Apache License Version 2.0, January 2004",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        _MIT.strip(),
        _MIT + _MIT_AS_IS,
        "Distributed under the MIT License.",
        "The MIT License (MIT)",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", _BSD + _BSD_AS_IS),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", _BSD + _BSD_NAMES + _BSD_AS_IS),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies.",
    ),
    "Zlib": (
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions:",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License, Version 1.0."),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one "
        "at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "All-rights-reserved": ("All rights reserved.",),
}
#: Every wording has a word with one of these in it, by which it is lined up with a text.
CUES = ("licen", "copyright", "reserved", "permission", "redistribut", "domain", "cc0", "cc by", "commons", "mpl")

WORD = re.compile(r"[\w.+-]*\w", re.UNICODE)
SPDX = "SPDX-License-Identifier"
#: Operators of SPDX expressions, and endings of names of licenses by version.
OPERATORS = ("or", "and", "with")
ENDINGS = ("-only", "-or-later")
STOPS = re.compile(r"[/.,:;!?)\"']*")
#: A word that names licensing; "cc" stands for "cc by".
CUE_WORD = re.compile("|".join(c.split(" ")[0] + ("$" if " " in c else "") for c in CUES))


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def overlapping(hits: list[tuple]) -> Iterator[list[tuple]]:
    """``hits``, (first word, end, ...), in groups: those that overlap, or are linked by others that do."""
    group: list[tuple] = []
    stop = 0
    for hit in sorted(hits):
        if group and hit[0] >= stop:
            yield group
            group = []
        group.append(hit)
        stop = max(stop, hit[1]) if len(group) > 1 else hit[1]
    if group:
        yield group


class Scanner:
    """Ranks and confirms templates. A confirmed template has at least ``least`` of its words, in order, in the block, with
    at most as many other words put in between as may be missing, and every word with a digit among them (such words tell
    licenses apart). Templates of up to ``short`` words are confirmed word for word."""

    def __init__(self, level: int = 3, least: float = 0.9, saving: float = 0.25, short: int = 12):
        self.least, self.saving, self.short = least, saving, short
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.templates: list[tuple[str, list[str], zstandard.ZstdCompressor]] = []
        #: Where each cue word stands: (template, place in it).
        self.places: dict[str, list[tuple[int, int]]] = {}
        for name, wordings in TEMPLATES.items():
            names = (name, *(name + e for e in ENDINGS)) if "GPL-" in name else (name,)
            for wording in (*wordings, *(f"{SPDX}: {n}" for n in names)):
                words = words_of(wording)
                shared = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                shared.precompute_compress(level=level)
                packed = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=False, write_dict_id=False)
                for at, word in enumerate(words):
                    if CUE_WORD.search(word):
                        self.places.setdefault(word, []).append((len(self.templates), at))
                self.templates.append((name, words, packed))

    def blocks(self, words: list[str]) -> set[tuple[int, int, int]]:
        """(template, first word, end) of all candidate blocks: where a template would stand, and a fifth of its words
        more on both sides for a long one. Cues of one notice that line it up at almost the same place give one block."""
        out = set()
        last: dict[int, int] = {}
        for i, word in enumerate(words):
            for k, at in self.places.get(word, ()):
                size = len(self.templates[k][1])
                start = i - at
                if size <= self.short:
                    if 0 <= start <= len(words) - size:
                        out.add((k, start, start + size))
                    continue
                slack = 2 + size // 5
                if k in last and abs(start - last[k]) <= size // 20:
                    continue
                if start + size + slack > 0:
                    last[k] = start
                    out.add((k, max(0, start - slack), min(len(words), start + size + slack)))
        return out

    def candidates(self, words: list[str]) -> Iterator[tuple[int, int, list[str]]]:
        """(template, place of the first word, words) of all blocks, and of each further license of SPDX expressions, which
        stands for a tag with its name."""
        for k, a, b in self.blocks(words):
            yield k, a, words[a:b]
        tag = SPDX.lower()
        for i, word in enumerate(words):
            if word == tag:
                j = i + 3
                while j < len(words) and words[j - 1] in OPERATORS:
                    for k, _ in self.places[tag]:
                        yield k, j - 1, [tag, words[j]]
                    j += 2

    def confirm(self, template: list[str], words: list[str]) -> tuple[int, int, list[str], list[str]] | None:
        """(first word, end, missing words, added words) of the template in a block, or nothing."""
        found = [b for b in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if b.size]
        # Words before and after the notice that the template happens to have too are no part of it.
        while len(found) > 1 and found[0].size < found[1].b - found[0].b - found[0].size:
            found.pop(0)
        while len(found) > 1 and found[-1].size < found[-1].b - found[-2].b - found[-2].size:
            found.pop()
        if not found:
            return None
        met = {i for b in found for i in range(b.a, b.a + b.size)}
        taken = {i for b in found for i in range(b.b, b.b + b.size)}
        start, end = found[0].b, found[-1].b + found[-1].size
        missing = [w for i, w in enumerate(template) if i not in met]
        added = [words[i] for i in range(start, end) if i not in taken]
        most = 0 if len(template) <= self.short else (1 - self.least) * len(template)
        if len(missing) > most or len(added) > most or any(c.isdigit() for w in missing for c in w):
            return None
        return start, end, missing, added

    def scan(self, text: str) -> list[tuple[int, int, str, float, str, str]]:
        """(start, length in code points, license, share of bytes saved, missing words, added words), in order of place."""
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        alone: dict[bytes, int] = {}
        ranked = []
        for k, a, block in self.candidates(words):
            data = " ".join(block).encode()
            if data not in alone:
                alone[data] = len(self.plain.compress(data))
            whole, given = alone[data], len(self.templates[k][2].compress(data))
            if whole - given >= self.saving * whole:
                ranked.append((given - whole, a, k, block, round(1 - given / whole, 6)))
        confirmed = []
        for _, a, k, block, share in sorted(ranked):
            if hit := self.confirm(self.templates[k][1], block):
                start, end, missing, added = hit
                # A further license of an expression is that one word; its tag stands elsewhere.
                start += words[a] in OPERATORS and block[0] == SPDX.lower()
                confirmed.append((a + start, a + end, k, share, missing, added))
        found: list[tuple[int, int, str, float, str, str]] = []
        for rivals in overlapping(confirmed):
            # Only savings on the same words compare.
            data = " ".join(words[min(c[0] for c in rivals) : max(c[1] for c in rivals)]).encode()
            order = [(len(self.templates[c[2]][2].compress(data)) if len(rivals) > 1 else 0, len(c[4]) + len(c[5]), -len(self.templates[c[2]][1]), c) for c in rivals]
            taken: list[tuple[int, int]] = []
            for *_, (start, end, k, share, missing, added) in sorted(order):
                if all(end <= x or start >= y for x, y in taken):
                    taken.append((start, end))
                    at, stop = spans[start][0], STOPS.match(text, spans[end - 1][1]).end()
                    found.append((at, stop - at, self.templates[k][0], share, " ".join(missing), " ".join(added)))
        return sorted(found)


def _scanner() -> Scanner:
    store = held("licenses")
    return store.get("scanner") or store.setdefault("scanner", Scanner())


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per confirmed notice: ``doc_id, start, length`` (code points), ``license, saving, missing, added``.

    Texts without any cue are left out before Python sees them; all others are scanned whole, at every cue and for every
    template, without a cap. Null and empty texts have no notice, a null id stays null, repeated rows are scanned each,
    other columns stay behind, and an empty table gives no rows. No shuffle."""
    lower = F.lower("text")
    cued = F.lit(False)
    for cue in CUES:
        cued = cued | F.contains(lower, F.lit(cue))
    names = ["doc_id", "start", "length", "license", "saving", "missing", "added"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                rows = [(i, *hit) for i, t in zip(ids, texts, strict=True) for hit in _scanner().scan(t)]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, start long, length long, license string, saving double, missing string, added string"
    return whole_text(docs, id_col, text_col).filter(cued).mapInArrow(run, schema)
