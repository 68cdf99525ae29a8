"""License scans by conditional compression.

Around licence cues a candidate block (the cue's line, or as much of it as the longest template needs on either side) is compressed
by itself and with each template as a raw zstandard dictionary; templates are ranked by how many bytes theirs saves. Going down the
ranking through all that save any, a template is confirmed if the block holds a passage that
differs from it by at most a fifth of its words, and in none of its deciding words (numbers, names and conditions); the
differing words are reported. Confirmed passages of a document do not overlap: the better ranked one stays.

Null and empty texts hold no licence. Rows repeat as they are given, with their (perhaps null) id. Every cue of a text is looked at,
however long its line. Of passages that overlap with equal savings the first in the text stays.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidewell.llm.common import Memo, small

#: Wordings of public licences and notices.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "ISC": (
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "BSD-2-Clause": (
        "SPDX-License-Identifier: BSD-2-Clause",
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "LGPL-2.1": ("SPDX-License-Identifier: LGPL-2.1-only", "This work is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "LGPL-3.0": ("SPDX-License-Identifier: LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "AGPL-3.0": ("SPDX-License-Identifier: AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MPL-2.0": ("SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "EPL-2.0": ("SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("SPDX-License-Identifier: CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    "Unlicense": (
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "BSL-1.0": (
        "SPDX-License-Identifier: BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0.",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.',
    ),
    "Zlib": ("SPDX-License-Identifier: Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."),
    "Proprietary": ("All rights reserved. No part of this work may be reproduced without permission.",),
}
#: Words that mark a candidate, in lower case.
CUES = ("licen", "copyright", "spdx-", "creative commons", "public domain", "permission", "warrant", "redistribut", "all rights reserved", "free software", "anyone is free", "\"as is\"")
#: Words in which a passage must agree with its template.
DECIDING = frozenset("mit isc bsd apache gnu general lesser affero mozilla mpl eclipse epl boost bsl zlib unlicense cc cc0 by nc nd sa attribution noncommercial noderivatives sharealike gpl lgpl agpl not without no only".split())
LEVEL, MOST_DIFFERENT = 9, 0.2
_WORD = re.compile(r"[^\W_]+")
_CUE = re.compile("|".join(map(re.escape, CUES)), re.I)


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].casefold(), m.start(), m.end()) for m in _WORD.finditer(text)]


def deciding(word: str) -> bool:
    return word in DECIDING or any(map(str.isdigit, word))


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.text = name, text
        self.words = [w for w, _, _ in words(text)]
        self.masks: dict[str, int] = {}
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        data = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)

    def ends(self, own: list[str]) -> list[tuple[int, int]]:
        """(distance, end) of all passages near enough to the template, nearest first: approximate matching of word sequences, bit-parallel."""
        m = len(self.words)
        there = set(own)
        if sum(w not in there for w in self.words) > MOST_DIFFERENT * m:
            return []  # each word that is nowhere costs an edit
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, dist, most, out = full, 0, m, MOST_DIFFERENT * m, []
        for j, w in enumerate(own):
            eq = self.masks.get(w, 0)
            xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            dist += bool(ph & top) - bool(mh & top)
            ph, mh = ph << 1 & full, mh << 1 & full  # a passage may start anywhere
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            if dist <= most:
                out.append((dist, j + 1))
        return sorted(out)

    def find(self, own: list[str]) -> tuple[int, int] | None:
        """(end, distance) of the passage nearest to the template."""
        found = self.ends(own)
        return (found[0][1], found[0][0]) if found else None

    def compare(self, own: list[str], first: int, end: int, distance: int) -> tuple[int, list[str] | None]:
        """(start, differing words) of a passage that ends there and starts at word `first` at the earliest; no words if it is another wording."""
        lo = max(first, end - len(self.words) - distance - 1)
        ops = difflib.SequenceMatcher(None, self.words, own[lo:end], autojunk=False).get_opcodes()
        start = lo + next((j1 for tag, _, _, j1, _ in ops if tag == "equal"), 0)
        gone, new = [], []
        for tag, i1, i2, j1, j2 in ops:
            if tag != "equal":
                gone += self.words[i1:i2]
                new += own[max(start, lo + j1) : lo + j2] if lo + j2 > start else []
        if len(gone) + len(new) > 2 * MOST_DIFFERENT * len(self.words) or any(map(deciding, gone + new)):
            return start, None
        return start, [f"-{w}" for w in gone] + [f"+{w}" for w in new]

    def confirm(self, own: list[str]) -> list[tuple[int, int, list[str], int]]:
        """(start, end, differing words, distance) of its passages in a list of words, nearest first. They do not overlap."""
        taken: list[tuple[int, int]] = []  # passages in order, those of another wording too
        out = []
        for distance, end in self.ends(own):
            i = bisect.bisect_left(taken, (end,))  # the first that starts there or later
            first = taken[i - 1][1] if i else 0
            if len(self.words) - (end - first) > MOST_DIFFERENT * len(self.words):
                continue  # what lies before it leaves too few words
            start, words_ = self.compare(own, first, end, distance)
            taken.insert(i, (start, end))
            if words_ is not None:
                out.append((start, end, words_, distance))
        return out


class Scanner:
    def __init__(self):
        self.templates = [Template(name, text) for name, texts in TEMPLATES.items() for text in texts]
        self.reach = max(len(t.words) for t in self.templates) + 20
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.cues = ahocorasick.Automaton()
        for c in CUES:
            self.cues.add_word(c, c)
        self.cues.make_automaton()
        self.memo = Memo(self.block, 20_000)

    def block(self, text: str) -> list[tuple]:
        """(start, end, licence, saved share, differing words) of a block, best first."""
        own = words(text)
        only = [w for w, _, _ in own]
        raw = text.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        ranked = sorted(((alone - len(t.packer.compress(raw)), i) for i, t in enumerate(self.templates)), key=lambda x: (-x[0], x[1]))
        nearest, more = [], []
        for rank, (saved, i) in enumerate(ranked):
            if saved > 0:
                t = self.templates[i]
                found = [(d, rank, own[a][1], own[b - 1][2], t.name, round(saved / alone, 4), " ".join(w)) for a, b, w, d in t.confirm(only)]
                nearest += found[:1]
                more += found[1:]
        out: list[tuple] = []
        # the nearest passage of each template, best template first, and then what else is like one
        for _, _, start, end, *rest in nearest + sorted(more):
            if all(end <= a or b <= start for a, b, *_ in out):
                out.append((start, end, *rest))
        return out

    def near(self, text: str, lo: int, hi: int, cue: int) -> list[tuple]:
        """Passages of the block text[lo:hi]; what it may have cut off is left to its own cue."""
        least = 2 * self.reach * (lo > 0 and text[lo - 1] != "\n")
        most = hi - lo - 2 * self.reach * (hi < len(text) and text[hi] != "\n")
        return [f for f in self.memo[text[lo:hi]] if least <= f[0] and f[1] <= most or f[0] <= cue - lo < f[1]]

    def scan(self, text: str) -> list[tuple]:
        if next(self.cues.iter(text.lower()), None) is None:
            return []
        found: dict[tuple, tuple] = {}
        seen = -1
        for m in _CUE.finditer(text):
            if m.start() < seen:
                continue
            # as many words around the cue as the longest template has: first of its line alone, and then of what is around it
            first, end = max(0, m.start() - 8 * self.reach), min(len(text), m.end() + 8 * self.reach)
            lo, hi = text.rfind("\n", first, m.start()) + 1 or first, text.find("\n", m.end(), end)
            hi = end if hi < 0 else hi
            at, own = lo, self.near(text, lo, hi, m.start())
            if (not own or any(b - a > 400 for a, b, *_ in own)) and (wide := self.near(text, first, end, m.start())):
                at, own = first, wide
            for a, b, *rest in own:
                found.setdefault((at + a, at + b), (at + a, at + b, *rest))
                if at + a <= m.start() < at + b:
                    seen = at + b
        out: list[tuple] = []
        for f in sorted(found.values(), key=lambda f: (-f[3], f[0], f[1])):
            if all(f[1] <= a or b <= f[0] for a, b, *_ in out):
                out.append(f)
        return sorted(out)


def license_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage: id, license, start, end (code points), saved (share of the block's compressed size), differences. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in small(batches):
            row, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = scanner.scan(text) if text else []
                row += [i] * len(own)
                found += own
            col = lambda i, kind: pa.array([f[i] for f in found], kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), col(2, pa.string()), col(0, pa.int64()), col(1, pa.int64()), col(3, pa.float64()), col(4, pa.string())], names=["id", "license", "start", "end", "saved", "differences"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, license string, start long, end long, saved double, differences string")
