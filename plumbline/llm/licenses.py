"""Operator 9: licence scans by Dice coefficient over word bigrams.

A template and a passage are compared by their sets of normalised word bigrams.  A passage
is a run of consecutive words, wherever it begins and ends, across lines too.  Dice can reach
``SIMILARITY`` only if the sizes of both sets lie within a factor of each other, so a template
meets only runs inside its size bounds, and only where enough different bigrams of it lie
close together.  A run is at most as many words longer than its template as its set may be
larger.  The work grows with the text's words, however they repeat.

Edge cases: null, empty and blank texts have no licence; a passage of one word has no bigram
and matches nothing; ties go to the first template by name; repeated rows give repeated
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, each_batch, text_column, texts

SIMILARITY = 0.8

#: Licence notices and texts (fixed values): several templates may stand for one licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
}

_WORD = re.compile(r"[a-z0-9]+")


#: Spellings that count as one (fixed values).
_SPELLINGS = {"licence": "license", "licenced": "licensed", "licences": "licenses"}


def _words(text: str) -> list[tuple[str, int, int]]:
    """Normalised words (lower case, letters and digits) and where they begin and end."""
    return [(_SPELLINGS.get(m[0], m[0]), m.start(), m.end()) for m in _WORD.finditer(_lower(text))]


def _lower(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def bigrams(text: str) -> list[tuple[str, str]]:
    """Word bigrams in order, repeats included."""
    ws = [w for w, _, _ in _words(text)]
    return list(zip(ws, ws[1:], strict=False))


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, similarity: float = SIMILARITY):
        self.similarity = similarity
        grams = [(name, bigrams(t)) for name, ts in sorted(templates.items()) for t in ts]
        self.known = [(name, frozenset(g)) for name, g in grams]
        factor = (2 - similarity) / similarity
        #: Least and greatest size of a set that can reach the similarity, and positions of the longest run.
        self.bounds = [(len(set(g)) / factor - 1e-9, len(set(g)) * factor + 1e-9, int(len(g) * factor + 1e-9)) for _, g in grams]
        self.owners: dict[tuple[str, str], list[int]] = {}
        for k, (_, b) in enumerate(self.known):
            for x in b:
                self.owners.setdefault(x, []).append(k)

    def _starts(self, hits: list[int], grams: list[tuple[str, str]], low: float, reach: int) -> Iterator[int]:
        """Hits from which at least ``low`` different bigrams of the template lie within reach."""
        inside: dict[tuple[str, str], int] = {}
        to = 0
        for at in hits:
            while to < len(hits) and hits[to] < at + reach:
                inside[grams[hits[to]]] = inside.get(grams[hits[to]], 0) + 1
                to += 1
            if len(inside) >= low:
                yield at
            inside[grams[at]] -= 1
            if not inside[grams[at]]:
                del inside[grams[at]]

    def _best_from(self, at: int, grams: list[tuple[str, str]], k: int) -> tuple[float, int]:
        """The highest Dice of a run that begins at a bigram, and the run's last bigram."""
        _, b = self.known[k]
        low, high, reach = self.bounds[k]
        seen: set[tuple[str, str]] = set()
        common, best, last = 0, 0.0, at
        for to in range(at, min(at + reach, len(grams))):
            x = grams[to]
            if x not in seen:
                seen.add(x)
                common += x in b
            if len(seen) > high:
                break
            if x in b and len(seen) >= low and (d := 2 * common / (len(seen) + len(b))) > best:
                best, last = d, to
        return best, last

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """Matches ``(first character, character after the last, licence, Dice)``, the best ones that don't overlap, in order."""
        words = _words(text)
        grams = [(a[0], b[0]) for a, b in zip(words, words[1:], strict=False)]
        hits: dict[int, list[int]] = {}
        for at, x in enumerate(grams):
            for k in self.owners.get(x, ()):
                hits.setdefault(k, []).append(at)
        found = []
        for k, places in hits.items():
            low, _, reach = self.bounds[k]
            for at in self._starts(places, grams, low, reach):
                d, last = self._best_from(at, grams, k)
                if d >= self.similarity:
                    found.append((words[at][1], words[last + 1][2], self.known[k][0], d))
        out: list[tuple[int, int, str, float]] = []
        for m in sorted(found, key=lambda m: (-m[3], m[2], m[0], m[1])):
            i = bisect_left(out, m[:1])
            if (i == 0 or out[i - 1][1] <= m[0]) and (i == len(out) or m[1] <= out[i][0]):
                out.insert(i, m)
        return out


def scan(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, license, dice, n_licenses, matches``: the best match of every document, null without one.

    A match has the characters from ``start`` to before ``end`` of the text.
    """
    fields = "start: int, end: int, license: string, dice: double"
    schema = f"doc_id bigint, license string, dice double, n_licenses bigint, matches array<struct<{fields}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(similarity=similarity)
        for b in each_batch(batches):
            found = [scanner.scan(t) if t else [] for t in texts(b)]
            best = [min(m, key=lambda x: (-x[3], x[2])) if m else (0, 0, None, None) for m in found]
            row = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("dice", pa.float64())])
            names = ("start", "end", "license", "dice")
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([x[2] for x in best], pa.string()),
                    pa.array([x[3] for x in best], pa.float64()),
                    pa.array([len({x[2] for x in m}) for m in found], pa.int64()),
                    pa.array([[dict(zip(names, x, strict=True)) for x in m] for m in found], pa.list_(row)),
                ],
                names=["doc_id", "license", "dice", "n_licenses", "matches"],
            )

    return arrow_map(text_column(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
