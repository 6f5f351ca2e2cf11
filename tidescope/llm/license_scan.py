"""License scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Units are the whole text, its paragraphs (parted by blank lines), its lines, and windows of its words as long as a template, wherever a line or
paragraph begins. A unit's A-Z become a-z and every run of bytes other
than letters and digits of ASCII becomes one space. With threshold t, a unit of n distinct bigrams can only match a template of m when n lies in
[t m / (2 - t), (2 - t) m / t]: units outside all bounds are left before their bigrams are compared, and templates outside a unit's
bounds are no candidates. A template's windows start at bigrams of its own, in texts that hold at least t m / (2 - t) of its distinct bigrams; of windows that overlap
the best is reported, of equal ones the first. No rows are exchanged.

Templates are rows of (identifier, text): :data:`TEMPLATES`, or the caller's own (:func:`templates` reads them from a table, whole licence
texts included).

Defined cases: null and empty texts have no units; units of fewer than two words match nothing; equal units of one kind in a document count
once; every template that a unit reaches is reported, ties too; a null doc_id is reported as null; empty tables give an empty result. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescope.llm.common import slices

#: The wording of public licence notices, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
THRESHOLD = 0.8


#: A-Z become a-z; every byte that is no letter or digit of ASCII becomes a space.
NORMAL = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))
PARAGRAPHS = re.compile(r"\n[ \t]*\n")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(NORMAL).split()


def units(text: str) -> Iterator[tuple[str, str]]:
    """The whole text, its paragraphs and its lines where there are several, each unit of a kind once."""
    yield "text", text
    for kind, parts in (("paragraph", PARAGRAPHS.split(text)), ("line", text.split("\n"))):
        if len(parts) > 1:
            yield from ((kind, u) for u in dict.fromkeys(parts))


class Matcher:
    """Templates by bigram, and the sizes that they allow."""

    def __init__(self, rows: tuple, threshold: float):
        self.rows, self.threshold, self.ratio = rows, threshold, threshold / (2 - threshold)
        grams = [set(pairwise(words(text))) for _, text in rows]
        self.sizes = [len(g) for g in grams]
        self.low, self.high = self.ratio * min(self.sizes), max(self.sizes) / self.ratio
        self.lengths = [max(1, len(words(text)) - 1) for _, text in rows]
        self.by_gram: dict[tuple, list[int]] = {}
        for i, own in enumerate(grams):
            for g in own:
                self.by_gram.setdefault(g, []).append(i)

    def match(self, unit: str) -> Iterator[tuple[int, float]]:
        if len(unit) < 2 * self.low:  # a bigram takes two more characters at least
            return
        own = words(unit)
        if len(own) <= self.low:
            return
        grams = set(pairwise(own))
        n = len(grams)
        if not self.low <= n <= self.high:
            return
        both = Counter(i for g in grams if g in self.by_gram for i in self.by_gram[g])
        for i, k in sorted(both.items()):
            m = self.sizes[i]
            if self.ratio * m <= n <= m / self.ratio and (dice := 2 * k / (n + m)) >= self.threshold:
                yield i, dice


    def windows(self, own: list[bytes]) -> Iterator[tuple[int, int, int, float]]:
        """(template, first word, end, dice) of the best windows of a text's words."""
        places: dict[int, list[int]] = {}
        by_gram = self.by_gram
        for p, g in enumerate(pairwise(own)):
            if g in by_gram:
                for i in by_gram[g]:
                    places.setdefault(i, []).append(p)
        for i, found in sorted(places.items()):
            m, length = self.sizes[i], self.lengths[i]
            if len(found) < self.ratio * m:
                continue
            good, held, end = [], Counter(), 0  # held: the template's bigrams in the window
            for k, start in enumerate(found):
                while end < len(found) and found[end] < start + length:
                    held[own[found[end]], own[found[end] + 1]] += 1
                    end += 1
                both = len(held)
                if 2 * both >= self.threshold * (both + m):
                    n = len(set(pairwise(own[start : start + length + 1])))
                    if (dice := 2 * both / (n + m)) >= self.threshold:
                        good.append((dice, -start))
                gone = own[start], own[start + 1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
            for k, (dice, back) in enumerate(good):
                near = []
                for step in (1, -1):
                    j = k + step
                    while 0 <= j < len(good) and abs(good[j][1] - back) < length:
                        near.append(good[j])
                        j += step
                if all(other < (dice, back) for other in near):
                    yield i, -back, min(len(own), -back + length + 1), dice


def templates(table: DataFrame) -> tuple:
    """Templates from a table (license_id, text): as many as there are licences."""
    return tuple((r["license_id"], r["text"]) for r in table.select("license_id", "text").filter("text is not null").orderBy("license_id", "text").collect() if len(words(r["text"])) > 1)


def scan(docs: DataFrame, threshold: float = THRESHOLD, rows: tuple = TEMPLATES) -> DataFrame:
    """(doc_id, kind, unit_sha256, license_id, template, dice) for every unit at or over ``threshold``; ``rows``: (identifier, text)."""
    kinds = [("doc_id", pa.int64()), ("kind", pa.string()), ("unit_sha256", pa.string()), ("license_id", pa.string()), ("template", pa.int32()), ("dice", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rows, threshold)
        for batch in slices(batches):
            out = []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for kind, unit in units(text) if text else ():
                    for i, dice in matcher.match(unit):
                        sha = hashlib.sha256(unit.encode("utf-8", "replace")).hexdigest()
                        out.append({"doc_id": d, "kind": kind, "unit_sha256": sha, "license_id": rows[i][0], "template": i, "dice": dice})
                own = words(text) if text else []
                seen = set()
                for i, start, end, dice in matcher.windows(own):
                    sha = hashlib.sha256(b" ".join(own[start:end])).hexdigest()
                    if (i, sha) not in seen:
                        seen.add((i, sha))
                        out.append({"doc_id": d, "kind": "window", "unit_sha256": sha, "license_id": rows[i][0], "template": i, "dice": dice})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, kind string, unit_sha256 string, license_id string, template int, dice double")
