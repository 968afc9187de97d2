"""Licence notices and texts in documents, by Dice coefficient over word bigrams.

Units of a text are its lines, its paragraphs of several lines (parted by an
empty line) and, if it has several paragraphs, the whole.  Units and templates
are lower-cased, ASCII punctuation becomes a space, and the sets of adjacent word
pairs are compared.  A coefficient of at least ``t`` needs set sizes within a
factor of ``t / (2 - t)``, so only templates in that range are compared, and a unit
smaller than the smallest of those bounds is left before its pairs are built.

Defined cases: null or empty texts have no match.  Units and templates of fewer
than two words have no pair and match nothing.  A unit may match several
templates; each is a row.  Repeated rows give repeated rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import in_arrow, slices

THRESHOLD = 0.8
_MARKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

# fixed texts: the notices and short licence texts that a scan looks for
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_MARKS).split()


def pairs_of(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


def units(text: str) -> Iterator[tuple[str, int, str]]:
    """(kind, number of its first line, text)."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        yield "line", i, line
    paragraphs = text.split("\n\n")
    at = 0
    for p in paragraphs:
        if "\n" in p:
            yield "paragraph", at, p
        at += p.count("\n") + 2
    if len(paragraphs) > 1:
        yield "text", 0, text


class Templates:
    """Templates in order of the size of their pair sets."""

    def __init__(self, texts: Mapping[str, str], threshold: float):
        made = [(pairs_of(words_of(text)), name) for name, text in texts.items()]
        self.items = sorted(((len(pairs), name, pairs) for pairs, name in made if pairs), key=lambda t: t[:2])
        self.sizes = [size for size, _, _ in self.items]
        self.threshold = threshold
        self.reach = threshold / (2 - threshold)
        self.least = self.sizes[0] * self.reach if self.sizes else float("inf")

    def match(self, unit: str) -> list[tuple[str, float]]:
        words = words_of(unit)
        if len(words) - 1 < self.least:
            return []
        pairs = pairs_of(words)
        n = len(pairs)
        low = bisect_left(self.sizes, n * self.reach - 1e-9)
        high = bisect_right(self.sizes, n / self.reach + 1e-9)
        out = []
        for size, name, template in self.items[low:high]:
            dice = 2 * len(pairs & template) / (n + size)
            if dice >= self.threshold:
                out.append((name, dice))
        return out


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, unit, line, license, dice): every unit and template that agree."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    texts = dict(templates)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts, threshold)
        for batch in slices(batches):
            rows = [
                (doc_id, kind, line, name, round(dice, 6))
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                if text
                for kind, line, unit in units(text)
                for name, dice in known.match(unit)
            ]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "unit", "line", "license", "dice"]
                )

    return in_arrow(source, work, "doc_id long, unit string, line long, license string, dice double")


def scan_sql(templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows over ``documents``, for DuckDB."""
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in templates.items())
    clean = "list_filter(string_split_regex(regexp_replace(lower({}), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]', ' ', 'g'), ' +'), lambda w: w <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""WITH templates(license, body) AS (VALUES {quoted}),
t AS (SELECT license, {pairs} AS p FROM (SELECT license, {clean.format("body")} AS w FROM templates)),
lines AS (SELECT doc_id, 'line' AS unit, unnest(range(len(l))) AS line, unnest(l) AS body
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
paragraphs AS (SELECT doc_id, unnest(p) AS body, unnest(range(1, len(p) + 1)) AS i, p
  FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents)),
units AS (
  SELECT doc_id, unit, line, body FROM lines
  UNION ALL SELECT doc_id, 'paragraph',
    coalesce(list_sum(list_transform(p[1:i - 1], lambda x: len(x) - len(replace(x, chr(10), '')) + 2)), 0)::BIGINT, body
  FROM paragraphs WHERE contains(body, chr(10))
  UNION ALL SELECT doc_id, 'text', 0, text FROM documents WHERE contains(text, chr(10) || chr(10))),
u AS (SELECT doc_id, unit, line, {pairs} AS p FROM (SELECT doc_id, unit, line, {clean.format("body")} AS w FROM units) WHERE len(w) > 1)
SELECT doc_id, unit, line::BIGINT AS line, license,
  round(2.0::DOUBLE * len(list_intersect(u.p, t.p)) / (len(u.p) + len(t.p)), 6) AS dice
FROM u, t WHERE len(t.p) > 0 AND 2.0::DOUBLE * len(list_intersect(u.p, t.p)) / (len(u.p) + len(t.p)) >= {threshold}"""
