"""Licence scans by patience alignment.

A text and a licence template are aligned on the words that occur once in both: their
longest increasing subsequence are anchors, matches are extended from them, and the
gaps between them are aligned in the same way, where other words are unique.  The
share of the template's words that are aligned is its coverage.

Whole texts are scanned.  A template can only be covered where its words are, so a
text is first aligned in windows around the template word that it has least often; a
text that lacks too many of a template's words cannot reach the coverage and is passed
over.  Between the places found, the longest common subsequence with the template says
whether it is covered with longer insertions: their length has no bound.  A place of
which words are missing at a side grows there until nothing more aligns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.llm.common import ASCII_LOWER_BYTES, map_batches, text_bytes

MIN_PERCENT = 80

# Part of a template's length that a window is wider on each side.
SLACK = 4

WORD = re.compile(rb"[0-9a-z\x80-\xff]+(?:\.[0-9]+)*")

# Notices that the licences ask to be put into works.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
        "more details."
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version. This program is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details."
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version. This library is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General "
        "Public License for more details."
    ),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General "
        "Public License for more details."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General "
        "Public License for more details."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to "
        "copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work."
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
}


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.translate(ASCII_LOWER_BYTES))


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence with increasing second numbers, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for number, (_, value) in enumerate(pairs):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            piles.append(number)
        else:
            tops[pile], piles[pile] = value, number
        back.append(piles[pile - 1] if pile else -1)
    chain, at = [], piles[-1] if piles else -1
    while at >= 0:
        chain.append(pairs[at])
        at = back[at]
    return chain[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of places with equal words, increasing in both."""
    pairs: list[tuple[int, int]] = []
    ranges = [(0, len(text), 0, len(template))]
    while ranges:
        a, b, c, d = ranges.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        once = _once(text, a, b)
        there = _once(template, c, d)
        common = sorted((once[w], there[w]) for w in once.keys() & there.keys())
        anchors = increasing(common)
        if not anchors:
            continue
        for x, y in anchors:
            ranges.append((a, x, c, y))
            pairs.append((x, y))
            a, c = x + 1, y + 1
        ranges.append((a, b, c, d))
    return sorted(pairs)


def _once(words: list[bytes], start: int, end: int) -> dict[bytes, int]:
    seen: dict[bytes, int] = {}
    for at in range(start, end):
        seen[words[at]] = -1 if words[at] in seen else at
    return {word: at for word, at in seen.items() if at >= 0}


def covered(words: list[bytes], masks: dict[bytes, int], size: int, places: range, need: int) -> int:
    """How many of ``places`` it takes, in order, until ``need`` words of the template are
    in a common subsequence with it; 0 if all are too few.

    Bit-parallel: a row's zeros are the template's words that lengthen the subsequence."""
    row = full = (1 << size) - 1
    for number, at in enumerate(places):
        mask = masks.get(words[at])
        if mask is None:
            continue
        hit = row & mask
        row = (row + hit | row & ~mask) & full
        if hit and size - row.bit_count() >= need:
            return number + 1
    return 0


def common(words: list[bytes], start: int, end: int, masks: dict[bytes, int], size: int) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence; places in words count from ``start``."""
    own = [at for at in range(start, end) if words[at] in masks]
    # The rows of covered(), walked back from the last: a number for each word.
    row = full = (1 << size) - 1
    rows = [row]
    for at in own:
        hit = row & masks[words[at]]
        row = (row + hit | row & ~masks[words[at]]) & full
        rows.append(row)

    def length(i: int, n: int) -> int:
        return n - (rows[i] & (1 << n) - 1).bit_count()

    pairs, i, n = [], len(own), size
    while i and n:
        if masks[words[own[i - 1]]] >> n - 1 & 1:
            i, n = i - 1, n - 1
            pairs.append((own[i] - start, n))
        elif length(i - 1, n) >= length(i, n - 1):
            i -= 1
        else:
            n -= 1
    return pairs[::-1]


class Template:
    def __init__(self, name: str, text: str) -> None:
        self.name = name
        self.words = words_of(text.encode())
        self.counts = Counter(self.words)
        self.places = {w: [n for n, x in enumerate(self.words) if x == w] for w in self.counts}
        size = len(self.words)
        self.masks = {w: sum(1 << n for n in at) for w, at in self.places.items()}
        self.mirrored = {w: sum(1 << size - 1 - n for n in at) for w, at in self.places.items()}

    def scan(self, words: list[bytes], counts: Counter, percent: int) -> Iterator[tuple]:
        """(first word, end, words aligned) of every place that covers the template."""
        reachable = sum(min(n, counts[w]) for w, n in self.counts.items())
        if 100 * reachable < percent * len(self.words):
            return
        near, last = list(self.near(words, counts, percent)), 0
        ends = [*(start for start, *_ in near[1:]), len(words)]
        for place, end in zip(near, ends):
            place = self.grown(words, place, last, end)
            yield from self.far(words, last, place[0], percent)
            yield place
            last = place[1]
        yield from self.far(words, last, len(words), percent)

    def far(self, words: list[bytes], low: int, high: int, percent: int) -> Iterator[tuple]:
        """Places in low … high with insertions of any length, each as short as can be."""
        size = len(self.words)
        need = max(1, -(-percent * size // 100))
        while taken := covered(words, self.masks, size, range(low, high), need):
            end = low + taken
            back = covered(words, self.mirrored, size, range(end - 1, low - 1, -1), need)
            pairs = align(words[end - back : end], self.words)
            if len(pairs) < need:
                # Where repeated words hide it from the anchors.
                pairs = common(words, end - back, end, self.masks, size)
            start = end - back + pairs[0][0]
            place = self.grown(words, (start, end - back + pairs[-1][0] + 1, len(pairs)), low, high)
            yield place
            low = place[1]

    def grown(self, words: list[bytes], place: tuple, low: int, high: int) -> tuple:
        """The place within low … high, wider as long as a template's length beyond its
        sides has more words of the template."""
        start, end, aligned = place
        step = len(self.words) + len(self.words) // SLACK + 1
        while aligned < len(self.words):
            first, last = max(low, start - step), min(high, end + step)
            pairs = align(words[first:last], self.words)
            if len(pairs) <= aligned:
                break
            start, end, aligned = first + pairs[0][0], first + pairs[-1][0] + 1, len(pairs)
        return start, end, aligned

    def near(self, words: list[bytes], counts: Counter, percent: int) -> Iterator[tuple]:
        """Places in windows of the template's length and a part more."""
        # Words whose absence would still leave enough must not be the only seeds.
        spare = len(self.words) - -(-percent * len(self.words) // 100)
        seeds, skipped = [], 0
        for word in sorted((w for w in self.counts), key=lambda w: (counts[w], w)):
            seeds.append(word)
            skipped += self.counts[word]
            if skipped > spare:
                break
        wide = len(self.words) // SLACK + 1
        wanted = {word: self.places[word] for word in seeds}
        done = 0
        for at, word in enumerate(words):
            if at < done or word not in wanted:
                continue
            best = None
            for place in wanted[word]:
                low = max(done, at - place - wide)
                high = min(len(words), at - place + len(self.words) + wide)
                pairs = align(words[low:high], self.words)
                if 100 * len(pairs) >= percent * len(self.words):
                    found = (low + pairs[0][0], low + pairs[-1][0] + 1, len(pairs))
                    if best is None or found[2] > best[2]:
                        best = found
            if best:
                yield best
                done = max(at + 1, best[1])


SCHEMA = (
    "doc_id long, license string, first_word long, end_word long, n_aligned long, coverage double"
)


def _scan_task(templates: dict[str, str], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(name, text) for name, text in templates.items()]
        known = [template for template in known if template.words]
        vocabulary = {word for template in known for word in template.counts}
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        names = ["doc_id", "license", "first_word", "end_word", "n_aligned", "coverage"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                counts = Counter(w for w in words if w in vocabulary)
                for template in known:
                    for start, end, aligned in template.scan(words, counts, percent):
                        share = aligned / len(template.words)
                        rows.append((doc_id, template.name, start, end, aligned, share))
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds)], names
            )

    return run


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    percent: int = MIN_PERCENT,
    text: str = "text",
) -> DataFrame:
    """Where documents cover a licence template by ``percent`` of its words or more.

    Returns (doc_id, license, first_word, end_word, n_aligned, coverage), places in
    words.  Places of one template do not overlap; one place may cover several
    templates.  Null and empty texts have none, repeated rows have theirs each; other
    columns are ignored.  ``templates`` go to every task: they are a fixed list.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("content"))
    return map_batches(rows, _scan_task(templates or TEMPLATES, percent), SCHEMA)
