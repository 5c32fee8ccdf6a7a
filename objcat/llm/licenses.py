"""License scans: texts aligned with license notices by patience alignment."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objcat.llm.common import slices, text_of, texts

# The notices that licenses ask to be quoted, or by which they are named.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of the pairs whose parts both rise."""
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    tails: list[int] = []  # smallest end of a rising run of each length
    at: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, b) in enumerate(pairs):
        length = bisect_left(tails, b)
        back[n] = at[length - 1] if length else -1
        if length == len(tails):
            tails.append(b)
            at.append(n)
        else:
            tails[length], at[length] = b, n
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def aligned(text: list[bytes], notice: list[bytes]) -> list[tuple[int, int]]:
    """(place in text, place in notice) of the words that patience alignment matches, in order.

    Equal beginnings and ends match. Between them, words that both have exactly once anchor the longest rising
    sequence, and the gaps between anchors are aligned alike. A gap without such words takes the longest
    rising sequence over all its equal words.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(notice))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == notice[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == notice[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        mine, theirs = Counter(text[a:b]), Counter(notice[c:d])
        where = {w: i for i, w in enumerate(text[a:b], a) if mine[w] == 1}
        anchors = increasing([(where[w], j) for j, w in enumerate(notice[c:d], c) if theirs[w] == 1 and w in where])
        if anchors:
            out += anchors
            for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
                gaps.append((i + 1, k, j + 1, m))
        else:
            places: dict[bytes, list[int]] = {}
            for i in range(a, b):
                places.setdefault(text[i], []).append(i)
            out += increasing([(i, j) for j in range(c, d) for i in places.get(notice[j], ())])
    return sorted(out)


class Notices:
    """The notices as words, and what a text must have for each to be found in it."""

    def __init__(self, notices: Mapping[str, str], threshold: float):
        self.threshold = threshold
        self.names = list(notices)
        self.words = [t.encode().translate(_FOLD).split() for t in notices.values()]
        if not all(self.words):
            raise ValueError("a notice has no words")
        self.numbers = {w: i + 1 for i, w in enumerate(sorted({w for t in self.words for w in t}))}
        self.counts = np.zeros((len(self.names), len(self.numbers) + 1), np.int64)
        for row, t in zip(self.counts, self.words):
            for w in t:
                row[self.numbers[w]] += 1
        self.need = np.array([-int(-threshold * len(t) // 1) for t in self.words])

    def found(self, text: bytes) -> Iterator[tuple[str, int, int, int, int]]:
        """(notice, start, end, matched words, words of the notice); offsets in code points of the text."""
        folded = text.translate(_FOLD)
        words = folded.split()
        get = self.numbers.get
        numbers = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        # A notice whose words the text does not have often enough cannot be covered; this drops nothing else.
        have = np.bincount(numbers, minlength=self.counts.shape[1])
        possible = np.flatnonzero(np.minimum(have, self.counts).sum(axis=1) >= self.need)
        ends = None
        for n in possible:
            for first, last, matched in self._places(words, numbers, int(n)):
                if ends is None:
                    ends = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", folded)]
                start, end = len(text[: ends[first][0]].decode()), len(text[: ends[last][1]].decode())
                yield self.names[n], start, end, matched, len(self.words[n])

    def _places(self, words: list[bytes], numbers: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
        """Where the notice stands: windows of one and a half times its length that have enough of its words are aligned."""
        notice, need = self.words[n], int(self.need[n])
        width = len(notice) + len(notice) // 2 + 1
        hits = np.flatnonzero(self.counts[n][numbers] > 0)
        enough = np.searchsorted(hits, hits + width) - np.arange(len(hits)) >= need
        after = -1
        for start in hits[enough]:
            if start <= after:
                continue
            pairs = aligned(words[start : start + width], notice)
            # The window starts at a word of the notice; it must be one that the alignment uses.
            if len(pairs) >= need and pairs[0][0] == 0:
                after = int(start) + pairs[-1][0]
                yield int(start), after, len(pairs)


def scan(docs: DataFrame, notices: Mapping[str, str] = NOTICES, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license, start, end, n_matched, n_words): every place where a text covers a notice to the threshold.

    Whole texts, every occurrence; start and end are code points of the original text. Case and ASCII punctuation
    do not count. Null text is empty. Texts stay where they are read, and memory holds one small batch; rows
    that repeat are scanned each on its own; an empty table gives no rows.
    """
    short = docs.select(docs[key].alias(key), text_of(docs, text).alias("text"))
    schema = short.select(key).schema.add("license", "string").add("start", "long").add("end", "long").add("n_matched", "long").add("n_words", "long")
    known = Notices(notices, threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, found = [], []
            for i, whole in enumerate(texts(batch, "text")):
                for match in known.found(whole):
                    rows.append(i)
                    found.append(match)
            if found:
                columns = [pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(zip(*found))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], schema.names)

    return short.mapInArrow(run, schema)


def licensed(docs: DataFrame, **options) -> DataFrame:
    """(key, licenses): the sorted notices of each text that has any."""
    key = options.get("key", "doc_id")
    return scan(docs, **options).groupBy(key).agg(F.sort_array(F.collect_set("license")).alias("licenses"))
