"""License notices by conditional compression: what a wording saves as a dictionary decides what is looked at.

1. Candidate blocks.  A wording of m words may have ``DIFFERENCES`` x m words
   missing or added.  Cut into one part more than that, at least one part stays
   unchanged, and with it two neighbouring words of it.  Around such pairs the text
   is cut into overlapping blocks of ``BLOCK`` words, whatever its lines.
2. Conditional compression.  Every block is compressed alone and with every wording
   as a raw zstandard dictionary, both as lower-cased words with single spaces.
   Blocks are short, so the bytes a short notice saves aren't lost in others.  The
   wordings that save ``LEAST`` bytes or more are the winners; no other is looked at.
3. Confirmation.  Around a block, the text is aligned with each winner (Sellers'
   dynamic programming over words), whatever the length of the wording.  A notice
   has few enough words that differ, and none of them names another license.
4. Of notices that overlap, the one counts whose wording saves most bytes of the
   place they cover together; then the one with most equal words less differences;
   then the first of the list.

A notice that saves too little in its block is passed over; the tests hold the
result against a search by words alone.

Defined results: null and empty texts have no notice; equal wording found twice
is two notices; texts are read whole; repeated rows each have their notices; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
import operator
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prsignal.llm.common import map_slices, type_of

def _gnu(name: str, title: str, version: str) -> list[tuple[str, str]]:
    return [
        (name, f"This work is licensed under the GNU {title}, version {version}."),
        (
            name,
            f"you can redistribute it and/or modify it under the terms of the GNU {title} as published "
            f"by the Free Software Foundation, either version {version} of the License, or any later version.",
        ),
    ]


def _creative_commons(version: str, scope: str) -> list[tuple[str, str]]:
    kinds = {
        "BY": "Attribution",
        "BY-SA": "Attribution-ShareAlike",
        "BY-ND": "Attribution-NoDerivatives",
        "BY-NC": "Attribution-NonCommercial",
        "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
        "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
    }
    return [
        pair
        for code, kind in kinds.items()
        for pair in (
            (f"CC-{code}-{version}", f"Licensed under CC {code} {version}."),
            (f"CC-{code}-{version}", f"licensed under a Creative Commons {kind} {version} {scope} License."),
        )
    ]


_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted"
_BSD_TERMS = (
    f"{_BSD} provided that the following conditions are met: Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_FULL = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
    "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE."
)

# The default: licenses and the wording of their notices, short and full.  ``BSD``: the sentence that BSD-2 and BSD-3 share, alone.
WORDINGS = (
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("MIT", _MIT_FULL),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License."),
    *_gnu("GPL-3.0", "General Public License", "3"),
    *_gnu("GPL-2.0", "General Public License", "2"),
    *_gnu("LGPL-3.0", "Lesser General Public License", "3"),
    *_gnu("LGPL-2.1", "Lesser General Public License", "2.1"),
    *_gnu("LGPL-2.0", "Library General Public License", "2"),
    *_gnu("AGPL-3.0", "Affero General Public License", "3"),
    *_creative_commons("4.0", "International"),
    *_creative_commons("3.0", "Unported"),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", _BSD),
    ("BSD-2-Clause", _BSD_TERMS),
    ("BSD-3-Clause", f"{_BSD_TERMS} {_BSD_NAMES}"),
    ("BSD-2-Clause", f"{_BSD_TERMS} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-1.0", "made available under the terms of the Eclipse Public License v1.0"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software.",
    ),
)

# Tables of other wordings may have so many rows, and so many words in each.
MAX_WORDINGS, MAX_WORDS = 1000, 10_000

DIFFERENCES = 0.1

# Words of a block, those before the pair it is cut around, and those that the next block shares with it.
BLOCK, BEFORE, SHARED = 48, 20, 20

# Bytes of a block that a wording has to save.
LEAST = 5

# Words that tell licenses apart are in the wordings of so few names, or among so few differences of two names.
FEW_NAMES, NEAR = 0.1, 5

_WORD = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")
_ONE = 1 << 32

# The compression of blocks: a level that tries every place (lower ones skip short notices between strange words),
# in frames without what says nothing of the block.
LEVEL = 19
_BARE = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}


def telling(templates: tuple[tuple[str, str], ...]) -> frozenset[str]:
    """The words that tell licenses apart: names that few wordings have, and what sets similar wordings apart."""
    proper: dict[str, set[str]] = {}
    plain, counts = set(), []
    for name, wording in templates:
        shouted = wording.upper()
        found = [(m.group(), m.start()) for m in _WORD.finditer(wording)]
        counts.append(Counter(w.lower() for w, _ in found))
        for w, at in found:
            opens = not wording[:at].rstrip() or wording[:at].rstrip()[-1] in ".:;"
            if w == w.lower():
                plain.add(w)
            elif not opens and shouted[max(0, at - 20) : at + 20] != wording[max(0, at - 20) : at + 20]:
                proper.setdefault(w.lower(), set()).add(name)
    most = max(2, FEW_NAMES * len({name for name, _ in templates}))
    out = {w for w, names in proper.items() if w not in plain and len(names) <= most}
    for i, (name, _) in enumerate(templates):
        for j in range(i):
            if templates[j][0] != name:
                differ = (counts[i] - counts[j]) + (counts[j] - counts[i])
                if differ.total() <= min(NEAR, max(counts[i].total(), counts[j].total()) / 2):
                    out |= differ.keys()
    return frozenset(out)


def words(text: str) -> list[tuple[str, int, int]]:
    """Lower-cased words with their places."""
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


class Wordings:
    """Wordings as dictionaries, with the pairs of words around which blocks are cut."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.templates = templates
        self.words = [[w for w, _, _ in words(wording)] for _, wording in templates]
        self.counts = [Counter(w) for w in self.words]
        self.most = [int(DIFFERENCES * len(w)) for w in self.words]
        self.telling = telling(templates)
        parts = [(k, a, b) for k, w in enumerate(self.words) for a, b in self._cut(len(w), self.most[k])]
        # Few words that every part has one of, long ones first, each with its neighbours: (step, word).
        self.pairs: dict[str, set[tuple[int, str]]] = {}
        while parts:
            holds: dict[str, int] = {}
            for k, a, b in parts:
                for w in {*self.words[k][a:b]}:
                    holds[w] = holds.get(w, 0) + 1
            best = max(holds, key=lambda w: (min(len(w), 7), holds[w], w))
            mine = [p for p in parts if best in self.words[p[0]][p[1] : p[2]]]
            parts = [p for p in parts if best not in self.words[p[0]][p[1] : p[2]]]
            for k, a, b in mine:
                at = self.words[k].index(best, a)
                step = 1 if at + 1 < b else -1 if at > a else 0
                self.pairs.setdefault(best, set()).add((step, self.words[k][at + step]))
        self._compressors: list[zstandard.ZstdCompressor] = []

    @staticmethod
    def _cut(n: int, most: int) -> list[tuple[int, int]]:
        edges = [n * i // (most + 1) for i in range(most + 2)]
        return list(zip(edges, edges[1:]))

    def __reduce__(self):
        return prepared, (self.templates,)

    def saved(self, part: list[str], among: Iterable[int]) -> list[int]:
        """How many bytes each of these wordings saves when the words are compressed."""
        if not self._compressors:
            for want in self.words:
                raw = zstandard.ZstdCompressionDict(" ".join(want).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                raw.precompute_compress(level=LEVEL)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=raw, **_BARE))
            self._compressors.append(zstandard.ZstdCompressor(level=LEVEL, **_BARE))
        data = " ".join(part).encode()
        alone = len(self._compressors[-1].compress(data))
        return [alone - len(self._compressors[k].compress(data)) for k in among]

    def blocks(self, have: list[str]) -> Iterator[tuple[int, int]]:
        """The ranges of words that are compressed: every pair is in one, with the words before it."""
        low = high = 0
        for i, word in enumerate(have):
            for step, beside in self.pairs.get(word, ()):
                if 0 <= i + step < len(have) and have[i + step] == beside:
                    if i + SHARED >= high:
                        low = max(0, i - BEFORE)
                        high = low + BLOCK
                        yield low, min(high, len(have))
                    break

    def stretches(self, have: list[str]) -> dict[int, list[tuple[int, int]]]:
        """For each winner of a block, the joined ranges of words in which its notices may lie."""
        out: dict[int, list[tuple[int, int]]] = {}
        everyone = range(len(self.words))
        for begin, end in self.blocks(have):
            for k, saved in enumerate(self.saved(have[begin:end], everyone)):
                if saved < LEAST:
                    continue
                reach = len(self.words[k]) + self.most[k]
                low, high = max(0, begin - reach), min(len(have), end + reach)
                mine = out.setdefault(k, [])
                if mine and low <= mine[-1][1]:
                    mine[-1] = (mine[-1][0], high)
                else:
                    mine.append((low, high))
        return out

    def names_another(self, differ: list[str], place: str) -> bool:
        """Whether differences are more than wording: a name or version is missing, or another name was added."""
        for d in differ:
            w = d[1:]
            number = any(c.isdigit() for c in w)
            if d[0] == "-":
                if number or w in self.telling:
                    return True
            # Added numbers may be those of lists and lines; names are written with capitals ("this library" is none).
            elif w in self.telling and not number:
                if any(m.group() != w for m in re.finditer(rf"(?<![^\W_]){re.escape(w)}(?![^\W_])", place, re.IGNORECASE)):
                    return True
        return False


@functools.cache
def prepared(templates: tuple[tuple[str, str], ...]) -> Wordings:
    return Wordings(templates)


def occurrences(want: list[str], have: list[str], most: int) -> list[tuple[int, int, int]]:
    """(differences, start, end): the parts of a text with at most so many differences, of overlapping ones the best."""
    n = len(have)
    number = {w: i for i, w in enumerate(dict.fromkeys(want))}
    ids = np.array([number.get(w, -1) for w in have])
    # Differences in the upper bits; below them the start, a later one being less.
    best = np.arange(n, -1, -1, dtype=np.int64)
    added = np.arange(n + 1, dtype=np.int64) * _ONE
    for w in want:
        row = best + _ONE
        row[1:] = np.where(ids == number[w], np.minimum(row[1:], best[:-1]), row[1:])
        best = np.minimum.accumulate(row - added) + added
    ends = np.flatnonzero(best < (most + 1) * _ONE)
    used, out = np.zeros(n, bool), []
    for end in ends[np.lexsort((ends, best[ends] // _ONE))].tolist():
        start = n - int(best[end] % _ONE)
        if start < end and not used[start:end].any():
            used[start:end] = True
            out.append((int(best[end] // _ONE), start, end))
    return out


def differences(want: list[str], part: list[str]) -> list[str]:
    """The fewest words that differ, missing ones first (Myers' greedy way)."""
    n, m = len(want), len(part)
    reach, trace = {1: 0}, []
    for d in range(n + m + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and reach[k - 1] < reach[k + 1])
            x = reach[k + 1] if down else reach[k - 1] + 1
            while x < n and x - k < m and want[x] == part[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                break
        else:
            continue
        break
    missing, extra, x, y = [], [], n, m
    for d in range(len(trace) - 1, 0, -1):
        reach, k = trace[d], x - y
        down = k == -d or (k != d and reach[k - 1] < reach[k + 1])
        k = k + 1 if down else k - 1
        x, y = reach[k], reach[k] - k
        (extra if down else missing).append(part[y] if down else want[x])
    return [f"-{w}" for w in missing[::-1]] + [f"+{w}" for w in extra[::-1]]


def contenders(wordings: Wordings, have: list[str], text: str, found, ranges) -> list[tuple]:
    """(wording, start, end, words that differ) of what is confirmed in ranges of words for each wording."""
    out = []
    for k, stretches in ranges.items():
        want, most = wordings.words[k], wordings.most[k]
        for low, high in stretches:
            part = have[low:high]
            # Words that the place lacks altogether are missing from every notice in it.
            if (wordings.counts[k] - Counter(part)).total() > most:
                continue
            for _, start, end in occurrences(want, part, most):
                start, end = start + low, end + low
                differ = differences(want, have[start:end])
                if not wordings.names_another(differ, text[found[start][1] : found[end - 1][2]]):
                    out.append((k, start, end, differ))
    return out


def notices(text: str, templates: tuple[tuple[str, str], ...] = WORDINGS) -> list[dict]:
    """The notices of a text in the order of their places."""
    wordings = prepared(templates)
    found = words(text)
    have = [w for w, _, _ in found]
    confirmed = contenders(wordings, have, text, found, wordings.stretches(have))
    confirmed.sort(key=operator.itemgetter(1))
    out, at = [], 0
    while at < len(confirmed):
        stop, end = at, confirmed[at][2]
        while stop < len(confirmed) and confirmed[stop][1] < end:
            end = max(end, confirmed[stop][2])
            stop += 1
        group, begin = confirmed[at:stop], confirmed[at][1]
        among = sorted({g[0] for g in group})
        saves = dict(zip(among, wordings.saved(have[begin:end], among)))

        def rank(g):
            missing = sum(w[0] == "-" for w in g[3])
            return -saves[g[0]], len(g[3]) + missing - len(wordings.words[g[0]]), g[0], g[1]

        used = np.zeros(end - begin, bool)
        for k, start, last, differ in sorted(group, key=rank):
            if not used[start - begin : last - begin].any():
                used[start - begin : last - begin] = True
                place, length = found[start][1], found[last - 1][2] - found[start][1]
                out.append(
                    {"license": templates[k][0], "start": place, "length": length, "saved": saves[k], "differences": differ}
                )
        at = stop
    return sorted(out, key=operator.itemgetter("start"))


_NOTICE = pa.struct(
    [
        ("license", pa.string()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("saved", pa.int64()),
        ("differences", pa.list_(pa.string())),
    ]
)


def table_of(templates) -> tuple[tuple[str, str], ...]:
    """(name, wording) pairs, or a DataFrame with these two columns first, checked; equal rows count once."""
    if isinstance(templates, DataFrame):
        templates = sorted(map(tuple, templates.select(*templates.columns[:2]).distinct().limit(MAX_WORDINGS + 1).collect()))
    out = tuple(dict.fromkeys((name, wording) for name, wording in templates))
    if len(out) > MAX_WORDINGS:
        raise ValueError(f"more than {MAX_WORDINGS} wordings")
    for name, wording in out:
        if not name or not 0 < len(words(wording or "")) <= MAX_WORDS:
            raise ValueError(f"the wording of {name!r} has no word or more than {MAX_WORDS}, or no name")
    return out


def scan(docs: DataFrame, id_col="doc_id", text_col="text", templates=WORDINGS) -> DataFrame:
    """(id, license, start, length, saved, differences): one row for each notice; places are in code points.

    ``templates`` is what is looked for: pairs of a license's name and a wording,
    or a DataFrame of them, of at most ``MAX_WORDINGS`` rows of ``MAX_WORDS`` words.
    """
    wordings = prepared(table_of(templates))
    if not wordings.pairs:
        docs = docs.limit(0)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [notices(t, wordings.templates) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_NOTICE))], ["id", "notices"])

    lower = F.lower("text")
    holds = functools.reduce(operator.or_, [F.contains(lower, F.lit(w)) for w in wordings.pairs], F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(holds)
    schema = (
        f"id {type_of(rows, 'id')}, notices array<struct<license: string, start: long, length: long, saved: long, "
        "differences: array<string>>>"
    )
    return map_slices(rows, run, schema).select(F.col("id").alias(id_col), F.inline("notices"))
