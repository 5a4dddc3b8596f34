"""License scans: winnowed fingerprints pick candidate templates, banded alignment reports what matches.

Templates (license texts, headers and one-line notices) are cut into runs of GRAM words; winnowing
keeps the least hash of every WINNOW neighbours, so that a document and a template that share
GRAM + WINNOW - 1 words in a row share a fingerprint; the grams of shorter templates are always kept.
The inverted index from fingerprint to
(template, place) is built from the fixed list below, or the caller's, whose size the caller bounds;
it is sent to every task. A document's fingerprints propose template and diagonal; around each
diagonal a banded local alignment of words (match, mismatch and gap scores) gives the matched words
of the template, its coverage and the span in the text; what is left of the band on either side is
aligned again, so that repeats close together are all found. Of overlapping spans the one that
covers more words stays.

Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII. Null and empty
texts have no finds. Repeated rows give repeated results. Ties between templates go to the one that
comes first by name. Extra columns are left out, whatever their names. Texts are scanned whole:
alignment runs only around proposed diagonals where enough of the template's words stand in the band
for a find, and in pieces as long as the template, so that time follows the length of the text and
the number of finds and of near misses. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from indexloom.llm import textops

GRAM = 3
WINNOW = 2
BAND = 8
MIN_COVERAGE = 0.8
PIECES = 512  # pieces of a text that are aligned at once
STEPS = 1 << 24  # cells of the table that counts a template's words by diagonal
MATCH, MISMATCH, GAP = 2, -2, -1

#: Names and texts of licenses, their headers and usual notices. Fixed values.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT notice": "Released under the MIT License",
    "MIT licensed notice": "Licensed under the MIT License",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0 sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0 sentence": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0 sentence": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC0-1.0 sentence": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "Unlicense text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "All rights reserved notice": "All rights reserved",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced",
}


def winnow(grams: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Positions of the least hash of each run of `window` (the rightmost of equals)."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))], dtype=np.int64) if len(grams) else np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(runs)) + window - 1 - runs[:, ::-1].argmin(axis=1))


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words = textops.Words(*textops.utf8(pa.array([templates[n] for n in self.names], type=pa.large_string())))
        self.words = [words.hash[a:b] for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
        entries = []
        for t, w in enumerate(self.words):
            g = textops.shingle_hashes(w, min(GRAM, max(len(w), 1)))
            entries += [(g[p], t, p) for p in range(len(g))]  # all grams of a template: a document's winnowed ones are among them
        entries.sort()
        self.hash = np.array([e[0] for e in entries], dtype=np.uint64)
        self.template = np.array([e[1] for e in entries], dtype=np.int64)
        self.place = np.array([e[2] for e in entries], dtype=np.int64)
        short = np.array([len(w) < GRAM + WINNOW - 1 for w in self.words], dtype=bool)
        self.short = np.unique(self.hash[short[self.template]])  # winnowing a document may drop these


def _band(template: np.ndarray, words: np.ndarray, i: int | np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the text that lie in the bands at the template's place i, whether they are in their pieces, and whether they hold its word."""
    at = np.add.outer(shift + i, np.arange(-band, band + 1))
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    return at, inside, inside & (words.take(at, mode="clip") == template[i])


def align(template: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.ndarray, band: int = BAND) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignments of a template with pieces words[lo:hi], all at once, with text place - template place within `shift` +- band: (score, matched words, start, end)."""
    many, width = len(lo), 2 * band + 1
    rows, column = np.arange(many), np.arange(width)
    best = np.zeros((4, many), np.int64)
    score, matched, start = np.zeros((many, width), np.int64), np.zeros((many, width), np.int64), np.full((many, width), -1, np.int64)
    beyond, none, cells = np.full((many, 1), -(1 << 40)), np.zeros((many, 1), np.int64), rows[:, None] * width
    for i in range(len(template)):
        at, inside, equal = _band(template, words, i, lo, hi, shift, band)
        diagonal = score + np.where(equal, MATCH, MISMATCH)
        up = np.concatenate([score[:, 1:], beyond], axis=1) + GAP  # the template's word has no partner
        take_up = up > diagonal
        new = np.where(take_up, up, diagonal)
        up_m, up_s = np.concatenate([matched[:, 1:], none], axis=1), np.concatenate([start[:, 1:], none], axis=1)
        new_m = np.where(take_up, up_m, matched + equal)
        new_s = np.where(take_up, up_s, np.where(start < 0, at, start))
        dead = (new <= 0) | ~inside
        new, new_m, new_s = np.where(dead, 0, new), np.where(dead, 0, new_m), np.where(dead, -1, new_s)
        # a text's word has no partner: each cell's value may come from any cell before it, less the gaps; the last of equals
        level = new - GAP * column
        source = np.maximum.accumulate(np.where(level == np.maximum.accumulate(level, axis=1), column, 0), axis=1)
        score = new.take(cells + source) + GAP * (column - source)
        matched, start = new_m.take(cells + source), new_s.take(cells + source)
        shown = np.where(equal, score, -1)
        k = shown.argmax(axis=1)
        now = shown[rows, k]
        better = now > best[0]
        if better.any():
            best[:, better] = np.stack([now, matched[rows, k], start[rows, k], at[rows, k] + 1])[:, better]
    return tuple(best)


def reach(template: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.ndarray, band: int = BAND) -> np.ndarray:
    """For each piece the number of the template's words that stand anywhere in its band: no alignment matches more."""
    found = np.zeros(len(lo), np.int64)
    for i in range(len(template)):
        found += _band(template, words, i, lo, hi, shift, band)[2].any(axis=1)
    return found


def align_all(template: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.ndarray, band: int = BAND) -> set[tuple[int, int, int]]:
    """(matched words, start, end) of the best local alignment of each piece and, again and again, of those in what it leaves on either side, as far as they reach MIN_COVERAGE."""
    need = MIN_COVERAGE * len(template)
    found: set[tuple[int, int, int]] = set()
    whole = True  # the first pieces are hopeful diagonals
    while len(lo):
        rest = []
        for k in range(0, len(lo), PIECES):
            part = [x[k : k + PIECES] for x in (lo, hi, shift)]
            part = [x[part[1] - part[0] >= need] for x in part]
            if not whole and len(part[0]):
                able = reach(template, words, *part, band) >= need
                part = [x[able] for x in part]
            if not len(part[0]):
                continue
            _, matched, start, end = align(template, words, *part, band)
            found |= {x for x in zip(matched.tolist(), start.tolist(), end.tolist(), strict=True) if x[0] >= need}
            some = matched > 0
            rest += [(part[0][some], start[some], part[2][some]), (end[some], part[1][some], part[2][some])]
        if not rest:
            break
        lo, hi, shift = (np.concatenate(x) for x in zip(*rest, strict=True))
        whole = False
    return found


def hopeful(template: np.ndarray, words: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    """Those of the diagonals, in steps of BAND and ascending, around which enough of the template's words stand for a find.

    Every pair of equal words marks its template place on its diagonal's step; the places marked on a
    step or two to either side are counted. This is done for as many steps at once as STEPS cells hold.
    """
    size, need = len(template), MIN_COVERAGE * len(template)
    order = np.argsort(template, kind="stable")
    known = template[order]
    at_once = max(1, STEPS // size)
    kept, k = [], 0
    while k < len(coarse):
        first = coarse[k] - 2
        upto = int(np.searchsorted(coarse, coarse[k] + at_once))
        last = coarse[upto - 1] + 2
        a = max(0, first * BAND)
        near = words[a : max(a, (last + 1) * BAND + size)]
        low = np.searchsorted(known, near)
        n = np.searchsorted(known, near, side="right") - low
        place = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        step = (np.repeat(np.arange(a, a + len(near)), n) - place) // BAND - first
        seen = np.zeros((last - first + 1, size), bool)
        fits = (step >= 0) & (step < len(seen))
        seen[step[fits], place[fits]] = True
        here = coarse[k:upto]
        around = seen[here - first].copy()
        for by in (-2, -1, 1, 2):
            around |= seen[here - first + by]
        kept.append(here[around.sum(axis=1) >= need])
        k = upto
    return np.concatenate(kept) if kept else coarse


def scan(words: np.ndarray, index: Index) -> list[tuple[int, int, float, int, int]]:
    """(template, matched words, coverage, first word, end word) of each find, by place."""
    grams = textops.shingle_hashes(words, GRAM)
    picked = np.union1d(winnow(grams), np.flatnonzero(np.isin(grams, index.short)))
    if not picked.size:
        return []
    low, high = np.searchsorted(index.hash, grams[picked]), np.searchsorted(index.hash, grams[picked], side="right")
    n = high - low
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    seeds = np.unique(np.stack([index.template[entry], (np.repeat(picked, n) - index.place[entry]) // BAND], axis=1), axis=0)
    finds = set()  # neighbouring bands overlap
    for t in np.unique(seeds[:, 0]).tolist():
        template = index.words[t]
        coarse = hopeful(template, words, seeds[seeds[:, 0] == t, 1])
        lo = np.maximum(0, coarse * BAND - 2 * BAND)
        hi = np.minimum(len(words), coarse * BAND + len(template) + 3 * BAND)
        for matched, start, end in align_all(template, words, lo, hi, coarse * BAND + BAND // 2, 2 * BAND):
            finds.add((t, matched, matched / len(template), start, end))
    out: list[tuple[int, int, float, int, int]] = []
    starts: list[int] = []  # of the spans chosen, which don't overlap
    for f in sorted(finds, key=lambda f: (-f[1], -f[2], f[3], f[0])):
        k = bisect.bisect_left(starts, f[4])
        if k == 0 or out[k - 1][4] <= f[3]:
            out.insert(k, f)
            starts.insert(k, f[3])
    return out


_FIND = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_finds", pa.int64()), ("licenses", pa.string()), ("finds", pa.list_(_FIND)), ("spans", pa.string())])


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Every find of every row of docs (doc_id, text); places are in code points, end exclusive."""
    sent = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for part in textops.slices(batch):
                texts = textops.text_column(part)
                buf, offsets = textops.utf8(texts)
                words = textops.Words(buf, offsets)
                grams = textops.shingle_hashes(words.hash, GRAM)
                at = np.minimum(np.searchsorted(index.hash, grams), len(index.hash) - 1)
                hit = np.concatenate([[0], np.cumsum(index.hash[at] == grams)]) if len(grams) else np.zeros(1, np.int64)
                a, b = np.minimum(words.offsets[:-1], len(grams)), np.minimum(words.offsets[1:], len(grams))
                rows = []
                for d in range(len(texts)):
                    found = []
                    if hit[b[d]] > hit[a[d]]:  # some gram of the document is a template's; most documents end here
                        lo, hi = words.offsets[d], words.offsets[d + 1]
                        points = np.concatenate([[0], np.cumsum((buf[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80)])  # code points before each byte
                        for t, m, cover, s, e in scan(words.hash[lo:hi], index):
                            start, end = points[words.start[lo + s] - offsets[d]], points[words.end[lo + e - 1] - offsets[d]]
                            found.append({"license": index.names[t], "coverage": round(cover, 6), "matched_words": m, "start": int(start), "end": int(end)})
                    rows.append(found)
                yield textops.batch_of(
                    _RESULT, part.column(0).cast(pa.int64()), [len(f) for f in rows], [",".join(sorted({x["license"] for x in f})) for f in rows], rows,
                    [",".join(f"{x['license']}:{x['start']}:{x['end']}:{x['coverage']}" for x in f) for f in rows],
                )

    return textops.narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_finds long, licenses string, finds array<struct<license:string,coverage:double,matched_words:long,start:long,end:long>>, spans string")
