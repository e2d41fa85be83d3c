"""License scans by conditional compression.

The cues are the templates' own words, so white space and comment marks between them do not matter: wherever a
template's words stand close enough together that its wording may, a candidate block opens. A block's words are compressed by
themselves and with each template's as zstandard raw dictionary, which ranks the templates by the bytes that they save. They are
confirmed down this ranking by exact wording differences, words that are missing, replaced or added: the first that stands
anywhere in the block wins its closest places, and what lies between these is a block of its own, ranked anew. A
block is done when no template is left in it that has words enough for its wording; those that save nothing come last. So
what the ranking passes over is overlapped by a winner or is no wording.

Null text: empty. Null doc_id: the row stays. Repeated rows: one result each. Empty table: no rows. Very
long texts: whole, by windows of bounded size. Ties of the ranking: by name. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import itertools
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts

#: Fixed wordings of public licenses and notices.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-notice": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
    "all-rights-reserved": "All rights reserved.",
}
#: A winner has at most this share of its words different.
MOST_DIFFERENT = 0.2
LEVEL = 3
_WORD = re.compile(r"\w(?:[\w./-]*\w)?")


@functools.cache
def _template_words(text: str) -> tuple[str, ...]:
    return tuple(w.lower() for w in _WORD.findall(text))


@functools.cache
def _compressor(template: str | None) -> zstandard.ZstdCompressor:
    """A compressor with a template as dictionary; None: without one."""
    if template is None:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    raw = zstandard.ZstdCompressionDict(" ".join(_template_words(template)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)


def likely(text: str, templates: tuple, most: float) -> list[tuple[str, str]]:
    """The templates of whose distinct words a text holds enough for their wording."""
    held = {w.lower() for w in set(_WORD.findall(text))}
    distinct = [(name, wanted, _template_words(wanted)) for name, wanted in templates]
    return [(name, wanted) for name, wanted, words in distinct if words and len(held.intersection(words)) >= len(set(words)) - int(most * len(words))]


def ranked(block: str, templates: tuple) -> list[tuple[float, str]]:
    """(saving, template), best first: bytes that the template saves of a block's words, as a share of what it has to say."""
    raw = block.encode()
    alone = len(_compressor(None).compress(raw))
    out = [((alone - len(_compressor(text).compress(raw))) / len(text) ** 0.5, name) for name, text in templates if text]
    return sorted((x for x in out if x[0] > 0), key=lambda x: (-x[0], x[1]))


@functools.cache
def _anchors(template: str, allowed: int) -> dict[str, tuple[int, ...]]:
    """allowed + 1 distinct words of the template, with their places: any wording with so few differences keeps one of them in its place."""
    wanted = _template_words(template)
    places: dict[str, list[int]] = {}
    for k, w in enumerate(wanted):
        places.setdefault(w, []).append(k)
    chosen = sorted(places, key=lambda w: (-len(w), w))[: allowed + 1]
    return {w: tuple(places[w] if len(places) <= allowed else places[w][:1]) for w in chosen}


def _apart(found: list[tuple]) -> list[tuple]:
    """Those of found, as (start, end, ...) and best first, that overlap with none before them."""
    starts, out = [], []
    for x in found:
        k = bisect.bisect_right(starts, x[0])
        if (not k or out[k - 1][1] <= x[0]) and (k == len(starts) or starts[k] >= x[1]):
            starts.insert(k, x[0])
            out.insert(k, x)
    return out


class Places:
    """Where words hold a template's wording, with differences in at most a share of its words."""

    def __init__(self, words: list[str], template: str, most: float):
        self.words, self.wanted = words, _template_words(template)
        self.allowed = int(most * len(self.wanted))
        self.need, self.counts = len(self.wanted) - self.allowed, Counter(self.wanted)
        anchors = _anchors(template, self.allowed)
        self.starts = sorted({i - k for i, w in enumerate(words) if w in anchors for k in anchors[w]})
        self.many = [0, *itertools.accumulate(w in self.counts for w in words)] if self.starts else [0]

    def windows(self, low: int, high: int) -> list[tuple[int, int, int]]:
        """(start, begin, end) for each start between low and high about which there are enough of the template's words."""
        out, n = [], len(self.wanted)
        for k in self.starts[bisect.bisect_left(self.starts, low - n - self.allowed) : bisect.bisect_right(self.starts, high + self.allowed)]:
            begin, end = max(low, k - self.allowed), min(high, k + n + self.allowed + 1)
            if end - begin >= self.need and self.many[end] - self.many[begin] >= self.need and (self.counts & Counter(self.words[begin:end])).total() >= self.need:
                out.append((k, begin, end))
        return out

    def may(self, low: int, high: int) -> bool:
        """Whether there are enough of the template's words between low and high."""
        return high - low >= self.need and self.many[-1] > 0 and self.many[high] - self.many[low] >= self.need

    def found(self, low: int = 0, high: int | None = None) -> list[tuple[int, int, int]]:
        """(first word, end, differing words) between low and high, in order."""
        out, free, n = [], [(low, len(self.words) if high is None else high)], len(self.wanted)
        matcher = difflib.SequenceMatcher(None, "", self.wanted, False)
        while free:
            low, high = free.pop()
            held = set()
            for k, begin, end in self.windows(low, high):
                if low <= k and k + n <= high and tuple(self.words[k : k + n]) == self.wanted:
                    held.add((k, k + n, 0))
                elif self.allowed:
                    matcher.set_seq1(self.words[begin:end])
                    same = [x for x in matcher.get_matching_blocks() if x.size]
                    first, last = same[0].a, same[-1].a + same[-1].size
                    different = max(n, last - first) - sum(x.size for x in same)
                    if different <= self.allowed:
                        held.add((begin + first, begin + last, different))
            new = _apart(sorted(held, key=lambda x: (x[2], x[0] - x[1], x[0])))
            out += new
            # What lies between is looked at by itself: a reworded copy must not be aligned with words of the copy beside it.
            edges = [low, *(e for x in new for e in x[:2]), high]
            free += [x for x in zip(edges[::2], edges[1::2]) if new and x[1] - x[0] >= self.need]
        return sorted(out)


def wording(block: str, template: str, most: float) -> list[tuple[int, int, int]]:
    """(start, end, differing words) for each place in the block that has the template's wording."""
    own = list(_WORD.finditer(block))
    return [(own[a].start(), own[b - 1].end(), d) for a, b, d in Places([m[0].lower() for m in own], template, most).found()]


def licenses(text: str, templates: tuple, most: float = MOST_DIFFERENT) -> tuple[int, list[tuple[int, int, str, int]]]:
    """Number of candidate blocks, and (start, end, template, differing words) of the winners, in order."""
    own = list(_WORD.finditer(text)) if (held := likely(text, templates, most)) else []
    words = [m[0].lower() for m in own]
    places = {name: Places(words, wanted, most) for name, wanted in held}
    blocks: list[list[int]] = []
    for begin, end in sorted({w[1:] for p in places.values() for w in p.windows(0, len(words))}):
        if blocks and begin <= blocks[-1][1]:
            blocks[-1][1] = max(blocks[-1][1], end)
        else:
            blocks.append([begin, end])
    out, free = [], [tuple(b) for b in blocks]
    while free:
        low, high = free.pop()
        here = {name: wanted for name, wanted in held if places[name].may(low, high)}
        if not here:
            continue
        first = [name for _, name in ranked(" ".join(words[low:high]), tuple(here.items()))]
        for name in first + sorted(here.keys() - set(first)):
            if spans := places[name].found(low, high):
                closest = min(d for *_, d in spans)
                won = [x for x in spans if x[2] == closest]
                out += [(own[a].start(), own[b - 1].end(), name, d) for a, b, d in won]
                edges = [low, *(e for x in won for e in x[:2]), high]
                free += [x for x in zip(edges[::2], edges[1::2]) if x[0] < x[1]]
                break
    return len(blocks), sorted(out)


def license_scan(documents: DataFrame, templates: dict[str, str] | None = None, most: float = MOST_DIFFERENT) -> DataFrame:
    """doc_id, n_blocks, n_licenses, licenses (names, sorted) and spans (name:start:end:differences) for each row of documents."""
    listed = tuple(sorted((templates or TEMPLATES).items()))

    def scan(batches):
        for batch in batches:
            rows = [licenses(x, listed, most) for x in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([len(f) for _, f in rows], pa.int64())]
            columns.append(pa.array([",".join(sorted({x[2] for x in f})) for _, f in rows], pa.string()))
            columns.append(pa.array([",".join(f"{n}:{a}:{b}:{d}" for a, b, n, d in f) for _, f in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_blocks", "n_licenses", "licenses", "spans"])

    return texts(documents).mapInArrow(scan, "doc_id long, n_blocks long, n_licenses long, licenses string, spans string")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
