"""Licence texts and notices, found by matching statistics on a generalised suffix automaton.

One automaton holds all words of all templates and phrases.  Each document streams through it: at each word the longest
match that ends there, and its state.  States say which phrases end there; matches that can't be extended to the right say
where in which templates they stand.  Long matches are chained, in the order of the template and with bounded gaps,
into spans; a span that covers enough of its template has the template's label.  Of overlapping spans the one of more
words stays.

Two neighbouring words that no template has side by side end every match of two words, so only runs of known pairs
stream; the rest has matches of at most one word, which nothing here counts.  No row is shuffled.
"""

from __future__ import annotations

import bisect
import functools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import shared

#: Words are runs of digits, letters and bytes beyond ASCII.
LETTERS = np.zeros(256, np.uint8)
LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1

#: (label, phrase): every place where the words stand consecutively counts.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: (label, template): notices and opening paragraphs of public licences.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
        "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def tokens(text: str) -> list[bytes]:
    """The words of a template: A-Z lower-cased, cut as in documents."""
    low = bytes(shared.FOLD[np.frombuffer(text.encode(), np.uint8)])
    return bytes(b if LETTERS[b] else 32 for b in low).split()


class SuffixAutomaton:
    """The generalised suffix automaton of several sequences of numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]  # (sequence, end) of each state's strings
        ends = []
        for s, sequence in enumerate(sequences):
            last = 0
            for e, x in enumerate(sequence):
                last = self._extend(last, x)
                ends.append((last, s, e))
        for state, s, e in ends:
            while state > 0:
                self.places[state].append((s, e))
                state = self.link[state]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        """The state of the strings of ``q`` that are as short as those that come from ``p``."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = part
            p = self.link[p]
        return part

    def _extend(self, p: int, x: int) -> int:
        if x in self.next[p]:
            return self._split(p, self.next[p][x], x)
        new = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][x], x)
        return new

    def stream(self, sequence: list[int]) -> tuple[list[int], list[int]]:
        """Matching statistics: at each place the length of the longest match that ends there, and its state."""
        following, link, length = self.next, self.link, self.length
        lengths, states, v, n = [], [], 0, 0
        for x in sequence:
            to = following[v].get(x)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = following[v].get(x)
            if to is None:
                n = 0
            else:
                v, n = to, n + 1
            lengths.append(n)
            states.append(v)
        return lengths, states


class Scanner:
    """Templates and phrases made ready for documents."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...], least: int, share: float, gap: int, notice: int):
        self.least, self.gap = least, gap
        words = [tokens(t) for _, t in (*templates, *phrases)]
        known = sorted({w for own in words for w in own})
        number = {w: i for i, w in enumerate(known)}
        sequences = [[number[w] for w in own] for own in words]
        self.labels, self.sizes = [x for x, _ in templates], [len(own) for own in words]
        self.automaton = SuffixAutomaton(sequences)
        by_hash = sorted((int(shared.token_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]), LETTERS)[0][0]), i) for w, i in number.items())
        self.hashes, self.numbers = np.array([h for h, _ in by_hash], np.uint64), np.array([i for _, i in by_hash], np.int64)
        self.pairs = np.zeros((len(known), len(known)), bool)
        for own in sequences:
            self.pairs[own[:-1], own[1:]] = True
        #: Words of a template that a span needs: all of a short notice, whose few words other notices share.
        self.needed = [n if n < notice else share * n for n in self.sizes]
        # phrases that end at a state: those of all states on its links
        self.phrases = [x for x, _ in phrases]
        own_phrases = defaultdict(list)
        for k, sequence in enumerate(sequences[len(templates) :]):
            v = 0
            for x in sequence:
                v = self.automaton.next[v][x]
            own_phrases[v].append((k, len(sequence)))
        self.ending: list[tuple[tuple[int, int], ...]] = []
        for v in range(len(self.automaton.next)):
            found, u = [], v
            while u >= 0:
                found += own_phrases.get(u, [])
                u = self.automaton.link[u]
            self.ending.append(tuple(found))
        self.one_word = [(number[words[len(templates) + k][0]], k) for k in range(len(phrases)) if len(sequences[len(templates) + k]) == 1]

    def known(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.numbers[at], -1)

    def scan(self, word: np.ndarray, bounds: np.ndarray) -> tuple[dict, dict]:
        """Places of phrases, (phrase, start) by text, and long matches, (template, end in it, end, length) by text."""
        places, matches = defaultdict(list), defaultdict(list)
        pair = np.zeros(len(word), bool)  # the word and the one after it stand side by side in a template
        both = (word[:-1] >= 0) & (word[1:] >= 0)
        pair[:-1][both] = self.pairs[word[:-1][both], word[1:][both]]
        pair[bounds[1:][bounds[1:] > 0] - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[False], pair, [False]]).astype(np.int8)))
        texts = np.searchsorted(bounds, edge[::2], "right") - 1
        stream, ending, templates = self.automaton.stream, self.ending, len(self.labels)
        for text, lo, hi in zip(texts.tolist(), edge[::2].tolist(), (edge[1::2] + 1).tolist(), strict=True):
            lengths, states = stream(word[lo:hi].tolist())
            at = lo - int(bounds[text])
            for i, (n, v) in enumerate(zip(lengths, states, strict=True)):
                for k, size in ending[v]:
                    if 1 < size <= n:
                        places[text].append((k, at + i - size + 1))
                if n >= self.least and (i + 1 == hi - lo or lengths[i + 1] != n + 1):
                    for t, e in self.automaton.places[v]:
                        if t < templates:
                            matches[text].append((t, e, at + i, n))
        for x, k in self.one_word:
            for i in np.flatnonzero(word == x).tolist():
                text = int(np.searchsorted(bounds, i, "right")) - 1
                places[text].append((k, i - int(bounds[text])))
        return places, matches

    def chain(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Chains of matches of one template each: (covered words, template, start, end)."""
        by_template = defaultdict(list)
        for t, e, i, n in matches:
            by_template[t].append((i, e, n))
        spans = []
        for t, own in by_template.items():
            own.sort()
            covered, before = [], []
            for j, (i, e, n) in enumerate(own):
                best, of = n, -1
                k = j - 1
                # ends ascend: matches further back than the longest one and the gap can't be followed by this one
                while k >= 0 and own[k][0] >= i - n - self.gap:
                    pi, pe, _ = own[k]
                    gain = min(n, i - pi, e - pe)
                    if gain > 0 and covered[k] + gain > best:
                        best, of = covered[k] + gain, k
                    k -= 1
                covered.append(best)
                before.append(of)
            used = [False] * len(own)
            for j in sorted(range(len(own)), key=lambda j: (-covered[j], j)):
                if covered[j] < self.needed[t]:
                    break
                path = [j]
                while before[path[-1]] >= 0:
                    path.append(before[path[-1]])
                if any(used[k] for k in path):
                    continue
                for k in path:
                    used[k] = True
                spans.append((covered[j], t, own[path[-1]][0] - own[path[-1]][2] + 1, own[j][0] + 1))
        return spans

    def spans(self, matches: list[tuple[int, int, int, int]]) -> list[dict]:
        """Covered spans that don't overlap: more words first, then larger shares, earlier ones, first templates."""
        starts, ends, out = [], [], []
        for covered, t, lo, hi in sorted(self.chain(matches), key=lambda c: (-c[0], self.sizes[c[1]], c[2], c[1])):
            at = bisect.bisect_right(starts, lo)
            if (at and ends[at - 1] > lo) or (at < len(starts) and starts[at] < hi):
                continue
            starts.insert(at, lo)
            ends.insert(at, hi)
            out.append({"label": self.labels[t], "start": lo, "end": hi, "covered": covered, "share": min(1.0, round(covered / self.sizes[t], 6))})
        return sorted(out, key=lambda s: s["start"])


@functools.cache
def _scanner(*args) -> Scanner:
    return Scanner(*args)


COLUMNS = "n_words long, places array<struct<label:string,start:long>>, spans array<struct<label:string,start:long,end:long,covered:long,share:double>>"
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))


def scan_licenses(
    docs: DataFrame, *, text_col: str = "text", templates: tuple = TEMPLATES, phrases: tuple = PHRASES, least: int = 3, share: float = 0.75, gap: int = 8, notice: int = 16
) -> DataFrame:
    """``docs`` with columns ``n_words``, ``places`` of phrases and covered ``spans`` of templates, both by start.

    Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII, numbered from 0.  Matches of ``least``
    words or more are chained with at most ``gap`` words between them; a chain that covers at least ``share`` of its
    template, and the whole of one of fewer than ``notice`` words, is a span.  Spans don't overlap; of several that do, the one that covers more words stays.

    A null or empty text has no words, places or spans.  Bytes that aren't UTF-8 become U+FFFD.  Columns of the new
    names (in any case) are replaced; others, repeated rows and null ids stay.  An empty table gives an empty result.
    """
    args = (tuple(map(tuple, templates)), tuple(map(tuple, phrases)), max(2, least), share, gap, notice)

    def compute(data: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        scanner = _scanner(*args)
        h, at = shared.token_hashes(data, bounds, LETTERS[shared.FOLD])
        places, matches = scanner.scan(scanner.known(h), at)
        texts = range(len(bounds) - 1)
        shown = [[{"label": scanner.phrases[k], "start": s} for k, s in sorted(places.get(t, ()), key=lambda p: (p[1], p[0]))] for t in texts]
        return [pa.array(np.diff(at).astype(np.int64)), pa.array(shown, _PLACES), pa.array([scanner.spans(matches[t]) if t in matches else [] for t in texts], _SPANS)]

    return shared.with_text_columns(docs, text_col, COLUMNS, compute)
