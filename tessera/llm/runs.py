"""Periodic runs of words: maximal stretches that repeat themselves, found through longest common extensions.

A run of period p covers a multiple of p, so all runs come from the pairs (i, i + p) of the harmonic grid i = 0, p, 2p, ...:
about n log n pairs for n words.  A pair of equal words is extended to both sides; if both extensions together reach p, a
run is found.  An extension compares a few words directly until both places are in a difference cover.  Only the suffixes
at places of the cover are sorted (by blocks of ``V`` words, then by doubling), and the range minimum over their common
prefixes, from a sparse table, gives the rest.  The table is built for those texts alone that have a pair which gets that far.

Texts are independent: no row is shuffled, and a text takes about 200 bytes a word while it is worked on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared

_ROOT = 8
V = _ROOT * _ROOT
#: Residues whose differences give every residue: a * 8 - b with b < 8.
COVER = np.unique(np.concatenate([np.arange(_ROOT), np.arange(0, V, _ROOT)]))
#: Words that are compared directly before a place of the cover is looked for.
FEW = 8


def _steps() -> np.ndarray:
    """For two residues, the least step from FEW on that takes both into the cover."""
    held = np.zeros(V, bool)
    held[COVER] = True
    r = np.arange(V)
    out = np.full((V, V), -1, np.int16)
    for d in range(FEW, FEW + V):
        both = held[(r + d) % V][:, None] & held[(r + d) % V][None, :]
        out[both & (out < 0)] = d
    return out


STEPS = _steps()


class SampledSuffixes:
    """Longest common extensions to the right of places of the cover.

    ``seq`` ends with at least ``V`` numbers that occur once, and so does each text in it end with one.
    """

    def __init__(self, seq: np.ndarray):
        n = len(seq) - V
        place = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
        self.at = np.full(len(seq) + 1, -1, np.int32)
        self.at[place] = np.arange(len(place), dtype=np.int32)
        blocks = np.ascontiguousarray(sliding_window_view(seq, V)[place].astype(">i4")).view(f"V{4 * V}").ravel()
        order, rank = self._ranked(blocks)
        levels, reach = [rank], V
        while rank.max(initial=-1) + 1 < len(place):
            later = self.at[np.minimum(place + reach, len(seq))]
            # a place without a later one has a block that occurs once already
            order, rank = self._ranked(rank.astype(np.int64) * (len(place) + 1) + np.where(later < 0, 0, rank[later] + 1))
            levels.append(rank)
            reach *= 2
        a, b = place[order[:-1]], place[order[1:]]
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = (self.at[np.minimum(p + common, len(seq))] for p in (a, b))
            common += np.where((x >= 0) & (y >= 0) & (levels[k][x] == levels[k][y]), V << k, 0)
        common += direct(seq, a + common, b + common, np.full(len(a), V, np.int64))
        self.rank = rank
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted order of keys and each key's number among distinct keys."""
        order = np.argsort(keys, kind="stable")
        own = keys[order]
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.cumsum(np.concatenate([np.zeros(1, np.int32), (own[1:] != own[:-1]).astype(np.int32)]), dtype=np.int32)[: len(keys)]
        return order, rank

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from places ``i`` and ``j`` (different ones, both in the cover) on."""
        x, y = self.rank[self.at[i]], self.rank[self.at[j]]
        low, high = np.minimum(x, y).astype(np.int64), np.maximum(x, y).astype(np.int64)
        out, level = np.empty(len(i), np.int64), np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << k)])
        return out


def direct(seq: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from ``i`` and ``j`` on agree, at most ``most`` of each pair."""
    out, left, t = np.zeros(len(i), np.int64), np.arange(len(i)), 0
    while len(left):
        left = left[(t < most[left]) & (seq[i[left] + t] == seq[j[left] + t])]
        t += 1
        out[left] = t
    return out


class Extensions:
    """Extensions of pairs inside texts: ``seq`` holds word numbers, each text followed by a number that occurs once."""

    def __init__(self, seq: np.ndarray, first: np.ndarray):
        top = int(seq.max(initial=0)) + 1
        self.first, self.n = first, len(seq)  # where texts begin, and the end
        self.seq = np.concatenate([seq, np.arange(top, top + V + FEW)])

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = STEPS[i % V, j % V].astype(np.int64)
        # a place of the cover of the texts that need one is one of the whole as well: texts move by multiples of V
        out = direct(self.seq, i, j, most)
        deep = np.flatnonzero(out == most)
        if len(deep):
            of = np.searchsorted(self.first, i[deep], "right") - 1
            texts = np.unique(of)
            size = self.first[texts + 1] - self.first[texts]
            shift = self.first[texts] % V
            room = -(-(size + shift) // V) * V
            begin = np.cumsum(room) - room
            top = int(self.seq.max()) + 1
            part = np.arange(top, top + int(room.sum()) + V, dtype=np.int64)  # numbers that occur once, where no text is
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            part[np.repeat(begin + shift, size) + within] = self.seq[np.repeat(self.first[texts], size) + within]
            move = (begin + shift - self.first[texts])[np.searchsorted(texts, of)] + out[deep]
            suffixes = SampledSuffixes(part)
            out[deep] += suffixes.extend(i[deep] + move, j[deep] + move)
        return out


def grid(sizes: np.ndarray, first: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the harmonic grid of texts of these sizes: (i, p), about ``most`` at a time."""
    half = sizes // 2
    text = np.repeat(np.arange(len(sizes)), half)
    p = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    count = (sizes[text] - 1) // p
    total = np.cumsum(count)
    at = 0
    while at < len(p):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        own, c = p[at:to], count[at:to]
        k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        each = np.repeat(own, c)
        yield np.repeat(first[text[at:to]], c) + k * each, each
        at = to


def find_runs(word: np.ndarray, bounds: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at least ``least`` words and two periods in texts of word numbers: (text, start, length, period), sorted so."""
    sizes = np.diff(bounds)
    n, texts = len(word), len(sizes)
    first = bounds + np.arange(texts + 1)
    seq = np.empty(n + texts, np.int64)
    top = int(word.max(initial=-1)) + 1
    seq[np.arange(n) + np.repeat(np.arange(texts), sizes)] = word
    seq[first[1:] - 1] = np.arange(top, top + texts)
    pairs = [(i[same], p[same]) for i, p in grid(np.where(sizes >= least, sizes, 0), first[:-1]) for same in [np.flatnonzero(seq[i] == seq[i + p])]]
    i, p = (np.concatenate([x[k] for x in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    right = Extensions(seq, first)(i, i + p)
    # to the left: the same in the mirrored sequence, whose texts begin behind the mirrored numbers that end them
    mirror = seq[::-1]
    moved = np.concatenate([mirror[1:], mirror[:1]]) if texts else mirror
    last = len(seq) - 1
    behind = i - 1
    inside = behind >= np.repeat(first[:-1], np.diff(first))[i] if len(i) else np.zeros(0, bool)
    left = np.zeros(len(i), np.int64)
    x = last - 1 - (behind[inside] + p[inside])
    left[inside] = Extensions(moved, len(seq) - first[::-1])(x, x + p[inside])
    start, length = i - left, p + left + right
    good = (length >= 2 * p) & (length >= least)
    start, length, p = start[good], length[good], p[good]
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    new = np.ones(len(start), bool)  # of one stretch the smallest period
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p = start[new], length[new], p[new]
    order = np.lexsort((length, p, start))
    start, length, p = start[order], length[order], p[order]
    text = np.searchsorted(first, start, "right") - 1
    return text, start - first[text], length, p


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Words of each text joined by blanks."""
    texts = len(bounds) - 1
    size = ends - starts + 1
    filled = bounds[1:] > bounds[:-1]
    size[bounds[1:][filled] - 1] -= 1  # none after a text's last word
    cut = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(starts - cut[:-1], size) + np.arange(cut[-1])
    out = np.concatenate([data, np.zeros(1, np.uint8)])[np.minimum(source, len(data))]
    blank = cut[1:] - 1
    out[np.delete(blank, bounds[1:][filled] - 1)] = 32
    return pa.LargeStringArray.from_buffers(texts, pa.py_buffer(cut[bounds].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, *, text_col: str = "text", least: int = 12) -> DataFrame:
    """``docs`` with columns ``n_words``, ``runs`` (by start, then period) and ``collapsed``.

    A run is a stretch of words with smallest period q, at least ``least`` words and 2 q long, that no neighbouring word
    extends keeping that period.  ``collapsed`` is the text's words, joined by blanks, without those that follow the first
    q words of some run.  Words are told apart by 64-bit hashes and by case.

    A null or empty text has no words, no runs and an empty ``collapsed``.  Bytes that aren't UTF-8 become U+FFFD.  Columns
    of the new names (in any case) are replaced; others, repeated rows and null ids stay.  An empty table gives an empty result.
    """

    def compute(data: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        h, at, starts, ends = shared.token_hashes(data, bounds, shared.WORD_CLASS, shared.SAME, spans=True)
        word = np.unique(h, return_inverse=True)[1]
        text, start, length, period = find_runs(word, at, least)
        marks = np.zeros(len(word) + 1, np.int64)
        np.add.at(marks, at[text] + start + period, 1)
        np.add.at(marks, at[text] + start + length, -1)
        kept = np.cumsum(marks[:-1]) == 0
        runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
        cut = np.searchsorted(text, np.arange(len(at)))
        left = np.concatenate([[0], np.cumsum(kept)])[at]
        return [pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), runs), _collapsed(data, starts[kept], ends[kept], left)]

    return shared.with_text_columns(docs, text_col, RUNS, compute)


def with_loops(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with loops put into the texts of every tenth id by crc32: from word a on, p words repeat.

    With h the crc32 of the decimal id and g = h div 10: a = g mod n and p = 1 + (n - a) div (3 + g mod 8) for n words.
    Other texts, and those of null ids, stay as they are.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    g = F.floor(h / 10)
    names = shared.unused(docs, "words", "a", "p")
    words, a, p = (F.col(f"`{x}`") for x in names)
    hit = (h % 10 == 0) & (shared.strip_blanks(F.col(f"`{text_col}`")) != "")
    n = F.size(words)
    first = F.when(hit, shared.words(F.col(f"`{text_col}`")))
    # whole arrays, no function of each word: an expression inside one would be worked out for each of them
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    looped = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " ")
    out = docs.withColumn(names[0], first).withColumn(names[1], F.when(hit, (g % n).cast("int"))).withColumn(names[2], F.when(hit, 1 + F.floor((n - a) / (3 + g % 8)).cast("int")))
    return out.withColumn(text_col, F.when(hit, looped).otherwise(F.col(f"`{text_col}`"))).drop(*names)
