"""Best-fit packing of token sequences, planned on a histogram of lengths.

Texts are tokenised once and written with, for each piece, its rank among the task's pieces of the same length.  Counts by
task and length give each piece a rank among all pieces of its length.  The plan is made from the counts alone: lengths
from the largest down, each put into the fullest sequences that still hold it, whole runs of equal sequences at a time.
A step of the plan says which ranks of a length go where, so that pieces find their places by length and rank.  The
plan's size is bounded by the capacity (at most 63 * 4 * 2048 steps for 2048 tokens), however many documents there are.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shared

PIECES = "doc_id long, piece int, start long, length long, ids binary, task int, rank long"


#: Letters, digits, the apostrophe and other bytes against signs: no rule of the tokenizer reaches from one to the other,
#: but for signs outside ASCII, whose texts are cut at blanks only.
PART_CLASS = shared.PUNCT_CLASS.copy()
PART_CLASS[ord("'")] = 1
_OTHER_SIGNS = re.compile(r"[^\x00-\x7f\w]")


#: The steps before the model for which ids of parts are ids of texts: blanks are dropped, the case is lowered, letters,
#: digits and signs are cut apart.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _CUT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    ],
}


def by_parts(tokenizer) -> bool:
    """Whether a tokenizer's ids of a text are those of its parts; others encode whole texts."""
    steps = json.loads(tokenizer.to_str())
    return steps["normalizer"] == _NORMALIZER and steps["pre_tokenizer"] == _PRE_TOKENIZER and steps["model"]["type"] == "BPE" and not steps["model"]["dropout"]


class PartMemory:
    """A worker's memory of the ids of distinct parts of texts, by their bytes.

    More than ``most`` parts empty it, which costs time only.  Tokenizers that don't work by parts encode whole texts.
    """

    def __init__(self, path: str, most: int = 1 << 19):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.exact = by_parts(self.tokenizer)
        self.model = self.tokenizer.model
        #: Texts that hold one of these strings go to the tokenizer whole: it cuts them out before anything else.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        # the arrays double as they fill
        self.flat, self.start, self.size, self.used = np.zeros(1 << 12, np.uint32), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), 0

    def _encode(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain = [w.isascii() and w.isalpha() for w in new]  # no normalising or cutting: the model's own words
        rest, sizes = encode_parts(self.tokenizer, [w.decode() for w, p in zip(new, plain, strict=True) if not p])
        cut = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        ids, size, k, rest = [], [], 0, rest.tolist()
        for w, p in zip(new, plain, strict=True):
            if p:
                own = [t.id for t in self.model.tokenize(w.decode())]
            else:
                own = rest[cut[k] : cut[k + 1]]
                k += 1
            ids += own
            size.append(len(own))
        return np.array(ids, np.uint32), np.array(size, np.int32)

    @staticmethod
    def _put(held: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
        if at + len(more) > len(held):
            held = np.concatenate([held[:at], np.zeros(at + 2 * len(more), held.dtype)])
        held[at : at + len(more)] = more
        return held

    def _places(self, parts: list[bytes]) -> list[int]:
        found = list(map(self.known.get, parts))
        if None in found:
            if len(self.known) > self.most:
                self.clear()
            new = list(dict.fromkeys(p for p in parts if p not in self.known))
            flat, size = self._encode(new)
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
            self.start = self._put(self.start, at, (self.used + np.cumsum(size) - size).astype(np.int32))
            self.size, self.flat = self._put(self.size, at, size), self._put(self.flat, self.used, flat)
            self.used += len(flat)
            found = list(map(self.known.__getitem__, parts))
        return found

    def _ids(self, index: np.ndarray, part_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[index].astype(np.int64)
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[index] - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)]
        return ids, np.concatenate([[0], end])[part_bounds]

    def of_parts(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts given as lists of parts, and where each text's begin."""
        index = np.array(self._places([p for own in split for p in own]), np.int64)
        return self._ids(index, np.concatenate([[0], np.cumsum([len(own) for own in split])]))

    def of_tokens(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts as bytes, cut by PART_CLASS; hashes only group equal tokens inside this call."""
        h, at, starts, ends = shared.token_hashes(data, bounds, PART_CLASS, shared.SAME, spans=True)
        _, first, where = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        parts = [raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        return self._ids(np.array(self._places(parts), np.int64)[where], at)


def encode_parts(tokenizer, parts: list[str], at_once: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Ids of parts by the tokenizers library, flat, and the number of each; ``at_once`` parts make one sequence."""
    ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    runs = [parts[i : i + at_once] for i in range(0, len(parts), at_once)]
    for lo in range(0, len(runs), 16):
        for run, e in zip(runs[lo : lo + 16], tokenizer.encode_batch(runs[lo : lo + 16], is_pretokenized=True, add_special_tokens=False), strict=True):
            ids.append(np.array(e.ids, np.int64))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(run)))
    return np.concatenate(ids), np.concatenate(sizes)


@functools.cache
def word_memory(path: str) -> PartMemory:
    """A worker's memory: most parts of a partition are in others as well."""
    return PartMemory(path)


def token_ids(memory: PartMemory, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts and where each text's begin; a null one has none."""
    data, cut = shared.text_bytes(texts)
    raw, n = data.tobytes(), len(texts)
    apart: dict[int, np.ndarray] = {}
    if not memory.exact or any(a.encode() in raw for a in memory.added):
        for i in range(n):
            t = raw[cut[i] : cut[i + 1]].decode()
            if t and (not memory.exact or any(a in t for a in memory.added)):
                apart[i] = np.array(memory.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
    beyond = np.concatenate([[0], np.cumsum(data > 127)])
    odd = [i for i in np.flatnonzero(np.diff(beyond[cut])).tolist() if i not in apart and _OTHER_SIGNS.search(raw[cut[i] : cut[i + 1]].decode())]
    if odd:
        ids, bounds = memory.of_parts([raw[cut[i] : cut[i + 1]].lower().split() for i in odd])  # at \x20 and \x09-\x0D
        apart |= {i: ids[bounds[k] : bounds[k + 1]] for k, i in enumerate(odd)}
    if not apart:
        return memory.of_tokens(shared.FOLD[data], cut)
    usual = np.setdiff1d(np.arange(n), list(apart))
    data, cut = shared.text_bytes(texts.take(pa.array(usual)))
    ids, bounds = memory.of_tokens(shared.FOLD[data], cut)
    own = [ids[:0]] * n
    for k, i in enumerate(usual.tolist()):
        own[i] = ids[bounds[k] : bounds[k + 1]]
    for i, x in apart.items():
        own[i] = x
    return np.concatenate([ids[:0], *own]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def _cut(ids: np.ndarray, bounds: np.ndarray, capacity: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Pieces of texts with their ends: the text, the piece's number, its start, its length, and its ids as bytes."""
    ids = np.insert(ids, bounds[1:], end).astype("<u4")
    size = np.diff(bounds) + 1
    pieces = -(-size // capacity)
    text = np.repeat(np.arange(len(size)), pieces)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * capacity
    length = np.minimum(size[text] - start, capacity)
    at = np.concatenate([[0], 4 * np.cumsum(length)])
    return text, piece, start, length, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())


def _pieces(path: str, capacity: int, end: int):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, ranks, task = word_memory(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            _, bounds = shared.text_bytes(batch.column(1))
            for lo, hi, _, _ in shared.chunks(np.zeros(0, np.uint8), bounds, 4 * shared.CHUNK):
                part = batch.slice(lo, hi - lo)
                text, piece, start, length, ids = _cut(*token_ids(memory, part.column(1)), capacity, end)
                by = np.argsort(length, kind="stable")
                rank = np.empty(len(by), np.int64)
                own = length[by]
                rank[by] = np.arange(len(by)) - np.searchsorted(own, own) + ranks[own]
                ranks += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(text)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), ids, pa.array(np.full(len(text), task, np.int32)), pa.array(rank)], names
                )

    return shared.frugal(run)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, ranks, per sequence, first sequence, offset) of best fit, longest first."""
    room: list[int] = []  # the rooms that open sequences have, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # room: runs (first sequence, sequences)
    steps, opened = [], 0

    def keep(r: int, run: tuple[int, int]) -> None:
        if r and run[1]:
            if r not in open_:
                bisect.insort(room, r)
            open_.setdefault(r, []).append(run)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(room, length)
            if at < len(room):
                r = room[at]
                first, n = open_[r].pop()
                if not open_[r]:
                    del open_[r], room[at]
            else:
                r, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = r // length
            full = min(n, left // each)
            if full:
                steps.append((length, rank, full * each, each, first, capacity - r))
                keep(r - each * length, (first, full))
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer than ``each`` are left
                steps.append((length, rank, left, left, first + full, capacity - r))
                keep(r - left * length, (first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                keep(r, (first + full, n - full))
    return steps


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 0, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Pieces of documents with their places: (doc_id, piece, start, length, ids, sequence_id, offset).

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers.  Each text ends with the id ``end``, so a
    null or empty text is a piece of one token.  Longer texts are cut into pieces of ``capacity`` ids; the last may be
    shorter.  Bytes that aren't UTF-8 become U+FFFD.  Any file of the tokenizers library will do: one that works by parts
    (``by_parts``) remembers them, others encode whole texts.  Rows that repeat an id, and rows with a null id, are packed like others.  Strings of the tokenizer's added
    tokens become those tokens, as in the library.  Parts of a chunk of text are grouped by 64-bit hashes.  Other columns
    are ignored.  An empty table gives no pieces.
    """
    spark = docs.sparkSession
    scratch = shared.Scratch(spark, "pack")
    shared.small_batches(spark)
    pieces = scratch.table(docs.select(shared.quoted(id_col).cast("long").alias("doc_id"), shared.valid_text(shared.quoted(text_col)).alias("text")).mapInArrow(_pieces(tokenizer, capacity, end), PIECES))
    counts = scratch.table(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = counts.select("task", "length", before.alias("before"))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    steps = spark.createDataFrame(plan(totals, capacity), "length long, first long, ranks long, each long, sequence long, at long")
    if counts.count() * 20 <= broadcast_bytes:
        earlier = F.broadcast(earlier)
    ranked = pieces.join(earlier, ["task", "length"]).withColumn("r", F.col("rank") + F.col("before"))
    q = F.col("r") - F.col("first")
    here = (ranked["length"] == steps["length"]) & (F.col("r") >= F.col("first")) & (F.col("r") < F.col("first") + F.col("ranks"))
    return ranked.join(F.broadcast(steps), here).select(
        "doc_id", "piece", "start", ranked["length"], "ids",
        (F.col("sequence") + F.expr("(r - first) div each")).alias("sequence_id"), (F.col("at") + q % F.col("each") * ranked["length"]).alias("offset"),
    )
