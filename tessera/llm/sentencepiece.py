"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed here.  Its normaliser (character map, extra blanks, dummy prefix, the marker for blanks) and its
model (unigram scores, or pairs to merge in the order of scores) become a tokenizer with byte fallback.  Batches of whole
texts are encoded in multithreaded calls; where no pair reaches from one word to the next (``word_pattern``), batches of the words
that a worker hasn't met, and a text's ids are those of its words.  Parity is verified by encoding the whole texts with the original library.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import packing, shared

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; numbers of fixed size stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file holds (field numbers are those of the published message definition)."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 pair merges
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_blanks: bool = True
    mark_blanks: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                model.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                model.kind, model.byte_fallback = own.get(3, 1), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                model.charsmap = own.get(2, b"")
                model.dummy_prefix, model.strip_blanks, model.mark_blanks = (bool(own.get(i, 1)) for i in (3, 4, 5))
        return model

    def merges(self) -> list[tuple[str, str]]:
        """The pairs of pieces that make a piece, best score first, then from left to right."""
        rank = {p: (-s, i) for i, (p, s, t) in enumerate(self.pieces) if t == NORMAL}
        found = [(rank[p], i, p[:i], p[i:]) for p in rank for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank]
        return [(a, b) for _, _, a, b in sorted(found)]


def build(model: Model):
    """A tokenizer of the tokenizers library for a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = next(i for i, (_, _, t) in enumerate(model.pieces) if t == UNKNOWN)
    if model.kind == 1:
        low = min(s for _, s, _ in model.pieces)
        scores = [(p, s if t in (NORMAL, BYTE, UNKNOWN) else low - 100) for p, s, t in model.pieces]
        tokenizer = Tokenizer(models.Unigram(scores, unknown, model.byte_fallback))
    else:
        tokenizer = Tokenizer(models.BPE(vocab, model.merges(), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    user = [AddedToken(p, normalized=True, special=False) for p, _, t in model.pieces if t == USER]
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.strip_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.mark_blanks:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    if user:
        tokenizer.add_tokens(user)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    tokenizer.encode_special_tokens = True
    return tokenizer


def word_pattern(model: Model) -> re.Pattern[str] | None:
    """Words whose ids, one after another, are those of the text; None if the model doesn't promise that.

    Every merge makes a piece, so none reaches over a place where no piece could lie.  A word is a run of signs that pieces join, with the
    marks before it; marks alone; or a run of other signs, which are pieces of their own or bytes.
    """
    plain = [p for p, _, t in model.pieces if t == NORMAL]
    unsure = model.kind != 2 or model.charsmap or model.strip_blanks or not model.mark_blanks or any(t == USER for _, _, t in model.pieces)
    # without all bytes, unknown signs of neighbours become one id
    if unsure or not model.byte_fallback or sum(t == BYTE for _, _, t in model.pieces) < 256 or any(re.search(f"[^{MARK}]{MARK}", p) for p in plain):
        return None
    joined = re.escape("".join(sorted({c for p in plain if len(p) > 1 for c in p} - {MARK})))
    return re.compile(f"{MARK}*[{joined}]+|{MARK}+|[^{MARK}{joined}]+" if joined else f"{MARK}+|[^{MARK}]+")


class WordMemory:
    """A worker's memory of the ids of distinct words.  More than ``most`` signs, counting 16 more for each word, empty it, which costs time only."""

    def __init__(self, model: Model, pattern: re.Pattern[str], most: int = 1 << 23):
        self.tokenizer, self.prefix, self.pattern, self.most = build(model), MARK * model.dummy_prefix, pattern, most
        self.tokenizer.normalizer = None  # words are cut from normalised texts
        self.ids = list(range(len(model.pieces)))  # one object for each id
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        words = [self.pattern.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        if self.held > self.most:
            self.known, self.held = {}, 0
        new = list(set(chain.from_iterable(words)).difference(self.known))
        flat, sizes = packing.encode_parts(self.tokenizer, new)
        flat, end = [self.ids[i] for i in flat.tolist()], np.cumsum(sizes).tolist()
        self.known.update(zip(new, (tuple(flat[a:b]) for a, b in zip([0, *end], end)), strict=True))
        self.held += sum(map(len, new)) + 16 * len(new)
        return [list(chain.from_iterable(map(self.known.__getitem__, own))) for own in words]


class Encoder:
    """Encodes batches of whole texts in ``threads`` threads; with ``parity``, also by the original library."""

    def __init__(self, model_file: str, parity: bool, threads: int):
        # read by the library's thread pool when it is first used; an encoder is made before that
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = str(threads > 1).lower(), str(threads)
        with open(model_file, "rb") as f:
            model = Model.parse(f.read())
        pattern = word_pattern(model)
        self.words, self.tokenizer = (WordMemory(model, pattern), None) if pattern else (None, build(model))
        self.threads, self.reference = threads, None
        if parity:
            from sentencepiece import SentencePieceProcessor

            self.reference = SentencePieceProcessor(model_file=model_file)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """The ids of each text, and whether the original library gives the same for the whole text."""
        ids = self.words.encode(texts) if self.words else [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if not self.reference:
            return ids, []
        return ids, [a == b for a, b in zip(ids, self.reference.encode(texts, num_threads=self.threads), strict=True)]


@functools.cache
def encoder(model_file: str, parity: bool, threads: int) -> Encoder:
    """A worker's encoder."""
    return Encoder(model_file, parity, threads)


class Decoder:
    """Texts from ids: the bytes of pieces, joined.  Bytes that aren't UTF-8 are left to the tokenizers library."""

    def __init__(self, model_file: str):
        with open(model_file, "rb") as f:
            self.model = Model.parse(f.read())
        self.tokenizer = build(self.model)
        self.table = [bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, _, t in self.model.pieces]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.table.__getitem__, ids))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


@functools.cache
def decoder(model_file: str) -> Decoder:
    """A worker's decoder."""
    return Decoder(model_file)


def encode(docs: DataFrame, model_file: str, *, text_col: str = "text", parity: bool = False, threads: int = 2) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and, with ``parity``, ``parity``: the original library gives the same ids.

    Null and empty texts have no ids; bytes that aren't UTF-8 become U+FFFD.  Columns of these names, in any case, are replaced, all others and repeated rows stay.  An
    empty table gives an empty result.
    """

    def encoded(texts: list[str | None]) -> list[pa.Array]:
        ids, same = encoder(model_file, parity, threads).encode([t or "" for t in texts])
        return [pa.array(ids, pa.list_(pa.int32())), *([pa.array(same, pa.bool_())] if parity else [])]

    return shared.with_columns(docs, text_col, "ids array<int>" + ", parity boolean" * parity, shared.by_rows(encoded, 128), text=True)


def decode(frame: DataFrame, model_file: str, *, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``frame`` with the string column ``into``: the text of ``ids_col``.  Null ids give null, no ids the empty text.

    A column of that name, in any case, is replaced, others and repeated rows stay.  An empty table gives an empty result.
    """

    def decoded(batch: pa.RecordBatch, column: pa.ListArray) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        own = decoder(model_file)
        for lo in range(0, len(batch), 512):
            part = column.slice(lo, 512)
            # the items of all lists at once: Arrow's own turn into Python values takes one after another
            flat, texts, at = part.flatten().to_numpy().tolist(), [], 0
            for n in part.value_lengths().to_pylist():
                texts.append(None if n is None else own.decode(flat[at : at + n]))
                at += n or 0
            yield batch.slice(lo, 512), [pa.array(texts, pa.string())]

    return shared.with_columns(frame, ids_col, f"`{into}` string", decoded)
