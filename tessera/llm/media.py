"""Payloads in PNG columns: chunks with checksums, numpy unfiltering, and a hash of low cosine frequencies."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import shared

SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRID, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray, level: int = 4) -> bytes:
    """An 8-bit greyscale PNG of a (height, width) array, each row with the one of the filters 0 (none), 1 (left) and 2 (up)
    that leaves the least sum of distances from zero."""
    height, width = pixels.shape
    options = np.zeros((3, height, width), np.uint8)
    options[0] = options[1] = options[2] = pixels
    options[1, :, 1:] -= pixels[:, :-1]
    options[2, 1:] -= pixels[:-1]
    kinds = np.minimum(options, np.negative(options)).sum(2, dtype=np.int64).argmin(0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = kinds
    rows[:, 1:] = options[kinds, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Undoes PNG's row filters (0 none, 1 left, 2 up, 3 mean, 4 Paeth) of one-byte pixels."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError(f"row {int((kinds > 4).argmax())} has an unknown filter")
    if (kinds > 2).any():
        return _by_diagonals(kinds, out)
    left = kinds == 1
    if left.any():
        out[left] = np.cumsum(out[left], axis=1, dtype=np.uint8)
    up = kinds == 2
    if up.any():
        # running sums of the differences since the last row that stands for itself
        sums = np.cumsum(np.where(up[:, None], out, 0), axis=0, dtype=np.uint8)
        base = np.maximum.accumulate(np.where(up, -1, np.arange(len(kinds))))
        own = np.where(base[:, None] >= 0, out[base] - sums[base], 0).astype(np.uint8)
        out = np.where(up[:, None], own + sums, out)
    return out


def _by_diagonals(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The same for all five filters: pixels of one diagonal need only those of the two before it."""
    height, width = rows.shape
    out = np.zeros((height + 1, width + 1), np.int32)
    for t in range(height + width - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x = t - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]  # left, above, above on the left
        pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        paeth = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
        out[y + 1, x + 1] = (rows[y, x] + np.choose(kinds[y], (0, a, b, (a + b) >> 1, paeth))) & 255
    return out[1:, 1:].astype(np.uint8)


def decode_png(media: bytes) -> np.ndarray:
    """The (height, width) array of an 8-bit greyscale PNG; every chunk's checksum is tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, head = 8, [], None
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"chunk {kind!r} at {at}: wrong checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale PNG without interlacing")
    width, height = head[:2]
    return unfilter(np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1))


_COSINES = np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(GRID)[None, :] + 1) / (2 * GRID))


def shrink(pixels: np.ndarray) -> np.ndarray:
    """Means over a GRID x GRID grid of about equal cells; a side of fewer pixels repeats them."""
    for axis in (0, 1):
        n = pixels.shape[axis]
        edge = np.arange(GRID + 1) * n // GRID
        if n >= GRID:
            pixels = np.add.reduceat(pixels, edge[:-1], axis, dtype=np.float64) / np.diff(edge).reshape((-1, 1) if axis == 0 else (1, -1))
        else:
            pixels = np.take(pixels, edge[:-1], axis)
    return pixels


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the LOW x LOW lowest cosine frequencies lie above their median (the constant left out)."""
    low = (_COSINES @ shrink(pixels) @ _COSINES.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _payload(text: bytes, width: int) -> np.ndarray:
    padded = text + b"\0" * (-len(text) % width or (width if not text else 0))
    return np.frombuffer(padded, np.uint8).reshape(-1, width)


def to_media(docs: DataFrame, *, text_col: str = "text", width: int = 64) -> DataFrame:
    """``docs`` with binary column ``media``: the text's UTF-8 bytes, zeros up to whole rows, as a PNG; ``n_bytes`` unpadded.

    A null or empty text is one row of zeros; bytes that aren't UTF-8 become U+FFFD.  Columns of these names, in any case, are
    replaced, ``text_col`` and others stay.
    Repeated rows and rows without an id are stored like others.  An empty table gives an empty result.
    """

    def stored(texts: list[str | None]) -> list[pa.Array]:
        raw = [(t or "").encode() for t in texts]
        return [pa.array([len(t) for t in raw], pa.int64()), pa.array([encode_png(_payload(t, width)) for t in raw], pa.binary())]

    return shared.with_columns(docs, text_col, "n_bytes long, media binary", shared.by_rows(stored, 512), text=True)


def read_media(frame: DataFrame, *, media_col: str = "media") -> DataFrame:
    """``frame`` with binary columns ``payload`` (the samples read back) and ``feature`` (the cosine hash).

    A null medium gives nulls; a damaged one (wrong signature, checksum or filter) stops the job.  Columns of these names,
    in any case, are replaced, others and repeated rows stay.  An empty table gives an empty result.
    """

    def read(media: list[bytes | None]) -> list[pa.Array]:
        images = [None if m is None else decode_png(m) for m in media]
        return [pa.array([None if x is None else f(x) for x in images], pa.binary()) for f in (np.ndarray.tobytes, cosine_hash)]

    return shared.with_columns(frame, media_col, "payload binary, feature binary", shared.by_rows(read, 512))
