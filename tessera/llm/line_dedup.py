"""Line deduplication through a sharded minimal perfect hash.

A line's key is the line without blanks at its ends, A-Z lower-cased.  Keys of at least ``min_chars`` code points that at
least ``min_docs`` documents hold are frequent; all their lines go except those in the largest document id that holds them.

Key hashes (128 bits) are counted by document.  The frequent ones are dealt to shards of about ``shard_keys`` keys, and
each shard gets a minimal perfect hash: cascaded bit arrays in which a key that hits a place alone owns it, ranked by the
bits before it.  Places are taken from both halves of a key, so keys that share a half part at some level.  The rank indexes
arrays of 64-bit fingerprints, counts and document ids, about 22 bytes a key.
Documents probe these arrays; no line is joined.  Up to ``broadcast_bytes`` the shards go to every task; beyond it, line
hashes are dealt to (shard, part) groups of bounded size and probe the one shard that they meet there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import shared

_BITS = np.array([bin(i).count("1") for i in range(256)], np.int64)
_SEED = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """A minimal perfect hash over distinct keys of two 64-bit halves."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]]):
        self.levels = levels  # (number of places, packed bits, keys before each byte)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        levels, before = [], 0
        while len(high):
            m = (2 * len(high) + 7) // 8 * 8
            at = cls._place(high, low, len(levels), m)
            alone = np.bincount(at, minlength=m) == 1
            packed = np.packbits(alone, bitorder="little")
            held = _BITS[packed]
            levels.append((m, packed, (before + np.cumsum(held) - held).astype(np.int64)))
            before += int(held.sum())
            high, low = high[~alone[at]], low[~alone[at]]
        return cls(levels)

    @staticmethod
    def _place(high: np.ndarray, low: np.ndarray, level: int, m: int) -> np.ndarray:
        step = np.uint64(int(_SEED) * (level + 1) % (1 << 64))
        return (shared.mix(shared.mix(high + step) + low) % np.uint64(m)).astype(np.int64)

    def __call__(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The index of each key; -1, or that of another key, for a key that wasn't built in."""
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for level, (m, packed, before) in enumerate(self.levels):
            at = self._place(high[left], low[left], level, m)
            byte, bit = packed[at >> 3], at & 7
            hit = (byte >> bit.astype(np.uint8)) & 1 > 0
            earlier = byte & ((1 << bit) - 1).astype(np.uint8)
            out[left[hit]] = (before[at >> 3] + _BITS[earlier])[hit]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *(m for m, _, _ in self.levels)], np.int64).tobytes()
        return head + b"".join(p.tobytes() + b.tobytes() for _, p, b in self.levels)

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        sizes = np.frombuffer(blob, np.int64, n, 8)
        at, levels = 8 + 8 * n, []
        for m in map(int, sizes):
            levels.append((m, np.frombuffer(blob, np.uint8, m // 8, at), np.frombuffer(blob, np.int64, m // 8, at + m // 8)))
            at += m // 8 + m
        return cls(levels)


class Shard:
    """A shard's perfect hash with its arrays."""

    def __init__(self, row):
        self.hash = PerfectHash.load(row["hash"])
        self.marks, self.docs = np.frombuffer(row["fingerprints"], np.int64), np.frombuffer(row["documents"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.int64)

    def keeper(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are frequent, the document that keeps each of those, and how many documents hold it."""
        if not len(self.marks):
            return np.zeros(len(h1), bool), np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        at = self.hash(h1.view(np.uint64), h2.view(np.uint64))
        known = (at >= 0) & (self.marks[at] == h2)
        return known, self.docs[at], self.counts[at]


INDEX = "shard long, keys long, hash binary, fingerprints binary, counts binary, documents binary"


def _build(table: pa.Table) -> pa.Table:
    h1, h2, n, doc = (table.column(c).to_numpy() for c in ("h1", "h2", "n", "doc"))
    table_hash = PerfectHash.build(h1.view(np.uint64), h2.view(np.uint64))
    at = table_hash(h1.view(np.uint64), h2.view(np.uint64))
    place = lambda x: [x[np.argsort(at)].astype(np.int64).tobytes()]
    return pa.table({"shard": [table.column("shard")[0].as_py()], "keys": [len(h1)], "hash": [table_hash.dump()], "fingerprints": place(h2), "counts": place(n), "documents": place(doc)})


def _lines(text: bytes, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines of a text; of those with keys of enough code points, the numbers and the key hashes."""
    lines = text.split(b"\n")
    at, keys = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip().lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                at.append(i)
                keys.append(xxhash.xxh3_128_digest(key))
    return lines, at, keys


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = dict.fromkeys(_lines((text.as_py() or "").encode(), min_chars)[2])
                ids += [doc] * len(own)
                keys += own
            h1, h2 = _hashes(keys)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h1), pa.array(h2)], ["doc", "h1", "h2"])

    return shared.frugal(run)


def drop_frequent_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, shard_keys: int = 1 << 16, broadcast_bytes: int = 32 << 20
) -> DataFrame:
    """``docs`` with frequent lines dropped from ``text_col``, and with columns ``n_lines`` (before), ``n_dropped`` and ``most_docs``, the
    number of documents that hold the most frequent of its dropped lines (0 if none is dropped).

    Columns of these three names, in any case, are replaced; all others stay.  A null text is one empty line and becomes an
    empty text; bytes that aren't UTF-8 become U+FFFD.  Rows that repeat an id count as one document.  Rows with a null id
    aren't counted and lose nothing.  Two lines are the same when 128-bit hashes of their keys are; a line whose key
    isn't frequent is taken for a frequent one only if it lands on its place and has its 64-bit fingerprint.  Of equal lines
    in the document that keeps them all stay.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    scratch = shared.Scratch(spark, "lines")
    new = ("n_lines", "n_dropped", "most_docs")
    kept = shared.others(docs, text_col, *new)
    # by number: the caller's names may be anything
    rows = docs.select(
        *(shared.quoted(f).alias(f"c{i}") for i, f in enumerate(kept)), shared.valid_text(shared.quoted(text_col)).alias("text"), shared.quoted(id_col).cast("long").alias("id")
    )
    found = rows.where(F.col("id").isNotNull()).select("id", "text").mapInArrow(_line_hashes(min_chars), "doc long, h1 long, h2 long")
    by_doc = found.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    frequent = scratch.table(by_doc.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("doc")).where(F.col("n") >= min_docs))
    shards = max(1, -(-frequent.count() // shard_keys))
    shard = F.pmod("h1", F.lit(shards)).alias("shard")
    index = scratch.table(frequent.select(shard, "*").groupBy("shard").applyInArrow(_build, INDEX))
    size = index.agg(F.coalesce(F.sum(F.octet_length("hash") + 24 * F.col("keys")), F.lit(0))).first()[0]
    schema = StructType([*rows.schema.fields[: len(kept)], *StructType.fromDDL("text string, n_lines long, n_dropped long, most_docs long").fields])
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast([r.asDict() for r in index.orderBy("shard").collect()])
        out = rows.mapInArrow(_prune(min_chars, held, shards, schema.names), schema)
    else:
        hits = _hits(found, index, shards)
        out = rows.join(hits, rows["id"] == hits["doc"], "left").drop("doc").mapInArrow(_prune(min_chars, None, shards, schema.names), schema)
    return out.toDF(*kept, text_col, *new)


def _hits(found: DataFrame, index: DataFrame, shards: int, most: int = 1 << 20) -> DataFrame:
    """(doc, hits): the keys of a document whose lines go, as pairs of halves with their counts, found shard by shard."""
    keyed = found.select("doc", "h1", "h2", F.pmod("h1", F.lit(shards)).alias("shard"))
    parts = keyed.groupBy("shard").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = keyed.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts"))).drop("parts")
    copies = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("part", F.col("part").cast("long")).drop("parts")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, h1, h2 = (left.column(c).to_numpy() for c in ("doc", "h1", "h2"))
        gone, held = np.zeros(len(doc), bool), np.zeros(len(doc), np.int64)
        for row in right.to_pylist():
            known, keeper, counts = Shard(row).keeper(h1, h2)
            mine = known & (keeper != doc)
            gone |= mine
            held[mine] = counts[mine]
        return pa.table({"doc": doc[gone], "h1": h1[gone], "h2": h2[gone], "n": held[gone]})

    hit = dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(probe, "doc long, h1 long, h2 long, n long")
    return hit.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2", "n")).alias("hits"))


def _prune(min_chars: int, held, shards: int, names: list[str]):
    """Drops lines: by probing the shards in ``held``, or by the column ``hits``.  Batches end with text, id and perhaps hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = [(r["shard"], Shard(r)) for r in held.value] if held else None
        for batch in batches:
            kept = batch.columns[: len(names) - 4]
            text, ids = batch.columns[len(kept) : len(kept) + 2]
            split = [_lines((t.as_py() or "").encode(), min_chars) for t in text]
            owner = np.repeat(np.arange(len(split)), [len(s[1]) for s in split])
            h1, h2 = _hashes([k for s in split for k in s[2]])
            gone, counts = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
            none = ids.is_null().to_numpy(zero_copy_only=False)
            own = ids.fill_null(0).to_numpy()
            if index is not None:
                at = np.mod(h1, shards)
                for k, shard in index:
                    mine = np.flatnonzero(at == k)
                    known, keeper, counts[mine] = shard.keeper(h1[mine], h2[mine])
                    gone[mine] = known & (keeper != own[owner[mine]]) & ~none[owner[mine]]
            else:
                lost = [{(y["h1"], y["h2"]): y["n"] for y in x or ()} for x in batch.columns[-1].to_pylist()]
                for j, (i, h) in enumerate(zip(owner.tolist(), zip(h1.tolist(), h2.tolist(), strict=True), strict=True)):
                    counts[j] = lost[i].get(h, 0)
                gone = counts > 0
            texts, dropped, most, at = [], [], np.zeros(len(split), np.int64), 0
            np.maximum.at(most, owner[gone], counts[gone])
            for lines, numbers, _ in split:
                out = {i for i, g in zip(numbers, gone[at : at + len(numbers)], strict=True) if g}
                at += len(numbers)
                dropped.append(len(out))
                texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in out) if out else b"\n".join(lines))
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(texts, pa.binary()).cast(pa.string()), pa.array([len(s[0]) for s in split], pa.int64()), pa.array(dropped, pa.int64()), pa.array(most)], names
            )

    return shared.frugal(run)
