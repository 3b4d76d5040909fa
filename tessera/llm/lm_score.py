"""Language-model scores by prediction by partial matching over bytes.

A text is modelled as its words, A-Z lower-cased, with one space between them and one end sign (a line feed) after them,
as UTF-8.  The pretrained model is a trie of byte contexts of up to ``order`` bytes with the counts of the bytes that
followed them in all training texts.  Counting excludes symbols: a shorter context counts a byte once for each longer
context in which it is new.  Of a context's count, a discount for each symbol goes to the escape; the discounts of
symbols counted once, twice, and more often are estimated for each order from the numbers of symbols counted 1 to 4 times.

With E the symbols of a context, q the next shorter context's distribution and m = q(E), a symbol outside E has the probability

    escape * q(symbol) / (1 - m),    escape = discounts / count * (1 - m)

that is, the escape leads to the shorter context from which E is excluded; and one of E has its own discounted share plus
its part of the rest, discounts / count * q(symbol).  As 1 - m cancels, both are sums over orders down to a uniform choice
of 256 bytes.  A text's score is the log10 of its probability.

Counts of all (order + 1)-grams and words are reduced inside tasks and then by key.  The grams of one three-byte context,
from which all longer contexts follow, lie in one shard; contexts of up to two bytes have at most 2**24 grams and are known
to every shard.  Every task knows the probabilities of the most frequent grams, up to ``hot_grams``.  All other grams of a
chunk of texts go to their shards, packed, and come back as sums for each text.  Words are looked up likewise.  Chunks are
written once with their texts' ids, so that nothing depends on the order of rows in a second scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared

END = shared.mix(np.array([1], np.uint64))[0]
WORD, GRAM = 0, 1
#: Words that every task knows the counts of, at most; the rest is looked up in shards.
HOT_WORDS = 1 << 16
#: Bytes of context that decide on the shard; shorter contexts are known to all shards.
LOCAL = 3


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def _normal_texts(part: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw = part.tobytes()
    return [b" ".join(raw[a:b].lower().split()) + b"\n" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-grams that end at each byte of each text, as numbers, and where each text's begin."""
    pad = b"\n" * order
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    code = np.zeros(len(data), np.uint64)
    for j in range(order + 1):
        code[j:] |= data[: len(data) - j].astype(np.uint64) << np.uint64(8 * j)
    bounds = np.concatenate([[0], np.cumsum(size)])
    keep = np.ones(len(data), bool)
    starts = bounds[:-1] + order * np.arange(len(texts))
    keep[(starts[:, None] + np.arange(order)[None, :]).ravel()] = False
    return code[keep], bounds


def low_bytes(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def _find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return at, sorted_[at] == keys


# ------------------------------------------------------------------ counts
def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _counts(order: int, most: int = 1 << 21):
    """(kind, key, n) of a partition's words and grams; more than ``most`` different ones are passed on before the end."""

    def rows(kind: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, n = parts[0]
        for lo in range(0, len(keys), 1 << 16):
            k = keys[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[lo : lo + (1 << 16)])], ["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORD: [], GRAM: []}
        docs = 0
        for batch in batches:
            data, bounds = shared.text_bytes(batch.column(0))
            for lo, hi, part, at in shared.chunks(data, bounds, 4 * shared.CHUNK):
                docs += hi - lo
                held[GRAM].append(np.unique(grams(_normal_texts(part, at), order)[0], return_counts=True))
                for _, _, small, cut in shared.chunks(part, at):
                    held[WORD].append(np.unique(shared.token_hashes(small, cut)[0], return_counts=True))
                for kind, parts in held.items():
                    if len(parts) > 12:
                        held[kind] = [_merge(parts)]
                        if len(held[kind][0][0]) > most:
                            yield from rows(kind, held[kind])
                            held[kind] = []
        held[WORD].append((np.array([END], np.uint64), np.array([docs])))
        for kind, parts in held.items():
            if parts:
                yield from rows(kind, [_merge(parts)])

    return shared.frugal(run)


def _threshold(counts: DataFrame, kind: int, most: int) -> int:
    """The least n such that at most ``most`` keys of a kind are counted n times or more (n up to 65536 is told apart)."""
    by = counts.where(F.col("kind") == kind).groupBy(F.least("n", F.lit(65536)).alias("n")).count().collect()
    left = most
    for r in sorted(by, key=lambda r: -r.n):
        left -= r["count"]
        if left < 0:
            return r.n + 1
    return 1


# ------------------------------------------------------------------ trie
def levels(codes: np.ndarray, counts: np.ndarray, order: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, grams of k context bytes, counts) for k from ``order`` down to ``last``."""
    for k in range(order, last - 1, -1):
        if k < order:
            codes, counts = np.unique(codes & low_bytes(k + 1), return_counts=True)
        yield k, codes, counts


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def discounts(n: np.ndarray) -> np.ndarray:
    """What symbols counted 0, 1, 2, 3 or more times give to the escape, from the numbers of those counted 1 to 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return np.array([0.0, *(np.clip(i - (i + 1) * y * n[i] / n[i - 1], 0.05, i - 0.05) if n[i - 1] else 0.5 for i in (1, 2, 3))])


class Trie:
    """Probabilities of known grams and escapes of known contexts, level by level, as sorted arrays."""

    def __init__(self, counted: list[tuple[int, np.ndarray, np.ndarray]], off: dict[int, np.ndarray], below: Trie | None = None):
        """``counted``: levels from the longest contexts down; ``off``: discounts by level; ``below``: the shorter contexts."""
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        rest = list(below.levels) if below else []
        for k, codes, counts in reversed(counted):
            lost = off[k][np.minimum(counts, 3)]
            contexts, at = np.unique(codes >> np.uint64(8), return_inverse=True)
            total = np.bincount(at, counts, len(contexts))
            escape = np.bincount(at, lost, len(contexts)) / total
            shorter = rest[0][2][np.searchsorted(rest[0][1], codes & low_bytes(k))] if rest else 1 / 256
            rest.insert(0, (k, codes, (counts - lost) / total[at] + escape[at] * shorter, contexts, np.log10(escape)))
        self.levels = rest

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it."""
        out, left, spent = np.zeros(len(codes)), np.arange(len(codes)), np.zeros(len(codes))
        for k, known, p, contexts, escape in self.levels:
            code = codes[left] & low_bytes(k + 1)
            at, seen = _find(known, code)
            out[left[seen]] = spent[seen] + np.log10(p[at[seen]])
            left, spent, code = left[~seen], spent[~seen], code[~seen]
            at, here = _find(contexts, code >> np.uint64(8))
            spent[here] += escape[at[here]]
        out[left] = spent - np.log10(256)
        return out


def _shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    context = (codes >> np.uint64(8)) & low_bytes(LOCAL)
    return ((((context * np.uint64(2654435761)) & np.uint64((1 << 40) - 1)) >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)


def _shard_column(shards: int) -> Column:
    """The same for the column ``key``."""
    context = F.shiftright("key", 8).bitwiseAND(int(low_bytes(LOCAL)))
    return (F.shiftright((context * 2654435761).bitwiseAND((1 << 40) - 1), 8) % shards).alias("shard")


TRIES = "shard long, codes binary, counts binary, singles array<long>, shorter array<struct<code: long, n: long>>"


def _pack_grams(order: int):
    def pack(table: pa.Table) -> pa.Table:
        codes, counts = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
        by = np.argsort(codes)
        codes, counts = codes[by], counts[by]
        singles = []
        for _, own, n in levels(codes, counts, order, LOCAL):
            singles += counts_of_counts(n).tolist()
        code, n = np.unique(own & low_bytes(LOCAL), return_counts=True)
        shorter = [{"code": c, "n": x} for c, x in zip(code.tolist(), n.tolist(), strict=True)]
        return pa.table({"shard": [table.column("shard")[0].as_py()], "codes": [codes.tobytes()], "counts": [counts.astype(np.int64).tobytes()], "singles": [singles], "shorter": pa.array([shorter], pa.list_(pa.struct([("code", pa.int64()), ("n", pa.int64())])))})

    return pack


def _pack_words(table: pa.Table) -> pa.Table:
    key, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    by = np.argsort(key)
    return pa.table({"shard": [table.column("shard")[0].as_py()], "codes": [key[by].tobytes()], "counts": [n[by].astype(np.int64).tobytes()]})


class Shards:
    """The trie in shards of about ``size`` grams, and what all of them share."""

    def __init__(self, scratch: shared.Scratch, counts: DataFrame, order: int, rows: int, size: int):
        self.order, self.shards = order, max(1, -(-rows // size))
        grams_ = counts.where(F.col("kind") == GRAM).select(_shard_column(self.shards), "key", "n")
        self.table = scratch.table(grams_.groupBy("shard").applyInArrow(_pack_grams(order), TRIES))
        singles = np.zeros((order - LOCAL + 1) * 4, np.int64)
        for r in self.table.select(F.posexplode("singles").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():  # four for each order
            singles[r.i] = r.n
        off = {order - i: discounts(n) for i, n in enumerate(singles.reshape(-1, 4))}
        below = self.table.select(F.inline("shorter")).groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most 2**24 rows, whatever the input
        code, n = below.column("code").to_numpy().view(np.uint64), below.column("n").to_numpy()
        by = np.argsort(code)
        counted = list(levels(code[by], n[by], LOCAL - 1, 0))
        off |= {k: discounts(counts_of_counts(x)) for k, _, x in counted}
        self.off, self.below = off, Trie(counted, off)

    def trie(self, codes: bytes, counts: bytes) -> Trie:
        return Trie(list(levels(np.frombuffer(codes, np.uint64), np.frombuffer(counts, np.int64), self.order, LOCAL)), self.off, self.below)


class _Opener:
    """What a task needs to open shards; small beside ``Shards``, which holds tables."""

    def __init__(self, of: Shards):
        self.order, self.off, self.below = of.order, of.off, of.below

    trie = Shards.trie


def _hot(opener, least: int):
    """(key, log10) of the grams counted ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opener.value
        for batch in batches:
            for row in batch.to_pylist():
                trie = own.trie(row["codes"], row["counts"])
                _, codes, p, _, _ = trie.levels[0]
                often = np.frombuffer(row["counts"], np.int64) >= least
                yield pa.RecordBatch.from_arrays([pa.array(codes[often].view(np.int64)), pa.array(np.log10(p[often]))], ["key", "log10"])

    return shared.frugal(run)


# ------------------------------------------------------------------ scores
def _is_held_out(doc_id: Column, fold: int, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


ASKED = pa.struct([("kind", pa.int32()), ("shard", pa.int64()), ("n", pa.int64()), ("rows", pa.binary()), ("keys", pa.binary())])
CHUNKS = (
    "chunk long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, known array<long>, base array<double>, score array<double>, "
    "asked array<struct<kind: int, shard: long, n: long, rows: binary, keys: binary>>"
)


def _asked(kind: int, shard: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> list[dict]:
    """What a chunk asks of each shard: the row numbers of its unknown keys, and the keys."""
    by = np.lexsort((keys, shard))
    shard, rows, keys = shard[by], rows[by].astype("<u4"), keys[by]
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    edge = [*first.tolist(), len(shard)]
    return [{"kind": kind, "shard": int(shard[a]), "n": b - a, "rows": rows[a:b].tobytes(), "keys": keys[a:b].tobytes()} for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _chunks(order: int, shards: int, word_shards: int, hot):
    """A row for each chunk of texts: what its texts score by what every task knows, and what it asks of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, logs, words, word_logs = hot.value
        chunk, end = TaskContext.get().partitionId() << 32, int(np.searchsorted(words, END))
        for batch in batches:
            data, bounds = shared.text_bytes(batch.column(2))
            for lo, hi, part, at in shared.chunks(data, bounds, 4 * shared.CHUNK):
                n = hi - lo
                code, cut = grams(_normal_texts(part, at), order)
                distinct, where = np.unique(code, return_inverse=True)
                place, seen = _find(codes, distinct)
                score = np.add.reduceat(np.where(seen, logs[place], 0.0)[where] if len(logs) else np.zeros(len(code)), cut[:-1])
                rest = np.flatnonzero(~seen[where])
                asked = _asked(GRAM, _shard_of(code[rest], shards), np.searchsorted(cut, rest, "right") - 1, code[rest])
                tokens, known, base, unknown = [], [], [], ([], [])
                for first, after, small, small_at in shared.chunks(part, at):
                    h, cut = shared.token_hashes(small, small_at)
                    place, seen = _find(words, h)
                    own = np.repeat(np.arange(after - first), np.diff(cut))
                    tokens.append(np.diff(cut) + 1)
                    known.append(np.bincount(own[seen], minlength=after - first))
                    base.append(np.bincount(own[seen], word_logs[place[seen]], after - first) + word_logs[end])
                    unknown[0].append(own[~seen] + first)
                    unknown[1].append(h[~seen])
                rows, keys = (np.concatenate(x) for x in unknown)
                asked += _asked(WORD, np.mod(shared.signed(keys), word_shards), rows, keys)
                one = [0, n]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk]), *(pa.ListArray.from_arrays(pa.array(one, pa.int32()), batch.column(i).slice(lo, n)) for i in (0, 1)),
                        *(shared.lists(np.concatenate(x), one) for x in (tokens, known, base)), shared.lists(score, one), pa.array([asked], pa.list_(ASKED)),
                    ],
                    ["chunk", "doc_id", "held_out", "n_tokens", "known", "base", "score", "asked"],
                )
                chunk += 1

    return shared.frugal(run)


def _answers(asked: DataFrame, table: DataFrame, answer, most: int = 1 << 21) -> DataFrame:
    """(chunk, rows, values, known): sums for the texts of each chunk.  A shard that is asked for many keys is copied to
    several groups of about ``most`` keys."""
    parts = asked.groupBy("shard").agg(F.ceil(F.sum("n") / most).cast("int").alias("parts"))
    dealt = asked.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("chunk"), F.col("parts"))).drop("parts")
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("to_part")
    copies = parts.join(table.select("shard", "codes", "counts"), "shard", "left").select(F.col("shard").alias("to_shard"), places, "codes", "counts")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        own = right.to_pylist()[0]
        value = answer(own["codes"] or b"", own["counts"] or b"")
        out: list[tuple] = []
        for row in left.to_pylist():  # none where the shard's keys fell to other parts
            rows, at = np.unique(np.frombuffer(row["rows"], "<u4"), return_inverse=True)
            keys, where = np.unique(np.frombuffer(row["keys"], np.uint64), return_inverse=True)
            logs, known = value(keys)
            out.append((row["chunk"], rows.tobytes(), np.bincount(at, logs[where]).tobytes(), np.bincount(at, known[where]).astype(np.int64).tobytes()))
        names, kinds = ("chunk", "rows", "values", "known"), (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return dealt.groupBy("shard", "part").cogroup(copies.groupBy("to_shard", "to_part")).applyInArrow(probe, "chunk long, rows binary, values binary, known binary")


def _texts(missing_end: int):
    """The rows of documents from chunks and their answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                get = lambda name: batch.column(name).slice(row, 1).flatten()  # noqa: B023, E731
                known, base, score = (get(c).to_numpy().copy() for c in ("known", "base", "score"))
                for a in batch.column("answers")[row].as_py() or []:
                    at, values = np.frombuffer(a["rows"], "<u4"), np.frombuffer(a["values"])
                    if a["kind"] == GRAM:
                        score[at] += values
                    else:
                        base[at] += values
                        known[at] += np.frombuffer(a["known"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [get("doc_id"), get("held_out"), get("n_tokens"), pa.array(known + 1 - missing_end), pa.array(np.round(base, 9)), pa.array(np.round(score, 9))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
                )

    return shared.frugal(run)


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 6, fold: int = 1, folds: int = 5, hot_grams: int = 2_000_000, shard_grams: int = 500_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document.

    Documents whose crc32 of the id as text leaves ``fold`` modulo ``folds`` are held out; all others train.
    ``base_score`` is that of a unigram word model with half a count added; tokens are words and one end.
    A null or empty text is one end.  A null id trains.  Repeated rows count and are scored each time; equal texts have
    equal scores, whether they are held out or not.  Other columns are ignored.  An empty table gives an empty result.
    Words are told apart by 64-bit hashes, grams by their bytes.  ``order`` is 3 to 7.
    """
    if not LOCAL <= order <= 7:
        raise ValueError("order must be 3 to 7")
    spark = docs.sparkSession
    scratch = shared.Scratch(spark, "lm")
    shared.small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.select("doc_id", _is_held_out(F.col("doc_id"), fold, folds).alias("held_out"), "text")
    counted = docs.where(~F.col("held_out")).select("text").mapInArrow(_counts(order), "kind int, key long, n long")
    counts = scratch.table(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    size = {r.kind: r for r in counts.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    tokens, distinct = (size[WORD].n, size[WORD].rows) if WORD in size else (0, 0)
    norm, end = tokens + 0.5 * (distinct + 1), int(END.view(np.int64))
    word_log = lambda n: np.log10((n + 0.5) / norm)

    words = counts.where((F.col("kind") == WORD) & (F.col("key") != end)).select("key", "n")
    ends = counts.where((F.col("kind") == WORD) & (F.col("key") == end)).collect()
    often = words.where(F.col("n") >= _threshold(counts, WORD, HOT_WORDS)).toArrow()  # at most HOT_WORDS rows
    word_keys = np.append(often.column("key").to_numpy(), end).view(np.uint64)
    word_logs = word_log(np.append(often.column("n").to_numpy(), ends[0].n if ends else 0))
    by = np.argsort(word_keys)
    word_shards = max(1, -(-distinct // shard_grams))
    word_table = scratch.table(words.select(F.pmod("key", F.lit(word_shards).cast("long")).alias("shard"), "key", "n").groupBy("shard").applyInArrow(_pack_words, "shard long, codes binary, counts binary"))

    trie = Shards(scratch, counts, order, size[GRAM].rows if GRAM in size else 0, shard_grams)
    opener = spark.sparkContext.broadcast(_Opener(trie))
    hot = trie.table.select("codes", "counts").mapInArrow(_hot(opener, _threshold(counts, GRAM, hot_grams)), "key long, log10 double").toArrow()  # at most hot_grams rows
    codes = hot.column("key").to_numpy().view(np.uint64)
    order_ = np.argsort(codes)
    held = spark.sparkContext.broadcast((codes[order_], hot.column("log10").to_numpy()[order_], word_keys[by], word_logs[by]))
    scratch.drop(counts)
    chunks = scratch.table(docs.mapInArrow(_chunks(order, trie.shards, word_shards, held), CHUNKS))

    def of_grams(codes: bytes, counts: bytes):
        own = opener.value.trie(codes, counts)
        return lambda keys: (own.log10(keys), np.ones(len(keys), np.int64))

    def of_words(codes: bytes, counts: bytes):
        known, n = np.frombuffer(codes, np.uint64), np.append(np.frombuffer(counts, np.int64), 0)

        def value(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, seen = _find(known, keys)
            c = np.where(seen, n[at], 0)
            return word_log(c), (c > 0).astype(np.int64)

        return value

    asked = chunks.select("chunk", F.inline("asked"))
    answers = None
    for kind, table, answer in ((GRAM, trie.table, of_grams), (WORD, word_table, of_words)):
        own = _answers(asked.where(F.col("kind") == kind).drop("kind"), table, answer).withColumn("kind", F.lit(kind))
        answers = own if answers is None else answers.union(own)
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "rows", "values", "known")).alias("answers"))
    out = chunks.drop("asked").join(by_chunk, "chunk", "left").drop("chunk").mapInArrow(_texts(0 if ends else 1), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
