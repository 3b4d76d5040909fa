"""What the training-data operators share: scratch tables, text as byte arrays, vectorised token hashes.

Word rules follow one convention everywhere: A-Z are lower-cased and words are runs of characters other than
``[\\x20\\x09-\\x0D]``.  Python's ``bytes.lower().split()`` does exactly that on UTF-8, and so do the native columns
``ascii_lower`` and ``words``.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"

#: Bytes of text that one vectorised step handles; the arrays of a step take about fifty times as much.
CHUNK = 1 << 18

#: A token of more bytes gets the hash of a library instead of the polynomial, whose collisions can be constructed.
LONG_TOKEN = 256


# ------------------------------------------------------------------ scratch tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster, which could not read that, gets an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


# ------------------------------------------------------------------ memory of tasks
def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, unless the session has its own number: texts can be long, and a batch and its
    copies are held whole on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:  # Spark's default
        spark.conf.set(key, str(rows))


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition function whose worker returns its free memory to the system at the end: workers live on and are used again."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return whole


class Scratch:
    """Written tables that cut lineage: a lost executor rereads them instead of recomputing what led to them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no unfinished plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch)  # type: ignore[attr-defined]
            path.getFileSystem(conf).delete(path, True)


# ------------------------------------------------------------------ native text columns
def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` has a fast path for texts without other letters."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def strip_blanks(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """The words of a text; none for a null text or one of blanks alone."""
    t = strip_blanks(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


# ------------------------------------------------------------------ texts as byte arrays
def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column and where each text begins; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(data: np.ndarray, bounds: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: (first row, row after the last, bytes, bounds)."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


WORD_CLASS = np.ones(256, np.uint8)
WORD_CLASS[[32, *range(9, 14)]] = 0
#: Letters, digits and non-ASCII bytes against other signs, as well as blanks: words and runs of punctuation.
PUNCT_CLASS = WORD_CLASS.copy()
PUNCT_CLASS[[b for b in range(33, 128) if not chr(b).isalnum()]] = 2
SAME = np.arange(256, dtype=np.uint8)
FOLD = SAME.copy()
FOLD[65:91] += 32

_RADIX, _LENGTH, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_powers: list[np.ndarray] = []


def _radix_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd radix modulo 2**64 and of its inverse; those for a usual chunk are kept for the life of a worker."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    inverse, usual = np.uint64(pow(int(_RADIX), -1, 1 << 64)), CHUNK + (CHUNK >> 2)
    made = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, usual) - 1, x, np.uint64)])) for x in (_RADIX, inverse)]
    if n <= usual:
        _powers[:] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply rounds); one to one."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def token_hashes(data: np.ndarray, bounds: np.ndarray, classes: np.ndarray = WORD_CLASS, fold: np.ndarray = FOLD, spans: bool = False, heads: tuple[int, ...] = ()) -> tuple:
    """64-bit hashes of all tokens (runs of one nonzero class) and, for each text, where its tokens begin; with ``spans``
    also where each token begins and ends; with ``heads`` also hashes of the tokens' first so many bytes.

    A token's hash is a polynomial in its bytes taken from prefix sums, so that equal tokens have equal hashes
    wherever they stand; that of a token of more than LONG_TOKEN bytes is taken from its bytes one by one.
    """
    n = len(data)
    kind = classes[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[bounds] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    power, inverse = _radix_powers(n + 1)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    term = fold[data].astype(np.uint64)
    term += np.uint64(1)
    term *= power[:n]
    np.cumsum(term, out=prefix[1:])
    del term
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    h = mix(h ^ ((ends - starts).astype(np.uint64) * _LENGTH))
    for i in np.flatnonzero(ends - starts > LONG_TOKEN).tolist():
        h[i] = xxhash.xxh3_64_intdigest(fold[data[starts[i] : ends[i]]].tobytes())
    out = (h, np.searchsorted(starts, bounds))
    if heads:
        out += tuple(mix((prefix[np.minimum(ends, starts + n)] - prefix[starts]) * inverse[starts] ^ np.uint64(n)) for n in heads)
    return out + (starts, ends) if spans else out


def join_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` tokens, in order; fewer tokens give none."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * _STEP + h[i : len(h) - n + 1 + i]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list column over flat values."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


# ------------------------------------------------------------------ columns of callers
def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those of these names, in any case."""
    new = {x.lower() for x in names}
    return [c for c in df.columns if c.lower() not in new]


def valid_text(c: Column) -> Column:
    """A text whose bytes that aren't UTF-8 are U+FFFD: what Python can decode."""
    return F.make_valid_utf8(c)


def with_columns(df: DataFrame, source: str, extra: str, compute: Callable[[pa.RecordBatch, pa.Array], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]], *, text: bool = False) -> DataFrame:
    """``df`` with more columns, computed from its column ``source``; no row is shuffled.

    ``extra`` is their schema; columns of these names, in any case, are replaced.  ``compute`` takes a batch and its
    ``source`` and gives parts of the batch with their new columns.  With ``text``, bytes of ``source`` that aren't UTF-8 are
    U+FFFD, in what stays of it as well.
    """
    added = StructType.fromDDL(extra)
    kept = others(df, *added.names)
    small = [c.lower() for c in kept]
    if source.lower() not in small:
        raise ValueError(f"{source} is no column, or has the name of a new one")
    at = small.index(source.lower())
    # by number: the caller's names may be anything
    plain = df.select(*((valid_text(quoted(c)) if text and i == at else quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)))
    schema = StructType([*plain.schema.fields, *(StructField(f"n{i}", f.dataType) for i, f in enumerate(added.fields))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, made in compute(batch, batch.column(at)):
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names)

    small_batches(df.sparkSession)
    return plain.mapInArrow(frugal(run), schema).toDF(*kept, *added.names)


def by_rows(compute: Callable[[list], list[pa.Array]], step: int) -> Callable[[pa.RecordBatch, pa.Array], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]]:
    """For ``with_columns``: ``step`` rows at a time, as Python values."""

    def parts(batch: pa.RecordBatch, column: pa.Array) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for lo in range(0, len(batch), step):
            yield batch.slice(lo, step), compute(column.slice(lo, step).to_pylist())

    return parts


def with_text_columns(docs: DataFrame, text_col: str, extra: str, compute: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """The same for texts, as bytes and bounds of about CHUNK bytes; a null text is empty."""

    def parts(batch: pa.RecordBatch, column: pa.Array) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        data, bounds = text_bytes(column)
        for lo, hi, part, cut in chunks(data, bounds):
            yield batch.slice(lo, hi - lo), compute(part, cut)

    return with_columns(docs, text_col, extra, parts, text=True)
