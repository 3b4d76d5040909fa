"""Quality by importance resampling.

Two bags of hashed words and word pairs (a word beside itself is one pair for all words) describe the target texts (labelled as good) and the raw corpus (all texts).  A
text's log importance weight is the mean, over its n-grams, of the log ratio of the two: sums of long texts lie hundreds apart
and would leave nothing to chance.  Gumbel noise is added to the
weight over the temperature, and the k largest sums are the sample: that is sampling k documents without replacement, each draw with
probabilities in proportion to weight ** (1 / temperature).  The k-th largest key is found exactly, by counting its
leading bits, and never by sorting or collecting documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared

BUCKETS = 1 << 16


def _grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and runs of signs and of neighbouring pairs, case kept, and where each text's begin.

    All pairs of a token and itself share a bucket, so that repetition itself is seen.
    """
    h, at = shared.token_hashes(data, bounds, shared.PUNCT_CLASS, shared.SAME)
    if not len(h):
        return np.zeros(0, np.int64), at
    pair = shared.join_hashes(h, 2)
    both = np.empty(2 * len(h), np.uint64)
    both[0::2], both[1::2] = h, np.concatenate([pair, h[-1:]])
    first = at[1:][at[1:] > at[:-1]] - 1  # a text's last token has no pair: its own bucket counts again
    both[2 * first + 1] = h[first]
    again = np.flatnonzero(h[1:] == h[:-1])
    both[2 * again[~np.isin(again, first)] + 1] = 0  # a token after itself is one pair, whatever the token
    return (both >> np.uint64(48)).astype(np.int64), 2 * at


def _counts(good: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, bounds = shared.text_bytes(batch.column(1))
            wanted = np.isin(batch.column(0).fill_null(-1).to_numpy(), good) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, part, at in shared.chunks(data, bounds):
                grams, cut = _grams(part, at)
                raw += np.bincount(grams, minlength=BUCKETS)
                mine = np.repeat(wanted[lo:hi], np.diff(cut))
                target += np.bincount(grams[mine], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return shared.frugal(run)


def _weights(docs: DataFrame, text_col: str, ratio: np.ndarray) -> DataFrame:
    def compute(data: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        grams, cut = _grams(data, bounds)
        total = np.concatenate([[0.0], np.cumsum(ratio[grams])])
        return [pa.array(np.diff(cut).astype(np.int64)), pa.array(np.round((total[cut[1:]] - total[cut[:-1]]) / np.maximum(np.diff(cut), 1), 9))]

    return shared.with_text_columns(docs, text_col, "n_grams long, log_weight double", compute)


def _left_out(raw: np.ndarray, target: np.ndarray, alpha: float):
    """(doc_id, flag, w): log weights of labelled texts by models of the target that don't hold the text itself, as those of
    texts without a label don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.log((raw + alpha) / (raw.sum() + alpha * BUCKETS))
        for batch in batches:
            data, bounds = shared.text_bytes(batch.column(2))
            flags, weights = batch.column(1).to_numpy(), []
            for lo, _, part, at in shared.chunks(data, bounds):
                grams, cut = _grams(part, at)
                for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    own, times = np.unique(grams[a:b], return_counts=True)
                    less = times if flags[lo + k] == 1 else 0
                    left = target.sum() - (b - a if flags[lo + k] == 1 else 0)
                    weights.append(float(times @ (np.log((target[own] - less + alpha) / (left + alpha * BUCKETS)) - base[own])) / max(b - a, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(weights, pa.float64())], ["doc_id", "flag", "w"])

    return shared.frugal(run)


def labelled_sample(labels: DataFrame, flag: str, most: int, id_col: str = "doc_id") -> list:
    """At most ``most`` labelled (id, flag) rows, chosen by a hash of the id; rows without id or flag don't count."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(flag).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(flag).cast("int").alias("flag"))
    return ids.groupBy("doc_id").agg(F.min("flag").alias("flag")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()


def expected_shares(values: np.ndarray, good: np.ndarray, bins: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Inner edges of about equally full bins of labelled values, and the share of good ones in each bin."""
    edges = np.unique(np.quantile(values, np.arange(1, bins) / bins))
    at = np.searchsorted(edges, values, "right")
    n = np.bincount(at, minlength=len(edges) + 1)
    return edges, np.bincount(at, good, len(edges) + 1) / np.maximum(n, 1)


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The exact k-th largest value of a long column: sixteen bits at a time, with at most 65536 counts a pass."""
    if k < 1:
        return None
    prefix = 0
    for shift in (48, 32, 16, 0):
        here = keys if shift == 48 else keys.where(F.shiftright(column, shift + 16) == prefix)
        counts = here.groupBy(F.shiftright(column, shift).alias("p")).count().collect()
        for p, n in sorted(((r["p"], r["count"]) for r in counts), reverse=True):
            if k <= n:
                prefix = p
                break
            k -= n
        else:
            return None
    return prefix


def importance_resample(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", flag: str = "quality", k: int | float | None = None, temperature: float = 0.1, max_labelled: int = 20_000, seed: int = 7, alpha: float = 1.0
) -> DataFrame:
    """``docs`` with columns n_grams, log_weight, gumbel_key and selected; those of these names are replaced.

    ``k`` documents are selected: a number of rows, a share of them (a float), or None for as many as the labels let expect to be good:
    the share of good labelled texts in each of 64 bins of log weights, each taken without the text itself in the target's
    model, times the bin's documents.  A high ``temperature`` samples evenly, a low one takes the largest weights; it is on the
    scale of ``log_weight``, the mean log ratio of a text's n-grams.

    The target texts are those of at most ``max_labelled`` labelled rows; counts of the raw corpus cover all documents.
    Null and empty texts have no n-grams and the log weight 0.  Bytes that aren't UTF-8 become U+FFFD.  New columns replace
    those of their names in any case.  Rows that repeat an id and a text have the same noise and so
    the same key; documents of equal keys (to a millionth) are selected together, and only they can exceed ``k``.  Null ids are
    unlabelled.  Without labels of both kinds everything is selected, unless ``k`` is given.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = shared.Scratch(spark, "quality")
    shared.small_batches(spark)
    own = docs.select(shared.quoted(id_col).cast("long").alias("doc_id"), shared.valid_text(shared.quoted(text_col)).alias("text"))
    docs = docs.select(*(shared.valid_text(shared.quoted(c)).alias(c) if c.lower() == text_col.lower() else shared.quoted(c) for c in shared.others(docs, "gumbel_key", "selected")))
    sample = labelled_sample(labels, flag, max_labelled)
    good = np.array(sorted(r.doc_id for r in sample if r.flag == 1), np.int64)
    counted = own.mapInArrow(_counts(good), "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # at most BUCKETS
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    share = lambda c: np.log((c + alpha) / (c.sum() + alpha * BUCKETS))
    ratio = share(target) - share(raw) if target.any() else np.zeros(BUCKETS)
    micro = (F.col("gumbel_key") * 1e6).cast("long")

    def scored(frame: DataFrame, row_id: str, text: str) -> DataFrame:
        # the noise belongs to the id and the text, so that rows that repeat both are taken together
        uniform = (F.pmod(F.xxhash64(F.lit(seed), shared.quoted(row_id).cast("long"), shared.quoted(text)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        noise = shared.unused(frame, "noise")[0]
        return _weights(frame.withColumn(noise, -F.log(-F.log(uniform))), text, ratio).withColumn("gumbel_key", F.col("log_weight") / temperature + F.col(noise)).drop(noise)

    small = scratch.table(scored(own, "doc_id", "text").select("doc_id", "log_weight", micro.alias("key")))
    if isinstance(k, float):
        k = round(k * small.count())
    elif k is None:
        known = spark.createDataFrame([(r.doc_id, r.flag) for r in sample], "doc_id long, flag int")
        seen = own.join(F.broadcast(known), "doc_id").select("doc_id", "flag", "text").mapInArrow(_left_out(raw, target, alpha), "doc_id long, flag int, w double")
        seen = seen.groupBy("doc_id").agg(F.min("w").alias("w"), F.min("flag").alias("flag")).toArrow()  # at most ``max_labelled`` rows
        flags = seen.column("flag").to_numpy() == 1
        if not flags.any() or flags.all():
            k = small.count()
        else:
            edges, shares = expected_shares(seen.column("w").to_numpy(), flags)
            bin_ = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col("log_weight")))
            k = round(sum(r["count"] * float(shares[r.bin]) for r in small.groupBy(bin_.alias("bin")).count().collect()))
    least = kth_largest(small, "key", k)
    everything = least is None and k > 0  # fewer documents than k
    scratch.drop(small)
    return scored(docs, id_col, text_col).withColumn("selected", F.lit(everything) if least is None else micro >= least)
