"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

P(grade >= j) = logistic(w.x - t_j): one weight vector for all grades, ordered thresholds t_1 < t_2 < ...  Features are the
presence of hashed words and beginnings of words that differ between labelled toxic and other texts.  The prediction is the expected severity,
the sum of P(grade >= j), and the grade that is at least as likely as not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.llm.quality import labelled_sample

BUCKETS = 1 << 20
#: The least log likelihood ratio of a feature: luck gives as much to one bucket of 16,000.
SURE = 16.0


def _features(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of words, then of their first four, then of their first five bytes, and each bucket's text."""
    h, cut, *heads = shared.token_hashes(data, bounds, shared.PUNCT_CLASS, heads=(4, 5))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(cut))
    for own in (h, *heads):
        yield (own >> np.uint64(44)).astype(np.int64), row


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, t0, c0, t1, c1): in how many toxic and other texts of each half of a partition each bucket occurs."""
    seen = np.zeros((4, BUCKETS), np.int32)
    for batch in batches:
        kind_of = 2 * batch.column(2).to_numpy() + (batch.column(1).to_numpy() != 1)
        data, bounds = shared.text_bytes(batch.column(0))
        for lo, _, part, at in shared.chunks(data, bounds):
            found = np.unique(np.concatenate([(row << 20) | bucket for bucket, row in _features(part, at)]))
            kinds = kind_of[lo + (found >> 20)]
            for kind in range(4):
                seen[kind] += np.bincount(found[kinds == kind] & (BUCKETS - 1), minlength=BUCKETS).astype(np.int32)
    some = np.flatnonzero(seen.any(0))
    for lo in range(0, len(some), 1 << 17):
        own = some[lo : lo + (1 << 17)]
        yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(x[own].astype(np.int64)) for x in seen)], ["bucket", "t0", "c0", "t1", "c1"])


def _chosen(buckets: np.ndarray):
    """(doc_id, flag, columns): the chosen features of each text, as packed 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[buckets] = np.arange(len(buckets))
        for batch in batches:
            data, bounds = shared.text_bytes(batch.column(2))
            for lo, hi, part, at in shared.chunks(data, bounds):
                codes = []
                for bucket, row in _features(part, at):
                    column = place[bucket]
                    codes.append((row[column >= 0] << 20) | column[column >= 0])
                code = np.unique(np.concatenate(codes))
                cut = np.searchsorted(code >> 20, np.arange(hi - lo + 1)).tolist()
                columns = (code & (BUCKETS - 1)).astype("<u2")
                packed = [columns[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:2], pa.array(packed, pa.binary())], ["doc_id", "flag", "columns"])

    return run


class OrdinalModel:
    """Weights by bucket and thresholds."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.buckets, self.weights, self.cuts = buckets, weights, cuts

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j from 1, a column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -500, 500)))

    @staticmethod
    def objective(p: np.ndarray, d: int, row: np.ndarray, column: np.ndarray, grade: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
        """The mean log likelihood less the prior's share, and its gradient.  ``p``: weights, first cut, logs of the gaps."""
        n = len(grade)
        w, gaps = p[:d], np.exp(np.clip(p[d + 1 :], -8, 8))
        cuts = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, w[column], n) if len(row) else np.zeros(n)
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -500, 500)))
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
        slope = edge * (1 - edge)
        i = np.arange(n)
        likely = np.maximum(edge[i, grade] - edge[i, grade + 1], 1e-12)
        by_score = (slope[i, grade] - slope[i, grade + 1]) / likely
        by_cut = np.zeros((n, len(cuts) + 2))
        by_cut[i, grade] -= slope[i, grade] / likely
        by_cut[i, grade + 1] += slope[i, grade + 1] / likely
        to_cut = by_cut[:, 1:-1].mean(0)
        after = to_cut[::-1].cumsum()[::-1]
        gain = np.concatenate([np.bincount(column, by_score[row], d) / n - decay / n * w if d else np.zeros(0), [to_cut.sum()], after[1:] * gaps])
        return float(np.log(likely).mean() - decay / n / 2 * (w @ w)), gain

    @classmethod
    def fit(cls, buckets: np.ndarray, row: np.ndarray, column: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 1000, decay: float = 0.2) -> OrdinalModel:
        """Maximum likelihood with a normal prior of precision ``decay`` on weights, by full-batch gradient steps with
        adaptive moments; the gaps of the cuts are kept positive."""
        d = len(buckets)
        p = np.concatenate([np.zeros(d), [2.0], np.zeros(grades - 1)])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, rounds + 1):
            _, gain = cls.objective(p, d, row, column, grade, decay)
            m, v = 0.9 * m + 0.1 * gain, 0.99 * v + 0.01 * gain * gain
            p = p + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        return cls(buckets, p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(p[d + 1 :], -8, 8)))]))


def _marks(t: np.ndarray, c: np.ndarray, nt: int, nc: int) -> np.ndarray:
    """Which features almost only toxic texts have, by their numbers of texts; those in ten toxic texts or more, if there are any."""
    almost = t * nc > 20 * c * nt
    often = almost & (t >= 10)
    return often if often.any() else almost


def grades_by_load(load: np.ndarray, toxic: np.ndarray, grades: int) -> np.ndarray:
    """0 for other texts; 1 to ``grades`` for toxic ones by load, cut at equal shares, texts of equal load together."""
    cuts = np.quantile(load[toxic], np.arange(1, grades) / grades)
    return np.where(toxic, 1 + np.searchsorted(cuts, load), 0)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", flag: str = "toxic", grades: int = 3, max_labelled: int = 20_000, features: int = 1024, least: int = 5) -> OrdinalModel | None:
    """Fits on at most ``max_labelled`` labelled ids; None where labels of both kinds aren't there.

    At most ``features`` buckets are features: those in ``least`` texts or more whose log likelihood ratio between toxic and other
    texts is at least SURE, which few buckets reach by luck; at least the best 16.  Buckets of equal
    ratio are taken by number.  Labels only say whether a text is toxic.  Toxic texts get
    grades 1 to ``grades`` by their load: how many different features they have that almost only toxic texts have.  It grows with
    what the model sees, so one weight vector can serve all grades (a share of words would grade long texts down, which
    presence can't tell).  Which features those are is decided on one half of the labelled texts (by a hash of the id) for
    the other half, so that no label decides on the grade of its own text.

    Labels without an id or a flag don't count; of several flags of an id the least holds, of several texts of an id the
    last in alphabetic order.  Null and empty texts are texts without features.  Columns besides id, text and flag are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    chosen_ids = labelled_sample(labels, flag, max_labelled)
    known = spark.createDataFrame([(r.doc_id, r.flag) for r in chosen_ids], "doc_id long, flag int")  # ``max_labelled`` rows at most
    own = docs.select(shared.quoted(id_col).cast("long").alias("doc_id"), F.coalesce(shared.quoted(text_col), F.lit("")).alias("text"))
    scratch = shared.Scratch(spark, "toxic")
    shared.small_batches(spark)
    held = scratch.table(own.join(F.broadcast(known), "doc_id").groupBy("doc_id", "flag").agg(F.max("text").alias("text")))
    table = held.withColumn("half", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).cast("int"))
    counted = table.select("text", "flag", "half").mapInArrow(shared.frugal(_presence), "bucket long, t0 long, c0 long, t1 long, c1 long")
    by = counted.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")))
    sizes = {(r.half, r.flag): r["count"] for r in table.groupBy("half", "flag").count().collect()}
    n_t, n_c = ([sizes.get((half, flag), 0) for half in (0, 1)] for flag in (1, 0))
    nt, nc = sum(n_t), sum(n_c)
    if not nt or not nc:
        return None
    t, c = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    part = lambda k, n, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    p = (t + c) / (nt + nc)
    ratio = 2 * (part(t, nt, p) + part(nt - t, nt, 1 - p) + part(c, nc, p) + part(nc - c, nc, 1 - p))
    best = by.where(t + c >= least).select("*", F.round(ratio, 9).alias("z")).orderBy(F.desc("z"), "bucket").limit(features).collect()
    best = best[: max(16, sum(r.z >= SURE for r in best))]
    best.sort(key=lambda r: r.bucket)
    buckets = np.array([r.bucket for r in best], np.int64)
    marked = np.stack([_marks(np.array([r[f"t{half}"] for r in best]), np.array([r[f"c{half}"] for r in best]), n_t[half], n_c[half]) for half in (0, 1)])
    halves = {r.doc_id: r.half for r in table.select("doc_id", "half").collect()}  # sampled ids
    rows = table.select("doc_id", "flag", "text").mapInArrow(shared.frugal(_chosen(buckets)), "doc_id long, flag int, columns binary").toArrow()  # a row for each sampled id
    order = np.argsort(rows.column("doc_id").to_numpy())
    toxic = rows.column("flag").to_numpy()[order] == 1
    columns = [np.frombuffer(x, "<u2") for x in rows.column("columns").take(pa.array(order)).to_pylist()]
    scratch.drop(held)
    row = np.repeat(np.arange(len(columns)), [len(x) for x in columns])
    column = np.concatenate(columns).astype(np.int64)
    other = 1 - np.array([halves[i] for i in np.sort(rows.column("doc_id").to_numpy()).tolist()], np.int64)
    load = np.bincount(row, marked[other[row], column], len(columns))
    return OrdinalModel.fit(buckets, row, column, grades_by_load(load, toxic, grades), grades)


def severity(docs: DataFrame, model: OrdinalModel | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with columns severity, grade and toxic; those of these names are replaced.

    Null and empty texts have no features: they get what the thresholds alone say, which is grade 0 wherever most of
    the sample is.  Repeated rows get equal results; all rows stay, null ids included.  Without a model every severity
    is 0.  An empty table gives an empty result.
    """
    lookup: list[np.ndarray] = []

    def compute(data: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        n = len(bounds) - 1
        if model is None:
            return [pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, bool))]
        if not lookup:  # once for each task
            lookup.append(np.zeros(BUCKETS, np.float32))
            lookup[0][model.buckets] = 1
        codes = []
        for bucket, row in _features(data, bounds):
            some = lookup[0][bucket] > 0
            codes.append((row[some] << 20) | bucket[some])
        code = np.unique(np.concatenate(codes))
        weights = model.weights[np.searchsorted(model.buckets, code & (BUCKETS - 1))] if len(code) else np.zeros(0)
        above = model.above(np.bincount(code >> 20, weights, n))
        grade = (above >= 0.5).sum(1)
        return [pa.array(np.round(above.sum(1), 6)), pa.array(grade.astype(np.int32)), pa.array(grade > 0)]

    return shared.with_text_columns(docs, text_col, "severity double, grade int, toxic boolean", compute)
