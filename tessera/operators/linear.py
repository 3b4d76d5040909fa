"""Ridge and elastic-net regressions on splits of a panel, fitted from moments.

One pass gives means and one the centred cross moments of all splits: numbers that grow with the features, not with the
rows.  From them every penalty of a grid is solved: ridge by its normal equations, elastic nets by coordinate
descent with soft thresholds, from the largest penalty down, each from the one before.  Penalties are chosen by the mean
daily rank information coefficient on validation rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.evaluate import daily_ic
from tessera.sources.panel import KEYS


@dataclass(frozen=True)
class Moments:
    """A split's rows in numbers: how many, means and centred cross products of features, then label."""

    n: int
    mean: np.ndarray
    cross: np.ndarray


@dataclass(frozen=True)
class Penalty:
    """``l1_ratio`` None is ridge: ``alpha`` times the sum of squares beside the sum of squared errors.  Otherwise an elastic net:
    alpha * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w^2) beside half the mean squared error.  Weights are of standardised features."""

    alpha: float
    l1_ratio: float | None = None


def moments(rows: DataFrame, features: list[str], label: str, by: str = "split") -> dict[str, Moments]:
    """Moments of the rows in which nothing is missing, for each value of ``by``."""
    columns = [*features, label]
    held = rows.select(F.col(by).cast("string").alias("split"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).dropna()
    first = held.groupBy("split").agg(F.count("*").alias("n"), *(F.avg(f"c{i}").alias(f"c{i}") for i in range(len(columns)))).collect()  # a row for each split
    mean = {r.split: np.array(r[2:]) for r in first}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            x = np.column_stack([batch.column(i).to_numpy() for i in range(1, batch.num_columns)])
            for split in set(names.tolist()):
                own = x[names == split] - mean[split]
                seen[split] = seen.get(split, 0.0) + own.T @ own
        for split, cross in seen.items():
            flat = cross.ravel()
            yield pa.RecordBatch.from_arrays([pa.array([split] * len(flat)), pa.array(np.arange(len(flat))), pa.array(flat)], ["split", "cell", "value"])

    sums = held.mapInArrow(partial, "split string, cell long, value double").groupBy("split", "cell").agg(F.sum("value").alias("value")).toArrow()
    cross = {s: np.zeros(len(columns) ** 2) for s in mean}
    for split, cell, value in zip(*(sums.column(c).to_pylist() for c in ("split", "cell", "value")), strict=True):
        cross[split][cell] = value
    return {r.split: Moments(r.n, mean[r.split], cross[r.split].reshape(len(columns), -1)) for r in first}


def descend(gram: np.ndarray, target: np.ndarray, l1: float, l2: float, start: np.ndarray, tol: float = 1e-10, rounds: int = 10_000) -> np.ndarray:
    """The least of w'Gw / 2 - t'w + l1 |w| + l2 w'w / 2, a coordinate at a time."""
    w = start.copy()
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            pull = target[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (gram[j, j] + l2) if gram[j, j] + l2 > 0 else 0.0
            most, w[j] = max(most, abs(new - w[j])), new
        if most < tol:
            break
    return w


def solve(of: Moments, penalties: list[Penalty]) -> dict[Penalty, tuple[float, np.ndarray]]:
    """(intercept, coefficients of the features as they are) for each penalty.  Constant features have none."""
    d = len(of.mean) - 1
    deviation = np.sqrt(np.maximum(np.diag(of.cross)[:d], 0.0) / max(of.n - 1, 1))
    used = deviation > 1e-12 * np.maximum(1.0, np.abs(of.mean[:d]))
    scale = np.where(used, deviation, 1.0)
    gram = of.cross[:d, :d] / np.outer(scale, scale) / of.n * np.outer(used, used)
    target = of.cross[:d, d] / scale / of.n * used
    out: dict[Penalty, tuple[float, np.ndarray]] = {}
    warm: dict[float, np.ndarray] = {}
    for p in sorted(penalties, key=lambda p: -p.alpha):
        if p.l1_ratio is None:
            w = np.zeros(d)
            w[used] = np.linalg.lstsq(gram[np.ix_(used, used)] + p.alpha / of.n * np.eye(int(used.sum())), target[used], rcond=None)[0]
        else:
            w = warm[p.l1_ratio] = descend(gram, target, p.alpha * p.l1_ratio, p.alpha * (1 - p.l1_ratio), warm.get(p.l1_ratio, np.zeros(d)))
        coefficients = w / scale
        out[p] = (float(of.mean[d] - coefficients @ of.mean[:d]), coefficients)
    return out


MODEL = "split string, candidate int, alpha double, l1_ratio double, intercept double, coefficients array<double>"


def fit(rows: DataFrame, features: list[str], label: str, penalties: list[Penalty], by: str = "split") -> DataFrame:
    """(split, candidate, alpha, l1_ratio, intercept, coefficients): a row for each split and penalty."""
    made = [
        (split, k, p.alpha, p.l1_ratio, solved[p][0], solved[p][1].tolist())
        for split, of in sorted(moments(rows, features, label, by).items()) for solved in [solve(of, penalties)] for k, p in enumerate(penalties)
    ]
    return rows.sparkSession.createDataFrame(made, MODEL)


def predict(rows: DataFrame, features: list[str], models: DataFrame, by: str = "split") -> DataFrame:
    """``rows`` with ``candidate`` and ``prediction`` for each of its split's models; NULL where a feature is missing."""
    # a row for each split and penalty, made by the driver
    own = F.broadcast(models.select(F.col("split").alias(by), "candidate", "intercept", "coefficients"))
    dot = F.aggregate(F.zip_with(F.array(*(F.col(f).cast("double") for f in features)), "coefficients", lambda x, c: x * c), F.col("intercept"), lambda s, v: s + v)
    return rows.withColumn(by, F.col(by).cast("string")).join(own, by).withColumn("prediction", dot).drop("intercept", "coefficients")


def scored(predicted: DataFrame, label: str, least: int = 2) -> DataFrame:
    """(split, candidate, mean_ic, ic_ir, days, coverage): daily rank coefficients of predictions on days that have one."""
    long = predicted.select(*KEYS, "split", F.col("candidate").cast("string").alias("factor"), F.col("prediction").alias("value"), F.col(label).alias("label"))
    daily = daily_ic(long, least, ("split",)).where("status = 'ok'")
    mean = daily.groupBy("split", "factor").agg(F.avg("rank_ic").alias("mean_ic"), F.try_divide(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("ic_ir"), F.count("*").alias("days"))
    share = long.groupBy("split", "factor").agg(F.avg((F.col("value").isNotNull() & F.col("label").isNotNull()).cast("double")).alias("coverage"))
    return share.join(mean, ["split", "factor"], "left").select("split", F.col("factor").cast("int").alias("candidate"), "mean_ic", "ic_ir", F.coalesce("days", F.lit(0)).alias("days"), "coverage")


def choose(models: DataFrame, validation: DataFrame) -> DataFrame:
    """The model of each split whose validation coefficient is largest; of equal ones the larger penalty, then the first."""
    best = validation.where("mean_ic is not null").join(models, ["split", "candidate"])
    key = F.struct(F.round("mean_ic", 9), "alpha", F.negative("candidate").alias("first"))
    return best.groupBy("split").agg(F.max_by(F.struct("candidate", "mean_ic", "alpha", "l1_ratio", "intercept", "coefficients"), key).alias("m")).select("split", "m.*")


def on_splits(panel: DataFrame, starts: dict[str, tuple[str, str, str]], gap_months: int) -> DataFrame:
    """``panel`` rows by split and role: train before the validation's start less ``gap_months`` (labels reach so far ahead),
    validation up to the test's start less the same gap, test up to its end.  ``starts``: (validation, test, end) dates."""
    day = F.col("datetime")
    roles = [
        F.struct(F.lit(split).alias("split"), F.when(day < F.add_months(F.lit(v).cast("date"), -gap_months), "train").when((day >= v) & (day < F.add_months(F.lit(t).cast("date"), -gap_months)), "validation").when((day >= t) & (day < e), "test").alias("role"))
        for split, (v, t, e) in starts.items()
    ]
    return panel.withColumn("__s", F.explode(F.array(*roles))).select(*panel.columns, "__s.*").where("role is not null")
