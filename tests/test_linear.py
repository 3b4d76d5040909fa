"""Elastic nets from moments against a descent on the rows, and the choice of penalties."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import linear
from tessera.operators.linear import Penalty

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(6)
    n = 400
    x = r.normal(size=(n, 4)) * [1, 50, 0.01, 1] + [0, 1e4, 2, 0]
    x[:, 3] = 7.0
    y = 0.3 * x[:, 0] + 0.02 * x[:, 1] + r.normal(size=n)
    rows = [(DAY + dt.timedelta(i // 10), f"S{i % 10}", "ab"[i % 2], *map(float, x[i]), float(y[i]) if i % 17 else None) for i in range(n)]
    schema = "datetime date, instrument string, split string, u double, v double, w double, k double, label double"
    return rows, spark.createDataFrame(rows, schema)


def by_rows(x, y, p, rounds=3000):
    """Coordinate descent on residuals of standardised rows."""
    deviation = x.std(0, ddof=1)
    z = np.where(deviation > 0, (x - x.mean(0)) / np.where(deviation > 0, deviation, 1), 0)
    left, w, n = y - y.mean(), np.zeros(x.shape[1]), len(y)
    for _ in range(rounds):
        for j in range(len(w)):
            if deviation[j] == 0:
                continue
            pull = z[:, j] @ left / n + (z[:, j] @ z[:, j] / n) * w[j]
            new = np.sign(pull) * max(abs(pull) - p.alpha * p.l1_ratio, 0) / (z[:, j] @ z[:, j] / n + p.alpha * (1 - p.l1_ratio))
            left, w[j] = left - z[:, j] * (new - w[j]), new
    coefficients = w / np.where(deviation > 0, deviation, 1)
    return y.mean() - coefficients @ x.mean(0), coefficients


PENALTIES = [Penalty(a, l1) for l1 in (0.0, 0.5, 1.0) for a in (1.0, 0.1, 0.01)]
FEATURES = ["u", "v", "w", "k"]


def test_elastic_nets_by_rows(data):
    rows, df = data
    got = {(m.split, m.candidate): m for m in linear.fit(df, FEATURES, "label", PENALTIES).collect()}
    assert len(got) == 2 * len(PENALTIES)
    for split in "ab":
        own = [r for r in rows if r[2] == split and r[7] is not None]
        x, y = np.array([r[3:7] for r in own]), np.array([r[7] for r in own])
        for k, p in enumerate(PENALTIES):
            intercept, coefficients = by_rows(x, y, p, 400)
            m = got[split, k]
            assert np.allclose(m.coefficients, coefficients, rtol=1e-5, atol=1e-9) and np.isclose(m.intercept, intercept, rtol=1e-5) and (m.alpha, m.l1_ratio) == (p.alpha, p.l1_ratio)
            assert m.coefficients[3] == 0
    assert sum(c == 0 for c in got["a", 6].coefficients) >= 2  # the lasso drops what is noise


def test_predictions_and_their_choice(data):
    rows, df = data
    models = linear.fit(df, FEATURES, "label", PENALTIES)
    some = df.withColumn("u", F.when(F.col("instrument") != "S3", F.col("u")))
    out = linear.predict(some, FEATURES, models)
    held = {(m.split, m.candidate): m for m in models.collect()}
    seen = out.collect()
    assert len(seen) == len(rows) * len(PENALTIES)
    for r in seen:
        m = held[r.split, r.candidate]
        assert (r.prediction is None) == (r.instrument == "S3") or r.split == "b"
        assert r.prediction is None or np.isclose(r.prediction, m.intercept + np.dot(m.coefficients, [r.u, r.v, r.w, r.k]))
    board = linear.scored(out, "label")
    marks = {(b.split, b.candidate): b for b in board.collect()}
    best = {c.split: c for c in linear.choose(models, board).collect()}
    for split in "ab":
        own = [(round(b.mean_ic, 9), PENALTIES[k].alpha, -k) for (s, k), b in marks.items() if s == split and b.mean_ic is not None]
        assert -max(own)[2] == best[split].candidate
    by_day = {}
    for r in seen:
        if (r.split, r.candidate) == ("a", 4) and r.prediction is not None and r.label is not None:
            by_day.setdefault(r.datetime, []).append((r.prediction, r.label))
    rank = lambda v: np.argsort(np.argsort(v))
    ics = [np.corrcoef(rank([a for a, _ in own]), rank([b for _, b in own]))[0, 1] for own in by_day.values() if len(own) > 1]
    assert np.isclose(marks["a", 4].mean_ic, np.mean(ics)) and marks["a", 4].days == len(ics)


def test_splits_leave_a_gap_and_empty_ones_give_nothing(spark):
    p = spark.createDataFrame([(dt.date(2020, m, 1), "a") for m in range(1, 13)], "datetime date, instrument string")
    got = {(r.split, r.datetime.month): r.role for r in linear.on_splits(p, {"s": ("2020-05-01", "2020-09-01", "2020-12-01")}, 2).collect()}
    assert got == {("s", m): r for m, r in {1: "train", 2: "train", 5: "validation", 6: "validation", 9: "test", 10: "test", 11: "test"}.items()}
    none = spark.createDataFrame([], "datetime date, instrument string, split string, u double, label double")
    assert linear.fit(none, ["u"], "label", [Penalty(1.0)]).collect() == []
