"""Array windows over small batches give what the window columns give, with missing values and short histories."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import histories
from tessera.operators import features
from tessera.operators.indicators import indicators
from tessera.plans import registry

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    r = random.Random(5)
    rows = []
    for name, days in (("a", 41), ("b", 3), ("c", 17), ("d", 12)):
        for i in range(days):
            low, close = r.uniform(1, 5), round(r.uniform(5, 6), 1)
            rows.append((DAY + dt.timedelta(i), name, close if name == "d" else r.uniform(5, 6), 7.0, low, 5.5 if name == "d" else None if r.random() < 0.04 else close, close, None if r.random() < 0.04 else float(r.randint(0, 9))))
    return spark.createDataFrame(rows, "datetime date, instrument string, open double, high double, low double, close double, vwap double, volume double")


@pytest.mark.parametrize("what", ["rolling", "lagged"])
@pytest.mark.parametrize("size", [4, 1000])
def test_arrays_and_columns_agree(spark, panel, what, size):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = features.rolling(panel, (3, 10)) if what == "rolling" else features.lagged(panel, 6)
        want = features.select(panel, features.rolling_family(3) + features.rolling_family(10) if what == "rolling" else features.lag_ratios(6))
        assert got.columns == want.columns
        a, b = (sorted(map(tuple, f.collect()), key=lambda r: (r[1], r[0])) for f in (got, want))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(a) == len(b) == 73
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2]
        for name, p, q in zip(got.columns[2:], x[2:], y[2:], strict=True):
            assert (p is None) == (q is None) and (p is None or np.isclose(p, q, rtol=1e-9, atol=1e-9)), (name, x[:2], p, q)


def test_indicators_go_on_over_batches(spark, panel):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = []
    try:
        for size in (7, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            made.append(sorted(map(tuple, indicators(panel.unionByName(panel.withColumn("datetime", F.date_add("datetime", 41)))).collect()), key=lambda r: (r[1], r[0])))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for x, y in zip(*made, strict=True):
        assert x[:2] == y[:2] and all((p is None) == (q is None) and (p is None or np.isclose(p, q, rtol=1e-9, atol=1e-9)) for p, q in zip(x[2:], y[2:], strict=True)), (x, y)


@pytest.mark.parametrize("query", ["features_rolling_family", "features_lag_ratios", "features_indicators"])
def test_frames_are_not_aggregated_row_by_row(spark, query):
    plan = registry.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_recurrences_go_on_over_batches():
    x, states, got = np.arange(1.0, 12), {}, []
    for start in range(0, 11, 4):  # two rows of look-back
        first = max(0, start - 2)
        own, end = np.arange(first, min(11, start + 4)), min(11, start + 4)
        rows = histories.Rows({}, own % 9, states, max(0, len(own) - 2), histories.WARM if first else 0)
        got += list(rows.exponential("m", x[own], 0.25, 2)[start - first : end - first])
    want, state = [], None
    for i, v in enumerate(x):
        state = v if i % 9 == 0 else state + 0.25 * (v - state)
        want.append(np.nan if i % 9 == 0 else state)
    assert np.allclose(got, want, equal_nan=True)
