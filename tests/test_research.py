"""Brute force where SQL can't say it, and cases that the given tables don't hold."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import ts
from tessera.operators import features, market, neutral, portfolio, splits
from tessera.sources import panel as src

DAY = dt.date(2020, 1, 1)


def panel(spark, days=60, instruments=4, seed=3):
    r = random.Random(seed)
    rows = []
    for k in range(instruments):
        close = 100.0
        for i in range(days):
            close *= 1 + r.uniform(-0.05, 0.05)
            rows.append((DAY + dt.timedelta(i), f"S{k}", close * r.uniform(0.99, 1.01), close * 1.02, close * 0.97, close, float(r.randint(1, 500)), close * r.randint(10, 90)))
    return spark.createDataFrame(rows, "datetime date, instrument string, open double, high double, low double, close double, volume double, amount double")


def test_a_total_loss_stays_lost(spark):
    rows = [(DAY + dt.timedelta(i), "a", x) for i, x in enumerate([0.1, -1.0, 0.1, None, 0.2])] + [(DAY + dt.timedelta(i), "b", x) for i, x in enumerate([0.5, -1.5, 1.0])]
    f = spark.createDataFrame(rows, "datetime date, instrument string, ret double")
    got = {(r.instrument, r.datetime.day): r.g for r in f.select("*", ts.running_product(F.col("ret")).alias("g")).collect()}
    assert [round(got["a", d], 9) + 0.0 for d in range(1, 6)] == [1.1, 0.0, 0.0, 0.0, 0.0]
    assert [round(got["b", d], 9) for d in range(1, 4)] == [1.5, -0.75, -1.5]
    one = portfolio.performance(f.where("instrument = 'a'").withColumn("method", F.lit("m")), "ret", 12).first()
    assert one.annual_return == -1 and one.max_drawdown == -1 and one.days == 4


def test_residuals_on_exposures_and_dummies(spark):
    r = np.random.default_rng(4)
    rows = [(DAY + dt.timedelta(d), f"S{i}", float(r.normal()), float(r.normal()), float(r.normal()) if i else None, "xyz"[i % 3]) for d in range(3) for i in range(12)]
    f = spark.createDataFrame(rows, "datetime date, instrument string, y double, a double, b double, g string")
    got = {(x.datetime, x.instrument): x.res for x in neutral.residual_on(f, "y", ["a", "b"], ["g"], "res", 5).collect()}
    for d in range(3):
        own = [x for x in rows if x[0] == DAY + dt.timedelta(d) and x[4] is not None]
        x = np.array([[1, v[3], v[4], v[5] == "x", v[5] == "y"] for v in own], float)
        y = np.array([v[2] for v in own])
        left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.allclose([got[v[0], v[1]] for v in own], left) and got[own[0][0], "S0"] is None
    assert all(v.res is None for v in neutral.residual_on(f, "y", ["a"], [], "res", 13).collect())


def test_greedy_pruning_walks_the_board(spark):
    r = random.Random(7)
    names = [f"f{i:02d}" for i in range(40)]
    score = {n: r.randint(0, 6) for n in names}
    edges = [(a, b) for a in names for b in names if a < b and r.random() < 0.12] + [("f00", "f00")]
    board = spark.createDataFrame(list(score.items()), "factor string, s int")
    got = {x.factor: x.kept for x in portfolio.greedy_pruning(board, spark.createDataFrame(edges, "a string, b string"), "s").collect()}
    near, kept = {n: {a if b == n else b for a, b in edges if n in (a, b)} - {n} for n in names}, set()
    for n in sorted(names, key=lambda n: (-score[n], n)):
        if not near[n] & kept:
            kept.add(n)
    assert got == {n: n in kept for n in names}


def test_ridge_by_normal_equations(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(80, 2)) * [1, 5] + [0, 3]
    y = x @ [0.5, -0.2] + r.normal(size=80) * 0.1
    rows = [(DAY + dt.timedelta(i), "a", *map(float, x[i]), float(y[i])) for i in range(80)]
    f = spark.createDataFrame(rows, "datetime date, instrument string, u double, v double, label double")
    got = {p.datetime: p.prediction for p in portfolio.ridge(f.limit(80), f, ["u", "v"], "label", 4.0).collect()}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.linalg.solve(z.T @ z + 4.0 * np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose([got[k[0]] for k in rows], y.mean() + z @ w, atol=1e-6)


def test_indicators_by_loops(spark):
    p = panel(spark, 50, 2)
    rows = {}
    for x in p.orderBy("datetime").collect():
        rows.setdefault(x.instrument, []).append(x)
    out = {(x.instrument, x.datetime): x for x in features.indicators(p).collect()}

    def ema(values, a):
        state, made = None, []
        for v in values:
            state = v if state is None else state + a * (v - state)
            made.append(state)
        return made

    for name, own in rows.items():
        c = [x.close for x in own]
        gain, loss = ema([max(b - a, 0) for a, b in zip(c, c[1:], strict=False)], 1 / 14), ema([max(a - b, 0) for a, b in zip(c, c[1:], strict=False)], 1 / 14)
        macd = [a - b for a, b in zip(ema(c, 2 / 13), ema(c, 2 / 27), strict=True)]
        obv = np.cumsum([0, *(np.sign(b.close - a.close) * b.volume for a, b in zip(own, own[1:], strict=False))])
        reach = ema([max(x.high - x.low, *((abs(x.high - b), abs(x.low - b)) if b else (0, 0))) for x, b in zip(own, [None, *c], strict=False)], 1 / 14)
        for i, x in enumerate(own):
            got = out[name, x.datetime]
            assert np.isclose(got.obv, obv[i])
            if i >= 14:
                assert np.isclose(got.rsi, 100 * gain[i - 1] / (gain[i - 1] + loss[i - 1])) and np.isclose(got.atr, reach[i])
                top, low = max(y.high for y in own[i - 13 : i + 1]), min(y.low for y in own[i - 13 : i + 1])
                assert np.isclose(got.williams, -100 * (top - x.close) / (top - low)) and np.isclose(got.stochastic, 100 * (x.close - low) / (top - low))
            if i >= 25:
                assert np.isclose(got.macd, macd[i])


def test_adaptive_average_by_a_loop(spark):
    p = panel(spark, 40, 1)
    c = [x.close for x in p.orderBy("datetime").collect()]
    got = [x.kama for x in features.kama(p, "close", 10, 2, 30).orderBy("datetime").collect()]
    state = None
    for i in range(len(c)):
        if i < 10:
            assert got[i] is None
            continue
        path = sum(abs(c[k] - c[k - 1]) for k in range(i - 9, i + 1))
        w = (abs(c[i] - c[i - 10]) / path * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        state = c[i] if state is None else state + w * (c[i] - state)
        assert np.isclose(got[i], state)


def test_splits_never_leak(spark):
    days = [DAY + dt.timedelta(i) for i in range(900) if i % 7 < 5]
    cal = spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "datetime date, pos long")
    from tessera.operators.joins import label_dates

    own = splits.purged_walk_forward(cal, train_months=9, validation_months=3, test_months=3, step_months=3, lag=1, horizon=5, embargo=4)
    audit = {r.check_name: r.status for r in splits.leakage_audit(own, label_dates(cal, 1, 5)).collect()}
    assert set(audit.values()) == {"pass"} and len(audit) == 5
    assert own.where("fate = 'purged'").count() > 0 and own.where("fate = 'embargoed'").count() == 8 * own.select("split_id").distinct().count()
    with pytest.raises(ValueError, match="allowed dates"):
        splits.allowed_dates(cal, spark.createDataFrame([(dt.date(1999, 1, 1),)], "datetime date"))


def test_liquidity_falls_back_to_close_times_volume(spark):
    p = panel(spark, 3, 3)
    assert market.with_liquidity_value(p)[1] == "amount"
    out, source = market.with_liquidity_value(p.withColumn("amount", F.lit(None).cast("double")))
    assert source == "close_volume" and all(abs(r.liquidity_value - r.close * r.volume) < 1e-9 for r in out.collect())
    assert market.with_liquidity_value(p.withColumns({c: F.lit(None).cast("double") for c in ("amount", "close")}))[1] == "unavailable"


def test_cells_that_cannot_be_read_are_counted(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2020-01-01\nx,2020-02-30\n,\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DateType())])
    assert {r.column: r.bad for r in src.bad_cells(spark, str(tmp_path / "x.csv"), schema).collect()} == {"a": 1, "b": 1}
