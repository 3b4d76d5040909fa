"""Many factors at once: daily correlations by matrices and residuals by one design, against one at a time."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd

from tessera.operators import evaluate, neutral

DAY = dt.date(2020, 1, 1)


def test_pairs_of_different_missing_patterns(spark):
    r = np.random.default_rng(1)
    rows, frames = [], {}
    for d in range(3):
        x = np.round(r.normal(size=(25, 7)), 1)
        x[r.random(25) < 0.3, 1] = np.nan  # factors 1 and 2 have patterns of their own, 3 and 4 share one
        x[r.random(25) < 0.5, 2] = np.nan
        x[:5, 3:5] = np.nan
        x[:, 5] = 3.0
        x[3:, 6] = np.nan
        frames[DAY + dt.timedelta(d)] = pd.DataFrame(x, columns=[f"f{j}" for j in range(7)])
        rows += [(DAY + dt.timedelta(d), f"S{i:02d}", f"f{j}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(25) for j in range(7)]
    got = {(g.datetime, g.factor_a, g.factor_b): g for g in evaluate.pair_correlation(spark.createDataFrame(rows, "datetime date, instrument string, factor string, value double"), 5).collect()}
    want = 0
    for day, f in frames.items():
        for a, b in itertools.combinations(f.columns, 2):
            both = f[[a, b]].dropna().rank()
            if both.empty:
                assert (day, a, b) not in got
                continue
            g, want = got[day, a, b], want + 1
            constant = both[a].nunique() == 1 or both[b].nunique() == 1
            assert g.common == len(both) and g.reason == ("insufficient" if len(both) < 5 else "constant" if constant else "ok")
            assert (g.rho is None) == (g.reason != "ok") and (g.rho is None or np.isclose(g.rho, both.corr().iloc[0, 1]))
    assert len(got) == want


def test_many_factors_in_one_pass(spark):
    from pyspark.sql import functions as F

    base = spark.range(40 * 120).select(F.make_date(F.lit(2020), F.lit(1), (F.col("id") % 2 + 1).cast("int")).alias("datetime"), F.concat(F.lit("S"), F.floor(F.col("id") / 2 % 40)).alias("instrument"), F.concat(F.lit("f"), F.floor(F.col("id") / 80)).alias("factor"), F.rand(3).alias("value"))
    out = evaluate.pair_correlation(base.dropDuplicates(["datetime", "instrument", "factor"]), 5)
    assert out.count() == 2 * 60 * 59 // 2
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_residuals_of_many_factors_from_one_design(spark):
    r = np.random.default_rng(5)
    rows = []
    for d in range(2):
        for i in range(30):
            y = [None if (j == 1 and i % 3 == 0) or (j == 3 and i < 24) else float(r.normal()) for j in range(4)]
            rows.append((DAY + dt.timedelta(d), f"S{i:02d}", *y, float(r.normal()) if i != 7 else None, float(i % 5), "abc"[i % 3] if i % 10 else None))
    df = spark.createDataFrame(rows, "datetime date, instrument string, y0 double, y1 double, y2 double, y3 double, u double, v double, g string")
    got = {(x.datetime, x.instrument): x for x in neutral.residuals_on(df, {f"y{j}": f"r{j}" for j in range(4)}, ["u", "v"], ["g"], 10).collect()}
    assert len(got) == 60
    for d in range(2):
        own = [x for x in rows if x[0] == DAY + dt.timedelta(d)]
        design = np.array([[1, x[6] if x[6] is not None else np.nan, x[7], x[8] == "a", x[8] == "b", x[8] == "c"] for x in own], float)
        for j in range(4):
            y = np.array([np.nan if x[2 + j] is None else x[2 + j] for x in own])
            ok = ~np.isnan(y) & ~np.isnan(design).any(1)
            want = np.full(30, np.nan)
            if ok.sum() >= 10:
                want[ok] = y[ok] - design[ok] @ np.linalg.pinv(design[ok]) @ y[ok]
            have = np.array([np.nan if got[x[0], x[1]][f"r{j}"] is None else got[x[0], x[1]][f"r{j}"] for x in own])
            assert np.allclose(have, want, equal_nan=True)
