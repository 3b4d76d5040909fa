"""Linear recurrences over more rows than a block, and the levels of formulas."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.recurrence import BLOCK, adaptive, exponential, recurrences
from tessera.operators import formulas

DAY = dt.date(2020, 1, 1)


def rows(spark, days, seed=1, missing=0.1):
    r = random.Random(seed)
    own = [(DAY + dt.timedelta(i), s, None if r.random() < missing else r.uniform(1, 9)) for s in ("a", "b") for i in range(days if s == "a" else 7)]
    return own, spark.createDataFrame(own, "datetime date, instrument string, x double")


@pytest.mark.parametrize("days", [1, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK + 3])
def test_exponential_means_by_a_loop(spark, days):
    own, df = rows(spark, days)
    got = {(r.instrument, r.datetime): (r.fast, r.slow) for r in exponential(df, {"fast": (F.col("x"), 2 / 3, 1), "slow": (F.col("x"), 1 / 14, 14)}).collect()}
    for s in ("a", "b"):
        for k, w in ((0, 2 / 3), (1, 1 / 14)):
            state, n = None, 0
            for d, name, x in own:
                if name != s:
                    continue
                if x is not None:
                    state, n = (x if state is None else state + w * (x - state)), n + 1
                value = got[s, d][k]
                assert (value is None) == (n < (1 if k == 0 else 14)) and (value is None or np.isclose(value, state, rtol=1e-12))


def test_any_affine_steps(spark):
    own, df = rows(spark, 3 * BLOCK, seed=4)
    out = recurrences(df, {"s": (F.col("x") / 9, F.col("x") - 4), "t": (F.lit(0.0), F.col("x"))})
    assert out.columns == ["datetime", "instrument", "x", "s", "t"]
    got = {(r.instrument, r.datetime): (r.s, r.t) for r in out.collect()}
    s = t = 0.0
    for d, name, x in own:
        if name == "a":
            if x is not None:
                s, t = x / 9 * s + x - 4, x
            assert np.isclose(got["a", d][0], s) and np.isclose(got["a", d][1], t)


def test_adaptive_average_over_gaps(spark):
    own, df = rows(spark, 2 * BLOCK, seed=9, missing=0.03)
    got = {(r.instrument, r.datetime): r.k for r in adaptive(df, "x", 5, 2, 30, "k").collect()}
    values = [x for _, s, x in own if s == "a"]
    state = None
    for i, x in enumerate(values):
        if x is None:
            assert got["a", DAY + dt.timedelta(i)] is None
            continue
        ready = i >= 5 and values[i - 5] is not None
        moves = [None if values[j] is None or values[j - 1] is None else abs(values[j] - values[j - 1]) for j in range(max(1, i - 4), i + 1)]
        path = sum(m for m in moves if m is not None) if len(moves) == 5 and None not in moves else None
        share = abs(x - values[i - 5]) / path if ready and path else 0.0
        w = (share * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        state = (x if state is None else state + w * (x - state)) if ready else None
        value = got["a", DAY + dt.timedelta(i)]
        assert (value is None) == (state is None) and (state is None or np.isclose(value, state))


def test_levels_share_equal_parts_and_alternate():
    v = formulas.SparkVocabulary.__new__(formulas.SparkVocabulary)
    formulas.Vocabulary.__init__(v)
    for kind in ("series", "date"):
        for word in ("rank", "corr", "delta"):
            setattr(v, f"{kind}_{word}", lambda *a, **k: a)
    v.column, v.constant, v.arithmetic = (lambda n: n), str, (lambda s, a, b: f"{a}{s}{b}")
    x = v.field("x")
    a = v.window(formulas.SERIES, "corr", v.window(formulas.DATE, "rank", x), v.window(formulas.DATE, "rank", v.field("x")), n=3)
    b = v.window(formulas.DATE, "rank", a + 1)
    c = v.window(formulas.SERIES, "delta", x, n=1)
    assert (a.level, b.level, c.level) == (3, 4, 1)
    assert {level: len(own) for level, own in v.levels.items()} == {1: 1, 2: 1, 3: 1, 4: 1}
