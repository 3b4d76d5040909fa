"""Feature libraries: named column builders with their look-back, and operators that need a state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import histories, ts, xs
from tessera.functions.guard import ratio
from tessera.operators.indicators import indicators, kama  # noqa: F401
from tessera.sources.panel import KEYS


@dataclass(frozen=True)
class FeatureSpec:
    """A feature: its column, the rows it looks back on, the columns it needs and the direction it is expected to have."""

    name: str
    builder: Callable[[], Column]
    window: int
    deps: tuple[str, ...] = ()
    direction: str = "watch"


def select(panel: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    """Keys and features in one projection, so that equal windows share one sort.  Changes are columns made first."""
    c, v = F.col("close"), F.col("volume")
    held = panel.withColumns({"__ret": ts.change(c), "__dc": ts.delta(c), "__dv": ts.delta(v), "__rv": ratio(v, ts.ref(v, 1)) + 1})
    return held.select(*KEYS, *(s.builder().alias(s.name) for s in specs))


def _spec(name: str, window: int, builder: Callable[[], Column], deps: str = "close", direction: str = "watch") -> FeatureSpec:
    return FeatureSpec(name, builder, window, tuple(deps.split()), direction)


C = F.col
BASIC = {
    s.name: s
    for s in (
        *(_spec(f"ret_{n}", n + 1, lambda n=n: ts.change(C("close"), n)) for n in (5, 10, 20)),
        _spec("rev_5", 6, lambda: -ts.change(C("close"), 5), direction="positive"),
        _spec("rev_20_exclude_5", 21, lambda: -(ratio(ts.ref(C("close"), 5), ts.ref(C("close"), 20)) - 1), direction="positive"),
        _spec("std_20", 21, lambda: ts.std(C("__ret"), 20), direction="negative"),
        _spec("downside_std_20", 21, lambda: ts.std(F.when(C("__ret").isNotNull(), F.least(C("__ret"), F.lit(0.0))), 20), direction="negative"),
        _spec("max_drawdown_20", 20, lambda: -ts.drawdown(C("close"), 20), direction="negative"),
        _spec("amplitude_20", 20, lambda: ts.mean(ratio(C("high") - C("low"), C("close")), 20), "high low close", "negative"),
        _spec("amount_mean_20", 20, lambda: ts.mean(C("amount"), 20), "amount"),
        _spec("amount_std_20", 20, lambda: ts.std(C("amount"), 20), "amount"),
        _spec("amount_cv_20", 20, lambda: ratio(ts.std(C("amount"), 20), ts.mean(C("amount"), 20)), "amount", "negative"),
        _spec("volume_ratio_5_20", 20, lambda: ratio(ts.mean(C("volume"), 5), ts.mean(C("volume"), 20)), "volume"),
        _spec("corr_ret_volume_20", 21, lambda: ts.corr(C("__ret"), C("volume"), 20), "close volume"),
        _spec("corr_ret_amount_20", 21, lambda: ts.corr(C("__ret"), C("amount"), 20), "close amount"),
    )
}

_SPAN = lambda: C("high") - C("low") + 1e-12
_TOP, _BOTTOM = (lambda: F.greatest("open", "close")), (lambda: F.least("open", "close"))
CANDLE = {
    s.name: s
    for s in (
        _spec("kmid", 1, lambda: ratio(C("close") - C("open"), C("open"))),
        _spec("klen", 1, lambda: ratio(C("high") - C("low"), C("open"))),
        _spec("kmid2", 1, lambda: (C("close") - C("open")) / _SPAN()),
        _spec("kup", 1, lambda: ratio(C("high") - _TOP(), C("open"))),
        _spec("kup2", 1, lambda: (C("high") - _TOP()) / _SPAN()),
        _spec("klow", 1, lambda: ratio(_BOTTOM() - C("low"), C("open"))),
        _spec("klow2", 1, lambda: (_BOTTOM() - C("low")) / _SPAN()),
        _spec("ksft", 1, lambda: ratio(2 * C("close") - C("high") - C("low"), C("open"))),
        _spec("ksft2", 1, lambda: (2 * C("close") - C("high") - C("low")) / _SPAN()),
    )
}


def lag_ratios(depth: int = 60) -> list[FeatureSpec]:
    """Lags 0 to depth - 1 of prices over the close, and of volume over the volume."""
    prices = [_spec(f"{x}_{n}", n + 1, lambda x=x, n=n: ratio(ts.ref(C(x), n), C("close")), f"{x} close") for x in ("open", "high", "low", "close", "vwap") for n in range(depth)]
    return prices + [_spec(f"volume_{n}", n + 1, lambda n=n: ts.ref(C("volume"), n) / (C("volume") + 1e-12), "volume") for n in range(depth)]


def rolling_family(n: int) -> list[FeatureSpec]:
    """Price, association, balance and volume features over n rows."""
    c, v, by_close = C("close"), C("volume"), lambda x: ratio(x, C("close"))
    make = {
        "roc": lambda: by_close(ts.ref(c, n)), "ma": lambda: by_close(ts.mean(c, n)), "std": lambda: by_close(ts.std(c, n)), "beta": lambda: by_close(ts.trend(c, n, "slope")),
        "rsqr": lambda: ts.trend(c, n, "r2"), "resi": lambda: by_close(ts.trend(c, n, "residual")), "max": lambda: by_close(ts.high(C("high"), n)), "min": lambda: by_close(ts.low(C("low"), n)),
        "qtlu": lambda: by_close(ts.quantile(c, n, 0.8)), "qtld": lambda: by_close(ts.quantile(c, n, 0.2)), "rank": lambda: ts.rank(c, n),
        "rsv": lambda: (c - ts.low(C("low"), n)) / (ts.high(C("high"), n) - ts.low(C("low"), n) + 1e-12),
        "imax": lambda: ts.arg_max(C("high"), n) / n, "imin": lambda: ts.arg_min(C("low"), n) / n, "imxd": lambda: (ts.arg_max(C("high"), n) - ts.arg_min(C("low"), n)) / n,
        "corr": lambda: ts.corr(c, F.when(v > -1, F.log1p(v)), n),
    }
    # windows don't nest: ``select`` makes changes first
    dc, dv, ret = C("__dc"), C("__dv"), C("__ret")
    plus, minus = (lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))), (lambda x: F.when(x.isNotNull(), F.greatest(-x, F.lit(0.0))))
    share = lambda x, part: ts.total(part(x), n) / (ts.total(F.abs(x), n) + 1e-12)
    moved = lambda: F.abs(ret) * v
    make |= {
        "cord": lambda: ts.corr(ret + 1, F.when(C("__rv") > 0, F.ln(C("__rv"))), n),
        "cntp": lambda: ts.mean((dc > 0).cast("double"), n), "cntn": lambda: ts.mean((dc < 0).cast("double"), n), "cntd": lambda: ts.mean((dc > 0).cast("double"), n) - ts.mean((dc < 0).cast("double"), n),
        "sump": lambda: share(dc, plus), "sumn": lambda: share(dc, minus), "sumd": lambda: share(dc, plus) - share(dc, minus),
        "vma": lambda: ts.mean(v, n) / (v + 1e-12), "vstd": lambda: ts.std(v, n) / (v + 1e-12), "wvma": lambda: ts.std(moved(), n) / (ts.mean(moved(), n) + 1e-12),
        "vsump": lambda: share(dv, plus), "vsumn": lambda: share(dv, minus), "vsumd": lambda: share(dv, plus) - share(dv, minus),
    }
    return [_spec(f"{k}_{n}", n + 1, f, "open high low close volume") for k, f in make.items()]


def lagged(panel: DataFrame, depth: int = 60) -> DataFrame:
    """Keys and the columns of ``lag_ratios``, by arrays of shifted rows."""
    prices = ("open", "high", "low", "close", "vwap")

    def ratios(rows: histories.Rows) -> dict[str, np.ndarray]:
        by = {**dict.fromkeys(prices, np.where(rows.columns["close"] == 0, np.nan, rows.columns["close"])), "volume": rows.columns["volume"] + 1e-12}
        return {f"{x}_{n}": rows.ref(rows.columns[x], n) / by[x] for x in by for n in range(depth)}

    return histories.along(panel, [*prices, "volume"], [s.name for s in lag_ratios(depth)], max(1, depth - 1), ratios)


def rolling(panel: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 30, 60)) -> DataFrame:
    """Keys and the columns of ``rolling_family`` over each number of rows, by arrays: all features of a window see one sort of its values."""
    names = [s.name for n in windows for s in rolling_family(n)]
    return histories.along(panel, ["open", "high", "low", "close", "volume"], names, max(windows), lambda rows: {f"{k}_{n}": x for n in windows for k, x in _rolled(rows, n).items()})


def _rolled(rows: histories.Rows, n: int) -> dict[str, np.ndarray]:
    ratio, tiny = histories.ratio, 1e-12
    high, low, c, v = (rows.columns[x] for x in ("high", "low", "close", "volume"))
    before, held = rows.ref(c, 1), rows.ref(v, 1)
    dc, dv, ret, rv = c - before, v - held, ratio(c, before) - 1, ratio(v, held) + 1
    log = lambda x: np.log(np.where(x > 0, x, np.nan))
    t = np.arange(n) - (n - 1) / 2
    slope = rows.reduced(lambda w: t @ histories.centred(w) / (t @ t), n, c)
    spread = rows.reduced(lambda w: np.square(histories.centred(w)).sum(axis=0), n, c)
    at_end = rows.reduced(lambda w: histories.centred(w)[-1], n, c) - slope * t[-1]

    upper, lower = rows.quantiles(c, n, (0.8, 0.2))
    rank = upper * 0 + rows.reduced(lambda w: ((w < w[-1]).sum(axis=0) + ((w == w[-1]).sum(axis=0) + 1) / 2) / n, n, c)
    top, floor, imax, imin = rows.high(high, n), rows.low(low, n), rows.arg(high, n, True), rows.arg(low, n, False)
    share = lambda x, sign: rows.total(np.maximum(sign * x, 0.0), n) / (rows.total(np.abs(x), n) + tiny)
    count = lambda x: rows.mean(np.where(np.isnan(dc), np.nan, x), n)
    rises, falls, gains, losses, fuller, thinner = count(dc > 0), count(dc < 0), share(dc, 1), share(dc, -1), share(dv, 1), share(dv, -1)
    moved = np.abs(ret) * v
    return {
        "roc": ratio(rows.ref(c, n), c), "ma": ratio(rows.mean(c, n), c), "std": ratio(rows.std(c, n), c), "beta": ratio(slope, c), "rsqr": ratio(np.square(slope) * (t @ t), spread), "resi": ratio(at_end, c),
        "max": ratio(top, c), "min": ratio(floor, c), "qtlu": ratio(upper, c), "qtld": ratio(lower, c), "rank": rank, "rsv": (c - floor) / (top - floor + tiny),
        "imax": imax / n, "imin": imin / n, "imxd": (imax - imin) / n, "corr": rows.corr(c, log(v + 1), n), "cord": rows.corr(ret + 1, log(rv), n),
        "cntp": rises, "cntn": falls, "cntd": rises - falls, "sump": gains, "sumn": losses, "sumd": gains - losses, "vma": rows.mean(v, n) / (v + tiny), "vstd": rows.std(v, n) / (v + tiny),
        "wvma": rows.std(moved, n) / (rows.mean(moved, n) + tiny), "vsump": fuller, "vsumn": thinner, "vsumd": fuller - thinner,
    }


def run_lengths(panel: DataFrame, mask: str) -> DataFrame:
    """(instrument, start, end, length) of each run of rows in which ``mask`` holds."""
    first = F.when(F.col(mask) == F.lag(mask).over(ts.by_date()), 0).otherwise(1)
    runs = panel.withColumn("__first", first).withColumn("run", F.sum("__first").over(ts.by_date().rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where(F.col(mask)).groupBy("instrument", "run").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"), F.count("*").alias("length")).drop("run")


def missing_spans(panel: DataFrame) -> DataFrame:
    """(instrument, start_date, end_date, days): gaps of instruments on the panel's calendar."""
    from tessera.operators.joins import calendar_of, dense_grid

    gaps = dense_grid(panel, calendar_of(panel)).where("close is null")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("instrument").orderBy("pos"))
    return gaps.withColumn("island", island).groupBy("instrument", "island").agg(F.min("datetime").alias("start_date"), F.max("datetime").alias("end_date"), F.count("*").alias("days")).drop("island")


def volume_indices(panel: DataFrame) -> DataFrame:
    """Adds nvi (negative volume index from 1000) and vpt (volume-price trend)."""
    p = panel.withColumns({"__ret": ts.change(C("close")), "__pv": ts.ref(C("volume"), 1)})
    quiet = F.when(C("volume") < C("__pv"), F.coalesce("__ret", F.lit(0.0))).otherwise(0.0)
    return p.withColumns({"nvi": 1000 * ts.running_product(quiet), "vpt": ts.running_total(F.coalesce(C("volume") * C("__ret"), F.lit(0.0)))}).drop("__ret", "__pv")


def market_factors(panel: DataFrame, *, month: int = 21, year: int = 252, short: int = 20, long: int = 60) -> DataFrame:
    """Seventeen price, liquidity and risk factors at the close.  The market is the equal-weight mean return of the date."""
    p = panel.withColumns({"__ret": ts.change(C("close")), "__before": ts.ref(C("close"), 1)})
    p = p.withColumn("__market", F.avg("__ret").over(xs.over()))
    p = p.withColumns({
        "__night": ratio(C("open"), C("__before")) - 1, "__day": ratio(C("close"), C("open")) - 1, "__range": F.pow(F.ln(ratio(C("high"), C("low"))), F.lit(2.0)),
        "__illiquid": ratio(F.abs("__ret"), C("amount")), "__vwap": ratio(C("close"), C("vwap")) - 1, "__down": F.when(C("__ret") < 0, C("__ret")),
        "__beta": ratio(ts.covariance(C("__ret"), C("__market"), long, 2 * long // 3), ts.variance(C("__market"), long, 2 * long // 3)),
    })
    p = p.withColumn("__own", C("__ret") - C("__beta") * C("__market"))
    before = by_date_before(short)
    return p.select(
        *KEYS, (ratio(ts.ref(C("close"), month), ts.ref(C("close"), year)) - 1).alias("momentum"), (-(ratio(C("close"), ts.ref(C("close"), month)) - 1)).alias("reversal"),
        ratio(C("close"), ts.high(C("close"), year, year // 2)).alias("high_share"), ts.mean(C("__night"), short, short // 2).alias("overnight"), ts.mean(C("__day"), short, short // 2).alias("intraday"),
        ts.high(C("__ret"), month, month // 2 + 1).alias("max_return"), ts.std(C("__ret"), long, long // 2).alias("volatility"), ts.std(C("__down"), long, long // 4).alias("downside_volatility"),
        ts.skew(C("__ret"), long, long // 2).alias("skewness"), F.sqrt(ts.mean(C("__range"), short, short // 2) / (4 * F.ln(F.lit(2.0)))).alias("parkinson"),
        ts.drawdown(C("close"), long, long // 2).alias("max_drawdown"), (ts.mean(C("__illiquid"), short, short // 2) * 1e6).alias("amihud"),
        (ratio(C("amount"), F.when(F.count("amount").over(before) >= short // 2, F.avg("amount").over(before))) - 1).alias("amount_momentum"),
        C("__vwap").alias("vwap_deviation"), ts.mean(C("__vwap"), short, short // 2).alias("vwap_deviation_mean"), C("__beta").alias("beta"), ts.std(C("__own"), long, 2 * long // 3).alias("idiosyncratic"),
    )


def by_date_before(n: int):
    """The n rows before the current one."""
    return ts.by_date().rowsBetween(-n, -1)


def market_state(panel: DataFrame, n: int, band: float) -> DataFrame:
    """(datetime, market_return, compounded, volatility, market_state) from the equal-weight return; one row a date, so the window
    over dates sees the calendar only."""
    daily = panel.withColumn("ret", ts.change(C("close"))).groupBy("datetime").agg(F.avg("ret").alias("market_return"))
    w = Window.orderBy("datetime").rowsBetween(-(n - 1), 0)
    full = F.count("market_return").over(w) == n
    out = daily.withColumns({"compounded": F.when(full, ts.growth(C("market_return"), w) - 1), "volatility": F.when(full, F.stddev_samp("market_return").over(w))})
    return out.withColumn("market_state", F.when(C("compounded").isNull(), "unknown").when(C("compounded") > band, "up").when(C("compounded") < -band, "down").otherwise("sideways"))


def summary(panel: DataFrame, columns: list[str]) -> DataFrame:
    long = panel.unpivot(KEYS, [F.col(c).cast("double").alias(c) for c in columns], "factor", "value")
    return long.groupBy("factor").agg(F.count("value").alias("present"), F.count_distinct("instrument").alias("instruments"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def lookback(specs: list[FeatureSpec]) -> dict[str, int]:
    return {s.name: s.window for s in specs}


def batches(specs: list[FeatureSpec], size: int = 100) -> Iterator[list[FeatureSpec]]:
    """Blocks of features: very wide projections leave code generation."""
    for i in range(0, len(specs), size):
        yield specs[i : i + size]
