"""Per-instrument window columns.  Frames are row-based and end at the current row; ``least`` observations are needed
(all ``n`` by default).  Every window has the total order ``datetime`` inside an instrument."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.functions.guard import ratio


def by_date():
    return Window.partitionBy("instrument").orderBy("datetime")


def frame(n: int):
    return by_date().rowsBetween(-(n - 1), 0)


def _full(value: Column, x: Column, n: int, least: int | None) -> Column:
    return F.when(F.count(x).over(frame(n)) >= (n if least is None else least), value)


def ref(x: Column, n: int) -> Column:
    """The value n rows ago; of later rows for negative n."""
    return F.lag(x, n).over(by_date()) if n >= 0 else F.lead(x, -n).over(by_date())


def change(x: Column, n: int = 1) -> Column:
    return ratio(x, ref(x, n)) - 1


def delta(x: Column, n: int = 1) -> Column:
    return x - ref(x, n)


def mean(x: Column, n: int, least: int | None = None) -> Column:
    return _full(F.avg(x).over(frame(n)), x, n, least)


def total(x: Column, n: int, least: int | None = None) -> Column:
    return _full(F.sum(x).over(frame(n)), x, n, least)


def low(x: Column, n: int, least: int | None = None) -> Column:
    return _full(F.min(x).over(frame(n)), x, n, least)


def high(x: Column, n: int, least: int | None = None) -> Column:
    return _full(F.max(x).over(frame(n)), x, n, least)


def std(x: Column, n: int, least: int | None = None) -> Column:
    """Sample standard deviation."""
    return _full(F.stddev_samp(x).over(frame(n)), x, n, least)


def variance(x: Column, n: int, least: int | None = None) -> Column:
    return _full(F.var_samp(x).over(frame(n)), x, n, least)


def skew(x: Column, n: int, least: int | None = None) -> Column:
    """Bias-corrected skewness; NULL under three observations or without spread."""
    k = F.count(x).over(frame(n)).cast("double")
    spread = F.stddev_pop(x).over(frame(n))
    return _full(F.when((k > 2) & (spread > 0), F.skewness(x).over(frame(n)) * F.sqrt(k * (k - 1)) / (k - 2)), x, n, least)


def _paired(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def covariance(x: Column, y: Column, n: int, least: int | None = None) -> Column:
    a, b = _paired(x, y)
    return _full(F.covar_samp(a, b).over(frame(n)), a, n, least)


def corr(x: Column, y: Column, n: int, least: int | None = None) -> Column:
    a, b = _paired(x, y)
    w = frame(n)
    return _full(ratio(F.covar_samp(a, b).over(w), F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)), a, n, least)


def beta(y: Column, x: Column, n: int, least: int | None = None) -> Column:
    """Slope of y on x."""
    a, b = _paired(y, x)
    return _full(ratio(F.covar_samp(a, b).over(frame(n)), F.var_samp(b).over(frame(n))), a, n, least)


def quantile(x: Column, n: int, q: float, least: int | None = None) -> Column:
    return _full(F.percentile(x, F.lit(q)).over(frame(n)), x, n, least)


def rank(x: Column, n: int, least: int | None = None) -> Column:
    """Average rank of the current value among the last n, as a share of their number."""
    held = F.array_agg(x).over(frame(n))
    below, same = F.size(F.filter(held, lambda v: v < x)), F.size(F.filter(held, lambda v: v == x))
    return _full(F.when(x.isNotNull(), (below + (same + 1) / 2) / F.size(held)), x, n, least)


def arg_max(x: Column, n: int, least: int | None = None) -> Column:
    """How many rows into the frame the largest value stands (1 to n), the first among equals."""
    return _arg(x, n, least, largest=True)


def arg_min(x: Column, n: int, least: int | None = None) -> Column:
    return _arg(x, n, least, largest=False)


def _arg(x: Column, n: int, least: int | None, largest: bool) -> Column:
    held = F.array_agg(F.coalesce(x, F.lit(float("-inf" if largest else "inf")))).over(frame(n))
    return _full(F.array_position(held, F.array_max(held) if largest else F.array_min(held)).cast("double"), x, n, least)


def trend(x: Column, n: int, what: str, least: int | None = None) -> Column:
    """Linear trend of x in time: 'slope', 'r2', or 'residual' of the current value."""
    t = F.row_number().over(by_date()).cast("double")
    w = frame(n)
    slope, spread = F.regr_slope(x, t).over(w), F.stddev_samp(x).over(w)
    if what == "slope":
        value = slope
    elif what == "r2":
        value = F.when(spread > 0, F.regr_r2(x, t).over(w))
    else:
        value = x - (F.regr_intercept(x, t).over(w) + slope * t)
    return _full(value, x, n, least)


def decay(x: Column, n: int) -> Column:
    """Weighted mean with weights n for the current row down to 1."""
    value = sum(((n - i) * ref(x, i) for i in range(1, n)), n * x)
    return value / (n * (n + 1) / 2)


def drawdown(x: Column, n: int, least: int | None = None) -> Column:
    """The largest fall below the highest earlier value of the frame, as a share (zero or negative)."""
    held = F.array_agg(x).over(frame(n))
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst"))
    step = lambda s, v: F.struct(F.coalesce(F.greatest(s["peak"], v), v).alias("peak"), F.least(s["worst"], F.coalesce(F.try_divide(v, F.greatest(s["peak"], v)), F.lit(1.0)) - 1).alias("worst"))
    return _full(F.aggregate(held, start, step, lambda s: s["worst"]), x, n, least)


def growth(x: Column, over=None) -> Column:
    """Product of 1 + x over a window, or of a group: zero from the first return of -100 % on, with the sign of its factors."""
    w = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    factor = 1 + x
    size = F.exp(w(F.sum(F.when(factor != 0, F.ln(F.abs(factor))))))
    sign = F.when(w(F.count_if(factor < 0)) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(w(F.count(x)) > 0, F.when(w(F.count_if(factor == 0)) > 0, 0.0).otherwise(sign * F.coalesce(size, F.lit(1.0))))


def running_total(x: Column) -> Column:
    return F.sum(x).over(by_date().rowsBetween(Window.unboundedPreceding, 0))


def running_product(x: Column) -> Column:
    """Product of 1 + x so far."""
    return growth(x, by_date().rowsBetween(Window.unboundedPreceding, 0))


def running_max(x: Column) -> Column:
    return F.max(x).over(by_date().rowsBetween(Window.unboundedPreceding, 0))


def forward_fill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(x: Column) -> Column:
    return F.first(x, ignorenulls=True).over(by_date().rowsBetween(0, Window.unboundedFollowing))


def carried(x: Column, position: Column, most: int) -> tuple[Column, Column]:
    """The last value at most ``most`` calendar positions old, and its age."""
    last = F.last(F.when(x.isNotNull(), F.struct(x.alias("v"), position.alias("p"))), ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    age = position - last["p"]
    return F.when(age <= most, last["v"]), age


def prior_mean(x: Column, n: int) -> Column:
    """Mean of the n rows before the current one; NULL unless all are there."""
    w = by_date().rowsBetween(-n, -1)
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w))


