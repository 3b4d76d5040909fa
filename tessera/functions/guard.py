"""Arithmetic in which NaN, infinities and zero denominators mean missing (NULL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or NULL for NaN and infinities."""
    c = c.try_cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clean(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.withColumns({c: finite(F.col(c)) for c in columns})


def finite_rows(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all the columns are finite numbers."""
    return clean(frame, columns).dropna(subset=columns)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def positive_log(c: Column) -> Column:
    """The natural logarithm of positive values."""
    return F.when(c > 0, F.ln(c))


def correlation(x: str, y: str, over=None) -> Column:
    """Pearson correlation over rows in which both are there; NULL where one side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    w = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return ratio(w(F.covar_samp(a, b)), w(F.stddev_samp(a)) * w(F.stddev_samp(b)))
