"""Formulas of nested windows and cross-sectional ranks; their SQL has a common table expression for each level."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import formulas as operators
from tessera.plans.base import query
from tessera.sources.panel import monthly_panel

W = "PARTITION BY instrument ORDER BY datetime"


def _f(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(value: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_f(n)} = {n} THEN {value} END"


def _simple(function: str):
    return staticmethod(lambda x, n: _full(f"{function}({x}) OVER {_f(n)}", x, n))


def _place(extreme: str):
    return staticmethod(lambda x, n: _full(f"CAST(list_position(list(round({x}, 9)) OVER {_f(n)}, {extreme}(round({x}, 9)) OVER {_f(n)}) AS DOUBLE)", x, n))


def _pair(x: str, y: str) -> tuple[str, str]:
    both = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    return f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"


class SqlVocabulary(operators.Vocabulary):
    """The words of the formulas in DuckDB's SQL."""

    column = staticmethod(lambda name: name)
    constant = staticmethod(lambda v: f"{float(v)}e0")

    @staticmethod
    def arithmetic(sign: str, a: str, b: str) -> str:
        return f"({a} / nullif({b}, 0))" if sign == "/" else f"({a} {sign} {b})"

    scalar_log = staticmethod(lambda x: f"CASE WHEN {x} > 0 THEN ln({x}) END")
    scalar_abs = staticmethod(lambda x: f"abs({x})")
    scalar_sign = staticmethod(lambda x: f"CAST(sign({x}) AS DOUBLE)")
    scalar_signedpower = staticmethod(lambda x, p: f"(sign({x}) * pow(abs({x}), {p}))")
    scalar_where = staticmethod(lambda c, a, b: f"CASE WHEN ({c}) IS NOT NULL THEN CASE WHEN {c} THEN {a} ELSE {b} END END")
    series_delay = staticmethod(lambda x, n: f"lag({x}, {n}) OVER ({W})")
    series_delta = staticmethod(lambda x, n: f"({x} - lag({x}, {n}) OVER ({W}))")
    series_change = staticmethod(lambda x, n: f"({x} / nullif(lag({x}, {n}) OVER ({W}), 0) - 1)")
    series_sum, series_mean, series_std, series_min, series_max, series_product = map(_simple, ("sum", "avg", "stddev_samp", "min", "max", "product"))
    series_argmax, series_argmin = _place("max"), _place("min")
    series_decay = staticmethod(lambda x, n: "((" + " + ".join([f"{n} * {x}", *(f"{n - i} * lag({x}, {i}) OVER ({W})" for i in range(1, n))]) + f") / {n * (n + 1) / 2})")

    @staticmethod
    def series_ts_rank(x: str, n: int) -> str:
        held = f"list(round({x}, 9)) FILTER (WHERE ({x}) IS NOT NULL) OVER {_f(n)}"
        place = f"list_position(list_sort({held}), round({x}, 9))"
        last = f"len({held}) + 1 - list_position(list_reverse_sort({held}), round({x}, 9))"
        return _full(f"CASE WHEN ({x}) IS NOT NULL THEN ({place} + {last}) / 2.0 / len({held}) END", x, n)

    @staticmethod
    def series_corr(x: str, y: str, n: int) -> str:
        a, b = _pair(x, y)
        return _full(f"covar_samp({a}, {b}) OVER {_f(n)} / nullif(stddev_samp({a}) OVER {_f(n)} * stddev_samp({b}) OVER {_f(n)}, 0)", a, n)

    @staticmethod
    def series_cov(x: str, y: str, n: int) -> str:
        a, b = _pair(x, y)
        return _full(f"covar_samp({a}, {b}) OVER {_f(n)}", a, n)

    @staticmethod
    def date_rank(x: str) -> str:
        own = f"round(CASE WHEN eligible THEN {x} END, 9)"
        return f"CASE WHEN {own} IS NOT NULL THEN (rank() OVER (PARTITION BY datetime ORDER BY {own} NULLS LAST) + (count(*) OVER (PARTITION BY datetime, {own}) - 1) / 2.0) / count({own}) OVER (PARTITION BY datetime) END"

    date_scale = staticmethod(lambda x: f"CASE WHEN eligible THEN {x} END / nullif(sum(abs(CASE WHEN eligible THEN {x} END)) OVER (PARTITION BY datetime), 0)")
    date_demean = staticmethod(lambda x, group: f"CASE WHEN eligible THEN {x} END - avg(CASE WHEN eligible THEN {x} END) OVER (PARTITION BY datetime, {group})")


def _sql() -> tuple[str, list[str]]:
    v = SqlVocabulary()
    made = operators.formulas(v)
    ctes, source = ["f0 AS (SELECT *, volume > 100 AS eligible, right(instrument, 1) AS grouping_ FROM panel)"], "f0"
    for level in sorted(v.levels):
        ctes.append(f"f{level} AS MATERIALIZED (SELECT *,\n  " + ",\n  ".join(f"{x} AS {name}" for name, x in v.levels[level].items()) + f"\n  FROM {source})")
        source = f"f{level}"
    # nine digits first and halves in decimals, so that noise doesn't decide how the sixth is rounded
    shown = ",\n  ".join(f"CAST(round(CAST({node.x} AS DECIMAL(38, 9)), 6) AS DOUBLE) AS {name}" for name, node in made.items())
    return ",\n".join(ctes) + f"\nSELECT datetime, instrument,\n  {shown} FROM {source}", list(made)


_TEXT, _NAMES = _sql()


@query("\n" + _TEXT, floats=" ".join(_NAMES))
def features_alpha_vocabulary(spark, sf_dir):
    """Thirty published formulas and two more, masked at every cross-section."""
    panel = monthly_panel(spark, sf_dir).withColumns({"eligible": F.col("volume") > 100, "grouping_": F.right("instrument", F.lit(1))})
    made = operators.alphas(panel)
    return made.select("datetime", "instrument", *(operators.noiseless(F.col(c)).alias(c) for c in _NAMES))
