"""Indicators and averages by linear recurrences; their SQL steps through each instrument's rows."""

from __future__ import annotations

from tessera.operators import indicators as operators
from tessera.plans.base import query
from tessera.sources.panel import monthly_panel

W = "PARTITION BY instrument ORDER BY datetime"


def _f(n: int) -> str:
    return f"(PARTITION BY instrument ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _agg(function: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_f(n)} = {n} THEN {function}({x}) OVER {_f(n)} END"


def _ref(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def _averaged(source: str, name: str, columns: dict[str, tuple[str, str, int]]) -> str:
    """CTEs that add exponential means {column: (values, weight, least)} to ``source``, a row at a time."""
    values = ", ".join(f"{x} AS x_{c}" for c, (x, _, _) in columns.items())
    first = ", ".join(f"x_{c} AS s_{c}" for c in columns)
    later = ", ".join(f"CASE WHEN v.x_{c} IS NULL THEN s.s_{c} WHEN s.s_{c} IS NULL THEN v.x_{c} ELSE s.s_{c} + {w} * (v.x_{c} - s.s_{c}) END" for c, (_, w, _) in columns.items())
    shown = ", ".join(f"CASE WHEN count(v.x_{c}) OVER (PARTITION BY v.instrument ORDER BY v.k) >= {least} THEN s.s_{c} END AS {c}" for c, (_, _, least) in columns.items())
    return f"""{name}_v AS MATERIALIZED (SELECT instrument, k, {values} FROM {source}),
{name}_s AS (SELECT instrument, k, {first} FROM {name}_v WHERE k = 1
  UNION ALL SELECT v.instrument, v.k, {later} FROM {name}_s s JOIN {name}_v v ON v.instrument = s.instrument AND v.k = s.k + 1),
{name} AS MATERIALIZED (SELECT t.*, {shown} FROM {source} t JOIN {name}_v v USING (instrument, k) JOIN {name}_s s USING (instrument, k))"""


def _part(n: int) -> str:
    return f"({_agg('sum', 'bought', n)}) / nullif({_agg('sum', 'span', n)}, 0)"


def _middle(n: int) -> str:
    return f"(({_agg('max', 'h', n)}) + ({_agg('min', 'l', n)})) / 2"


_BASE = f"""b0 AS (
  SELECT datetime, instrument, row_number() OVER ({W}) AS k, close AS c, high AS h, low AS l, CAST(volume AS DOUBLE) AS v,
         {_ref('close', 1)} AS before, {_ref('high', 1)} AS h1, {_ref('low', 1)} AS l1 FROM panel
), b1 AS (
  SELECT *, c - before AS d, h - l AS hl, (h + l + c) / 3 AS typical, (h + l) / 2 AS middle, greatest(h - l, abs(h - before), abs(l - before)) AS reach,
         h - h1 AS up, l1 - l AS down, c - least(l, before) AS bought, greatest(h, before) - least(l, before) AS span, abs(h - l1) AS vm_high, abs(l - h1) AS vm_low FROM b0
), b2 AS MATERIALIZED (
  SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS gain, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS loss,
         CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS minus,
         typical - {_ref('typical', 1)} AS turn, CASE WHEN hl > 0 THEN (2 * c - h - l) / hl ELSE 0 END * v AS place, (up - down) * hl / nullif(2 * v, 0) AS lift FROM b1
)"""

_LEVELS = ",\n".join([
    _averaged("b2", "a1", {
        "ema_fast": ("c", "2.0e0 / 13", 12), "ema_slow": ("c", "2.0e0 / 27", 26), "e1": ("c", "2.0e0 / 16", 15), "d1": ("d", "2.0e0 / 26", 25), "m1": ("abs(d)", "2.0e0 / 26", 25),
        "gains": ("gain", "1.0e0 / 14", 14), "losses": ("loss", "1.0e0 / 14", 14), "atr": ("reach", "1.0e0 / 14", 14), "t20": ("typical", "2.0e0 / 21", 20), "ups": ("plus", "1.0e0 / 14", 14),
        "downs": ("minus", "1.0e0 / 14", 14), "force": ("d * v", "2.0e0 / 14", 13), "v12": ("v", "2.0e0 / 13", 12), "v26": ("v", "2.0e0 / 27", 26), "range_1": ("hl", "2.0e0 / 10", 9),
    }),
    f"""c1 AS (SELECT *, ema_fast - ema_slow AS macd, 100 * gains / CASE WHEN gains + losses > 0 THEN gains + losses END AS rsi, 100 * (v12 - v26) / nullif(v26, 0) AS pvo,
  100 * ups / nullif(atr, 0) AS adx_high, 100 * downs / nullif(atr, 0) AS adx_low, 100 * (c / nullif({_ref('c', 12)}, 0) - 1) AS roc, {_agg('max', 'h', 14)} AS top, {_agg('min', 'l', 14)} AS floor FROM a1)""",
    f"""c2 AS MATERIALIZED (SELECT *, 100 * macd / nullif(ema_slow, 0) AS ppo, 100 * (c - floor) / CASE WHEN top > floor THEN top - floor END AS stochastic,
  (rsi - ({_agg('min', 'rsi', 14)})) / nullif(({_agg('max', 'rsi', 14)}) - ({_agg('min', 'rsi', 14)}), 0) AS stochastic_rsi,
  100 * abs(adx_high - adx_low) / CASE WHEN adx_high + adx_low > 0 THEN adx_high + adx_low END AS dx FROM c1)""",
    _averaged("c2", "a2", {
        "macd_signal": ("macd", "2.0e0 / 10", 9), "ppo_signal": ("ppo", "2.0e0 / 10", 9), "pvo_signal": ("pvo", "2.0e0 / 10", 9), "e2": ("e1", "2.0e0 / 16", 15), "d2": ("d1", "2.0e0 / 14", 13),
        "m2": ("m1", "2.0e0 / 14", 13), "adx": ("dx", "1.0e0 / 14", 14), "range_2": ("range_1", "2.0e0 / 10", 9),
    }),
    _averaged("a2", "a3", {"e3": ("e2", "2.0e0 / 16", 15)}),
    f"""c3 AS (SELECT *, {', '.join(f"c / nullif({_ref('c', n)}, 0) - 1 AS r{n}" for n in (10, 15, 20, 30))}, range_1 / nullif(range_2, 0) AS narrow, {_agg('avg', 'stochastic_rsi', 3)} AS stochastic_rsi_k,
  pow(100 * (c / nullif({_agg('max', 'c', 14)}, 0) - 1), 2) AS fall, {_agg('avg', 'typical', 20)} AS typical_mean, list(typical) OVER {_f(20)} AS typicals FROM a3)""",
    f"""c4 AS (SELECT *, 100 * (({_agg('avg', 'r10', 10)}) + 2 * ({_agg('avg', 'r15', 10)}) + 3 * ({_agg('avg', 'r20', 10)}) + 4 * ({_agg('avg', 'r30', 15)})) AS kst,
  {_agg('avg', 'c', 20)} AS bollinger_mid, {_agg('stddev_pop', 'c', 20)} AS spread, {_agg('max', 'h', 20)} AS donchian_high, {_agg('min', 'l', 20)} AS donchian_low,
  CASE WHEN len(typicals) = 20 THEN list_avg(list_transform(typicals, lambda x: abs(x - typical_mean))) END AS distance FROM c3)""",
    "c5 AS (SELECT *, bollinger_mid + 2 * spread AS bollinger_high, bollinger_mid - 2 * spread AS bollinger_low FROM c4)",
])

_FLOW = f"sum(CASE WHEN turn {{}} 0 THEN typical * v ELSE 0 END) OVER {_f(14)}"
_SHOWN = {
    "tsi": "100 * d2 / nullif(m2, 0)", "ultimate": f"100 * (4 * {_part(7)} + 2 * {_part(14)} + {_part(28)}) / 7", "stochastic_rsi_d": _agg("avg", "stochastic_rsi_k", 3),
    "stochastic_signal": _agg("avg", "stochastic", 3), "williams": "stochastic - 100", "awesome": f"({_agg('avg', 'middle', 5)}) - ({_agg('avg', 'middle', 34)})", "ppo_diff": "ppo - ppo_signal",
    "pvo_diff": "pvo - pvo_signal", "macd_diff": "macd - macd_signal", "sma_fast": _agg("avg", "c", 12), "sma_slow": _agg("avg", "c", 26),
    "wma": "(" + " + ".join(f"{9 - i} * {_ref('c', i)}" if i else "9 * c" for i in range(9)) + ") / 45", "trix": f"100 * (e3 / nullif({_ref('e3', 1)}, 0) - 1)", "mass_index": _agg("sum", "narrow", 25),
    "vortex_high": f"({_agg('sum', 'vm_high', 14)}) / nullif({_agg('sum', 'reach', 14)}, 0)", "vortex_low": f"({_agg('sum', 'vm_low', 14)}) / nullif({_agg('sum', 'reach', 14)}, 0)",
    "dpo": f"{_ref('c', 11)} - ({_agg('avg', 'c', 20)})", "kst_signal": _agg("avg", "kst", 9), "ichimoku_conversion": _middle(9), "ichimoku_base": _middle(26), "ichimoku_a": f"({_middle(9)} + {_middle(26)}) / 2",
    "ichimoku_b": _middle(52), "cci": "CASE WHEN typical <> typical_mean THEN (typical - typical_mean) / nullif(0.015e0 * distance, 0) END",
    "aroon_up": f"CASE WHEN count(h) OVER {_f(26)} = 26 THEN 4.0 * (list_position(list(h) OVER {_f(26)}, max(h) OVER {_f(26)}) - 1) END",
    "aroon_down": f"CASE WHEN count(l) OVER {_f(26)} = 26 THEN 4.0 * (list_position(list(l) OVER {_f(26)}, min(l) OVER {_f(26)}) - 1) END",
    "bollinger_width": "100 * (bollinger_high - bollinger_low) / nullif(bollinger_mid, 0)", "bollinger_share": "(c - bollinger_low) / CASE WHEN bollinger_high > bollinger_low THEN bollinger_high - bollinger_low END",
    "keltner_high": "t20 + 2 * atr", "keltner_low": "t20 - 2 * atr", "donchian_mid": "(donchian_high + donchian_low) / 2", "ulcer": f"sqrt({_agg('avg', 'fall', 14)})", "adi": f"sum(place) OVER ({W})",
    "obv": f"sum(v * coalesce(sign(d), 0)) OVER ({W})", "cmf": f"({_agg('sum', 'place', 20)}) / nullif({_agg('sum', 'v', 20)}, 0)", "ease": "lift", "ease_signal": _agg("avg", "lift", 14),
    "vwap": f"({_agg('sum', 'typical * v', 14)}) / nullif({_agg('sum', 'v', 14)}, 0)",
    "mfi": f"CASE WHEN count(v) OVER {_f(14)} = 14 AND {_FLOW.format('>')} + {_FLOW.format('<')} > 0 THEN 100 * {_FLOW.format('>')} / ({_FLOW.format('>')} + {_FLOW.format('<')}) END",
}

NAMES = [*operators.MOMENTUM, *operators.TREND, *operators.VOLATILITY, *operators.VOLUME]


@query(f"""
{_BASE},
{_LEVELS}
SELECT datetime, instrument, {', '.join(f'{_SHOWN[n]} AS {n}' if n in _SHOWN else n for n in NAMES)} FROM c5""", floats=" ".join(NAMES))
def features_indicators(spark, sf_dir):
    """62 published indicators; averages are linear recurrences composed in blocks."""
    return operators.indicators(monthly_panel(spark, sf_dir))


@query(f"""
n AS (SELECT datetime, instrument, row_number() OVER ({W}) AS k, close AS x, {_ref('close', 10)} AS b, abs(close - {_ref('close', 1)}) AS move FROM panel),
p AS (SELECT *, {_agg('sum', 'move', 10)} AS path FROM n),
w AS MATERIALIZED (SELECT *, pow(coalesce(abs(x - b) / CASE WHEN path > 0 THEN path END, 0) * (2.0e0 / 3 - 2.0e0 / 31) + 2.0e0 / 31, 2) AS w FROM p),
s AS (SELECT instrument, k, CAST(NULL AS DOUBLE) AS s FROM w WHERE k = 1
  UNION ALL SELECT w.instrument, w.k, CASE WHEN w.b IS NOT NULL THEN coalesce(s.s + w.w * (w.x - s.s), w.x) END FROM s JOIN w ON w.instrument = s.instrument AND w.k = s.k + 1)
SELECT datetime, instrument, s AS kama FROM w JOIN s USING (instrument, k)""", floats="kama")
def ts_adaptive_average(spark, sf_dir):
    return operators.kama(monthly_panel(spark, sf_dir), "close", 10, 2, 30)
