"""Published momentum, trend, volatility and volume indicators of an OHLCV panel, of each instrument's rows.

All are arrays of sorted histories (``functions.histories``); exponential and Wilder averages are linear recurrences.
Warm-up rows are NULL, and so are shares of a range or a sum that is zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tessera.functions import histories
from tessera.functions.histories import centred, ratio
from tessera.functions.recurrence import adaptive
from tessera.sources.panel import KEYS

MOMENTUM = "rsi stochastic_rsi stochastic_rsi_k stochastic_rsi_d tsi ultimate stochastic stochastic_signal williams awesome roc ppo ppo_signal ppo_diff pvo pvo_signal pvo_diff".split()
TREND = (
    "macd macd_signal macd_diff sma_fast sma_slow ema_fast ema_slow wma vortex_high vortex_low trix mass_index dpo kst kst_signal "
    "ichimoku_conversion ichimoku_base ichimoku_a ichimoku_b adx adx_high adx_low cci aroon_up aroon_down"
).split()
VOLATILITY = "atr bollinger_mid bollinger_high bollinger_low bollinger_width bollinger_share keltner_high keltner_low donchian_high donchian_low donchian_mid ulcer".split()
VOLUME = "adi obv cmf force ease ease_signal vwap mfi".split()


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.where(whole > 0, whole, np.nan)


def kama(panel: DataFrame, column: str, window: int, fast: int, slow: int) -> DataFrame:
    """(datetime, instrument, kama): the adaptive average of ``column``."""
    return adaptive(panel.select(*KEYS, column), column, window, fast, slow, "kama").select(*KEYS, "kama")


#: Rows that values look back on: a mean of 9 of means of 15 of changes over 30 rows, and one more for recurrences.
LOOK_BACK = 64


def indicators(panel: DataFrame) -> DataFrame:
    """Keys and all names of MOMENTUM, TREND, VOLATILITY and VOLUME."""
    return histories.along(panel, ["close", "high", "low", "volume"], [*MOMENTUM, *TREND, *VOLATILITY, *VOLUME], LOOK_BACK, _indicators)


def _indicators(r: histories.Rows) -> dict[str, np.ndarray]:
    c, h, low, v = (r.columns[x] for x in ("close", "high", "low", "volume"))
    change = lambda x, n: ratio(x, r.ref(x, n)) - 1
    ema = lambda name, x, n, least: r.exponential(name, x, 2.0 / (n + 1), least)
    wilder = lambda name, x: r.exponential(name, x, 1 / 14, 14)
    before = r.ref(c, 1)
    d, hl, typical, middle = c - before, h - low, (h + low + c) / 3, (h + low) / 2
    reach = np.fmax(hl, np.fmax(np.abs(h - before), np.abs(low - before)))
    up, down, bought, span = h - r.ref(h, 1), r.ref(low, 1) - low, c - np.fmin(low, before), np.fmax(h, before) - np.fmin(low, before)
    vm_high, vm_low, turn = np.abs(h - r.ref(low, 1)), np.abs(low - r.ref(h, 1)), typical - r.ref(typical, 1)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    inside = _share(2 * c - h - low, hl)
    inside = np.where(np.isnan(inside), 0.0, inside) * v
    lift = ratio((up - down) * hl, 2 * v)

    ema_fast, ema_slow, v12, v26, range_1 = ema("ema_fast", c, 12, 12), ema("ema_slow", c, 26, 26), ema("v12", v, 12, 12), ema("v26", v, 26, 26), ema("range_1", hl, 9, 9)
    gains, losses, atr = wilder("gains", np.maximum(d, 0.0)), wilder("losses", np.maximum(-d, 0.0)), wilder("atr", reach)
    macd, rsi, pvo = ema_fast - ema_slow, 100 * _share(gains, gains + losses), 100 * ratio(v12 - v26, v26)
    ppo, adx_high, adx_low = 100 * ratio(macd, ema_slow), 100 * ratio(wilder("ups", plus), atr), 100 * ratio(wilder("downs", minus), atr)
    macd_signal, ppo_signal, pvo_signal = ema("macd_signal", macd, 9, 9), ema("ppo_signal", ppo, 9, 9), ema("pvo_signal", pvo, 9, 9)
    d2, a2 = ema("d2", ema("d1", d, 25, 25), 13, 13), ema("a2", ema("a1", np.abs(d), 25, 25), 13, 13)
    e3 = ema("e3", ema("e2", ema("e1", c, 15, 15), 15, 15), 15, 15)
    adx = wilder("adx", 100 * _share(np.abs(adx_high - adx_low), adx_high + adx_low))
    narrow = ratio(range_1, ema("range_2", range_1, 9, 9))

    top, floor = r.high(h, 14), r.low(low, 14)
    stochastic = 100 * _share(c - floor, top - floor)
    stochastic_rsi = _share(rsi - r.low(rsi, 14), r.high(rsi, 14) - r.low(rsi, 14))
    stochastic_rsi_k = r.mean(stochastic_rsi, 3)
    kst = 100 * (r.mean(change(c, 10), 10) + 2 * r.mean(change(c, 15), 10) + 3 * r.mean(change(c, 20), 10) + 4 * r.mean(change(c, 30), 15))
    mid, spread, t20 = r.mean(c, 20), r.std(c, 20, 0), ema("t20", typical, 20, 20)
    high_20, low_20, of = r.high(h, 20), r.low(low, 20), lambda n: (r.high(h, n) + r.low(low, n)) / 2
    part = lambda n: ratio(r.total(bought, n), r.total(span, n))
    rising, falling = (r.total(np.where(way, typical * v, 0.0), 14) + r.total(v, 14) * 0 for way in (turn > 0, turn < 0))
    distance, deviation = r.reduced(lambda w: centred(w)[-1], 20, typical), r.reduced(lambda w: np.abs(centred(w)).mean(axis=0), 20, typical)
    fall = np.square(100 * (ratio(c, r.high(c, 14)) - 1))
    return {
        "rsi": rsi, "stochastic_rsi": stochastic_rsi, "stochastic_rsi_k": stochastic_rsi_k, "stochastic_rsi_d": r.mean(stochastic_rsi_k, 3), "tsi": 100 * ratio(d2, a2),
        "ultimate": 100 * (4 * part(7) + 2 * part(14) + part(28)) / 7, "stochastic": stochastic, "stochastic_signal": r.mean(stochastic, 3), "williams": stochastic - 100, "awesome": r.mean(middle, 5) - r.mean(middle, 34),
        "roc": 100 * change(c, 12), "ppo": ppo, "ppo_signal": ppo_signal, "ppo_diff": ppo - ppo_signal, "pvo": pvo, "pvo_signal": pvo_signal, "pvo_diff": pvo - pvo_signal,
        "macd": macd, "macd_signal": macd_signal, "macd_diff": macd - macd_signal, "sma_fast": r.mean(c, 12), "sma_slow": r.mean(c, 26), "ema_fast": ema_fast, "ema_slow": ema_slow,
        "wma": r.reduced(lambda w: np.arange(1.0, 10) @ w / 45, 9, c), "vortex_high": ratio(r.total(vm_high, 14), r.total(reach, 14)), "vortex_low": ratio(r.total(vm_low, 14), r.total(reach, 14)),
        "trix": 100 * change(e3, 1), "mass_index": r.total(narrow, 25), "dpo": r.ref(c, 11) - mid, "kst": kst, "kst_signal": r.mean(kst, 9),
        "ichimoku_conversion": of(9), "ichimoku_base": of(26), "ichimoku_a": (of(9) + of(26)) / 2, "ichimoku_b": of(52), "adx": adx, "adx_high": adx_high, "adx_low": adx_low,
        "cci": ratio(np.where(distance == 0, np.nan, distance), 0.015 * deviation), "aroon_up": 4 * (r.arg(h, 26, True) - 1), "aroon_down": 4 * (r.arg(low, 26, False) - 1),
        "atr": atr, "bollinger_mid": mid, "bollinger_high": mid + 2 * spread, "bollinger_low": mid - 2 * spread, "bollinger_width": 100 * ratio(4 * spread, mid), "bollinger_share": _share(c - (mid - 2 * spread), 4 * spread),
        "keltner_high": t20 + 2 * atr, "keltner_low": t20 - 2 * atr, "donchian_high": high_20, "donchian_low": low_20, "donchian_mid": (high_20 + low_20) / 2, "ulcer": np.sqrt(r.mean(fall, 14)),
        "adi": r.running_total("adi", inside), "obv": r.running_total("obv", v * np.where(np.isnan(d), 0.0, np.sign(d))), "cmf": ratio(r.total(inside, 20), r.total(v, 20)),
        "force": ema("force", d * v, 13, 13), "ease": lift, "ease_signal": r.mean(lift, 14), "vwap": ratio(r.total(typical * v, 14), r.total(v, 14)), "mfi": 100 * _share(rising, rising + falling),
    }
