"""Windows along instruments' rows as arrays: Spark deals and sorts the rows, a task computes on batches of them.

Rows of an instrument lie in one partition in the order of dates.  A batch is preceded by the last ``look_back`` rows before it, so
a task holds one batch and these, never a history.  In arrays, NaN is missing; a window that holds a missing value has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.panel import KEYS


#: Rows before a batch that recurrences start after.
WARM = 1


class Rows:
    """Consecutive rows of sorted instruments: ``columns`` by name, and ``place``, the row's number inside its instrument from 0."""

    def __init__(self, columns: dict[str, np.ndarray], place: np.ndarray, states: dict[str, float], cut: int, start: int):
        self.columns, self.place, self.states, self.cut, self.start = columns, place, states, cut, start

    def ref(self, x: np.ndarray, n: int) -> np.ndarray:
        """The value n rows ago."""
        out = np.full(len(x), np.nan)
        out[n:] = x[: max(0, len(x) - n)]
        out[self.place < n] = np.nan
        return out

    def _placed(self, values: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(self.place), np.nan)
        out[n - 1 :] = values
        out[self.place < n - 1] = np.nan
        return out

    def reduced(self, function: Callable[[np.ndarray], np.ndarray], n: int, *columns: np.ndarray) -> np.ndarray:
        """``function`` of the last n rows: of arrays of n rows of values, the oldest first, for each column."""
        if len(self.place) < n:
            return np.full(len(self.place), np.nan)
        return self._placed(function(*(sliding_window_view(x, n).T for x in columns)), n)

    def total(self, x: np.ndarray, n: int) -> np.ndarray:
        return self.reduced(lambda w: w.sum(axis=0), n, x)

    def mean(self, x: np.ndarray, n: int) -> np.ndarray:
        return self.total(x, n) / n

    def high(self, x: np.ndarray, n: int) -> np.ndarray:
        return self.reduced(lambda w: w.max(axis=0), n, x)

    def low(self, x: np.ndarray, n: int) -> np.ndarray:
        return self.reduced(lambda w: w.min(axis=0), n, x)

    def std(self, x: np.ndarray, n: int, less: int = 1) -> np.ndarray:
        """Sample deviation, of the population with ``less`` 0; exactly zero for equal values."""
        return self.reduced(lambda w: np.sqrt(np.square(centred(w)).sum(axis=0) / (n - less)), n, x)

    def quantiles(self, x: np.ndarray, n: int, shares: tuple[float, ...]) -> list[np.ndarray]:
        """Interpolated quantiles, all from one sort of each frame."""
        if len(x) < n:
            return [np.full(len(x), np.nan) for _ in shares]
        own = np.sort(sliding_window_view(x, n), axis=1)
        places = [(int(q * (n - 1)), q * (n - 1) % 1) for q in shares]
        return [self._placed(own[:, i] + part * (own[:, min(i + 1, n - 1)] - own[:, i]) + own[:, -1] * 0, n) for i, part in places]

    def corr(self, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
        def correlation(v: np.ndarray, w: np.ndarray) -> np.ndarray:
            a, b = centred(v), centred(w)
            return ratio((a * b).sum(axis=0), np.sqrt(np.square(a).sum(axis=0)) * np.sqrt(np.square(b).sum(axis=0)))

        return self.reduced(correlation, n, x, y)

    def arg(self, x: np.ndarray, n: int, largest: bool) -> np.ndarray:
        """How many rows into the frame the largest or smallest value stands (1 to n), the first among equals."""
        return self.reduced(lambda w: np.where(np.isnan(w.sum(axis=0)), np.nan, 1.0 + (np.argmax if largest else np.argmin)(w.T, axis=1)), n, x)

    def recurrence(self, name: str, a: np.ndarray | float, b: np.ndarray) -> np.ndarray:
        """s = a * s_before + b from 0 at each instrument's first row: affine steps, composed over spans of doubling length.

        ``name`` keeps the state from batch to batch.  Steps may look at the row before; a batch's first row has none, so it has no state.
        """
        a, s = np.where(self.place == 0, 0.0, a)[self.start :], np.array(b, dtype=float)[self.start :]
        s[0] += a[0] * self.states.get(name, 0.0)
        a[0] = 0.0
        span = 1
        while span < len(s) and a.any():
            s[span:] += a[span:] * s[:-span]
            a[span:] *= a[:-span].copy()
            span *= 2
        s = np.concatenate([np.full(self.start, np.nan), s])
        if self.cut:
            self.states[name] = float(s[self.cut + WARM - 1])
        return s

    def running_total(self, name: str, x: np.ndarray) -> np.ndarray:
        """Sum of the values so far; missing before the first."""
        known = ~np.isnan(x)
        seen = self.recurrence(f"{name}, seen", 1.0, known.astype(float))
        return np.where(seen > 0, self.recurrence(name, 1.0, np.where(known, x, 0.0)), np.nan)

    def exponential(self, name: str, x: np.ndarray, weight: float, least: int) -> np.ndarray:
        """The first value, then s + weight * (value - s); missing values leave it as it is.  Missing before ``least`` values."""
        known = ~np.isnan(x)
        seen = self.recurrence(f"{name}, seen", 1.0, known.astype(float))
        first, v = known & (seen == 1), np.where(known, x, 0.0)
        s = self.recurrence(name, np.where(known, np.where(first, 0.0, 1.0 - weight), 1.0), np.where(first, v, weight * v))
        return np.where(seen >= max(1, least), s, np.nan)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Missing for zero denominators."""
    return a / np.where(b == 0, np.nan, b)


def centred(w: np.ndarray) -> np.ndarray:
    """Distances of windows' values from their mean; from the last value first, so that equal values have none."""
    d = w - w[-1]
    return d - d.mean(axis=0)


def along(panel: DataFrame, columns: list[str], names: list[str], look_back: int, compute: Callable[[Rows], dict[str, np.ndarray]]) -> DataFrame:
    """Keys and ``names`` (doubles, NULL for NaN and infinities): what ``compute`` makes of rows that see ``look_back`` rows (one at least) before them."""
    held = panel.select(*KEYS, *(F.col(c).cast("double").alias(c) for c in columns)).repartition("instrument").sortWithinPartitions("instrument", "datetime")
    schema = T.StructType([*(held.schema[k] for k in KEYS), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first, states, start = None, 0, {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.concat_batches([before, batch]) if before is not None else batch
            code = own.column("instrument").dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.concatenate([[True], code[1:] != code[:-1]])
            at = np.arange(len(code))
            place = at - np.maximum.accumulate(np.where(starts, at, 0))
            place[np.cumsum(starts) == 1] += first
            cut, fresh = max(0, len(code) - look_back), len(code) - batch.num_rows
            values = {c: own.column(c).to_numpy(zero_copy_only=False) for c in columns}
            with np.errstate(all="ignore"):
                made = compute(Rows({c: np.where(np.isfinite(x), x, np.nan) for c, x in values.items()}, place, states, cut, start))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in KEYS), *(pa.array(made[n][fresh:], mask=~np.isfinite(made[n][fresh:])) for n in names)], names=[*KEYS, *names]
            )
            before, first, start = own.slice(cut), int(place[cut]), WARM if cut else start

    return held.mapInArrow(run, schema)
