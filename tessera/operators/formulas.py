"""Short-horizon formulas of windows inside cross-sectional ranks inside windows, dealt to levels.

A formula is a function of a ``Vocabulary``.  Elementwise parts stay expressions; a window over an instrument's rows or a
date's cross-section becomes a column of the first level after those that it needs.  Odd levels hold windows over
instruments and even ones those over dates, so a level has one partitioning, and equal parts
of several formulas are one column.  Every cross-sectional operation sees eligible rows alone.

What is shuffled decides how much disk a large panel takes, so Spark's plan (``evaluate``) deals words anew.  Words over dates wait for the last round
that they can wait for (``rounds``), and words over instruments are made anew beside each round that reads them: what is carried are fields and
ranks, not windows.  A date's rows are ranked in arrays of its task (``cross_sections``): side by side, every rank would sort whole wide rows again.
"""

from __future__ import annotations

import functools
import operator
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import ts, xs
from tessera.functions.guard import ratio
from tessera.sources.panel import KEYS

SERIES, DATE = 1, 0


@dataclass(frozen=True)
class Node:
    """A value of a formula: an expression, the level that it is ready at, and a key by which equal ones are known."""

    of: Vocabulary
    x: Any
    level: int
    key: str
    reads: frozenset[str] = frozenset()

    def _with(self, sign: str, other: Node | float, flip: bool = False) -> Node:
        other = other if isinstance(other, Node) else self.of.number(other)
        a, b = (other, self) if flip else (self, other)
        return Node(self.of, self.of.arithmetic(sign, a.x, b.x), max(a.level, b.level), f"({a.key} {sign} {b.key})", a.reads | b.reads)

    def __add__(self, y: Node | float) -> Node:
        return self._with("+", y)

    def __radd__(self, y: Node | float) -> Node:
        return self._with("+", y, True)

    def __sub__(self, y: Node | float) -> Node:
        return self._with("-", y)

    def __rsub__(self, y: Node | float) -> Node:
        return self._with("-", y, True)

    def __mul__(self, y: Node | float) -> Node:
        return self._with("*", y)

    def __rmul__(self, y: Node | float) -> Node:
        return self._with("*", y, True)

    def __truediv__(self, y: Node | float) -> Node:
        return self._with("/", y)

    def __lt__(self, y: Node | float) -> Node:
        return self._with("<", y)

    def __gt__(self, y: Node | float) -> Node:
        return self._with(">", y)

    def __neg__(self) -> Node:
        return 0 - self


def _reads(nodes: tuple[Node, ...]) -> frozenset[str]:
    return functools.reduce(operator.or_, (n.reads for n in nodes))


class Vocabulary:
    """What formulas are made of.  Subclasses say what each word is: ``scalar_*``, ``series_*`` and ``date_*`` methods take expressions."""

    def __init__(self):
        self.levels: dict[int, dict[str, tuple[str, Any]]] = {}
        self.names: dict[str, Node] = {}
        self.reads: dict[str, frozenset[str]] = {}

    def field(self, name: str) -> Node:
        return Node(self, self.column(name), 0, name, frozenset([name]))

    def number(self, value: float) -> Node:
        return Node(self, self.constant(value), 0, repr(value))

    def each(self, word: str, *nodes: Node, **more: float) -> Node:
        """An elementwise word."""
        key = f"{word}({', '.join([n.key for n in nodes] + [repr(v) for v in more.values()])})"
        return Node(self, getattr(self, f"scalar_{word}")(*(n.x for n in nodes), **more), max(n.level for n in nodes), key, _reads(nodes))

    def window(self, kind: int, word: str, *nodes: Node, **more: Any) -> Node:
        key = f"{word}({', '.join([n.key for n in nodes] + [repr(v) for v in more.values()])})"
        if key not in self.names:
            level = max(n.level for n in nodes) + 1
            level += level % 2 != kind
            name = f"w{len(self.names)}_"
            build: Callable = getattr(self, f"{'series' if kind else 'date'}_{word}")
            self.levels.setdefault(level, {})[name] = build(*(n.x for n in nodes), **more)
            self.reads[name] = _reads(nodes) | {v for v in more.values() if isinstance(v, str)}
            self.names[key] = Node(self, self.column(name), level, key, frozenset([name]))
        return self.names[key]

    def __getattr__(self, word: str):
        cls = type(self)
        if hasattr(cls, f"series_{word}"):
            return lambda *nodes, **more: self._series(word, *nodes, **more)
        if hasattr(cls, f"date_{word}"):
            return lambda *nodes, **more: self.window(DATE, word, *nodes, **more)
        if hasattr(cls, f"scalar_{word}"):
            return lambda *nodes, **more: self.each(word, *nodes, **more)
        raise AttributeError(word)

    def _series(self, word: str, *args: Node | int) -> Node:
        nodes = [a for a in args if isinstance(a, Node)]
        return self.window(SERIES, word, *nodes, n=next(a for a in args if not isinstance(a, Node)))


def noiseless(x: Column) -> Column:
    """Nine digits: what is ranked or compared isn't rounding noise."""
    return F.round(x, 9)


@dataclass(frozen=True)
class Section:
    """A word over a date's rows of x: ``rank``, ``scale`` or ``demean``, the last by the column ``group``."""

    word: str
    x: Column
    group: str | None = None


class SparkVocabulary(Vocabulary):
    """Words as columns, those over dates as sections.  ``eligible`` is the name of a boolean column."""

    def __init__(self, eligible: str):
        super().__init__()
        self.eligible = eligible

    column = staticmethod(F.col)
    constant = staticmethod(lambda v: F.lit(float(v)))

    @staticmethod
    def arithmetic(sign: str, a: Column, b: Column) -> Column:
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: ratio(a, b), "<": lambda: a < b, ">": lambda: a > b}[sign]()

    scalar_log = staticmethod(lambda x: F.when(x > 0, F.ln(x)))
    scalar_abs = staticmethod(F.abs)
    scalar_sign = staticmethod(F.signum)
    scalar_signedpower = staticmethod(lambda x, p: F.signum(x) * F.pow(F.abs(x), F.lit(float(p))))
    scalar_where = staticmethod(lambda c, a, b: F.when(c.isNotNull(), F.when(c, a).otherwise(b)))
    series_delay = staticmethod(lambda x, n: ts.ref(x, n))
    series_delta = staticmethod(lambda x, n: ts.delta(x, n))
    series_change = staticmethod(lambda x, n: ts.change(x, n))
    series_sum = staticmethod(lambda x, n: ts.total(x, n))
    series_mean = staticmethod(lambda x, n: ts.mean(x, n))
    series_std = staticmethod(lambda x, n: ts.std(x, n))
    series_min = staticmethod(lambda x, n: ts.low(x, n))
    series_max = staticmethod(lambda x, n: ts.high(x, n))
    series_argmax = staticmethod(lambda x, n: ts.arg_max(noiseless(x), n))
    series_argmin = staticmethod(lambda x, n: ts.arg_min(noiseless(x), n))
    series_ts_rank = staticmethod(lambda x, n: ts.rank(noiseless(x), n))
    series_decay = staticmethod(lambda x, n: ts.decay(x, n))
    series_corr = staticmethod(lambda x, y, n: ts.corr(x, y, n))
    series_cov = staticmethod(lambda x, y, n: ts.covariance(x, y, n))

    @staticmethod
    def series_product(x: Column, n: int) -> Column:
        held = F.array_agg(x).over(ts.frame(n))
        return F.when(F.size(held) == n, F.aggregate(held, F.lit(1.0), lambda s, v: s * v))

    def _masked(self, x: Column) -> Column:
        return F.when(F.col(self.eligible), x)

    def date_rank(self, x: Column) -> Section:
        """Average rank among eligible rows of the date, as a share of their number."""
        return Section("rank", noiseless(self._masked(x)))

    def date_scale(self, x: Column) -> Section:
        """Values over the sum of absolute ones."""
        return Section("scale", self._masked(x))

    def date_demean(self, x: Column, group: str) -> Section:
        """Values less the mean of the date's group."""
        return Section("demean", self._masked(x), group)


def formulas(v: Vocabulary) -> dict[str, Node]:
    """Published formulas over open, high, low, close, volume, vwap and a column ``grouping_``."""
    o, h, low, c, vol, vwap = (v.field(x) for x in ("open", "high", "low", "close", "volume", "vwap"))
    ret, adv20 = v.change(c, 1), v.mean(vol, 20)
    d1, d7 = v.delta(c, 1), v.delta(c, 7)
    sums = v.sum(o, 5) * v.sum(ret, 5)
    gap = vwap - c
    turn = lambda n: v.where(v.min(d1, n) > 0, d1, v.where(v.max(d1, n) < 0, d1, -d1))
    return {
        "alpha_001": v.rank(v.argmax(v.signedpower(v.where(ret < 0, v.std(ret, 20), c), p=2), 5)) - 0.5,
        "alpha_002": -v.corr(v.rank(v.delta(v.log(vol), 2)), v.rank((c - o) / o), 6),
        "alpha_003": -v.corr(v.rank(o), v.rank(vol), 10),
        "alpha_004": -v.ts_rank(v.rank(low), 9),
        "alpha_005": v.rank(o - v.mean(vwap, 10)) * -v.abs(v.rank(c - vwap)),
        "alpha_006": -v.corr(o, vol, 10),
        "alpha_007": v.where(adv20 < vol, -v.ts_rank(v.abs(d7), 60) * v.sign(d7), v.number(-1)),
        "alpha_008": -v.rank(sums - v.delay(sums, 10)),
        "alpha_009": turn(5),
        "alpha_010": v.rank(turn(4)),
        "alpha_011": (v.rank(v.max(gap, 3)) + v.rank(v.min(gap, 3))) * v.rank(v.delta(vol, 3)),
        "alpha_012": v.sign(v.delta(vol, 1)) * -d1,
        "alpha_013": -v.rank(v.cov(v.rank(c), v.rank(vol), 5)),
        "alpha_014": -v.rank(v.delta(ret, 3)) * v.corr(o, vol, 10),
        "alpha_015": -v.sum(v.rank(v.corr(v.rank(h), v.rank(vol), 3)), 3),
        "alpha_016": -v.rank(v.cov(v.rank(h), v.rank(vol), 5)),
        "alpha_017": -v.rank(v.ts_rank(c, 10)) * v.rank(v.delta(d1, 1)) * v.rank(v.ts_rank(vol / adv20, 5)),
        "alpha_018": -v.rank(v.std(v.abs(c - o), 5) + (c - o) + v.corr(c, o, 10)),
        "alpha_020": -v.rank(o - v.delay(h, 1)) * v.rank(o - v.delay(c, 1)) * v.rank(o - v.delay(low, 1)),
        "alpha_022": -(v.delta(v.corr(h, vol, 5), 5) * v.rank(v.std(c, 20))),
        "alpha_026": -v.max(v.corr(v.ts_rank(vol, 5), v.ts_rank(h, 5), 5), 3),
        "alpha_028": v.scale(v.corr(adv20, low, 5) + (h + low) / 2 - c),
        "alpha_033": v.rank(o / c - 1),
        "alpha_034": v.rank(2 - v.rank(v.std(ret, 2) / v.std(ret, 5)) - v.rank(d1)),
        "alpha_040": -v.rank(v.std(h, 10)) * v.corr(h, vol, 10),
        "alpha_042": v.rank(vwap - c) / v.rank(vwap + c),
        "alpha_044": -v.corr(h, v.rank(vol), 5),
        "alpha_053": -v.delta(((c - low) - (h - c)) / (c - low), 9),
        "alpha_058": -v.ts_rank(v.decay(v.corr(v.demean(vwap, group="grouping_"), vol, 4), 8), 6),
        "alpha_101": (c - o) / (h - low + 0.001),
        # words that the formulas above leave out
        "growth_5": v.product(1 + ret, 5) - 1,
        "last_low_10": v.argmin(low, 10),
    }


def _twice_ranked(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Twice the average rank among known values, as whole numbers; zero where there is none."""
    at = np.flatnonzero(known)
    at = at[np.argsort(x[at], kind="stable")]
    v, new = x[at], np.ones(len(at), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
    starts = np.flatnonzero(new)
    ties = np.diff(np.append(starts, len(v)))
    out = np.zeros(len(x), dtype=np.int32)
    out[at] = np.repeat(2 * starts + ties + 1, ties)
    return out


def _scaled(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values over the sum of absolute ones, and where there are any."""
    total = np.abs(x[known]).sum()
    return x / (total or 1.0), known & (total != 0)


def _demeaned(x: np.ndarray, known: np.ndarray, group: np.ndarray) -> np.ndarray:
    sums, counts = np.bincount(group[known], x[known], group.max() + 1), np.bincount(group[known], minlength=group.max() + 1)
    return x - (sums / np.maximum(counts, 1))[group]


def cross_sections(panel: DataFrame, held: list[str], words: dict[str, Section], beside: tuple[str, ...] = (), ready: tuple[str, ...] = ()) -> DataFrame:
    """Keys, the columns ``held`` and those of ``words``.  The panel has one row for each key.

    Rows are dealt by date, a task computes on one date's rows in arrays, and they are dealt back by instrument in the order of dates, where windows
    along the instruments follow.  Words in ``ready`` are made of columns that are dealt anyway, held or ``beside``, so that their x isn't.  Ranks
    are dealt as whole numbers, which take half the room of shares.
    """
    groups = {s.group for s in words.values() if s.group}
    x = {name: s.x.cast("double").alias(f"__{name}") for name, s in words.items()}
    by = [F.col(g).cast("string").alias(f"__by_{g}") for g in sorted(groups)]
    dealt = xs.dealt(panel.select(*KEYS, *held, *(c for c in beside if c not in held), *by, *(x[n] for n in words if n not in ready)), "datetime")
    wide = dealt.select(*KEYS, *held, *(f"__by_{g}" for g in sorted(groups)), *(x[n] if n in ready else f"__{n}" for n in words))
    ranks, rest = [n for n, s in words.items() if s.word == "rank"], {n: (s.word, s.group) for n, s in words.items() if s.word != "rank"}
    kept = [*KEYS, *held]
    whole = T.ArrayType(T.IntegerType())
    schema = T.StructType([*(wide.schema[c] for c in kept), T.StructField("__twice", whole), T.StructField("__of", whole), *(T.StructField(n, T.DoubleType()) for n in rest)])

    def one_date(rows: pa.Table) -> pa.Table:
        n = rows.num_rows

        def column(name: str) -> tuple[np.ndarray, np.ndarray]:
            c = rows.column(f"__{name}")
            return c.to_numpy(), c.is_valid().to_numpy()

        twice, of = np.zeros((n, len(ranks)), dtype=np.int32), np.zeros(len(ranks), dtype=np.int32)
        for i, name in enumerate(ranks):
            v, known = column(name)
            twice[:, i], of[i] = _twice_ranked(v, known), known.sum()
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * len(ranks))
        made = [pa.ListArray.from_arrays(ends, pa.array(twice.ravel())), pa.ListArray.from_arrays(ends, pa.array(np.tile(of, n)))]
        for name, (word, group) in rest.items():
            v, known = column(name)
            if word == "scale":
                v, known = _scaled(v, known)
            else:
                v = _demeaned(v, known, rows.column(f"__by_{group}").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy())
            made.append(pa.array(v, mask=~known))
        return pa.Table.from_arrays([*(rows.column(c) for c in kept), *made], names=schema.names)

    back = xs.dealt(wide.groupBy("datetime").applyInArrow(one_date, schema), "instrument").sortWithinPartitions("instrument", "datetime")
    share = lambda i: F.when(F.col("__twice")[i] > 0, F.col("__twice")[i] / 2 / F.col("__of")[i])
    return back.select(*kept, *(share(ranks.index(n)).alias(n) if n in ranks else F.col(n) for n in words))


class Rounds:
    """Words over dates by rounds.  Windows along instruments come before and after a round, but not before the first."""

    def __init__(self, v: Vocabulary, made: dict[str, Node]):
        self.reads, self.made = v.reads, _reads(tuple(made.values()))
        self.levels = {name: level for level in sorted(v.levels) for name in v.levels[level]}
        dates = [name for name, level in self.levels.items() if level % 2 == DATE]
        first: dict[str, int] = {}
        for name in dates:
            windows = any(self.levels.get(r, DATE) % 2 == SERIES for r in self.reads[name])
            first[name] = max([int(windows), *(first[r] + 1 for r in self.under(self.reads[name]) if r in first)])
        self.number = max(first.values(), default=-1) + 1
        self.of: dict[str, int] = {}
        for name in reversed(dates):
            last = min((self.of[d] - 1 for d in self.of if name in self.under(self.reads[d])), default=self.number - 1)
            # one that can't wait for the last round comes as early as it can
            self.of[name] = last if last == self.number - 1 else first[name]

    def series(self, names: frozenset[str]) -> dict[int, list[str]]:
        """Words over instruments that ``names`` are made of, by level."""
        found: dict[int, list[str]] = {}
        wanted, names = set(), set(names)
        while names:
            wanted |= names
            names = {r for n in names if self.levels.get(n, DATE) % 2 == SERIES for r in self.reads[n]} - wanted
        for name, level in self.levels.items():
            if name in wanted and level % 2 == SERIES:
                found.setdefault(level, []).append(name)
        return found

    def under(self, names: frozenset[str]) -> set[str]:
        """Fields and words over dates that ``names`` are made of, by windows along instruments alone."""
        windows = {n for names_ in self.series(names).values() for n in names_}
        return {r for n in windows for r in self.reads[n]}.union(names) - windows

    def targets(self, i: int) -> frozenset[str]:
        """What the round reads, and after the last one the formulas."""
        return frozenset().union(*(self.reads[n] for n, k in self.of.items() if k == i)) if i < self.number else self.made

    def carried(self, i: int) -> set[str]:
        """What the round hands on that it doesn't make."""
        later = set().union(*(self.under(self.targets(k)) for k in range(i + 1, self.number + 1)))
        return {c for c in later if self.of.get(c, -1) < i}


def evaluate(panel: DataFrame, v: SparkVocabulary, made: dict[str, Node]) -> DataFrame:
    """Keys and the formulas' values, round by round."""
    rounds = Rounds(v, made)
    for i in range(rounds.number + 1):
        for level, names in rounds.series(rounds.targets(i)).items():
            panel = panel.withColumns({name: v.levels[level][name] for name in names})
        if i == rounds.number:
            break
        words = {n: v.levels[rounds.levels[n]][n] for n, k in rounds.of.items() if k == i}
        held = sorted(rounds.carried(i).union([v.eligible] if i + 1 < rounds.number else ()) - set(KEYS))
        # a column that several words would be made of, had they it beside those held, is dealt in place of theirs
        lacking = {n: v.reads[n] - {s.group, *held, *KEYS} for n, s in words.items()}
        lone = Counter(c for lack in lacking.values() if len(lack) == 1 for c in lack)
        beside = {c for c, k in lone.items() if k > 1}
        ready = tuple(n for n, lack in lacking.items() if lack <= beside)
        panel = cross_sections(panel, held, words, (*sorted(beside), v.eligible) if ready else (), ready)
    return panel.select(*KEYS, *(node.x.alias(name) for name, node in made.items()))


def alphas(panel: DataFrame, eligible: str = "eligible") -> DataFrame:
    v = SparkVocabulary(eligible)
    return evaluate(panel, v, formulas(v))
