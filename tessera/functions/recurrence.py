"""Linear recurrences along an instrument's rows as window columns: s = a * s_before + b.

Steps are affine maps, and maps compose.  Rows are cut into blocks of ``BLOCK``: a row composes the steps of its block so
far, a block's first row composes the maps of the blocks before it, and both together give the state.  So a row holds
at most one block's steps and one map for each earlier block, never its history.  All windows share one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ts

BLOCK = 64


def _composed(steps: Column) -> Column:
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(steps, start, lambda s, m: F.struct((s["a"] * m["a"]).alias("a"), (s["b"] * m["a"] + m["b"]).alias("b")))


def recurrences(panel: DataFrame, steps: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``panel`` with a column for each (a, b): s = a * s_before + b, from 0 on.  A step without a or b leaves s as it is."""
    so_far = ts.by_date().rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(ts.by_date()) - 1
    known = lambda a, b: a.isNotNull() & b.isNotNull()
    maps = {f"__m_{n}": F.struct(F.when(known(a, b), a).otherwise(1.0).cast("double").alias("a"), F.when(known(a, b), b).otherwise(0.0).cast("double").alias("b")) for n, (a, b) in steps.items()}
    held = panel.withColumns({"__place": place, **maps})
    inside = F.col("__place") % BLOCK
    last = lambda n: F.slice(F.array_agg(f"__m_{n}").over(ts.frame(BLOCK)), -(inside + 1).cast("int"), (inside + 1).cast("int"))
    held = held.withColumns({f"__c_{n}": _composed(last(n)) for n in steps})
    whole = lambda n: F.array_agg(F.when(inside == BLOCK - 1, F.col(f"__c_{n}"))).over(so_far)
    held = held.withColumns({f"__s_{n}": F.when(inside == 0, _composed(whole(n))["b"]) for n in steps})
    state = lambda n: F.col(f"__c_{n}.a") * F.last(f"__s_{n}", ignorenulls=True).over(so_far) + F.col(f"__c_{n}.b")
    out = held.withColumns({n: state(n) for n in steps})
    return out.drop("__place", *(f"__{k}_{n}" for n in steps for k in "mcs"))


def exponential(panel: DataFrame, columns: dict[str, tuple[Column, float, int]]) -> DataFrame:
    """``panel`` with exponential means {name: (values, weight, least)}: the first value, then s + weight * (value - s).

    Missing values leave the mean as it is; it is NULL before ``least`` values.
    """
    so_far = ts.by_date().rowsBetween(Window.unboundedPreceding, 0)
    held = panel.withColumns({f"__x_{n}": x.cast("double") for n, (x, _, _) in columns.items()})
    held = held.withColumns({f"__n_{n}": F.count(f"__x_{n}").over(so_far) for n in columns})
    first = lambda n: F.col(f"__n_{n}") == 1
    steps = {n: (F.when(F.col(f"__x_{n}").isNotNull(), F.when(first(n), 0.0).otherwise(1.0 - w)), F.when(first(n), F.col(f"__x_{n}")).otherwise(w * F.col(f"__x_{n}"))) for n, (_, w, _) in columns.items()}
    out = recurrences(held, steps)
    return out.withColumns({n: F.when(F.col(f"__n_{n}") >= max(1, least), F.col(n)) for n, (_, _, least) in columns.items()}).drop(*(f"__{k}_{n}" for n in columns for k in "xn"))


def adaptive(panel: DataFrame, column: str, window: int, fast: int, slow: int, name: str) -> DataFrame:
    """``panel`` with an average whose weight follows the share of net in total movement over ``window`` rows.

    It starts from a value ``window`` rows after another one; a row without a value, or without one that many rows before, has none.
    After such rows it starts again.
    """
    x = F.col(column).cast("double")
    held = panel.withColumn("__before", ts.ref(x, window)).withColumn("__move", F.abs(ts.delta(x)))
    path = F.when(F.count("__move").over(ts.frame(window)) == window, F.sum("__move").over(ts.frame(window)))
    share = F.coalesce(F.try_divide(F.abs(x - F.col("__before")), F.when(path > 0, path)), F.lit(0.0))
    ready = x.isNotNull() & F.col("__before").isNotNull()
    held = held.withColumns({"__ready": ready, "__weight": F.pow(share * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1), F.lit(2.0))})
    # rows without a value change nothing: what counts is the last row that has one
    earlier = F.last(F.when(x.isNotNull(), F.col("__ready")), ignorenulls=True).over(ts.by_date().rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("__starts", ~F.coalesce(earlier, F.lit(False)))
    a = F.when(F.col("__ready"), F.when(F.col("__starts"), 0.0).otherwise(1 - F.col("__weight")))
    b = F.when(F.col("__starts"), x).otherwise(F.col("__weight") * x)
    return recurrences(held, {name: (a, b)}).withColumn(name, F.when(F.col("__ready"), F.col(name))).drop("__before", "__move", "__ready", "__weight", "__starts")
