"""Statistics over daily series: bootstrap, multiple testing, serial correlation, weighted medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.guard import ratio


def numbered(daily: DataFrame, by: str = "factor") -> DataFrame:
    """Adds pos, from 0, by date inside each series."""
    return daily.withColumn("pos", (F.row_number().over(Window.partitionBy(by).orderBy("datetime")) - 1).cast("long"))


def draw(*keys) -> Column:
    """A number below 2**32 from an MD5 digest of the keys: the same on any cluster and in other engines."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("long")


def _resampled(x: DataFrame, pool: DataFrame, value: str, samples: int, length: int, seed: int, by: str, joint: bool) -> DataFrame:
    """(by, days, mean, standard_error, low, high, p) from a pool (by, block, start) of places where blocks begin.

    A sample is ceil(n / length) blocks, the last one cut, of values about the mean.  Block sums are differences of
    running sums: a sample is n / length rows, not n.
    """
    w = Window.partitionBy(by)
    cut = x.withColumns({"__d": F.col(value) - F.avg(value).over(w), "days": F.count("*").over(w)})
    cut = cut.withColumn("__s", F.sum("__d").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    series = x.groupBy(by).agg(F.count("*").alias("days"), F.avg(value).alias("mean")).where(F.col("days") >= max(20, 2 * length))
    starts = series.join(pool.groupBy(by).agg(F.count("*").alias("blocks")), by)
    n_blocks = F.ceil(F.col("days") / length).cast("long")
    draws = starts.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("__b", F.explode(F.sequence(F.lit(1).cast("long"), n_blocks)))
    keys = [F.lit(str(seed)), *([] if joint else [F.col(by)]), F.col("sample").cast("string"), F.col("__b").cast("string")]
    draws = draws.withColumn("block", draw(*keys) % F.col("blocks")).withColumn("__k", F.when(F.col("__b") == n_blocks, F.col("days") - (n_blocks - 1) * length).otherwise(F.lit(length)))
    placed = draws.join(pool, [by, "block"]).withColumn("__end", F.col("start") + F.col("__k") - 1)
    first, last = cut.select(by, F.col("pos").alias("start"), (F.col("__s") - F.col("__d")).alias("__before")), cut.select(by, F.col("pos").alias("__end"), F.col("__s").alias("__after"))
    sums = placed.join(first, [by, "start"]).join(last, [by, "__end"]).groupBy(by, "sample", "days", "mean").agg(F.sum(F.col("__after") - F.col("__before")).alias("__t"))
    means = sums.withColumn("m", F.col("__t") / F.col("days"))
    hits = F.count_if(F.round(F.abs("m"), 12) >= F.round(F.abs("mean"), 12))
    out = means.groupBy(by, "days", "mean").agg(F.stddev_samp("m").alias("standard_error"), F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), ((1 + hits) / (samples + 1)).alias("p"))
    return out.select(by, "days", "mean", "standard_error", (F.col("mean") - F.col("q")[1]).alias("low"), (F.col("mean") - F.col("q")[0]).alias("high"), "p")


def block_bootstrap(daily: DataFrame, value: str, *, samples: int, length: int, seed: int, by: str = "factor", joint: bool = False) -> DataFrame:
    """(by, days, mean, standard_error, low, high, p) of a mean from moving blocks; series under max(20, 2 * length) values
    are left out.  The interval is reflected about the mean, and p counts the sample itself.  With ``joint``, series share draws."""
    x = numbered(daily.where(F.col(value).isNotNull()), by)
    n = F.count("*").over(Window.partitionBy(by))
    pool = x.withColumn("__n", n).where(F.col("pos") <= F.col("__n") - length).select(by, F.col("pos").alias("block"), F.col("pos").alias("start"))
    return _resampled(x, pool, value, samples, length, seed, by, joint)


def gap_aware_bootstrap(daily: DataFrame, calendar: DataFrame, value: str, *, samples: int, length: int, seed: int, by: str = "factor") -> DataFrame:
    """The same with blocks that never cross a missing calendar date (or a missing value)."""
    x = daily.where(F.col(value).isNotNull()).join(F.broadcast(calendar.select("datetime", F.col("pos").alias("__c"))), "datetime")
    x = numbered(x, by)
    island = Window.partitionBy(by, "__i")
    runs = x.withColumn("__i", F.col("__c") - F.col("pos")).withColumn("__last", F.max("pos").over(island)).where(F.col("pos") + length - 1 <= F.col("__last"))
    pool = runs.select(by, (F.row_number().over(Window.partitionBy(by).orderBy("pos")) - 1).cast("long").alias("block"), F.col("pos").alias("start"))
    return _resampled(x.drop("__c"), pool, value, samples, length, seed, by, False)


def stationary_bootstrap(daily: DataFrame, value: str, *, samples: int, mean_length: int, seed: int, by: str = "factor") -> DataFrame:
    """(by, days, standard_error) of a mean: blocks of geometric length on the series closed to a circle; NULL under 3 values."""
    x = numbered(daily.where(F.col(value).isNotNull()), by).select(by, "pos", value)
    series = x.groupBy(by).agg(F.count("*").alias("days"))
    rows = series.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("days") - 1)))
    text = lambda c: F.col(c).cast("string")
    restart = (F.col("t") == 0) | (draw(F.lit(str(seed)), F.lit("restart"), F.col(by), text("sample"), text("t")) * mean_length < (1 << 32))
    begun = F.last(F.when(restart, F.struct("t", (draw(F.lit(str(seed)), F.lit("start"), F.col(by), text("sample"), text("t")) % F.col("days")).alias("at"))), ignorenulls=True)
    w = Window.partitionBy(by, "sample").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__r", begun.over(w)).withColumn("pos", (F.col("__r.at") + F.col("t") - F.col("__r.t")) % F.col("days"))
    means = rows.join(x, [by, "pos"]).groupBy(by, "days", "sample").agg(F.avg(value).alias("m"))
    return means.groupBy(by, "days").agg(F.stddev_samp("m").alias("s")).select(by, "days", F.when(F.col("days") >= 3, F.col("s")).alias("standard_error"))


def benjamini(tests: DataFrame, family: str = "family", p: str = "p", name: str = "factor") -> DataFrame:
    """Adds q_bh (Benjamini-Hochberg) and q_by (Benjamini-Yekutieli) inside each family; ties by name."""
    up = Window.partitionBy(family).orderBy(p, name)
    m = F.count("*").over(Window.partitionBy(family))
    t = tests.withColumns({"__i": F.row_number().over(up), "__m": m})
    t = t.withColumn("__h", F.sum(1.0 / F.col("__i")).over(Window.partitionBy(family)))
    later = Window.partitionBy(family).orderBy("__i").rowsBetween(0, Window.unboundedFollowing)
    q = F.min(F.col(p) * F.col("__m") / F.col("__i")).over(later)
    return t.withColumns({"q_bh": F.least(q, F.lit(1.0)), "q_by": F.least(q * F.col("__h"), F.lit(1.0))}).drop("__i", "__m", "__h")


def holm(tests: DataFrame, family: str = "family", p: str = "p", name: str = "factor") -> DataFrame:
    """Adds the step-down adjusted p-value."""
    up = Window.partitionBy(family).orderBy(p, name)
    t = tests.withColumns({"__i": F.row_number().over(up), "__m": F.count("*").over(Window.partitionBy(family))})
    step = (F.col("__m") - F.col("__i") + 1) * F.col(p)
    return t.withColumn("p_holm", F.least(F.max(step).over(Window.partitionBy(family).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("__i", "__m")


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal p-value by a published rational approximation of the error function (error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def hac_mean(daily: DataFrame, value: str, bandwidth: int, by: str = "factor") -> DataFrame:
    """(by, days, mean, standard_error, t, p): Bartlett-weighted long-run variance on consecutive positions."""
    x = numbered(daily.where(F.col(value).isNotNull()), by)
    w = Window.partitionBy(by)
    x = x.withColumns({"__d": F.col(value) - F.avg(value).over(w), "__n": F.count("*").over(w)})
    o = w.orderBy("pos")
    weighted = F.col("__d") * F.col("__d") + sum((2 * (1 - k / (bandwidth + 1)) * F.col("__d") * F.coalesce(F.lag("__d", k).over(o), F.lit(0.0)) for k in range(1, bandwidth + 1)), F.lit(0.0))
    out = x.withColumn("__w", weighted).groupBy(by).agg(F.count("*").alias("days"), F.avg(value).alias("mean"), F.sum("__w").alias("__s"))
    se = F.sqrt(F.greatest(F.col("__s"), F.lit(0.0))) / F.col("days")
    out = out.withColumn("standard_error", se).withColumn("t", ratio(F.col("mean"), F.col("standard_error")))
    return out.withColumn("p", normal_two_sided(F.col("t"))).drop("__s")


def autocorrelations(daily: DataFrame, value: str, lags: int, by: str = "factor") -> DataFrame:
    """(by, lag, autocorrelation) about the series' mean."""
    x = numbered(daily.where(F.col(value).isNotNull()), by)
    w = Window.partitionBy(by)
    x = x.withColumn("__d", F.col(value) - F.avg(value).over(w))
    o = w.orderBy("pos")
    sums = x.select(by, F.col("__d"), *(F.lag("__d", k).over(o).alias(f"__{k}") for k in range(1, lags + 1))).groupBy(by).agg(F.sum(F.col("__d") * F.col("__d")).alias("__v"), *(F.sum(F.col("__d") * F.col(f"__{k}")).alias(f"{k}") for k in range(1, lags + 1)))
    long = sums.unpivot([by, "__v"], [str(k) for k in range(1, lags + 1)], "lag", "s")
    return long.select(by, F.col("lag").cast("int").alias("lag"), ratio(F.col("s"), F.col("__v")).alias("autocorrelation"))


def effective_size(daily: DataFrame, value: str, lags: int, by: str = "factor") -> DataFrame:
    """(by, days, inflation, effective): Bartlett variance inflation and days over it."""
    inflation = 1 + 2 * F.sum((1 - F.col("lag") / (lags + 1)) * F.col("autocorrelation"))
    r = autocorrelations(daily, value, lags, by).groupBy(by).agg(F.greatest(inflation, F.lit(1e-9)).alias("inflation"))
    n = daily.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("days"))
    return n.join(r, by).withColumn("effective", F.col("days") / F.col("inflation"))


def weighted_median(frame: DataFrame, value: str, weight: str, by: list[str], tie: str) -> DataFrame:
    """(by, weighted_median): the first value at which the running weight reaches half of the total."""
    rows = frame.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    w = Window.partitionBy(*by)
    run = F.sum(weight).over(w.orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0))
    held = rows.withColumns({"__r": run, "__t": F.sum(weight).over(w)}).where(F.col("__r") * 2 >= F.col("__t"))
    return held.groupBy(*by).agg(F.min(value).alias("weighted_median"))


def pooled_weighted_median(frame: DataFrame, value: str, weight: str, by: str, parts: int = 256) -> DataFrame:
    """``weighted_median`` of groups too large for one task; the frame is read three times.

    Values lie in ranges of about equal size, whose weights tell the range that the half falls into; only its values are walked.
    """
    rows = frame.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(by, F.col(value).alias("__v"), F.col(weight).alias("__w"))
    cuts = rows.groupBy(by).agg(F.array_distinct(F.percentile_approx("__v", [i / parts for i in range(1, parts)], 20 * parts)).alias("__cuts"))
    placed = rows.join(F.broadcast(cuts), by).select(by, "__v", "__w", F.size(F.filter("__cuts", lambda c: c <= F.col("__v"))).alias("__p"))
    sums = placed.groupBy(by, "__p").agg(F.sum("__w").alias("__s"))
    w = Window.partitionBy(by)
    up = F.sum("__s").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0))
    found = sums.withColumns({"__r": up, "__t": F.sum("__s").over(w)}).where(F.col("__r") * 2 >= F.col("__t"))
    found = found.groupBy(by).agg(F.min("__p").alias("__p"), F.min_by(F.col("__r") - F.col("__s"), "__p").alias("__b"), F.first("__t").alias("__t"))
    own = placed.join(F.broadcast(found), [by, "__p"]).groupBy(by, "__v", "__b", "__t").agg(F.sum("__w").alias("__w"))
    run = F.col("__b") + F.sum("__w").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    held = own.withColumns({"__r": run, "__top": F.max("__v").over(w)})
    # the range's last value counts, should sums in another order end just below the half
    return held.where((F.col("__r") * 2 >= F.col("__t")) | (F.col("__v") == F.col("__top"))).groupBy(by).agg(F.min("__v").alias("weighted_median"))
