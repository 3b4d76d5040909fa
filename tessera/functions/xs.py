"""Per-date cross-sectional columns.  Ranks average ties; quantiles interpolate; a side that is missing has no result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.guard import ratio


def over(*keys: str):
    return Window.partitionBy(*(keys or ("datetime",)))


def count(x: Column, *keys: str) -> Column:
    return F.count(x).over(over(*keys))


def dealt(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows by cross-section, in as many partitions as the session's shuffles have.  Spark merges partitions up to a size, and then a task
    sorts many cross-sections at once; it leaves a number that was asked for."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ranked(x: Column, *keys: str) -> tuple[Column, Column]:
    """The average rank (see below), and the number of rows that have the value, from one sort and one window."""
    whole = over(*keys).orderBy(x.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return average_rank(x, *keys), F.count(x).over(whole)


def average_rank(x: Column, *keys: str) -> Column:
    """Rank from 1, ties averaged, among rows that have the value."""
    w = over(*keys)
    first = F.rank().over(w.orderBy(x.asc_nulls_last()))
    # rows that tie share a peer group: the range frame of the current value alone
    ties = F.count(x).over(w.orderBy(x.asc_nulls_last()).rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), first + (ties - 1) / 2)


def percent_rank(x: Column, *keys: str) -> Column:
    rank, n = ranked(x, *keys)
    return rank / n


def rank_normal(x: Column, *keys: str) -> Column:
    return F.when(count(x, *keys) >= 2, (percent_rank(x, *keys) - 0.5) * 3.46)


def rank_signed(x: Column, *keys: str) -> Column:
    """Rank on [-1, 1]."""
    rank, n = ranked(x, *keys)
    return F.when(n > 1, 2 * (rank - 1) / F.greatest(n - 1, F.lit(1)) - 1)


def mid_rank(x: Column, least: int, *keys: str) -> tuple[Column, Column]:
    """Centred mid-rank (r - 0.5)/n - 0.5, and the reason where there is none."""
    n = count(x, *keys)
    reason = F.when(x.isNull(), "missing").when(n < least, "insufficient").otherwise("ok")
    return F.when(reason == "ok", (average_rank(x, *keys) - 0.5) / n - 0.5), reason


def median(x: Column, *keys: str) -> Column:
    return F.percentile(x, F.lit(0.5)).over(over(*keys))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def winsorised(frame, x: str, into: str, scale: float = 4.5, keys=("datetime",)):
    """Adds x clipped at ``scale`` median absolute deviations from the median; unchanged where the deviation is 0."""
    frame = frame.withColumn("__m", median(F.col(x), *keys)).withColumn("__d", median(F.abs(F.col(x) - F.col("__m")), *keys))
    inside = clip(F.col(x), F.col("__m") - scale * F.col("__d"), F.col("__m") + scale * F.col("__d"))
    return frame.withColumn(into, F.when(F.col("__d") > 0, inside).otherwise(F.col(x))).drop("__m", "__d")


def zscore(frame, x: str, into: str, robust: bool = True, most: float | None = 3.0, keys=("datetime",), fall_back: bool = False):
    """Adds a z-score: around median and 1.4826 deviations, or mean and sample deviation; NULL under 2 values or without
    spread, but for ``fall_back``, which then takes the population deviation around the median.  Equal values have no spread, even
    if rounding leaves a tiny deviation around their mean."""
    c, w = F.col(x), over(*keys)
    if robust:
        frame = frame.withColumn("__c", median(c, *keys)).withColumn("__s", median(F.abs(c - F.col("__c")), *keys) * 1.4826)
        if fall_back:
            frame = frame.withColumn("__s", F.when(F.col("__s") > 0, F.col("__s")).otherwise(F.stddev_pop(c).over(w)))
    else:
        frame = frame.withColumn("__c", F.avg(c).over(w)).withColumn("__s", F.when(F.max(c).over(w) > F.min(c).over(w), F.stddev_samp(c).over(w)))
    z = F.when((F.col("__s") > 0) & (F.count(c).over(w) >= 2), (c - F.col("__c")) / F.col("__s"))
    return frame.withColumn(into, z if most is None else clip(z, F.lit(-most), F.lit(most))).drop("__c", "__s")


def bucket(frame, x: str, into: str, q: int, keys=("datetime",)):
    """Adds equal-count buckets 1..: quantile edges with duplicates dropped, the value is above the inner edges below it.
    NULL under q values."""
    w = over(*keys)
    edges = F.array_distinct(F.percentile(F.col(x), F.array(*(F.lit(i / q) for i in range(q + 1)))).over(w))
    frame = frame.withColumn("__e", edges)
    inner = F.slice("__e", 2, F.greatest(F.size("__e") - 2, F.lit(0)))
    value = 1 + F.size(F.filter(inner, lambda e: e < F.col(x)))
    return frame.withColumn(into, F.when((F.count(F.col(x)).over(w) >= q) & F.col(x).isNotNull() & (F.size("__e") > 1), value)).drop("__e")


def rank_bucket(x: Column, n: int, *keys: str) -> Column:
    """ceil(percent rank * n)."""
    return F.ceil(percent_rank(x, *keys) * n).cast("int")


def equal_weight(*keys: str) -> Column:
    return 1 / F.count(F.lit(1)).over(over(*keys))


def centred_rank(x: Column, *keys: str) -> Column:
    return percent_rank(x, *keys) - 0.5


def residual(y: Column, x: Column, least: int, *keys: str) -> Column:
    """Residual of y on one exposure inside a date; NULL under ``least`` pairs or without spread."""
    w = over(*keys)
    both = y.isNotNull() & x.isNotNull()
    a, b = F.when(both, y), F.when(both, x)
    slope = ratio(F.covar_pop(a, b).over(w), F.var_pop(b).over(w))
    return F.when(both & (F.count(a).over(w) >= least), y - F.avg(a).over(w) - slope * (x - F.avg(b).over(w)))


def residual_two(y: Column, x: Column, z: Column, least: int, *keys: str) -> Column:
    """Residual of y on two exposures inside a date, in closed form."""
    w = over(*keys)
    all_ = y.isNotNull() & x.isNotNull() & z.isNotNull()
    a, b, c = (F.when(all_, v) for v in (y, x, z))
    cov = lambda p, q: F.covar_pop(p, q).over(w)
    det = cov(b, b) * cov(c, c) - cov(b, c) * cov(b, c)
    first = ratio(cov(a, b) * cov(c, c) - cov(a, c) * cov(b, c), det)
    second = ratio(cov(a, c) * cov(b, b) - cov(a, b) * cov(b, c), det)
    out = y - F.avg(a).over(w) - first * (x - F.avg(b).over(w)) - second * (z - F.avg(c).over(w))
    return F.when(all_ & (F.count(a).over(w) >= least), out)


def clipped_zscore(frame, x: str, into: str, low: float = 0.01, high: float = 0.99, keys=("datetime",)):
    """Adds the z-score of x clipped at two quantiles; NULL without spread."""
    w = over(*keys)
    frame = frame.withColumn("__q", F.percentile(F.col(x), F.array(F.lit(low), F.lit(high))).over(w))
    frame = frame.withColumn("__x", clip(F.col(x), F.col("__q")[0], F.col("__q")[1]))
    spread = F.stddev_samp("__x").over(w)
    return frame.withColumn(into, F.when(spread > 0, (F.col("__x") - F.avg("__x").over(w)) / spread)).drop("__q", "__x")


def rank_band(x: Column, tie: Column, bands: list[tuple[str, int]], rest: str, *keys: str) -> Column:
    """The first band (name, last rank) that a row's rank from the largest lies in, ties by ``tie``."""
    rank = F.row_number().over(over(*keys).orderBy(x.desc(), tie))
    out = F.when(rank <= bands[0][1], bands[0][0])
    for name, last in bands[1:]:
        out = out.when(rank <= last, name)
    return F.when(x.isNotNull(), out.otherwise(rest))


def size_name(percentile: Column) -> Column:
    return F.when(percentile <= 1 / 3, "Small").when(percentile <= 2 / 3, "Mid").when(percentile.isNotNull(), "Large")


def rank_target(frame, label: str, least: int):
    """(datetime, instrument, target): centred percent ranks on dates of ``least`` labels or more; and a receipt by date."""
    counted = frame.withColumn("__n", count(F.col(label)))
    target = counted.where(F.col(label).isNotNull()).withColumn("target", centred_rank(F.col(label))).where(F.col("__n") >= least).select("datetime", "instrument", "target")
    receipt = frame.groupBy("datetime").agg(F.count(label).alias("pairs"))
    return target, receipt.withColumn("eligible", F.col("pairs") >= least)
