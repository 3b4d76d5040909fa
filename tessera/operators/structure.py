"""The structure of rankings over time: regressions of factor returns, lagged ranks and sets, bands, ages, pairs of factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import xs
from tessera.functions.guard import correlation, ratio
from tessera.operators.evaluate import pair_correlation
from tessera.sources.panel import KEYS

BANDS = (("top", 0.1), ("next", 0.2), ("middle", 0.5))


def alpha_beta(returns: DataFrame, periods: int) -> DataFrame:
    """(alpha, annual_alpha, beta, r2, days): factor returns regressed on the universe's."""
    y, x = F.col("factor_return"), F.col("universe_return")
    out = returns.where(y.isNotNull() & x.isNotNull()).agg(F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("days"))
    return out.select("alpha", (F.pow(1 + F.col("alpha"), F.lit(float(periods))) - 1).alias("annual_alpha"), "beta", "r2", "days")


def _placed(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows with their date's position; a calendar has one row a date."""
    return rows.join(F.broadcast(calendar.select("datetime", "pos")), "datetime")


def _lagged(rows: DataFrame, lags: list[int], columns: list[str]) -> DataFrame:
    """(instrument, pos, lag, columns): what stood ``lag`` positions before."""
    return rows.select("instrument", *columns, "pos", F.explode(F.array(*(F.lit(x) for x in lags))).alias("lag")).withColumn("pos", F.col("pos") + F.col("lag"))


def lagged_autocorrelation(panel: DataFrame, factor: str, calendar: DataFrame, lags: list[int]) -> DataFrame:
    """(datetime, lag, autocorrelation, pairs) of ranks, ``lag`` dates of the calendar apart."""
    ranked = _placed(panel.where(F.col(factor).isNotNull()).select(*KEYS, xs.average_rank(F.col(factor)).alias("r")), calendar)
    before = _lagged(ranked.withColumnRenamed("r", "b"), lags, ["b"])
    both = ranked.join(before, ["instrument", "pos"])
    return both.groupBy("datetime", "lag").agg(correlation("r", "b").alias("autocorrelation"), F.count("*").alias("pairs"))


def quantile_turnover(panel: DataFrame, factor: str, q: int, calendar: DataFrame, lags: list[int]) -> DataFrame:
    """(datetime, lag, size, entered, turnover, earlier, retained, overlap_turnover) of the top quantile.

    turnover = entered / size; overlap_turnover = 1 - retained / earlier.  Dates without a set so long before have no row.
    """
    bucketed = xs.bucket(panel.where(F.col(factor).isNotNull()), factor, "bucket", q)
    top = _placed(bucketed.where(F.col("bucket") == q).select(*KEYS), calendar)
    before = _lagged(top, lags, [])
    sizes = before.groupBy("pos", "lag").agg(F.count("*").alias("earlier"))
    now = top.withColumn("lag", F.explode(F.array(*(F.lit(x) for x in lags)))).join(before.withColumn("kept", F.lit(1)), ["instrument", "pos", "lag"], "left")
    out = now.groupBy("datetime", "pos", "lag").agg(F.count("*").alias("size"), F.count_if(F.col("kept").isNull()).alias("entered"), F.count("kept").alias("retained")).join(sizes, ["pos", "lag"])
    return out.select("datetime", "lag", "size", "entered", ratio(F.col("entered"), F.col("size")).alias("turnover"), "earlier", "retained", (1 - ratio(F.col("retained"), F.col("earlier"))).alias("overlap_turnover"))


def banded(panel: DataFrame, score: str, calendar: DataFrame, bands: tuple[tuple[str, float], ...] = BANDS) -> DataFrame:
    """(datetime, instrument, pos, place, n, band): bands by ceil(share * n) of the date's order, ties by instrument; 'rest' beyond them."""
    day = Window.partitionBy("datetime")
    rows = panel.where(F.col(score).isNotNull())
    placed = rows.select(*KEYS, F.row_number().over(day.orderBy(F.desc(score), "instrument")).alias("place"), F.count("*").over(day).alias("n"))
    band = F.lit("rest")
    for name, share in reversed(bands):
        band = F.when(F.col("place") <= F.ceil(F.round(F.col("n") * share, 9)), name).otherwise(band)
    return _placed(placed, calendar).withColumn("band", band)


def migration(bands: DataFrame, lag: int = 1) -> DataFrame:
    """(datetime, origin, destination, members, share): where the members of each band are ``lag`` dates later, 'absent' if nowhere.

    ``datetime`` is the later date; shares are of the origin's members.  Later dates without any row have none.
    """
    days = bands.select("datetime", "pos").distinct()
    before = bands.select("instrument", (F.col("pos") + lag).alias("pos"), F.col("band").alias("origin")).join(F.broadcast(days), "pos")
    now = bands.select("instrument", "pos", F.col("band").alias("destination"))
    moved = before.join(now, ["instrument", "pos"], "left").withColumn("destination", F.coalesce("destination", F.lit("absent")))
    out = moved.groupBy("datetime", "origin", "destination").agg(F.count("*").alias("members"))
    return out.withColumn("share", ratio(F.col("members"), F.sum("members").over(Window.partitionBy("datetime", "origin"))))


def ages(members: DataFrame) -> DataFrame:
    """(datetime, members, age_mean, age_median, age_max, censored) of sets (datetime, instrument, pos).

    A member's age is the number of dates of its unbroken membership so far; those there since the first date are
    censored: they may be older.
    """
    own = Window.partitionBy("instrument").orderBy("pos")
    spell = members.withColumn("spell", F.col("pos") - F.row_number().over(own))
    aged = spell.withColumn("start", F.min("pos").over(Window.partitionBy("instrument", "spell"))).withColumn("age", F.col("pos") - F.col("start") + 1)
    first = F.broadcast(members.agg(F.min("pos").alias("first")))
    return aged.crossJoin(first).groupBy("datetime").agg(
        F.count("*").alias("members"), F.avg("age").alias("age_mean"), F.percentile("age", F.lit(0.5)).alias("age_median"), F.max("age").alias("age_max"), F.count_if(F.col("start") == F.col("first")).alias("censored")
    )


def churn(members: DataFrame) -> DataFrame:
    """(datetime, previous, current, retained, entries, exits, retention, entry_rate, exit_rate, jaccard, churn) of consecutive
    sets; churn is half the sum of the changes of equal weights.  Positions without a set on both sides have no row."""
    sizes = members.groupBy("datetime", "pos").agg(F.count("*").alias("current"))
    before = members.select("instrument", (F.col("pos") + 1).alias("pos"))
    kept = members.join(before, ["instrument", "pos"]).groupBy("pos").agg(F.count("*").alias("retained"))
    earlier = sizes.select((F.col("pos") + 1).alias("pos"), F.col("current").alias("previous"))
    out = sizes.join(earlier, "pos").join(kept, "pos", "left").withColumn("retained", F.coalesce("retained", F.lit(0)))
    now, was, held = (F.col(c) for c in ("current", "previous", "retained"))
    moved = held * F.abs(1 / now - 1 / was) + (now - held) / now + (was - held) / was
    return out.select(
        "datetime", "previous", "current", "retained", (now - held).alias("entries"), (was - held).alias("exits"), ratio(held, was).alias("retention"), ratio(now - held, now).alias("entry_rate"),
        ratio(was - held, was).alias("exit_rate"), ratio(held, now + was - held).alias("jaccard"), (moved / 2).alias("churn"),
    )


def pair_reduction(long: DataFrame, least: int, *, least_fraction: float = 0.8, least_coverage: float = 0.5) -> DataFrame:
    """A row for each pair of factors over all dates: numbers of dates by reason, signs, and means, medians and first deciles of
    rho, its size, common rows, their share of the universe and of the union, on the dates that have a rho.

    Pairs are comparable with a rho on enough dates and enough coverage on nine of ten of these.
    """
    universe = long.groupBy("datetime").agg(F.count_distinct("instrument").alias("universe"))
    finite = long.where("value is not null").groupBy("datetime", "factor").agg(F.count("*").alias("finite"))
    names = long.select("factor").distinct()
    pairs = names.select(F.col("factor").alias("factor_a")).join(names.select(F.col("factor").alias("factor_b")), F.col("factor_a") < F.col("factor_b"))
    side = lambda x: finite.select("datetime", F.col("factor").alias(f"factor_{x}"), F.col("finite").alias(f"finite_{x}"))
    rows = universe.crossJoin(pairs).join(pair_correlation(long, least), ["datetime", "factor_a", "factor_b"], "left")
    rows = rows.join(side("a"), ["datetime", "factor_a"], "left").join(side("b"), ["datetime", "factor_b"], "left")
    common, rho = F.coalesce("common", F.lit(0)), F.col("rho")
    union = F.coalesce("finite_a", F.lit(0)) + F.coalesce("finite_b", F.lit(0)) - common
    held = {"rho": rho, "abs_rho": F.abs(rho), "n_common": common.cast("double"), "coverage": ratio(common, F.col("universe")), "jaccard": ratio(common, union)}
    rows = rows.withColumns({f"v_{k}": F.when(rho.isNotNull(), v) for k, v in held.items()})
    share = lambda c: ratio(F.count_if(c), F.count("rho"))
    sign = F.round(rho, 9)
    numbers = [f(f"v_{k}").alias(f"{n}_{k}") for k in held for n, f in (("mean", F.avg), ("median", lambda c: F.percentile(c, F.lit(0.5))), ("p10", lambda c: F.percentile(c, F.lit(0.1))))]
    out = rows.groupBy("factor_a", "factor_b").agg(
        F.count("*").alias("dates"), F.count("rho").alias("valid_dates"), F.count_if(F.coalesce("reason", F.lit("insufficient")) == "insufficient").alias("insufficient_dates"),
        F.count_if(F.col("reason") == "constant").alias("constant_dates"), share(sign > 0).alias("positive"), share(sign < 0).alias("negative"), *numbers,
    )
    out = out.withColumns({"valid_fraction": ratio(F.col("valid_dates"), F.col("dates")), "sign_consistency": F.greatest("positive", "negative")})
    return out.withColumn("comparable", (F.col("valid_fraction") >= least_fraction) & F.coalesce(F.col("p10_coverage") >= least_coverage, F.lit(False)))


def band_returns(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, days, mean_label, positive): over dates, the mean of the band's mean labels and the share of positive ones."""
    daily = bands.select(*KEYS, "band").join(labels.select(*KEYS, "label"), KEYS).where("label is not null").groupBy("datetime", "band").agg(F.avg("label").alias("m"))
    return daily.groupBy("band").agg(F.count("*").alias("days"), F.avg("m").alias("mean_label"), F.avg((F.round("m", 9) > 0).cast("double")).alias("positive"))


def sliced(daily: DataFrame, states: DataFrame, state: str) -> DataFrame:
    """(factor, state, days, rank_ic_mean, win_rate) of daily coefficients by a state of their dates (one row a date)."""
    rows = daily.where("status = 'ok'").join(F.broadcast(states.select("datetime", state)), "datetime")
    return rows.groupBy("factor", state).agg(F.count("*").alias("days"), F.avg("rank_ic").alias("rank_ic_mean"), F.avg((F.round("rank_ic", 9) > 0).cast("double")).alias("win_rate"))


def leg_exposure(panel: DataFrame, factor: str, exposure: str, share: float) -> DataFrame:
    """(datetime, members, long, short, universe, net): mean exposure of the top and bottom floor(n * share), ties by instrument."""
    rows = panel.where(F.col(factor).isNotNull() & F.col(exposure).isNotNull())
    day = Window.partitionBy("datetime")
    n = F.floor(F.count("*").over(day) * share)
    legs = rows.withColumns({"__top": F.row_number().over(day.orderBy(F.desc(factor), "instrument")) <= n, "__low": F.row_number().over(day.orderBy(factor, "instrument")) <= n})
    x = F.col(exposure)
    out = legs.groupBy("datetime").agg(F.count_if("__top").alias("members"), F.avg(F.when(F.col("__top"), x)).alias("long"), F.avg(F.when(F.col("__low"), x)).alias("short"), F.avg(x).alias("universe"))
    return out.where("members > 0").withColumn("net", F.col("long") - F.col("short"))


def liquid_selection(panel: DataFrame, score: str, liquidity: str, quantile: float, k: int) -> DataFrame:
    """(datetime, eligible, members, mean_label): the k best scores among rows at or above the date's quantile of liquidity, ties by
    instrument; means are of the labels that are there."""
    day = Window.partitionBy("datetime")
    rows = panel.where(F.col(score).isNotNull() & F.col(liquidity).isNotNull()).withColumn("__floor", F.percentile(liquidity, F.lit(quantile)).over(day)).where(F.round(liquidity, 9) >= F.round("__floor", 9))
    ranked = rows.withColumns({"__r": F.row_number().over(day.orderBy(F.desc(score), "instrument")), "__n": F.count("*").over(day)})
    return ranked.where(F.col("__r") <= k).groupBy("datetime").agg(F.first("__n").alias("eligible"), F.count("*").alias("members"), F.avg("label").alias("mean_label"))
