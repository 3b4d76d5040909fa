"""Attribution of scores to exposures, groups and styles; comparison of methods; evidence and stability boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import xs
from tessera.functions.guard import correlation, ratio
from tessera.operators.evaluate import daily_ic
from tessera.sources.panel import KEYS

C = F.col


def _sign(c: Column) -> Column:
    return F.signum(F.round(c, 9))


def pairwise_ic(long: DataFrame, least: int) -> DataFrame:
    """(datetime, factor, rank_ic, pairs, factor_missing, label_missing): rank correlation on valid pairs, and what lacks."""
    missing = long.groupBy("datetime", "factor").agg(F.count_if(C("value").isNull()).alias("factor_missing"), F.count_if(C("label").isNull()).alias("label_missing"))
    ic = daily_ic(long, least).select("datetime", "factor", "rank_ic", "pairs")
    return missing.join(ic, ["datetime", "factor"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def directional_summary(daily: DataFrame, dates: int) -> DataFrame:
    """(factor, days, direction, rank_ic_mean, directional_mean, directional_win_rate, coverage): signs taken from the mean."""
    ok = daily.where("rank_ic is not null").withColumn("direction", _sign(F.avg("rank_ic").over(Window.partitionBy("factor"))))
    return ok.groupBy("factor", "direction").agg(
        F.count("*").alias("days"), F.avg("rank_ic").alias("rank_ic_mean"), F.avg(C("rank_ic") * C("direction")).alias("directional_mean"),
        F.avg((F.round(C("rank_ic") * C("direction"), 9) > 0).cast("double")).alias("directional_win_rate"), (F.count("*") / dates).alias("coverage"),
    )


def exposure_correlation(long: DataFrame, exposures: dict[str, str], least: int) -> DataFrame:
    """(factor, exposure, days, mean_rho, mean_abs_rho): daily rank correlation of factors with exposures, over dates."""
    out = None
    for name, column in exposures.items():
        d = daily_ic(long.select(*KEYS, "factor", "value", C(column).alias("label")), least).where("status = 'ok'")
        s = d.groupBy("factor").agg(F.count("*").alias("days"), F.avg("rank_ic").alias("mean_rho"), F.avg(F.abs("rank_ic")).alias("mean_abs_rho")).withColumn("exposure", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def evaluator_table(wide: DataFrame, factors: list[str], labels: list[str], q: int) -> DataFrame:
    """(datetime, instrument, factor, label, factor_value, factor_quantile, forward_return): one row for each valid pair."""
    kept = wide.unpivot([*KEYS, *labels], factors, "factor", "factor_value").where("factor_value is not null")
    kept = xs.bucket(kept, "factor_value", "factor_quantile", q, ("datetime", "factor"))
    return kept.unpivot([*KEYS, "factor", "factor_value", "factor_quantile"], labels, "label", "forward_return").where("forward_return is not null")


def common_samples(long: DataFrame, least: int, q: int = 5) -> DataFrame:
    """(datetime, factor, pairs, distinct_values, buckets, ic_day, bucket_day, status) of each date and factor."""
    v = long.where("value is not null and label is not null")
    b = xs.bucket(v, "value", "__b", q, ("datetime", "factor"))
    out = b.groupBy("datetime", "factor").agg(F.count("*").alias("pairs"), F.count_distinct("value").alias("distinct_values"), F.count_distinct("__b").alias("buckets"))
    out = out.withColumns({"ic_day": (C("pairs") >= least) & (C("distinct_values") > 1)})
    out = out.withColumn("bucket_day", C("ic_day") & (C("buckets") == q))
    return out.withColumn("status", F.when(C("pairs") < least, "insufficient").when(C("distinct_values") < 2, "constant").when(C("buckets") < q, "too_few_buckets").otherwise("ok"))


def evidence_board(daily: DataFrame, value: str, era: str, least_days: int) -> DataFrame:
    """(factor, mean, years, annual_agreement, largest_era_share, worst_era, worst_without_era) from a daily metric.

    Years with ``least_days`` or more count; era means and means without one era are signed by the overall mean."""
    d = daily.where(C(value).isNotNull())
    full = d.groupBy("factor").agg(F.avg(value).alias("mean"), F.sum(value).alias("__t"), F.count("*").alias("__n")).withColumn("__s", _sign(C("mean")))
    y = d.groupBy("factor", F.year("datetime").alias("y")).agg(F.avg(value).alias("m"), F.count("*").alias("n")).where(C("n") >= least_days).join(full, "factor")
    years = y.groupBy("factor").agg(F.count("*").alias("years"), F.avg((F.round(C("m") * C("__s"), 9) > 0).cast("double")).alias("annual_agreement"))
    e = d.groupBy("factor", era).agg(F.sum(value).alias("s"), F.count("*").alias("n")).join(full, "factor")
    eras = e.groupBy("factor").agg(
        ratio(F.max(F.abs("s")), F.sum(F.abs("s"))).alias("largest_era_share"), F.min(C("s") / C("n") * C("__s")).alias("worst_era"), F.min(ratio(C("__t") - C("s"), C("__n") - C("n")) * C("__s")).alias("worst_without_era"),
    )
    return full.select("factor", "mean").join(years, "factor", "left").join(eras, "factor", "left")


def slice_stability(slices: DataFrame) -> DataFrame:
    """(factor, slices, positive_share, mean, deviation, worst, best) over a factor's slices (factor, slice, mean)."""
    return slices.groupBy("factor").agg(F.count("*").alias("slices"), F.avg((F.round("mean", 9) > 0).cast("double")).alias("positive_share"), F.avg("mean").alias("average"), F.stddev_samp("mean").alias("deviation"), F.min("mean").alias("worst"), F.max("mean").alias("best"))


def cohorts(panel: DataFrame, score: str, sizes: list[int]) -> DataFrame:
    """The panel's rows once for each cohort (top k by score, ties by instrument) that they are in."""
    ranked = panel.where(C(score).isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy("datetime").orderBy(F.desc(score), "instrument")))
    return ranked.withColumn("cohort", F.explode(F.filter(F.array(*(F.lit(k) for k in sizes)), lambda k: k >= C("__r")))).drop("__r")


def size_exposure(panel: DataFrame, score: str, percentile: str, size: str, sizes: list[int]) -> DataFrame:
    """(cohort, days, mean_percentile, small, mid, large): daily means and shares of cohorts, averaged over dates."""
    daily = cohorts(panel, score, sizes).groupBy("datetime", "cohort").agg(F.avg(percentile).alias("p"), *(F.avg((C(size) == n).cast("double")).alias(n.lower()) for n in ("Small", "Mid", "Large")))
    return daily.groupBy("cohort").agg(F.count("*").alias("days"), F.avg("p").alias("mean_percentile"), *(F.avg(n).alias(n) for n in ("small", "mid", "large")))


def active_share(panel: DataFrame, score: str, group: str, k: int) -> DataFrame:
    """(datetime, active_share, hhi): half the sum of differences of group shares between the top k and all, and the top's concentration."""
    n = F.count("*").over(xs.over())
    all_ = panel.where(C(score).isNotNull()).withColumn("__n", n).groupBy("datetime", group).agg((F.count("*") / F.max("__n")).alias("u"))
    top = cohorts(panel, score, [k]).withColumn("__n", n).groupBy("datetime", group).agg((F.count("*") / F.max("__n")).alias("t"))
    both = all_.join(top, ["datetime", group], "full_outer").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("u", "t")})
    return both.groupBy("datetime").agg((F.sum(F.abs(C("t") - C("u"))) / 2).alias("active_share"), F.sum(C("t") * C("t")).alias("hhi"))


def group_ic(long: DataFrame, group: str, least: int) -> DataFrame:
    """(factor, group, days, rank_ic_mean) of daily rank correlations inside groups."""
    d = daily_ic(long, least, (group,)).where("status = 'ok'")
    return d.groupBy("factor", group).agg(F.count("*").alias("days"), F.avg("rank_ic").alias("rank_ic_mean"))


def controlled_regression(panel: DataFrame, score: str, size: str, group: str, target: str, least: int) -> DataFrame:
    """(datetime, score_coefficient, size_coefficient, rows): the target on score and size z-scores with a constant for each group.

    Means of groups are taken off all sides and the two-variable normal equations solved, which gives the same coefficients
    as dummies.  Dates under ``least`` rows or without spread are left out."""
    p = panel.dropna(subset=[score, size, group, target])
    z = lambda c: ratio(C(c) - F.avg(c).over(xs.over()), F.stddev_pop(c).over(xs.over()))
    p = p.withColumns({"__a": z(score), "__b": z(size), "__n": F.count(F.lit(1)).over(xs.over())}).where((C("__n") >= least) & C("__a").isNotNull() & C("__b").isNotNull())
    inner = xs.over("datetime", group)
    p = p.withColumns({k: C(c) - F.avg(c).over(inner) for k, c in (("__x", "__a"), ("__z", "__b"), ("__y", target))})
    s = lambda a, b: F.sum(C(a) * C(b))
    d = p.groupBy("datetime").agg(s("__x", "__x").alias("xx"), s("__z", "__z").alias("zz"), s("__x", "__z").alias("xz"), s("__x", "__y").alias("xy"), s("__z", "__y").alias("zy"), F.count("*").alias("rows"))
    det = C("xx") * C("zz") - C("xz") * C("xz")
    return d.where(F.abs(det) > 1e-9).select("datetime", ((C("xy") * C("zz") - C("zy") * C("xz")) / det).alias("score_coefficient"), ((C("zy") * C("xx") - C("xy") * C("xz")) / det).alias("size_coefficient"), "rows")


def incremental_ic(panel: DataFrame, base: str, added: str, label: str, least: int) -> DataFrame:
    """(datetime, score_rho, residual_ic, base_ic, combined_ic): correlation of two scores, the rank IC of the part of the second
    that the first doesn't explain, and the rank ICs of the first alone and of the mean of both percent ranks."""
    p = panel.dropna(subset=[base, added, label])
    p = p.withColumns({"__ra": xs.percent_rank(C(base)), "__rb": xs.percent_rank(C(added)), "__n": F.count(F.lit(1)).over(xs.over()), "__left": xs.residual(C(added), C(base), least)}).where(C("__n") >= least)
    p = p.withColumns({"__both": F.round((C("__ra") + C("__rb")) / 2, 12), "__left": F.round("__left", 12)})
    p = p.withColumns({"__rl": xs.average_rank(C(label)), "__rr": xs.average_rank(C("__left")), "__rc": xs.average_rank(C("__both"))})
    return p.groupBy("datetime").agg(correlation("__ra", "__rb").alias("score_rho"), correlation("__rr", "__rl").alias("residual_ic"), correlation("__ra", "__rl").alias("base_ic"), correlation("__rc", "__rl").alias("combined_ic"))


def method_summary(daily: DataFrame) -> DataFrame:
    """(method, splits, pooled_mean, worst_split, mean_rank, place) from (split_id, method, datetime, value): methods ranked in
    each split, ordered by pooled mean, then name."""
    s = daily.where("value is not null").groupBy("split_id", "method").agg(F.avg("value").alias("m")).withColumn("r", F.rank().over(Window.partitionBy("split_id").orderBy(F.desc(F.round("m", 12)))))
    pooled = daily.where("value is not null").groupBy("method").agg(F.avg("value").alias("pooled_mean"))
    out = s.groupBy("method").agg(F.count("*").alias("splits"), F.min("m").alias("worst_split"), F.avg("r").alias("mean_rank")).join(pooled, "method")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("pooled_mean"), "method")))


def prediction_equivalence(a: DataFrame, b: DataFrame, column: str, atol: float, rtol: float) -> DataFrame:
    """One row: keys in both, in one alone, values within tolerance, the largest difference."""
    x, y = a.select(*KEYS, C(column).alias("x"), F.lit(1).alias("l")), b.select(*KEYS, C(column).alias("y"), F.lit(1).alias("r"))
    d = F.abs(C("x") - C("y"))
    return x.join(y, KEYS, "full_outer").agg(F.count(C("l") + C("r")).alias("both"), F.count_if(C("r").isNull()).alias("left_only"), F.count_if(C("l").isNull()).alias("right_only"), F.count_if(d <= atol + rtol * F.abs("y")).alias("equivalent"), F.max(d).alias("largest"))


def common_days(labels: DataFrame, arms: dict[str, DataFrame], label: str, least: int) -> DataFrame:
    """(datetime, <arm>, contrast): rank ICs of all arms on rows that every arm and the label have, and the first less the second."""
    p = labels.select(*KEYS, label)
    for n, t in arms.items():
        p = p.join(t.select(*KEYS, C("prediction").alias(n)), KEYS)
    p = p.dropna().withColumn("__n", F.count(F.lit(1)).over(xs.over())).where(C("__n") >= least).withColumn("__l", xs.average_rank(C(label)))
    names = list(arms)
    p = p.withColumns({f"__{n}": xs.average_rank(C(n)) for n in names})
    return p.groupBy("datetime").agg(*(correlation(f"__{n}", "__l").alias(n) for n in names)).withColumn("contrast", C(names[0]) - C(names[1]))


def era_reconciliation(daily: DataFrame, stored: DataFrame, tolerance: float) -> DataFrame:
    """(factor, era, mean, stored, status) of means over closed eras against stored ones (factor, era, start, end, stored)."""
    hit = daily.join(stored, "factor").where((C("datetime") >= C("start")) & (C("datetime") <= C("end")))
    out = hit.groupBy("factor", "era", "stored").agg(F.avg("value").alias("mean"))
    gap = F.abs(C("mean") - C("stored"))
    return out.select("factor", "era", "mean", "stored", F.when(C("stored").isNull(), "no_reference").when(gap <= tolerance, "match").when(_sign(C("mean")) == _sign(C("stored")), "same_direction").otherwise("conflict").alias("status"))


def group_extremes(means: DataFrame, group: str) -> DataFrame:
    """(factor, groups, lowest_group, lowest, highest_group, highest, range) of means by context group, ties by name."""
    key = lambda c: F.struct(C("rank_ic_mean"), C(c))
    out = means.groupBy("factor").agg(F.count("*").alias("groups"), F.min(key(group)).alias("lo"), F.max(key(group)).alias("hi"))
    return out.select("factor", "groups", C(f"lo.{group}").alias("lowest_group"), C("lo.rank_ic_mean").alias("lowest"), C(f"hi.{group}").alias("highest_group"), C("hi.rank_ic_mean").alias("highest"), (C("hi.rank_ic_mean") - C("lo.rank_ic_mean")).alias("range"))


def taxonomy(factors: DataFrame, overrides: DataFrame, patterns: DataFrame) -> DataFrame:
    """(factor, family, source): the override's family, else that of the first pattern (by order) that fits, else other."""
    fit = factors.join(F.broadcast(patterns), F.expr("factor rlike pattern")).groupBy("factor").agg(F.min_by("family", "order").alias("__p"))
    out = factors.join(overrides.select("factor", C("family").alias("__o")), "factor", "left").join(fit, "factor", "left")
    return out.select("factor", F.coalesce("__o", "__p", F.lit("other")).alias("family"), F.when(C("__o").isNotNull(), "override").when(C("__p").isNotNull(), "pattern").otherwise("none").alias("source"))


def scope_distribution(daily: DataFrame, value: str, era: Column) -> DataFrame:
    """(factor, scope, n, mean, median, p10, p90) over all dates, each year and each era: one scan, three rows a date."""
    scopes = F.array(F.lit("all"), F.concat(F.lit("year_"), F.year("datetime").cast("string")), F.concat(F.lit("era_"), era))
    p = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = daily.where(C(value).isNotNull()).withColumn("scope", F.explode(scopes)).groupBy("factor", "scope").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), p.alias("p"))
    return out.select("factor", "scope", "n", "mean", C("p")[1].alias("median"), C("p")[0].alias("p10"), C("p")[2].alias("p90"))


def context_keys(keys: DataFrame, universes: dict[str, DataFrame]) -> DataFrame:
    """Keys with a flag for each universe (in order of priority), the number of them, and the first one's name."""
    from tessera.operators.joins import flagged

    out = keys.select(*KEYS)
    for n, t in universes.items():
        out = flagged(out, t, f"in_{n}")
    names = list(universes)
    segment = F.when(C(f"in_{names[0]}"), names[0])
    for n in names[1:]:
        segment = segment.when(C(f"in_{n}"), n)
    return out.withColumns({"memberships": sum((C(f"in_{n}").cast("int") for n in names), F.lit(0)), "segment": segment.otherwise("outside")})
