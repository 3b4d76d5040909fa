"""Contracts, guards, evidence and reconciliation: results are check tables or labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import xs
from tessera.functions.guard import ratio
from tessera.sources.panel import KEYS


def checks(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check_name, status, observed_value): how many rows break each rule, in one pass."""
    one = frame.agg(*(F.count_if(c).alias(n) for n, c in rules.items()))
    long = one.unpivot([], list(rules), "check_name", "observed_value")
    return long.select("check_name", F.when(F.col("observed_value") == 0, "pass").otherwise("fail").alias("status"), "observed_value")


def panel_contract(panel: DataFrame) -> DataFrame:
    """Keys are there and unique, prices are positive and in order."""
    twice = F.count("*").over(Window.partitionBy(*KEYS)) > 1
    c = F.col
    held = panel.withColumn("__twice", twice)
    return checks(held, {"null_key": c("datetime").isNull() | c("instrument").isNull(), "repeated_key": c("__twice"), "nonpositive_close": c("close") <= 0, "high_below_low": c("high") < c("low")})


def interval_contract(intervals: DataFrame) -> DataFrame:
    """Intervals are in order and don't overlap inside an instrument."""
    w = Window.partitionBy("instrument").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    held = intervals.withColumn("__before", F.max(F.coalesce("end", F.lit("9999-12-31").cast("date"))).over(w))
    return checks(held, {"reversed": F.col("end") < F.col("start"), "overlap": F.coalesce(F.col("start") <= F.col("__before"), F.lit(False))})


def maturity_violations(labels: DataFrame, dates: DataFrame, as_of: Column) -> DataFrame:
    """Labels whose exit date isn't before the given date."""
    return labels.where("label is not null").join(F.broadcast(dates.select("datetime", "exit")), "datetime").where((F.col("exit") >= as_of) | F.col("exit").isNull())


def stratified_sample(frame: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum in the order of a hash of seed and key: the same rows on any cluster."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key))), key)
    return frame.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def guard_columns(frame: DataFrame, prefixes: tuple[str, ...] = ("test_",), parts: tuple[str, ...] = ("oos",)) -> DataFrame:
    """The frame, unless a column's name shows data that a selection must not see."""
    seen = [c for c in frame.columns if c.startswith(prefixes) or any(p in c for p in parts)]
    if seen:
        raise ValueError(f"forbidden columns: {seen}")
    return frame


def with_tradability(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join with defaults for rows without a label: can't be traded, and why."""
    out = panel.join(labels.select(*KEYS, "can_buy", "can_sell", "disabled_reason"), KEYS, "left")
    return out.withColumns({"can_buy": F.coalesce("can_buy", F.lit(False)), "can_sell": F.coalesce("can_sell", F.lit(False)), "disabled_reason": F.coalesce("disabled_reason", F.lit("missing_tradability"))})


def with_quality(panel: DataFrame, issues: DataFrame) -> DataFrame:
    """Adds issue_count and issue_rules (sorted and distinct, joined by '|')."""
    per = issues.groupBy(*KEYS).agg(F.count("*").alias("issue_count"), F.array_join(F.array_sort(F.collect_set("rule")), "|").alias("issue_rules"))
    out = panel.join(per, KEYS, "left")
    return out.withColumns({"issue_count": F.coalesce("issue_count", F.lit(0)), "issue_rules": F.coalesce("issue_rules", F.lit(""))})


def resolved_rules(frame: DataFrame, rules: DataFrame, on: list[str]) -> DataFrame:
    """Each row with the one dated rule that holds, and the number of rules that do; none or several give NULL."""
    r = rules.select(*(F.col(c).alias(f"__{c}") for c in on), "start", "end", "rate")
    hit = (F.col("datetime") >= F.col("start")) & (F.col("end").isNull() | (F.col("datetime") <= F.col("end")))
    for c in on:
        hit = hit & (frame[c] == F.col(f"__{c}"))
    out = frame.join(r, hit, "left").groupBy(*KEYS).agg(F.count("rate").alias("matches"), F.max("rate").alias("rate"))
    return out.withColumn("rate", F.when(F.col("matches") == 1, F.col("rate")))


def disagreements(sources: dict[str, DataFrame], flag: str) -> DataFrame:
    """Keys on which sources that have the flag disagree: one column a source."""
    names = sorted(sources)
    rows = [t.select(*KEYS, F.col(flag).alias("v"), F.lit(n).alias("s")) for n, t in sources.items()]
    both = rows[0]
    for t in rows[1:]:
        both = both.unionByName(t)
    out = both.groupBy(*KEYS).pivot("s", names).agg(F.first("v"))
    return out.where(F.size(F.array_distinct(F.array_compact(F.array(*names)))) > 1)


def missing_by_source(sources: dict[str, DataFrame]) -> DataFrame:
    """(source, instrument, missing, first_date, last_date): keys that another source has."""
    every = None
    for t in sources.values():
        k = t.select(*KEYS)
        every = k if every is None else every.union(k)
    every = every.distinct()
    out = None
    for n, t in sources.items():
        gap = every.join(t.select(*KEYS), KEYS, "left_anti").groupBy("instrument").agg(F.count("*").alias("missing"), F.min("datetime").alias("first_date"), F.max("datetime").alias("last_date")).withColumn("source", F.lit(n))
        out = gap if out is None else out.unionByName(gap)
    return out


def listing_age(panel: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds age in days since the first listing and its bucket."""
    first = intervals.groupBy("instrument").agg(F.min("start").alias("__listed"))
    age = F.datediff("datetime", "__listed")
    bins = F.when(F.col("age").isNull() | (F.col("age") < 0), "unknown").when(F.col("age") <= 60, "0-60").when(F.col("age") <= 120, "61-120").when(F.col("age") <= 250, "121-250").when(F.col("age") <= 500, "251-500").otherwise("501+")
    return panel.join(first, "instrument", "left").withColumn("age", age).withColumn("age_bucket", bins).drop("__listed")


def relative_returns(long: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Label minus the benchmark's of the date."""
    return long.join(benchmark, "datetime", "left").withColumn("relative", F.col("label") - F.col("benchmark"))


def phases(frame: DataFrame, moment: str, open_hour: int = 9) -> DataFrame:
    """before_open, after_open or unknown of a publication moment; moments at midnight have no precision."""
    t = F.col(moment)
    none = t.isNull() | (F.date_trunc("day", t) == t)
    return frame.withColumn("phase", F.when(none, "unknown").when(F.hour(t) < open_hour, "before_open").otherwise("after_open"))


def duplicate_columns(long: DataFrame) -> DataFrame:
    """(factor_a, factor_b) of factors whose values are equal on every key: equal content sums, then equality counted."""
    h = long.groupBy("factor").agg(F.sum(F.xxhash64(*KEYS, "value").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n"))
    same = h.alias("a").join(h.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.factor") < F.col("b.factor"))).select(F.col("a.factor").alias("factor_a"), F.col("b.factor").alias("factor_b"), F.col("a.n").alias("n"))
    x, y = long.select(*KEYS, F.col("factor").alias("factor_a"), F.col("value").alias("x")), long.select(*KEYS, F.col("factor").alias("factor_b"), F.col("value").alias("y"))
    equal = same.join(x, "factor_a").join(y, ["factor_b", *KEYS]).where(F.equal_null("x", "y")).groupBy("factor_a", "factor_b", "n").count()
    return equal.where("count = n").select("factor_a", "factor_b")


def stable_frontier(coverage: DataFrame, least: float) -> DataFrame:
    """The earliest date from which coverage never falls below ``least`` again."""
    bad = coverage.agg(F.max(F.when(F.coalesce(F.col("coverage") < least, F.lit(True)), F.col("datetime"))).alias("bad"))
    return coverage.crossJoin(F.broadcast(bad)).where(F.col("bad").isNull() | (F.col("datetime") > F.col("bad"))).agg(F.min("datetime").alias("frontier"))


def conflicts(facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with several distinct values, and how many."""
    return facts.groupBy(*keys).agg(F.count_distinct(value).alias("values")).where("`values` > 1")


def reconciled(events: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row for each key: the one distinct value of each field or NULL, the reasons for NULLs, the number of rows."""
    out = events.groupBy(*keys).agg(F.count("*").alias("rows"), *(F.count_distinct(f).alias(f"__n_{f}") for f in fields), *(F.max(f).alias(f) for f in fields))
    why = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"__n_{f}") > 1, F.lit(f"conflict_{f}")).when(F.col(f"__n_{f}") == 0, F.lit(f"missing_{f}")) for f in fields))), "|")
    return out.withColumn("reasons", why).withColumns({f: F.when(F.col(f"__n_{f}") == 1, F.col(f)) for f in fields}).drop(*(f"__n_{f}" for f in fields))


def quote_checks(panel: DataFrame, by: tuple[str, ...] = ("instrument",), slack: float = 0.002) -> DataFrame:
    """(by, rows, positive, ordered, vwap_inside): counts of consistent quotes, by instrument or by instrument and window."""
    c = F.col
    inside = (c("vwap") >= c("low") * (1 - slack)) & (c("vwap") <= c("high") * (1 + slack))
    ordered = (c("low") <= F.least("open", "close")) & (c("high") >= F.greatest("open", "close"))
    return panel.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if((c("open") > 0) & (c("close") > 0) & (c("volume") > 0)).alias("positive"), F.count_if(ordered).alias("ordered"), F.count_if(inside).alias("vwap_inside"))


def set_overlap(held: DataFrame, by: str = "datetime") -> DataFrame:
    """(by, size, kept, entered, left, jaccard) of each set against the one before."""
    days = held.select(by).distinct().withColumn("__n", F.row_number().over(Window.orderBy(by)))
    h = held.join(F.broadcast(days), by).select("__n", "instrument")
    a, b = h.withColumn("now", F.lit(1)), h.select((F.col("__n") + 1).alias("__n"), "instrument", F.lit(1).alias("before"))
    out = a.join(b, ["__n", "instrument"], "full_outer").groupBy("__n").agg(F.count("now").alias("size"), F.count(F.col("now") + F.col("before")).alias("kept"), F.count_if(F.col("before").isNull()).alias("entered"), F.count_if(F.col("now").isNull()).alias("left"))
    return out.where("__n > 1").join(F.broadcast(days), "__n").select(by, "size", "kept", "entered", "left", ratio(F.col("kept"), F.col("size") + F.col("left")).alias("jaccard"))


def concentration(panel: DataFrame, group: str, weight: str) -> DataFrame:
    """(datetime, hhi, top_share): squared shares and the largest share of groups."""
    g = panel.groupBy("datetime", group).agg(F.sum(weight).alias("__w"))
    s = g.withColumn("__s", ratio(F.col("__w"), F.sum("__w").over(xs.over())))
    return s.groupBy("datetime").agg(F.sum(F.col("__s") * F.col("__s")).alias("hhi"), F.max("__s").alias("top_share"))


def period_summary(daily: DataFrame, periods: DataFrame, value: str, per_year: int) -> DataFrame:
    """(period, days, mean, median, ratio, positive): daily values in closed periods; the ratio is annualised."""
    hit = daily.join(F.broadcast(periods), (F.col("datetime") >= F.col("start")) & (F.col("datetime") <= F.col("end")))
    return hit.groupBy("period").agg(
        F.count(value).alias("days"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), (ratio(F.avg(value), F.stddev_samp(value)) * F.sqrt(F.lit(float(per_year)))).alias("ratio"), F.avg((F.round(value, 9) > 0).cast("double")).alias("positive"),
    )


def leave_one_out(daily: DataFrame, era: str, value: str, by: str = "factor") -> DataFrame:
    """(by, era, own mean, mean of all other eras): sums less the era's own."""
    per = daily.where(F.col(value).isNotNull()).groupBy(by, era).agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))
    w = Window.partitionBy(by)
    return per.select(by, era, ratio(F.col("__s"), F.col("__n")).alias("mean"), ratio(F.sum("__s").over(w) - F.col("__s"), F.sum("__n").over(w) - F.col("__n")).alias("others"))


def top_k_retention(panel: DataFrame, score: str, k: int) -> DataFrame:
    """Set overlap of consecutive top-k members, ties by instrument."""
    w = Window.partitionBy("datetime").orderBy(F.desc(score), "instrument")
    top = panel.where(F.col(score).isNotNull()).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return set_overlap(top.select(*KEYS))


def best_trial(trials: DataFrame, metric: str, plateau: float, simplicity: str) -> DataFrame:
    """Of the trials within ``plateau`` of the best, the simplest; ties by trial."""
    near = trials.withColumn("__best", F.max(metric).over(Window.partitionBy("group"))).where(F.col(metric) >= F.col("__best") - plateau)
    w = Window.partitionBy("group").orderBy(simplicity, F.desc(metric), "trial")
    return near.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__best")


def distribution(frame: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, mean, median, p90 by nearest rank, largest)."""
    p90 = F.expr(f"percentile_disc(0.9) within group (order by `{value}`)")
    return frame.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), p90.alias("p90"), F.max(value).alias("largest"))
