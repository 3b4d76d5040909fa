"""Data quality, tradability and universes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import guard, ts, xs
from tessera.functions.guard import ratio
from tessera.sources.panel import KEYS

FIELDS, PRICES = ["open", "high", "low", "close", "volume", "amount"], ["open", "high", "low", "close"]


def missing_rates(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(field, rows, missing, rate)."""
    one = panel.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.unpivot("rows", columns, "field", "missing").withColumn("rate", ratio(F.col("missing"), F.col("rows")))


def row_issues(panel: DataFrame, *, large_return: float = 0.3, jump: float = 0.3, adjustment: float = 0.5) -> DataFrame:
    """One row for each (row, rule) of eighteen rules: (datetime, instrument, category, rule)."""
    c = F.col
    rules = [("missing", f"{f}_missing", c(f).isNull()) for f in FIELDS] + [("price", f"{f}_le_zero", c(f) <= 0) for f in PRICES]
    rules += [("price", "high_lt_low", c("high") < c("low")), *(("price", f"{f}_outside_high_low", (c(f) < c("low")) | (c(f) > c("high"))) for f in ("open", "close"))]
    rules += [("volume_amount", f"{f}_lt_zero", c(f) < 0) for f in ("volume", "amount")]
    rules += [("return", "abs_daily_return_too_large", c("__r") > large_return), ("return", "close_jump_too_large", c("__r") > jump), ("return", "suspected_adjustment_error", c("__r") > adjustment)]
    held = panel.withColumn("__r", F.abs(ts.change(c("close"))))
    found = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(k).alias("category"), F.lit(r).alias("rule"))) for k, r, cond in rules)))
    return held.withColumn("issue", F.explode(found)).select(*KEYS, "issue.category", "issue.rule")


def rule_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category", "rule").agg(F.count("*").alias("issues"), F.count_distinct("instrument").alias("instruments"), F.count_distinct("datetime").alias("dates"))


def availability(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """(instrument, expected, valid, missing, zero_volume, score): expected days from the first to the last row."""
    life = panel.groupBy("instrument").agg(F.min("datetime").alias("s"), F.max("datetime").alias("e"), F.count("close").alias("valid"), F.count_if(F.col("volume") == 0).alias("zero_volume"))
    # first and last rows lie on the calendar, one row a date: expected days are a difference of positions
    at = lambda c, p: F.broadcast(calendar.select(F.col("datetime").alias(c), F.col("pos").alias(p)))
    out = life.join(at("s", "__s"), "s").join(at("e", "__e"), "e").withColumn("expected", F.col("__e") - F.col("__s") + 1).withColumn("missing", F.col("expected") - F.col("valid"))
    return out.select("instrument", "expected", "valid", "missing", "zero_volume", (100 * ratio(F.col("valid"), F.col("expected"))).alias("score"))


def date_coverage(panel: DataFrame, counts: DataFrame) -> DataFrame:
    """(datetime, expected, present, coverage) against expected members."""
    have = panel.where("close is not null").groupBy("datetime").agg(F.count_distinct("instrument").alias("present"))
    return counts.withColumnRenamed("members", "expected").join(have, "datetime", "left").withColumn("present", F.coalesce("present", F.lit(0))).withColumn("coverage", ratio(F.col("present"), F.col("expected")))


def profile(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(factor, rows, finite_rate, p10, median, p90, content): ``content`` adds hashes of keys and values, in any order."""
    long = panel.unpivot(KEYS, columns, "factor", "value")
    p = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return long.groupBy("factor").agg(F.count("*").alias("rows"), F.avg(F.col("value").isNotNull().cast("double")).alias("finite_rate"), p.alias("p")).select("factor", "rows", "finite_rate", *(F.col("p")[i].alias(n) for i, n in enumerate(("p10", "median", "p90"))))


def content_hash(panel: DataFrame, columns: list[str]) -> DataFrame:
    long = panel.unpivot(KEYS, columns, "factor", "value")
    return long.groupBy("factor").agg(F.sum(F.xxhash64(*KEYS, "value").cast("decimal(38,0)")).alias("content"))


def limit_flags(panel: DataFrame, limit, tolerance: float = 0.002, one_price: float = 1e-4) -> DataFrame:
    """Adds previous_close, is_limit_up, is_limit_down, one_price and limit_status; ``limit`` is a column."""
    c = F.col
    p = panel.withColumns({"previous_close": ts.ref(c("close"), 1), "__l": limit})
    up, down = c("previous_close") * (1 + c("__l") - tolerance), c("previous_close") * (1 - c("__l") + tolerance)
    known = c("previous_close").isNotNull() & c("__l").isNotNull() & c("open").isNotNull() & c("high").isNotNull() & c("low").isNotNull() & c("close").isNotNull()
    is_up, is_down = known & (c("close") >= up) & (c("high") >= up), known & (c("close") <= down) & (c("low") <= down)
    flat = (F.abs(c("open") - c("high")) <= one_price) & (F.abs(c("high") - c("low")) <= one_price) & (F.abs(c("low") - c("close")) <= one_price)
    status = F.when(~known, "unknown").when(is_down, "limit_down").when(is_up, "limit_up").otherwise("normal")
    return p.withColumns({"is_limit_up": F.coalesce(is_up, F.lit(False)), "is_limit_down": F.coalesce(is_down, F.lit(False)), "one_price": F.coalesce(known & flat & (is_up | is_down), F.lit(False)), "limit_status": status}).drop("__l")


#: Points taken from a score of 100.
PENALTIES = {"suspended": 100.0, "limit": 50.0, "one_price_limit": 30.0, "low_liquidity": 20.0, "new_listing": 15.0, "unknown": 40.0}


def tradability(panel: DataFrame, limit, *, buckets: int = 5, low_bucket: int = 1, new_days: int = 3) -> DataFrame:
    """Adds liquidity_bucket, can_buy, can_sell, tradability_score and disabled_reason."""
    c = F.col
    p = xs.bucket(limit_flags(panel, limit), "amount", "liquidity_bucket", buckets)
    p = p.withColumn("__age", F.row_number().over(ts.by_date()))
    suspended, low, new = F.coalesce(c("volume") <= 0, F.lit(True)), F.coalesce(c("liquidity_bucket") <= low_bucket, F.lit(False)), c("__age") <= new_days
    unknown = (c("limit_status") == "unknown") | c("liquidity_bucket").isNull()
    reasons = [("suspended", suspended), ("limit_up", c("is_limit_up")), ("limit_down", c("is_limit_down")), ("one_price_limit", c("one_price")), ("low_liquidity", low), ("new_listing", new), ("unknown_limit", c("limit_status") == "unknown"), ("unknown_liquidity", c("liquidity_bucket").isNull())]
    lost = [(suspended, "suspended"), (c("is_limit_up") | c("is_limit_down"), "limit"), (c("one_price"), "one_price_limit"), (low, "low_liquidity"), (new, "new_listing"), (unknown, "unknown")]
    score = F.lit(100.0) - sum((F.when(cond, PENALTIES[k]).otherwise(0.0) for cond, k in lost), F.lit(0.0))
    return p.withColumns({
        "can_buy": ~(suspended | c("is_limit_up") | low | new | unknown), "can_sell": ~(suspended | c("is_limit_down") | unknown),
        "tradability_score": F.round(F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0)), 2), "disabled_reason": F.array_join(F.array_compact(F.array(*(F.when(cond, F.lit(r)) for r, cond in reasons))), "|"),
    }).drop("__age")


def reason_counts(labels: DataFrame) -> DataFrame:
    """(reason, rows, instruments) of the joined reason strings."""
    each = labels.where("disabled_reason <> ''").select("instrument", F.explode(F.split("disabled_reason", r"\|")).alias("reason"))
    return each.groupBy("reason").agg(F.count("*").alias("rows"), F.count_distinct("instrument").alias("instruments"))


def universe(panel: DataFrame, calendar: DataFrame, selection: DataFrame, *, lookback: int, least: int, top: int) -> DataFrame:
    """(selection_date, instrument, rank, median_amount, valid_days): top by trailing median amount, ties by mean, then id."""
    days = calendar.join(selection.select(F.col("datetime").alias("selection_date")), F.col("datetime") == F.col("selection_date")).select("selection_date", F.col("pos").alias("at"))
    window = calendar.join(F.broadcast(days), (F.col("pos") > F.col("at") - lookback) & (F.col("pos") <= F.col("at"))).select("datetime", "selection_date")
    stats = panel.join(F.broadcast(window), "datetime").groupBy("selection_date", "instrument").agg(F.percentile("amount", F.lit(0.5)).alias("median_amount"), F.avg("amount").alias("__m"), F.count("amount").alias("valid_days")).where(F.col("valid_days") >= least)
    w = Window.partitionBy("selection_date").orderBy(F.desc("median_amount"), F.desc("__m"), "instrument")
    return stats.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("__m")


def membership_changes(snapshots: DataFrame) -> DataFrame:
    """(selection_date, instrument, change): enter or exit against the previous snapshot."""
    days = snapshots.select("selection_date").distinct().withColumn("n", F.row_number().over(Window.orderBy("selection_date")))
    held = snapshots.join(F.broadcast(days), "selection_date").select("n", "instrument", F.lit(1).alias("h"))
    now, before = held.withColumnRenamed("h", "now"), held.select((F.col("n") + 1).alias("n"), "instrument", F.col("h").alias("before"))
    both = now.join(before, ["n", "instrument"], "full_outer").where("(now is null or before is null) and n > 1")
    return both.join(F.broadcast(days), "n").select("selection_date", "instrument", F.when(F.col("now").isNull(), "exit").otherwise("enter").alias("change"))


def to_intervals(snapshots: DataFrame, calendar: DataFrame) -> DataFrame:
    """(instrument, start, end): consecutive snapshots merged; each lasts until the day before the next one takes effect."""
    days = snapshots.select("selection_date").distinct().withColumn("n", F.row_number().over(Window.orderBy("selection_date")))
    cal = calendar.withColumn("effective", F.lead("datetime").over(Window.orderBy("datetime"))).select(F.col("datetime").alias("selection_date"), "effective")
    days = days.join(F.broadcast(cal), "selection_date").withColumn("until", F.date_sub(F.lead("effective").over(Window.orderBy("n")), 1))
    placed = snapshots.join(F.broadcast(days), "selection_date")
    island = F.col("n") - F.row_number().over(Window.partitionBy("instrument").orderBy("n"))
    last = F.max_by("until", "n")
    return placed.withColumn("i", island).groupBy("instrument", "i").agg(F.min("effective").alias("start"), last.alias("end")).drop("i")


def of_categories(issues: DataFrame, categories: list[str]) -> DataFrame:
    return issues.where(F.col("category").isin(categories))


def tradable_rows(frame: DataFrame, *, least_bucket: int, least_score: float, excluded: tuple[str, ...] = (), need_buy: bool = True) -> DataFrame:
    """Rows liquid and tradable enough, that can be bought, aren't core-missing and have no excluded quality status; a missing
    status counts as unknown."""
    keep = (F.col("liquidity_bucket") >= least_bucket) & (F.col("tradability_score") >= least_score)
    if need_buy:
        keep = keep & F.coalesce("can_buy", F.lit(False))
    if "data_quality_status" in frame.columns and excluded:
        keep = keep & ~F.coalesce("data_quality_status", F.lit("unknown")).isin(*excluded)
    if "has_core_missing" in frame.columns:
        keep = keep & ~F.coalesce("has_core_missing", F.lit(False))
    return frame.where(keep)


def _runs(rows: DataFrame, position: str, prefix: str) -> DataFrame:
    """(instrument, longest_<prefix>, <prefix>s): runs of consecutive positions."""
    island = F.col(position) - F.row_number().over(Window.partitionBy("instrument").orderBy(position))
    runs = rows.withColumn("__g", island).groupBy("instrument", "__g").agg(F.count("*").alias("n"))
    return runs.groupBy("instrument").agg(F.max("n").alias(f"longest_{prefix}"), F.count("*").alias(f"{prefix}s"))


def availability_runs(panel: DataFrame, calendar: DataFrame, *, long_zero: int, long_gap: int) -> DataFrame:
    """(instrument, expected, valid, missing, longest_gap, gaps, longest_zero_run, zero_runs, score).

    Expected days reach from the first to the last row on the calendar: a difference of positions.  Gaps come from the
    positions of neighbouring rows, so missing days are never listed.  ``zero`` marks rows without trade.
    """
    p = panel.where("close is not null").join(F.broadcast(calendar), "datetime").withColumn("__k", F.row_number().over(ts.by_date()))
    gap = F.col("pos") - F.lag("pos").over(ts.by_date()) - 1
    life = p.withColumn("__gap", gap).groupBy("instrument").agg(
        (F.max("pos") - F.min("pos") + 1).alias("expected"), F.count("*").alias("valid"), F.coalesce(F.max("__gap"), F.lit(0)).alias("longest_gap"), F.count_if(F.col("__gap") > 0).alias("gaps"),
    )
    out = life.join(_runs(p.where("zero"), "__k", "zero_run"), "instrument", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("longest_zero_run", "zero_runs")})
    out = out.withColumn("missing", F.col("expected") - F.col("valid"))
    lost = F.least(ratio(F.col("missing"), F.col("expected")), F.lit(1.0)) * 60 + F.when(F.col("longest_zero_run") >= long_zero, 15).otherwise(0) + F.when(F.col("longest_gap") >= long_gap, 10).otherwise(0)
    return out.select("instrument", "expected", "valid", "missing", "longest_gap", "gaps", "longest_zero_run", "zero_runs", F.greatest(F.lit(0.0), 100 - lost).alias("score"))


def abnormal_instruments(issues: DataFrame, available: DataFrame, *, long_zero: int, long_gap: int) -> DataFrame:
    """(instrument, score, issues, rules, structural) of instruments with issues, long gaps or long runs without trade."""
    n = issues.groupBy("instrument").agg(F.count("*").alias("issues"), F.count_distinct("rule").alias("rules"))
    out = available.join(n, "instrument", "left").withColumns({"issues": F.coalesce("issues", F.lit(0)), "rules": F.coalesce("rules", F.lit(0)), "structural": (F.col("longest_gap") >= long_gap) | (F.col("longest_zero_run") >= long_zero)})
    return out.where(F.col("structural") | (F.col("issues") > 0)).select("instrument", "score", "issues", "rules", "structural")


def abnormal_dates(issues: DataFrame, coverage: DataFrame) -> DataFrame:
    """(datetime, coverage, issues, instruments, rules) of dates with issues or without full coverage."""
    n = issues.groupBy("datetime").agg(F.count("*").alias("issues"), F.count_distinct("instrument").alias("instruments"), F.count_distinct("rule").alias("rules"))
    out = coverage.join(n, "datetime", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("issues", "instruments", "rules")})
    return out.where((F.col("issues") > 0) | (F.col("coverage") < 1))


def factor_coverage(wide: DataFrame, factors: list[str], labels: list[str]) -> DataFrame:
    """(factor, label, total_rows, valid_rows, coverage, missing_rate, factor_missing_rows, label_missing_rows), in one pass."""
    have = {c: guard.finite(F.col(c)).isNotNull() for c in (*factors, *labels)}
    one = wide.agg(F.count("*").alias("n"), *(F.count_if(have[f] & have[y]).alias(f"{f}|{y}") for f in factors for y in labels), *(F.count_if(~have[c]).alias(c) for c in have))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.lit(y).alias("label"), F.col("n").alias("total_rows"), F.col(f"`{f}|{y}`").alias("valid_rows"), F.col(f).alias("factor_missing_rows"), F.col(y).alias("label_missing_rows")) for f in factors for y in labels)))
    out = one.select(each.alias("e")).select("e.*").withColumn("coverage", ratio(F.col("valid_rows"), F.col("total_rows")))
    return out.withColumn("missing_rate", 1 - F.col("coverage"))
