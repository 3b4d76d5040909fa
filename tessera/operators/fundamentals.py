"""Valuation, order-flow and statement factors, revisions of statements and the timeline of what was public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ts
from tessera.functions.guard import positive_log, ratio
from tessera.sources.panel import KEYS

C = F.col


def _positive(c: str) -> Column:
    return F.when(C(c) > 0, C(c))


def _prior_mean(c: str, n: int, least: int) -> Column:
    w = ts.by_date().rowsBetween(-n, -1)
    return F.when(F.count(c).over(w) >= least, F.avg(c).over(w))


def valuation(frame: DataFrame) -> DataFrame:
    """Keys and twelve factors from total_mv, circ_mv, pe_ttm, pb, ps_ttm, dv_ttm, turnover_rate_f and volume_ratio."""
    p = frame.withColumn("__t", C("turnover_rate_f").cast("double") / 100)
    inverse = lambda c: ratio(F.lit(1.0), _positive(c))
    return p.select(
        *KEYS, positive_log(C("total_mv")).alias("log_total_cap"), positive_log(C("circ_mv")).alias("log_float_cap"), ratio(C("circ_mv"), C("total_mv")).alias("float_share"),
        inverse("pe_ttm").alias("earnings_yield"), inverse("pb").alias("book_to_price"), inverse("ps_ttm").alias("sales_to_price"), (C("dv_ttm").cast("double") / 100).alias("dividend_yield"),
        C("__t").alias("turnover"), ts.mean(C("__t"), 20, 10).alias("turnover_mean"), ts.std(C("__t"), 20, 10).alias("turnover_deviation"), (ratio(C("__t"), _prior_mean("__t", 20, 10)) - 1).alias("abnormal_turnover"), C("volume_ratio"),
    )


SIZES = ("sm", "md", "lg", "elg")


def order_flow(frame: DataFrame) -> DataFrame:
    """Keys and ten factors from bought and sold amounts by order size, the net flow (in ten thousands) and the traded amount."""

    def imbalance(*sizes: str) -> Column:
        buy, sell = (sum((C(f"{side}_{s}_amount").cast("double") for s in sizes), F.lit(0.0)) for side in ("buy", "sell"))
        return ratio(buy - sell, buy + sell)

    p = frame.withColumns({"__net": ratio(C("net_mf_amount").cast("double") * 10_000, C("traded_amount")), "__big": imbalance("lg", "elg")})
    names = dict(zip(("small", "medium", "large", "extra_large"), SIZES, strict=True))
    return p.select(
        *KEYS, imbalance(*SIZES).alias("overall_imbalance"), *(imbalance(s).alias(f"{n}_imbalance") for n, s in names.items()), C("__big").alias("institutional_imbalance"), C("__net").alias("net_flow"),
        ts.mean(C("__net"), 5, 3).alias("net_flow_5"), ts.mean(C("__net"), 20, 10).alias("net_flow_20"), ts.mean(C("__big"), 20, 10).alias("institutional_flow_20"),
    )


def statement_factors(frame: DataFrame) -> DataFrame:
    """Keys and nineteen factors of statements; a row whose statement wasn't public on its date stops the job."""
    late = C("information_available_date").isNull() | (C("information_available_date") > C("datetime"))
    checked = frame.where(F.assert_true(~late, F.lit("statement is not public on the row's date")).isNull())
    d = lambda c: C(c).cast("double")
    a, r, i, f, m = d("total_assets"), d("revenue"), d("net_income"), d("cashflow"), d("market_cap")
    growth = ratio(i, F.abs(d("prior_net_income"))) - F.signum(d("prior_net_income"))
    made = {
        "gross_profitability": ratio(r - d("cost"), a), "operating_profitability": ratio(d("operating_profit"), a), "return_on_assets": ratio(i, a), "book_leverage": ratio(d("total_liabilities"), a),
        "current_ratio": ratio(d("current_assets"), d("current_liabilities")), "cash_ratio": ratio(d("cash"), d("current_liabilities")), "cashflow_to_assets": ratio(f, a), "cashflow_quality": ratio(f, F.abs(i)),
        "accruals": ratio(i - f, a), "asset_growth": ratio(a, d("prior_total_assets")) - 1, "revenue_growth": ratio(r, d("prior_revenue")) - 1, "income_growth": growth, "cashflow_to_sales": ratio(f, r),
        "gross_margin": ratio(r - d("cost"), r), "net_margin": ratio(i, r), "book_to_market": ratio(d("equity"), m), "earnings_to_price": ratio(i, m), "sales_to_price": ratio(r, m), "cashflow_to_price": ratio(f, m),
    }
    return checked.select(*KEYS, *(v.alias(k) for k, v in made.items()))


def prepared_revisions(rows: DataFrame, precedence: list[str], keys: list[str], period: str = "end_date") -> DataFrame:
    """Adds available (the first date of ``precedence`` that can be read), available_from, status, row_hash, priority and
    sequence inside keys and period: by availability (missing last), priority, hash.

    The report period never stands in for a missing date; an announcement before the period's end stops the job.
    """
    dates = [F.try_to_date(C(c), "yyyyMMdd") for c in precedence]
    source = F.coalesce(*(F.when(x.isNotNull(), F.lit(c)) for c, x in zip(precedence, dates, strict=True)))
    out = rows.withColumns({"available": F.coalesce(*dates), "available_from": source})
    early = F.coalesce(C("available") < F.try_to_date(C(period), "yyyyMMdd"), F.lit(False))
    out = out.where(F.assert_true(~early, F.lit("announced before the report period's end")).isNull())
    columns = sorted(rows.columns)
    text = F.to_json(F.struct(*(C(c).cast("string").alias(c) for c in columns)), {"ignoreNullFields": "false"})
    priority = F.coalesce(C("update_flag").try_cast("int"), F.lit(-1)) if "update_flag" in rows.columns else F.lit(-1)
    out = out.withColumns({"status": F.when(C("available").isNotNull(), "authoritative").otherwise("research_pending"), "row_hash": F.sha2(text, 256), "priority": priority})
    return out.withColumn("sequence", F.row_number().over(Window.partitionBy(*keys, period).orderBy(F.col("available").asc_nulls_last(), "priority", "row_hash")))


def winners(prepared: DataFrame, keys: list[str], period: str = "end_date") -> DataFrame:
    """The last revision of each key, period and public date, and how many there were."""
    w = Window.partitionBy(*keys, period, "available")
    out = prepared.where("available is not null").withColumns({"same_day": F.count("*").over(w), "__r": F.row_number().over(w.orderBy(F.desc("priority"), F.desc("sequence")))})
    return out.where("__r = 1").drop("__r")


def event_timeline(events: DataFrame, datasets: list[str], prior: list[str]) -> DataFrame:
    """(entity, available, period, <dataset>, prior_<dataset>) from winners (entity, dataset, available, period, value).

    On each public date of an entity, the latest period that all datasets have by then, with each dataset's value as last
    revised by then; of the datasets in ``prior`` also the value one year earlier.  ``period`` is a date.
    """
    days = events.select("entity", "available").distinct()
    first = events.groupBy("entity", "period", "dataset").agg(F.min("available").alias("a")).groupBy("entity", "period").agg(F.count("*").alias("n"), F.max("a").alias("available"))
    whole = first.where(F.col("n") == len(datasets)).select("entity", "available", "period")
    w = Window.partitionBy("entity").orderBy("available").rangeBetween(Window.unboundedPreceding, 0)
    current = days.select("entity", "available", F.lit(None).cast("date").alias("period"), F.lit(1).alias("k")).unionByName(whole.withColumn("k", F.lit(0)))
    current = current.withColumn("period", F.max("period").over(w)).where("k = 1 and period is not null").drop("k")

    def known(out: DataFrame, dataset: str, into: str, shift: int) -> DataFrame:
        # one union and one window for each look-up: the last event of the entity and period on or before the date
        e = events.where(F.col("dataset") == dataset).select("entity", F.col("period").alias("__p"), "available", F.col("value").alias(into), F.lit(0).alias("k"), F.lit(None).cast("date").alias("period"))
        q = out.select("entity", F.add_months("period", shift).alias("__p"), "available", F.lit(None).cast(events.schema["value"].dataType).alias(into), F.lit(1).alias("k"), "period")
        last = F.last(into, ignorenulls=True).over(Window.partitionBy("entity", "__p").orderBy("available", "k").rowsBetween(Window.unboundedPreceding, 0))
        got = e.unionByName(q).withColumn(into, last).where("k = 1").select("entity", "available", "period", into)
        return out.join(got, ["entity", "available", "period"], "left")

    out = current
    for d in datasets:
        out = known(out, d, d, 0)
    for d in prior:
        out = known(out, d, f"prior_{d}", -12)
    return out


def pit_audit(aligned: DataFrame, events: DataFrame) -> DataFrame:
    """(check_name, status, observed_value) of rows (datetime, instrument, available): values used before they were public,
    availability that goes back in time, rows that don't hold the latest event."""
    from tessera.operators.audits import checks
    from tessera.operators.joins import as_of

    latest = as_of(aligned.select(*KEYS), events, "available", []).withColumnRenamed("event_date", "__latest")
    held = aligned.join(latest, KEYS, "left").withColumn("__before", F.max("available").over(ts.by_date().rowsBetween(Window.unboundedPreceding, -1)))
    return checks(held, {"future_use": C("available") > C("datetime"), "availability_goes_back": C("available") < C("__before"), "not_the_latest": ~F.equal_null("available", "__latest")})


def revision_audit(prepared: DataFrame, keys: list[str], by: str, period: str = "end_date") -> DataFrame:
    """(by, rows, keys, periods, revised, most_revisions, pending) of prepared statements."""
    per = prepared.groupBy(by, *keys, period).agg(F.count("*").alias("n"), F.count_if(C("available").isNull()).alias("p"))
    return per.groupBy(by).agg(F.sum("n").alias("rows"), F.count_distinct(*keys).alias("entities"), F.count("*").alias("periods"), F.count_if(C("n") > 1).alias("revised"), F.max("n").alias("most_revisions"), F.sum("p").alias("pending"))
