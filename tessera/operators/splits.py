"""Purged and embargoed splits, their audits, inner development splits, period calendars and timing checks.

Calendars have one row a date, so bounds of splits are found on the driver; everything by date is a join.
"""

from __future__ import annotations

import bisect
import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import label_dates


def add_months(day: dt.date, n: int) -> dt.date:
    """The same day n months later, or the last day of a shorter month."""
    months = day.year * 12 + day.month - 1 + n
    first, after = dt.date(months // 12, months % 12 + 1, 1), dt.date((months + 1) // 12, (months + 1) % 12 + 1, 1)
    return first + dt.timedelta(min(day.day, (after - first).days) - 1)


def walk_forward_bounds(dates: list[dt.date], *, train_months: int, validation_months: int, test_months: int, step_months: int, rolling: bool, least_test: int) -> list[tuple]:
    """(split_id, train_start, validation_start, test_start, test_end) with an open end, on a sorted calendar."""
    at = lambda day: dates[i] if (i := bisect.bisect_left(dates, day)) < len(dates) else None
    out, start = [], at(add_months(dates[0], train_months + validation_months))
    while start:
        end, validation = add_months(start, test_months), at(add_months(start, -validation_months))
        if bisect.bisect_left(dates, end) - bisect.bisect_left(dates, start) < least_test:
            break
        out.append((f"split_{len(out) + 1:03d}", add_months(validation, -train_months) if rolling else dates[0], validation, start, end))
        start = at(add_months(start, step_months))
    return out


def purged_walk_forward(calendar: DataFrame, *, train_months: int, validation_months: int, test_months: int, step_months: int, lag: int, horizon: int, embargo: int, rolling: bool = False, least_test: int = 1) -> DataFrame:
    """(split_id, datetime, fold, fate): kept, purged (the label reaches into a later fold) or embargoed (the last ``embargo``
    kept dates of train and of validation).  Train and validation only have dates whose label ends on the calendar."""
    dates = [r.datetime for r in calendar.select("datetime").orderBy("datetime").collect()]  # one row a date
    bounds = walk_forward_bounds(dates, train_months=train_months, validation_months=validation_months, test_months=test_months, step_months=step_months, rolling=rolling, least_test=least_test)
    b = calendar.sparkSession.createDataFrame(bounds, "split_id string, train_start date, validation_start date, test_start date, test_end date")
    days = label_dates(calendar, lag, horizon)
    d = F.col("datetime")
    rows = days.join(F.broadcast(b), (d >= F.col("train_start")) & (d < F.col("test_end")))
    rows = rows.withColumn("fold", F.when(d >= F.col("test_start"), "test").when(d >= F.col("validation_start"), "validation").otherwise("train"))
    rows = rows.where("fold = 'test' or exit is not null")
    last_test = F.max(F.when(F.col("fold") == "test", d)).over(Window.partitionBy("split_id"))
    rows = rows.withColumn("__last", last_test)
    against = F.when(F.col("fold") == "train", F.col("validation_start")).otherwise(F.col("test_start"))
    purged = (F.col("fold") != "test") & (F.col("entry") <= F.col("__last")) & (F.col("exit") >= against)
    rows = rows.withColumn("__purged", purged)
    tail = F.row_number().over(Window.partitionBy("split_id", "fold", "__purged").orderBy(F.desc("datetime")))
    fate = F.when(F.col("__purged"), "purged").when((F.col("fold") != "test") & (F.col("__tail") <= embargo), "embargoed").otherwise("kept")
    return rows.withColumn("__tail", tail).select("split_id", "datetime", "fold", fate.alias("fate"))


def split_manifest(splits: DataFrame) -> DataFrame:
    """One row for each split: first and last kept dates and their number by fold, purged and embargoed dates."""
    kept = lambda fold: F.when((F.col("fold") == fold) & (F.col("fate") == "kept"), F.col("datetime"))
    folds = ("train", "validation", "test")
    return splits.groupBy("split_id").agg(
        *(f(kept(x)).alias(f"{x}_{n}") for x in folds for f, n in ((F.min, "start"), (F.max, "end"), (F.count, "dates"))),
        F.count_if(F.col("fate") == "purged").alias("purged_dates"), F.count_if(F.col("fate") == "embargoed").alias("embargoed_dates"),
    )


def leakage_audit(splits: DataFrame, dates: DataFrame) -> DataFrame:
    """(check_name, status, observed_value): labels of one fold that overlap a later one, dates in several folds,
    embargoed dates still in use.  ``dates`` has (datetime, entry, exit)."""
    used = splits.where("fate = 'kept'")
    spans = used.groupBy("split_id").agg(*(f(F.when(F.col("fold") == x, F.col("datetime"))).alias(f"{x}_{n}") for x in ("validation", "test") for f, n in ((F.min, "lo"), (F.max, "hi"))))
    rows = used.join(F.broadcast(dates.select("datetime", "entry", "exit")), "datetime").join(F.broadcast(spans), "split_id")
    overlap = lambda fold, into: (F.col("fold") == fold) & (F.col("entry") <= F.col(f"{into}_hi")) & (F.col("exit") >= F.col(f"{into}_lo"))
    one = rows.agg(
        F.count_if(overlap("train", "test")).alias("train_test_label_overlap"), F.count_if(overlap("train", "validation")).alias("train_validation_label_overlap"),
        F.count_if(overlap("validation", "test")).alias("validation_test_label_overlap"),
    )
    twice = used.groupBy("split_id", "datetime").agg(F.count_distinct("fold").alias("n")).agg(F.count_if(F.col("n") > 1).alias("same_date_cross_fold_count"))
    again = splits.where("fate = 'embargoed'").join(used.select("split_id", "datetime"), ["split_id", "datetime"], "left_semi").agg(F.count("*").alias("embargo_violation_count"))
    both = one.crossJoin(twice).crossJoin(again)  # one row each
    names = both.columns
    long = both.unpivot([], names, "check_name", "observed_value")
    return long.select("check_name", F.when(F.col("observed_value") == 0, "pass").otherwise("fail").alias("status"), "observed_value")


def development_splits(splits: DataFrame, dates: DataFrame, fractions: list[float], *, validation: float, embargo: int, least: int) -> DataFrame:
    """(split_id, inner_id, datetime, fold): inside the kept train dates of each split, for each fraction the dates up to it are
    development; the last ``validation`` share of those validates.  Train labels that reach the validation dates are
    purged, the last ``embargo`` dates of both sides dropped, and inner splits with under ``least`` dates on a side left out.
    """
    w = Window.partitionBy("split_id")
    own = splits.where("fold = 'train' and fate = 'kept'").join(F.broadcast(dates.select("datetime", "exit")), "datetime")
    own = own.withColumns({"__p": F.row_number().over(w.orderBy("datetime")), "__n": F.count("*").over(w)})
    grid = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("inner_id"), F.lit(float(f)).alias("f")) for i, f in enumerate(fractions))))
    own = own.withColumn("__g", grid).select("*", "__g.inner_id", F.floor(F.col("__n") * F.col("__g.f")).alias("__end")).where(F.col("__p") <= F.col("__end"))
    own = own.withColumn("fold", F.when(F.col("__p") > F.col("__end") - F.floor(F.col("__end") * validation), "validation").otherwise("train"))
    inner = Window.partitionBy("split_id", "inner_id")
    own = own.withColumn("__first", F.min(F.when(F.col("fold") == "validation", F.col("datetime"))).over(inner)).where((F.col("fold") == "validation") | (F.col("exit") < F.col("__first")))
    tail = F.row_number().over(Window.partitionBy("split_id", "inner_id", "fold").orderBy(F.desc("datetime")))
    own = own.withColumn("__t", tail).where(F.col("__t") > embargo)
    sides = own.withColumns({"__a": F.count_if(F.col("fold") == "train").over(inner), "__b": F.count_if(F.col("fold") == "validation").over(inner)})
    return sides.where((F.col("__a") >= least) & (F.col("__b") >= least)).select("split_id", "inner_id", "datetime", "fold")


def protocol_folds(dates: DataFrame, years: list[int], histories: list[int | None]) -> DataFrame:
    """(year, history, datetime): for each task year the training dates whose label has matured before it begins; ``history``
    is the number of last such dates, or 0 for all of them (None)."""
    spark = dates.sparkSession
    tasks = spark.createDataFrame([(y, h or 0, dt.date(y, 1, 1)) for y in years for h in histories], "year int, history int, boundary date")
    safe = dates.where("exit is not null").join(F.broadcast(tasks), (F.col("datetime") < F.col("boundary")) & (F.col("exit") < F.col("boundary")))
    last = F.row_number().over(Window.partitionBy("year", "history").orderBy(F.desc("datetime")))
    return safe.withColumn("__r", last).where((F.col("history") == 0) | (F.col("__r") <= F.col("history"))).select("year", "history", "datetime")


def period_calendar(dates: DataFrame, periods: DataFrame) -> DataFrame:
    """(period, first_date, last_date, dates, mature_dates) of closed periods; mature: the label ends inside the period."""
    hit = dates.join(F.broadcast(periods), (F.col("datetime") >= F.col("start")) & (F.col("datetime") <= F.col("end")))
    return hit.groupBy("period").agg(F.min("datetime").alias("first_date"), F.max("datetime").alias("last_date"), F.count("*").alias("dates"), F.count_if(F.col("exit") <= F.col("end")).alias("mature_dates"))


def execution_days(signals: DataFrame, calendar: DataFrame) -> DataFrame:
    """(signal_date, execution_date, status): the next calendar date, or why there is none."""
    nxt = calendar.select(F.col("datetime").alias("signal_date"), F.lead("datetime").over(Window.orderBy("datetime")).alias("execution_date"), F.lit(True).alias("__on"))
    out = signals.join(F.broadcast(nxt), "signal_date", "left")
    return out.select("signal_date", "execution_date", F.when(F.col("__on").isNull(), "not_a_session").when(F.col("execution_date").isNull(), "calendar_end").otherwise("ok").alias("status"))


def timing_violations(fields: DataFrame) -> DataFrame:
    """(field, rows, violations) from (field, available, used): a value is late if it is available after its use, or never."""
    late = F.col("available").isNull() | (F.col("available") > F.col("used"))
    return fields.groupBy("field").agg(F.count("*").alias("rows"), F.count_if(late).alias("violations"))


def allowed_dates(frame: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of the allowed dates; an allowed date without a row stops the job."""
    absent = dates.select("datetime").distinct().join(frame.select("datetime").distinct(), "datetime", "left_anti")
    if not absent.isEmpty():
        raise ValueError(f"allowed dates without rows, for example {absent.first().datetime}")
    return frame.join(F.broadcast(dates.select("datetime").distinct()), "datetime", "left_semi")


def by_split(daily: DataFrame, assignments: DataFrame) -> DataFrame:
    """Daily rows once for each split that has their date (many to many on the date)."""
    return daily.join(F.broadcast(assignments.select("split_id", "datetime", "fold")), "datetime")


def common_window(daily: DataFrame, by: str = "method") -> DataFrame:
    """Rows of the dates that every method has."""
    n = daily.select(by).distinct().count()
    dates = daily.groupBy("datetime").agg(F.count_distinct(by).alias("n")).where(F.col("n") == n).select("datetime")
    return daily.join(F.broadcast(dates), "datetime", "left_semi")
