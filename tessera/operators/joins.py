"""Point-in-time joins, calendars, labels and splits.  Intervals are closed; a NULL end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ts
from tessera.functions.guard import ratio
from tessera.sources.panel import KEYS


def calendar_of(panel: DataFrame) -> DataFrame:
    """(datetime, pos): the distinct dates, numbered from 1.  One row a date, however large the panel."""
    return panel.select("datetime").distinct().withColumn("pos", F.row_number().over(Window.orderBy("datetime")).cast("long"))


def dense_grid(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every date for every instrument, with the panel's columns where it has a row."""
    return calendar.crossJoin(panel.select("instrument").distinct()).join(panel, KEYS, "left")


def looked_up(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join whose right keys are unique; a repeated key stops the job."""
    twice = F.assert_true(F.col("__n") == 1, F.lit("repeated key"))
    checked = right.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*on))).where(twice.isNull()).drop("__n")
    return left.join(checked, on, how)


def replaced_columns(parent: DataFrame, corrected: DataFrame, names: list[str], on: list[str] = KEYS) -> DataFrame:
    """The parent with the named columns taken from a correction table; rows and order of columns stay."""
    return parent.drop(*names).join(corrected.select(*on, *names), on, "left").select(*parent.columns)


def in_interval(frame: DataFrame, intervals: DataFrame) -> Column:
    return (frame["datetime"] >= intervals["start"]) & ((frame["datetime"] <= intervals["end"]) | intervals["end"].isNull())


def _by_year(intervals: DataFrame, last: Column) -> DataFrame:
    """Intervals dealt to the years they touch, so that the join has an equality on instrument and year."""
    return intervals.withColumn("__year", F.explode(F.sequence(F.year("start"), F.year(F.coalesce("end", last)))))


def members(frame: DataFrame, intervals: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows inside (left_semi) or outside (left_anti) any interval of their instrument; keys stay as they are."""
    right = _by_year(intervals.withColumnRenamed("instrument", "__i"), F.lit("2100-12-31").cast("date"))
    on = (frame["instrument"] == right["__i"]) & (F.year(frame["datetime"]) == right["__year"]) & in_interval(frame, right)
    return frame.join(right, on, how)


def flagged(frame: DataFrame, intervals: DataFrame, into: str) -> DataFrame:
    """Adds whether a row lies in an interval of its instrument."""
    hit = members(frame.select(*KEYS).distinct(), intervals).withColumn(into, F.lit(True))
    return frame.join(hit, KEYS, "left").withColumn(into, F.coalesce(into, F.lit(False)))


def key_grid(intervals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Distinct (datetime, instrument) inside intervals: each interval picks its dates from the calendar, an array with one
    element a date, so nothing is joined by range."""
    dates = [r.datetime for r in calendar.select("datetime").distinct().orderBy("datetime").collect()]
    all_ = F.array(*(F.lit(d) for d in dates)) if dates else F.array().cast("array<date>")
    own = F.filter(all_, lambda d: (d >= F.col("start")) & (F.col("end").isNull() | (d <= F.col("end"))))
    return intervals.select(F.explode(own).alias("datetime"), "instrument").distinct()


def intersected(left: DataFrame, right: DataFrame) -> DataFrame:
    """Overlaps of two interval tables by instrument, with what became of the left interval (kept, truncated, split)."""
    l_, r = left.select("instrument", F.col("start").alias("ls"), F.col("end").alias("le")), right.select(F.col("instrument").alias("i2"), "start", "end")
    hit = l_.join(r, (F.col("instrument") == F.col("i2")) & (F.col("ls") <= F.col("end")) & (F.col("start") <= F.col("le")))
    out = hit.select("instrument", "ls", "le", F.greatest("ls", "start").alias("start"), F.least("le", "end").alias("end"))
    parts = F.count(F.lit(1)).over(Window.partitionBy("instrument", "ls", "le"))
    fate = F.when(parts > 1, "split").when((F.col("start") == F.col("ls")) & (F.col("end") == F.col("le")), "kept").otherwise("truncated")
    return out.withColumn("fate", fate).drop("ls", "le")


def uncovered(left: DataFrame, right: DataFrame) -> DataFrame:
    """(instrument, start, end): the spans of the left intervals' union that no right interval covers, by a sweep over their ends.

    An open end is NULL, in the result as well; intervals that end before they start hold nothing.
    """

    def moves(x: DataFrame, a: int, b: int) -> DataFrame:
        x = x.where("end is null or start <= end")
        begin = x.select("instrument", F.col("start").alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b"))
        return begin.union(x.where("end is not null").select("instrument", F.date_add("end", 1), F.lit(-a), F.lit(-b)))

    w = Window.partitionBy("instrument").orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    at = moves(left, 1, 0).union(moves(right, 0, 1)).groupBy("instrument", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    parts = at.select("instrument", "at", F.date_sub(F.lead("at").over(w), 1).alias("until"), ((F.sum("a").over(so_far) > 0) & (F.sum("b").over(so_far) == 0)).alias("out"))
    # parts meet without gaps, so those that follow each other are one span
    parts = parts.withColumn("span", F.count_if(~F.col("out")).over(so_far)).where("out")
    return parts.groupBy("instrument", "span").agg(F.min("at").alias("start"), F.when(F.count_if(F.col("until").isNull()) == 0, F.max("until")).alias("end")).drop("span")


def keys_inside(spans: DataFrame, calendar: DataFrame) -> DataFrame:
    """``spans`` with ``keys``, the number of calendar dates in each; the calendar, a row a date, goes along as one array."""
    days = calendar.agg(F.sort_array(F.collect_list("datetime")).alias("days"))
    inside = F.filter("days", lambda d: (d >= F.col("start")) & (F.col("end").isNull() | (d <= F.col("end"))))
    return spans.crossJoin(F.broadcast(days)).withColumn("keys", F.size(inside)).drop("days")


def member_counts(intervals: DataFrame, calendar: DataFrame) -> DataFrame:
    """(datetime, members) by running sums of entries and exits; days are never multiplied by intervals."""
    moves = intervals.select(F.col("start").alias("datetime"), F.lit(1).alias("d")).union(intervals.where("end is not null").select(F.date_add("end", 1), F.lit(-1)))
    daily = moves.groupBy("datetime").agg(F.sum("d").alias("d")).union(calendar.select("datetime", F.lit(0).cast("long")))
    running = F.sum("d").over(Window.orderBy("datetime").rangeBetween(Window.unboundedPreceding, 0))
    return daily.withColumn("members", running).join(calendar.select("datetime"), "datetime", "left_semi").groupBy("datetime").agg(F.max("members").alias("members"))


def as_of(keys: DataFrame, events: DataFrame, event_date: str, columns: list[str], by: str = "instrument") -> DataFrame:
    """For each key the latest event on or before its date: one union and one window, no range join."""
    event = F.struct(F.col(event_date).alias("event_date"), *columns)
    # event columns break ties of one date, so that the order is total
    e = events.select(by, F.col(event_date).alias("datetime"), event.alias("__e"), F.lit(0).alias("__k"))
    k = keys.select(by, "datetime", F.lit(None).cast(e.schema["__e"].dataType).alias("__e"), F.lit(1).alias("__k"))
    w = Window.partitionBy(by).orderBy("datetime", "__k", "__e").rowsBetween(Window.unboundedPreceding, 0)
    out = e.unionByName(k).withColumn("__e", F.last("__e", ignorenulls=True).over(w)).where("__k = 1")
    return out.select("datetime", by, "__e.event_date", *(f"__e.{c}" for c in columns))


def latest_revision(records: DataFrame, keys: list[str], available: str, as_of_date, order: list[Column]) -> DataFrame:
    """The record of each key that was the latest on a date: by availability, then ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(available), *order)
    return records.where(F.col(available) <= as_of_date).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def effective(keys: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Facts effective at each key's date; keys with several facts are ambiguous and get none."""
    right = facts.withColumnRenamed("instrument", "__i")
    hit = keys.join(right, (keys["instrument"] == right["__i"]) & in_interval(keys, right)).groupBy(*KEYS).agg(F.count("*").alias("matches"), *(F.first(c).alias(c) for c in columns))
    out = keys.join(hit, KEYS, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.withColumns({c: F.when(F.col("matches") == 1, F.col(c)) for c in columns})


def aligned(left: DataFrame, right: DataFrame, column: str, tolerance: float) -> DataFrame:
    """Full outer join of two sources: (keys, left, right, side, close enough)."""
    out = left.select(*KEYS, F.col(column).alias("left_value")).join(right.select(*KEYS, F.col(column).alias("right_value")), KEYS, "full_outer")
    side = F.when(F.col("left_value").isNull(), "right_only").when(F.col("right_value").isNull(), "left_only").otherwise("both")
    gap = ratio(F.abs(F.col("left_value") - F.col("right_value")), F.abs("left_value"))
    return out.withColumns({"side": side, "matches": F.when(side == "both", gap <= tolerance)})


def compared(a: DataFrame, b: DataFrame, columns: list[str], atol: float, rtol: float) -> DataFrame:
    """(factor, rows, exact, near, largest difference) of two tables on common keys."""
    x, y = a.unpivot(KEYS, columns, "factor", "a"), b.unpivot(KEYS, columns, "factor", "b")
    both = x.join(y, [*KEYS, "factor"])
    d = F.abs(F.col("a") - F.col("b"))
    return both.groupBy("factor").agg(F.count("*").alias("rows"), F.count_if(F.equal_null("a", "b")).alias("exact"), F.count_if(d <= atol + rtol * F.abs("b")).alias("near"), F.max(d).alias("largest"))


# ------------------------------------------------------------------ calendar, labels, splits
def label_dates(calendar: DataFrame, lag: int, hold: int) -> DataFrame:
    """(datetime, pos, entry, exit, terminal): entry ``lag`` and exit ``lag + hold`` positions later."""
    w = Window.orderBy("datetime")
    return calendar.select("datetime", "pos", F.lead("datetime", lag).over(w).alias("entry"), F.lead("datetime", lag + hold).over(w).alias("exit")).withColumn("terminal", F.col("exit").isNull())


def exact_label(panel: DataFrame, dates: DataFrame, price: str = "close") -> DataFrame:
    """Forward return between the entry and exit dates of the calendar; NULL without two positive prices.  Rows that
    are missing don't shorten the horizon."""
    p = panel.select("instrument", F.col("datetime").alias("__d"), F.when(F.col(price) > 0, F.col(price)).alias("__p"))
    entry, exit_ = p.toDF("instrument", "entry", "__in"), p.toDF("instrument", "exit", "__out")
    out = panel.select(*KEYS).join(F.broadcast(dates.select("datetime", "entry", "exit")), "datetime").join(entry, ["instrument", "entry"], "left").join(exit_, ["instrument", "exit"], "left")
    return out.select(*KEYS, "entry", "exit", (ratio(F.col("__out"), F.col("__in")) - 1).alias("label"))


def position_label(panel: DataFrame, calendar: DataFrame, lag: int, hold: int, price: str = "close", into: str = "label") -> DataFrame:
    """The panel with the same label, from range frames over calendar positions: one shuffle by instrument, no join of prices."""
    w = Window.partitionBy("instrument").orderBy("__pos")
    at = lambda k: F.max(F.when(F.col(price) > 0, F.col(price))).over(w.rangeBetween(k, k))
    placed = panel.join(F.broadcast(calendar.select("datetime", F.col("pos").alias("__pos"))), "datetime")  # one row a date
    return placed.withColumn(into, ratio(at(lag + hold), at(lag)) - 1).drop("__pos")


def shifted_label(horizon: int, price: str = "close") -> Column:
    """lead(1 + h) / lead(1) - 1 over an instrument's rows."""
    return ratio(ts.ref(F.col(price), -1 - horizon), ts.ref(F.col(price), -1)) - 1


def month_ends(calendar: DataFrame) -> DataFrame:
    return calendar.groupBy(F.trunc("datetime", "month").alias("month")).agg(F.max("datetime").alias("datetime"))


def walk_forward(dates: DataFrame, first: str, test_months: int, validation_months: int, embargo: int) -> DataFrame:
    """(split_id, datetime, fold) of purged, embargoed, expanding walk-forward splits.

    ``dates`` has (datetime, entry, exit).  Dates whose label reaches into the next fold are purged; the last
    ``embargo`` of what is left of train and validation are embargoed.
    """
    bounds = dates.agg(F.max("datetime").alias("last")).select(F.posexplode(F.expr(f"sequence(date'{first}', last, interval {test_months} months)")).alias("k", "test_start"))
    bounds = bounds.select((F.col("k") + 1).alias("split_id"), "test_start", F.add_months("test_start", test_months).alias("test_end"), F.add_months("test_start", -validation_months).alias("validation_start"))
    d = dates.crossJoin(F.broadcast(bounds)).where("datetime < test_end")
    fold = F.when(F.col("datetime") >= F.col("test_start"), "test").when(F.col("datetime") >= F.col("validation_start"), "validation").otherwise("train")
    d = d.withColumn("fold", fold)
    next_ = F.when(F.col("fold") == "train", F.col("validation_start")).when(F.col("fold") == "validation", F.col("test_start"))
    safe = d.where((F.col("fold") == "test") | (F.col("exit") < next_))
    tail = F.row_number().over(Window.partitionBy("split_id", "fold").orderBy(F.desc("datetime")))
    return safe.withColumn("__t", tail).where((F.col("fold") == "test") | (F.col("__t") > embargo)).select("split_id", "datetime", "fold")
