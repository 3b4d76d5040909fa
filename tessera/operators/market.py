"""Market tables, instrument states, eligibility, session records and reconciliation of quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ts, xs
from tessera.functions.guard import ratio
from tessera.operators.joins import dense_grid
from tessera.operators.portfolio import tick_bounds
from tessera.operators.quality import limit_flags
from tessera.sources.panel import KEYS

C = F.col

#: Points taken from a score of 100.
PENALTIES = {"suspended": 100.0, "limit": 50.0, "one_price_limit": 30.0, "low_liquidity": 20.0, "new_listing": 15.0, "price_anomaly": 50.0, "volume_anomaly": 35.0, "core_missing": 100.0, "unknown": 40.0}


def with_liquidity_value(panel: DataFrame) -> tuple[DataFrame, str]:
    """Adds liquidity_value and says its source: the amount where any row has one, else close * volume, else nothing."""
    amounts, both = panel.agg(F.count("amount"), F.count_if(C("close").isNotNull() & C("volume").isNotNull())).first()
    if amounts:
        return panel.withColumn("liquidity_value", C("amount")), "amount"
    if both:
        return panel.withColumn("liquidity_value", C("close") * C("volume")), "close_volume"
    return panel.withColumn("liquidity_value", F.lit(None).cast("double")), "unavailable"


def tradability_labels(panel: DataFrame, limit: Column, issues: DataFrame, *, buckets: int = 5, low_bucket: int = 1, new_days: int = 60) -> DataFrame:
    """The panel with every tradability flag, can_buy, can_sell, tradability_score and disabled_reason.

    ``issues`` (datetime, instrument, category): those of category price or return make a price anomaly, those of
    volume_amount a volume anomaly.  Days listed count from the first row with all prices.
    """
    p, source = with_liquidity_value(limit_flags(panel, limit))
    p = xs.bucket(p, "liquidity_value", "liquidity_bucket", buckets).withColumn("liquidity_source", F.lit(source))
    missing = C("open").isNull() | C("high").isNull() | C("low").isNull() | C("close").isNull()
    p = p.withColumn("core_missing", missing)
    first = F.min(F.when(~C("core_missing"), C("datetime"))).over(Window.partitionBy("instrument"))
    p = p.withColumns({
        "suspended": C("core_missing") | (F.coalesce("volume", F.lit(0.0)) == 0), "listed_days": F.datediff("datetime", first), "low_liquidity": F.coalesce(C("liquidity_bucket") <= low_bucket, F.lit(False)),
        "one_price_limit_up": C("is_limit_up") & C("one_price"), "one_price_limit_down": C("is_limit_down") & C("one_price"),
    })
    p = p.withColumn("new_listing", F.coalesce(C("listed_days") < new_days, F.lit(True)))
    kinds = issues.groupBy(*KEYS).agg(F.bool_or(C("category").isin("price", "return")).alias("price_anomaly"), F.bool_or(C("category") == "volume_amount").alias("volume_anomaly"))
    p = p.join(kinds, KEYS, "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("price_anomaly", "volume_anomaly")})
    p = p.withColumn("data_quality_status", F.when(C("price_anomaly") | C("volume_anomaly"), "issue").otherwise("ok"))
    no_limit, no_liquidity = C("limit_status") == "unknown", C("liquidity_bucket").isNull()
    p = p.withColumn("unknown", no_limit | no_liquidity)
    named = [(c, C(c)) for c in ("suspended",)] + [("limit_up", C("is_limit_up")), ("limit_down", C("is_limit_down"))]
    named += [(c, C(c)) for c in ("one_price_limit_up", "one_price_limit_down", "low_liquidity", "new_listing", "price_anomaly", "volume_anomaly", "core_missing")]
    named += [("unknown_limit", no_limit), ("unknown_liquidity", no_liquidity)]
    both = C("suspended") | C("price_anomaly") | C("volume_anomaly") | C("core_missing") | C("unknown")
    lost = [("suspended", C("suspended")), ("limit", C("is_limit_up") | C("is_limit_down")), ("one_price_limit", C("one_price_limit_up") | C("one_price_limit_down"))]
    lost += [(c, C(c)) for c in ("low_liquidity", "new_listing", "price_anomaly", "volume_anomaly", "core_missing", "unknown")]
    score = F.lit(100.0) - sum((F.when(cond, PENALTIES[k]).otherwise(0.0) for k, cond in lost), F.lit(0.0))
    return p.withColumns({
        "disabled_reason": F.array_join(F.array_compact(F.array(*(F.when(cond, F.lit(n)) for n, cond in named))), "|"),
        "can_buy": ~(both | C("is_limit_up") | C("low_liquidity") | C("new_listing")), "can_sell": ~(both | C("is_limit_down")), "tradability_score": F.round(F.greatest(score, F.lit(0.0)), 2),
    })


def raw_units(panel: DataFrame, factor: str = "factor") -> DataFrame:
    """Adjusted prices and volumes in raw units: prices divided by the factor, volumes multiplied."""
    return panel.withColumns({**{c: ratio(C(c), C(factor)) for c in ("open", "high", "low", "close")}, "volume": C("volume") * C(factor)})


def market_table(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """(datetime, instrument, close, volume, suspended, can_buy, can_sell): every date of each instrument from its first to its last
    row; missing prices are carried, missing volumes are zero, and such days can't be traded."""
    grid = dense_grid(panel.select(*KEYS, "close", "volume"), calendar)
    w = Window.partitionBy("instrument")
    seen = grid.withColumns({"__lo": F.min(F.when(C("close").isNotNull(), C("datetime"))).over(w), "__hi": F.max(F.when(C("close").isNotNull(), C("datetime"))).over(w)}).where((C("datetime") >= C("__lo")) & (C("datetime") <= C("__hi")))
    out = seen.withColumns({"suspended": C("close").isNull() | (F.coalesce("volume", F.lit(0.0)) == 0)})
    return out.select(*KEYS, ts.forward_fill(C("close")).alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"), "suspended", (~C("suspended")).alias("can_buy"), (~C("suspended")).alias("can_sell"))


def complete_instruments(panel: DataFrame, calendar: DataFrame, share: float = 1.0) -> DataFrame:
    """Instruments that have a price on the given share of the calendar's dates."""
    n = calendar.count()
    return panel.groupBy("instrument").agg(F.count("close").alias("dates")).where(C("dates") >= n * share)


def chained_factor(raw: DataFrame, anchor: DataFrame) -> DataFrame:
    """(datetime, instrument, factor): the anchor's factor times the running product of previous close / stated previous close after
    the anchor date; an instrument without an anchor starts at one over its first close."""
    p = raw.withColumn("__step", F.coalesce(ratio(ts.ref(C("close"), 1), C("preclose")), F.lit(1.0))).join(anchor, "instrument", "left")
    p = p.where(C("anchor_date").isNull() | (C("datetime") > C("anchor_date")))
    first = F.row_number().over(ts.by_date()) == 1
    p = p.withColumn("__s", F.when(C("anchor_date").isNull() & first, ratio(F.lit(1.0), C("close"))).otherwise(C("__step")))
    product = ts.growth(C("__s") - 1, ts.by_date().rowsBetween(Window.unboundedPreceding, 0))
    return p.select(*KEYS, (F.coalesce("anchor_factor", F.lit(1.0)) * product).alias("factor"))


def instrument_states(panel: DataFrame, intervals: DataFrame, calendar: DataFrame, rules: DataFrame) -> DataFrame:
    """Keys with listed, delisted, age in sessions, board and rule_id: the one dated rule of the board (NULL if none or several)."""
    life = intervals.groupBy("instrument").agg(F.min("start").alias("listed_date"), F.max("end").alias("delisted_date"))
    place = calendar.select(F.col("datetime").alias("listed_date"), F.col("pos").alias("__l"))
    p = panel.select(*KEYS).join(F.broadcast(calendar), "datetime").join(life, "instrument", "left").join(F.broadcast(place), "listed_date", "left")
    p = p.withColumns({"board": F.when(F.right("instrument", F.lit(1)) < "5", "main").otherwise("growth"), "age": C("pos") - C("__l"), "listed": C("datetime") >= C("listed_date"), "delisted": F.coalesce(C("datetime") > C("delisted_date"), F.lit(False))})
    r = rules.select(F.col("board").alias("__b"), "start", "end", "rule_id")
    hit = (C("board") == C("__b")) & (C("datetime") >= C("start")) & (C("end").isNull() | (C("datetime") <= C("end")))
    out = p.join(r, hit, "left").groupBy(*KEYS, "board", "listed", "delisted", "age").agg(F.count("rule_id").alias("n"), F.max("rule_id").alias("rule_id"))
    return out.withColumn("rule_id", F.when(C("n") == 1, C("rule_id"))).drop("n")


def participation_volume(panel: DataFrame, n: int, share: float) -> DataFrame:
    """Keys and the volume that may be traded: a share of the mean of the n rows before."""
    return panel.select(*KEYS, (ts.prior_mean(C("volume"), n) * share).alias("tradable_volume"))


def eligibility(keys: DataFrame, facts: DataFrame, *, least_age: int, least_amount: float) -> DataFrame:
    """Keys with entry, reasons and action from dated facts (instrument, field, visible, value): the latest fact of each field that
    was visible by the date counts.  A missing fact excludes entry; a delisted instrument is sold, a suspended one held."""
    known = facts.where("instrument is not null and visible is not null").select("instrument", C("visible").alias("datetime"), "field", "value")
    both = keys.select(*KEYS, F.lit(None).cast("string").alias("field"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("__key")).union(known.select("instrument", "datetime", "field", C("value").cast("double"), F.lit(0)).select("datetime", "instrument", "field", "value", "0"))
    # one walk along an instrument's facts and dates; of equal dates the facts come first, the largest value last
    w = Window.partitionBy("instrument").orderBy("datetime", "__key", "value").rowsBetween(Window.unboundedPreceding, 0)
    latest = {f: F.last(F.when(C("field") == f, F.struct("value")), ignorenulls=True).over(w)["value"] for f in ("age", "amount", "delisted", "suspended")}
    out = both.withColumns(latest).where("__key = 1")
    failed = [(C("age").isNull(), "age_unknown"), (C("age") < least_age, "too_young"), (C("amount").isNull(), "amount_unknown"), (C("amount") < least_amount, "illiquid"), (C("delisted") == 1, "delisted"), (C("suspended") == 1, "suspended")]
    why = F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in failed))), "|")
    action = F.when(C("delisted") == 1, "sell").when(C("suspended") == 1, "hold").when(C("amount") < least_amount, "reduce").otherwise("keep")
    return out.select(*KEYS, (why == "").alias("entry"), why.alias("reasons"), action.alias("action"))


def session_records(panel: DataFrame, limit: float, quotes: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Keys with suspended, own bounds from the previous close rounded to the tick, and whether quoted bounds agree."""
    p = panel.withColumn("__before", ts.ref(C("close"), 1))
    low, high = tick_bounds(C("__before"), limit)
    p = p.withColumns({"low_bound": low.cast("double"), "high_bound": high.cast("double"), "suspended": F.coalesce(C("volume") == 0, F.lit(True))}).join(quotes, KEYS, "left")
    agree = (F.abs(C("quoted_low") - C("low_bound")) <= tolerance) & (F.abs(C("quoted_high") - C("high_bound")) <= tolerance)
    state = F.when(C("__before").isNull(), "no_reference").when(C("quoted_low").isNull(), "no_quote").when(agree, "agreed").otherwise("mismatch")
    return p.select(*KEYS, "suspended", "low_bound", "high_bound", state.alias("limit_state"))


def quote_status(source: DataFrame, local: DataFrame, tolerance: float) -> DataFrame:
    """Keys and status of a session in two sources: agreed, source_only, local_only, suspended (no volume in either) or conflict."""
    s, l_ = source.select(*KEYS, C("close").alias("__sc"), C("volume").alias("__sv")), local.select(*KEYS, C("close").alias("__lc"), C("volume").alias("__lv"))
    near = F.abs(C("__sc") - C("__lc")) <= tolerance * F.abs("__sc")
    status = F.when(C("__lc").isNull(), "source_only").when(C("__sc").isNull(), "local_only").when((C("__sv") == 0) & (C("__lv") == 0), "suspended").when(near, "agreed").otherwise("conflict")
    return s.join(l_, KEYS, "full_outer").select(*KEYS, status.alias("status"))


def status_segments(status: DataFrame, calendar: DataFrame) -> DataFrame:
    """(instrument, status, start, end, sessions): unbroken runs of one status on the calendar."""
    p = status.join(F.broadcast(calendar), "datetime").withColumn("__g", C("pos") - F.row_number().over(Window.partitionBy("instrument", "status").orderBy("pos")))
    return p.groupBy("instrument", "status", "__g").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"), F.count("*").alias("sessions")).drop("__g")


def static_universe(panel: DataFrame, start: str, end: str, least_days: int, top: int) -> DataFrame:
    """(instrument, mean_amount, days, rank): the most liquid instruments of one window, ties by id."""
    w = panel.where((C("datetime") >= F.lit(start).cast("date")) & (C("datetime") <= F.lit(end).cast("date")))
    s = w.groupBy("instrument").agg(F.avg("amount").alias("mean_amount"), F.count("amount").alias("days")).where(C("days") >= least_days)
    # the first ``top`` rows, without a window over all
    best = s.orderBy(F.desc("mean_amount"), "instrument").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_amount"), "instrument")))


def universe_summary(intervals: DataFrame, prefix: int) -> DataFrame:
    """(prefix, instruments, spans, first_date, last_date) of an interval table."""
    return intervals.groupBy(F.substring("instrument", 1, prefix).alias("prefix")).agg(F.count_distinct("instrument").alias("instruments"), F.count("*").alias("spans"), F.min("start").alias("first_date"), F.max("end").alias("last_date"))


def adjustment_changes(panel: DataFrame, most: float) -> DataFrame:
    """(instrument, rows, changes, breaks): how often an adjustment factor changes, and by more than ``most``."""
    step = F.abs(ratio(C("factor"), ts.ref(C("factor"), 1)) - 1)
    return panel.withColumn("__s", step).groupBy("instrument").agg(F.count("*").alias("rows"), F.count_if(C("__s") > 1e-9).alias("changes"), F.count_if(C("__s") > most).alias("breaks"))


def active_sets(left: DataFrame, right: DataFrame, calendar: DataFrame) -> DataFrame:
    """(datetime, both, left_only, right_only): instruments active by two interval tables on each date of the calendar."""
    from tessera.operators.joins import key_grid

    a, b = (key_grid(t, calendar).withColumn(n, F.lit(1)) for t, n in ((left, "__a"), (right, "__b")))
    return a.join(b, KEYS, "full_outer").groupBy("datetime").agg(F.count(C("__a") + C("__b")).alias("both"), F.count_if(C("__b").isNull()).alias("left_only"), F.count_if(C("__a").isNull()).alias("right_only"))


def membership_issues(members: DataFrame, life: DataFrame) -> DataFrame:
    """(instrument, start, end, issue): membership without a life, outside it, or overlapping the span before."""
    before = F.max("end").over(Window.partitionBy("instrument").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    m = members.withColumn("__before", before).join(life.groupBy("instrument").agg(F.min("start").alias("__s"), F.max("end").alias("__e")), "instrument", "left")
    found = F.array_compact(F.array(F.when(C("__s").isNull(), F.lit("no_life")), F.when((C("start") < C("__s")) | (C("end") > C("__e")), F.lit("outside_life")), F.when(C("start") <= C("__before"), F.lit("overlap"))))
    return m.select("instrument", "start", "end", F.explode(found).alias("issue"))


def segment_issues(segments: DataFrame) -> DataFrame:
    """(partition_id, segment_id, issue) of partition segments (partition_id, segment_id, start, end): reversed or overlapping."""
    before = F.max("end").over(Window.partitionBy("partition_id").orderBy("start", "segment_id").rowsBetween(Window.unboundedPreceding, -1))
    found = F.array_compact(F.array(F.when(C("end") < C("start"), F.lit("reversed")), F.when(C("start") <= C("__before"), F.lit("overlap"))))
    return segments.withColumn("__before", before).select("partition_id", "segment_id", F.explode(found).alias("issue"))


def backfill_audit(frame: DataFrame, fields: list[str]) -> DataFrame:
    """(field, rows, present, constant): fields with one value for each instrument look filled back from today."""
    long = frame.unpivot(KEYS, [C(f).cast("string").alias(f) for f in fields], "field", "value")
    per = long.groupBy("field", "instrument").agg(F.count("*").alias("n"), F.count("value").alias("p"), F.count_distinct("value").alias("d"))
    return per.groupBy("field").agg(F.sum("n").alias("rows"), F.sum("p").alias("present"), F.count_if((C("d") == 1) & (C("p") > 1)).alias("constant"))


def regime_coverage(daily: DataFrame, value: str, windows: DataFrame) -> DataFrame:
    """(window, low, middle, high): how many dates of each window lie in the terciles of the whole series."""
    q = daily.agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    d = daily.crossJoin(F.broadcast(q)).join(F.broadcast(windows), (C("datetime") >= C("start")) & (C("datetime") <= C("end")))
    v = C(value)
    return d.groupBy("window").agg(F.count_if(v <= C("q")[0]).alias("low"), F.count_if((v > C("q")[0]) & (v <= C("q")[1])).alias("middle"), F.count_if(v > C("q")[1]).alias("high"))
