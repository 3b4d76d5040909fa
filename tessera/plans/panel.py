"""Queries over sources, keys, point-in-time joins, calendars, cross-sections and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import guard, ts, xs
from tessera.operators import joins, quality
from tessera.plans.base import DAILY, query
from tessera.sources import panel as src
from tessera.sources.panel import daily_panel, monthly_panel

W = "PARTITION BY instrument ORDER BY datetime"
D = "PARTITION BY datetime"


@query("SELECT * FROM panel", floats="open high low close volume amount vwap")
def panel_monthly(spark, sf_dir):
    return monthly_panel(spark, sf_dir)


@query("SELECT datetime, instrument, close, amount FROM panel WHERE datetime BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND instrument < 'S000050'", floats="close amount")
def panel_scan(spark, sf_dir):
    return monthly_panel(spark, sf_dir).where((F.col("datetime") >= F.lit("1997-01-01").cast("date")) & (F.col("datetime") <= F.lit("1998-12-31").cast("date")) & (F.col("instrument") < "S000050")).select("datetime", "instrument", "close", "amount")


@query("SELECT datetime, instrument, 'close' AS factor, close AS value FROM panel UNION ALL SELECT datetime, instrument, 'volume', volume FROM panel", floats="value")
def panel_to_long(spark, sf_dir):
    return src.to_long(monthly_panel(spark, sf_dir), ["close", "volume"])


@query("SELECT datetime, max(close) FILTER (WHERE instrument = 'S000001') AS S000001, max(close) FILTER (WHERE instrument = 'S000002') AS S000002 FROM panel GROUP BY datetime", floats="S000001 S000002")
def panel_to_wide(spark, sf_dir):
    return src.to_wide(monthly_panel(spark, sf_dir).where("instrument is not null"), ["S000001", "S000002"], "close")


@query("SELECT datetime, instrument, sha256(instrument || '|' || CAST(datetime AS VARCHAR)) AS source_row_id FROM panel")
def panel_row_ids(spark, sf_dir):
    return monthly_panel(spark, sf_dir).select("datetime", "instrument", src.row_id("instrument", "datetime").alias("source_row_id"))


@query(f"SELECT datetime, instrument, close AS price, volume * 100 AS volume, amount * 1000 AS amount, lag(close) OVER ({W}) AS previous_close FROM panel", floats="price volume amount previous_close")
def panel_normalised_bars(spark, sf_dir):
    names = {c: c for c in ("datetime", "instrument", "close", "volume", "amount")}
    out = src.normalise_bars(monthly_panel(spark, sf_dir), "one", names, 100.0, 1000.0)
    return out.select("datetime", "instrument", F.col("close").alias("price"), "volume", "amount", "previous_close")


@query("""
u AS (SELECT year(datetime) AS y, instrument, datetime, 'close' AS field, close AS v FROM panel UNION ALL SELECT year(datetime), instrument, datetime, 'vwap', vwap FROM panel)
SELECT field, CAST(y AS INTEGER) AS year, count(v) AS present, count(DISTINCT instrument) AS instruments, min(datetime) AS first_date, max(datetime) AS last_date FROM u GROUP BY field, y""")
def panel_field_coverage(spark, sf_dir):
    long = src.to_long(monthly_panel(spark, sf_dir), ["close", "vwap"], "field", "v")
    return long.groupBy("field", F.year("datetime").alias("year")).agg(F.count("v").alias("present"), F.count_distinct("instrument").alias("instruments"), F.min("datetime").alias("first_date"), F.max("datetime").alias("last_date"))


@query("""
k AS (SELECT date_trunc('day', ts) AS d, user_id, count(*) AS n FROM events GROUP BY 1, 2)
SELECT CAST(d AS DATE) AS datetime, 'U' || CAST(user_id AS VARCHAR) AS instrument FROM k WHERE n = 1""", base="", floats="")
def keys_normalised(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").alias("datetime"), F.concat(F.lit(" u"), F.col("user_id").cast("string")).alias("instrument"))
    return src.normalise_keys(e)


@query("""
c AS (SELECT DISTINCT lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS code FROM customer)
SELECT code, CASE WHEN code[1] IN ('6', '9') THEN 'SH' WHEN code[1] IN ('4', '8') THEN 'BJ' ELSE 'SZ' END || code AS instrument FROM c""", base="")
def instrument_codes(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lpad((F.col("c_custkey") * 7919 % 1000000).cast("string"), 6, "0").alias("code")).distinct()
    return c.select("code", src.instrument_code(F.concat(F.lit(" "), "code")).alias("instrument"))


@query("SELECT datetime, instrument, ln(close) AS value FROM panel WHERE close > 0", floats="value")
def finite_rows(spark, sf_dir):
    return guard.finite_rows(monthly_panel(spark, sf_dir).select("datetime", "instrument", guard.positive_log(F.col("close")).alias("value")), ["value"])


@query("SELECT substr(instrument, 1, 6) AS prefix, count(*) AS n, count(DISTINCT instrument) AS instruments FROM panel WHERE substr(instrument, 1, 6) IN ('S00000', 'S00001') GROUP BY 1")
def prefix_universe(spark, sf_dir):
    p = monthly_panel(spark, sf_dir).withColumn("prefix", F.substring("instrument", 1, 6)).where(F.col("prefix").isin("S00000", "S00001"))
    return p.groupBy("prefix").agg(F.count("*").alias("n"), F.count_distinct("instrument").alias("instruments"))


@query("""
w AS (SELECT DISTINCT CAST(round(i * (m - 1) / 9.0) AS BIGINT) + 1 AS pos FROM range(10) t(i), (SELECT max(pos) AS m FROM cal))
SELECT datetime, pos FROM cal WHERE pos IN (SELECT pos FROM w)""")
def dates_evenly_spaced(spark, sf_dir):
    c = joins.calendar_of(monthly_panel(spark, sf_dir))
    m = c.agg(F.max("pos").alias("m"))
    wanted = m.select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"), "m").select((F.round(F.col("i") * (F.col("m") - 1) / 9.0).cast("long") + 1).alias("pos")).distinct()
    return c.join(F.broadcast(wanted), "pos", "left_semi").select("datetime", "pos")


@query("SELECT datetime, instrument, CAST(year(datetime) AS INTEGER) AS year, CASE WHEN year(datetime) < 1998 THEN 'early' ELSE 'late' END AS era FROM panel")
def period_labels(spark, sf_dir):
    return monthly_panel(spark, sf_dir).select("datetime", "instrument", F.year("datetime").alias("year"), F.when(F.year("datetime") < 1998, "early").otherwise("late").alias("era"))


def _life(p):
    return p.groupBy("instrument").agg(F.add_months(F.min("datetime"), 6).alias("start"), F.add_months(F.max("datetime"), -6).alias("end"))


LIFE = "life AS (SELECT instrument, CAST(min(datetime) + INTERVAL 6 MONTH AS DATE) AS s, CAST(max(datetime) - INTERVAL 6 MONTH AS DATE) AS e FROM panel GROUP BY 1)"


@query(f"""
{LIFE}
SELECT p.datetime, p.instrument, coalesce(p.datetime BETWEEN s AND e, false) AS member, CASE WHEN p.datetime BETWEEN s AND e THEN close END AS masked FROM panel p LEFT JOIN life USING (instrument)""", floats="masked")
def join_interval_flag(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    out = joins.flagged(p, _life(p), "member")
    return out.select("datetime", "instrument", "member", F.when(F.col("member"), F.col("close")).alias("masked"))


@query(f"""
{LIFE}
SELECT c.datetime, l.instrument FROM cal c JOIN life l ON c.datetime BETWEEN s AND e""")
def join_key_grid(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    return joins.key_grid(_life(p), joins.calendar_of(p))


@query(f"""
{LIFE}, two AS (SELECT instrument, CAST(min(datetime) AS DATE) AS s2, CAST(min(datetime) + INTERVAL 24 MONTH AS DATE) AS e2 FROM panel GROUP BY 1 UNION ALL SELECT instrument, CAST(min(datetime) + INTERVAL 36 MONTH AS DATE), CAST(max(datetime) AS DATE) FROM panel GROUP BY 1),
hit AS (SELECT l.instrument, s, e, greatest(s, s2) AS start_date, least(e, e2) AS end_date FROM life l JOIN two t ON l.instrument = t.instrument AND s <= e2 AND s2 <= e)
SELECT instrument, start_date, end_date, CASE WHEN count(*) OVER (PARTITION BY instrument, s, e) > 1 THEN 'split' WHEN start_date = s AND end_date = e THEN 'kept' ELSE 'truncated' END AS fate FROM hit""")
def join_interval_intersection(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    lo, hi = F.min("datetime"), F.max("datetime")
    two = p.groupBy("instrument").agg(F.array(F.struct(lo.alias("start"), F.add_months(lo, 24).alias("end")), F.struct(F.add_months(lo, 36).alias("start"), hi.alias("end"))).alias("x")).select("instrument", F.explode("x").alias("x")).select("instrument", "x.*")
    return joins.intersected(_life(p), two).select("instrument", F.col("start").alias("start_date"), F.col("end").alias("end_date"), "fate")


@query(f"""
{LIFE}
SELECT c.datetime, count(l.instrument) AS members FROM cal c LEFT JOIN life l ON c.datetime BETWEEN s AND e GROUP BY 1""")
def join_member_counts(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    return joins.member_counts(_life(p), joins.calendar_of(p))


STATEMENTS = "st AS (SELECT DISTINCT ON (o_custkey, CAST(o_orderdate AS DATE)) o_custkey AS cust, CAST(o_orderdate AS DATE) AS d, o_totalprice AS price, o_orderkey AS ok FROM orders ORDER BY o_custkey, CAST(o_orderdate AS DATE), o_orderkey DESC)"


@query(f"""
{STATEMENTS}, k AS (SELECT DISTINCT o_custkey AS cust, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS datetime FROM orders)
SELECT k.datetime, 'C' || CAST(k.cust AS VARCHAR) AS instrument, st.d AS event_date, st.price, st.ok AS orderkey FROM k ASOF JOIN st ON k.cust = st.cust AND k.datetime >= st.d""", base="", floats="price")
def join_as_of(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("instrument")
    events = o.select(name, F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    keys = o.select(name, F.add_months(F.trunc("o_orderdate", "month"), 1).alias("datetime")).distinct()
    return joins.as_of(keys, events, "d", ["orderkey", "price"]).select("datetime", "instrument", "event_date", "price", "orderkey")


@query("""
SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS period, o_orderkey AS orderkey, o_totalprice AS price FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1997-06-30'
QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1""", base="", floats="price")
def join_latest_revision(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("period"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    return joins.latest_revision(o, ["cust", "period"], "d", F.lit("1997-06-30").cast("date"), [F.desc("orderkey")]).select("cust", "period", "orderkey", "price")


FACTS = "f AS (SELECT instrument, year(datetime) AS code, CAST(min(datetime) AS DATE) AS s, CAST(max(datetime) + INTERVAL 1 MONTH AS DATE) AS e FROM panel GROUP BY 1, 2)"


@query(f"""
{FACTS}, m AS (SELECT p.datetime, p.instrument, count(f.code) AS matches, any_value(f.code) AS code FROM panel p LEFT JOIN f ON p.instrument = f.instrument AND p.datetime BETWEEN f.s AND f.e GROUP BY 1, 2)
SELECT datetime, instrument, matches, CASE WHEN matches = 1 THEN CAST(code AS INTEGER) END AS code FROM m""")
def join_effective(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    facts = p.groupBy("instrument", F.year("datetime").alias("code")).agg(F.min("datetime").alias("start"), F.add_months(F.max("datetime"), 1).alias("end"))
    return joins.effective(p.select("datetime", "instrument"), facts, ["code"]).select("datetime", "instrument", F.col("matches").cast("long").alias("matches"), "code")


def _second(spark, sf_dir):
    """A second provider: fewer instruments on odd months, prices scaled on some."""
    p = monthly_panel(spark, sf_dir)
    odd, some = F.month("datetime") % 5 == 0, F.substring("instrument", -1, 1) == "7"
    return p.where(~(odd & (F.substring("instrument", -1, 1) == "3"))).withColumn("close", F.when(some, F.col("close") * 1.0002).otherwise(F.col("close")))


SECOND = "two AS (SELECT datetime, instrument, CASE WHEN instrument[-1] = '7' THEN close * 1.0002 ELSE close END AS c2 FROM panel WHERE NOT (month(datetime) % 5 = 0 AND instrument[-1] = '3'))"


@query(f"""
{SECOND}
SELECT p.datetime, p.instrument, CASE WHEN c2 IS NULL THEN 'left_only' ELSE 'both' END AS side, CASE WHEN c2 IS NOT NULL THEN abs(close - c2) / close <= 0.0001 END AS matches FROM panel p LEFT JOIN two USING (datetime, instrument)""")
def join_source_alignment(spark, sf_dir):
    return joins.aligned(monthly_panel(spark, sf_dir), _second(spark, sf_dir), "close", 1e-4).select("datetime", "instrument", "side", "matches")


@query(f"""
{SECOND}
SELECT 'close' AS factor, count(*) AS rows, count(*) FILTER (WHERE close = c2) AS exact, count(*) FILTER (WHERE abs(close - c2) <= 0.000001 + 0.0001 * abs(c2)) AS near, max(abs(close - c2)) AS largest FROM panel JOIN two USING (datetime, instrument)""", floats="largest")
def join_value_comparison(spark, sf_dir):
    return joins.compared(monthly_panel(spark, sf_dir), _second(spark, sf_dir), ["close"], 1e-6, 1e-4)


@query("SELECT datetime, pos, lead(datetime, 1) OVER (ORDER BY datetime) AS entry, lead(datetime, 3) OVER (ORDER BY datetime) AS exit, lead(datetime, 3) OVER (ORDER BY datetime) IS NULL AS terminal FROM cal")
def calendar_label_dates(spark, sf_dir):
    return joins.label_dates(joins.calendar_of(monthly_panel(spark, sf_dir)), 1, 2)


LABEL = """dm AS (SELECT datetime, lead(datetime, 1) OVER (ORDER BY datetime) AS entry, lead(datetime, 2) OVER (ORDER BY datetime) AS exit FROM cal),
lab AS (SELECT p.datetime, p.instrument, o.close / i.close - 1 AS label FROM panel p JOIN dm ON p.datetime = dm.datetime LEFT JOIN panel i ON i.instrument = p.instrument AND i.datetime = dm.entry LEFT JOIN panel o ON o.instrument = p.instrument AND o.datetime = dm.exit)"""


@query(f"""
{LABEL}
SELECT datetime, instrument, label FROM lab""", floats="label")
def label_exact_calendar(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    return joins.exact_label(p, joins.label_dates(joins.calendar_of(p), 1, 1)).select("datetime", "instrument", "label")


@query(f"SELECT datetime, instrument, lead(close, 3) OVER ({W}) / lead(close, 1) OVER ({W}) - 1 AS label_2 FROM panel", floats="label_2")
def label_row_shift(spark, sf_dir):
    return monthly_panel(spark, sf_dir).select("datetime", "instrument", joins.shifted_label(2).alias("label_2"))


@query("SELECT CAST(date_trunc('month', datetime) AS DATE) AS month, max(datetime) AS datetime FROM panel GROUP BY 1", base=DAILY)
def calendar_month_ends(spark, sf_dir):
    return joins.month_ends(joins.calendar_of(daily_panel(spark, sf_dir)))


@query("""
dm AS (SELECT datetime, lead(datetime, 2) OVER (ORDER BY datetime) AS exit FROM cal),
b AS (SELECT row_number() OVER (ORDER BY ts) AS split_id, CAST(ts AS DATE) AS ts, CAST(ts + INTERVAL 12 MONTH AS DATE) AS te, CAST(ts - INTERVAL 12 MONTH AS DATE) AS vs FROM (SELECT unnest(generate_series(TIMESTAMP '1998-01-01', (SELECT max(datetime)::TIMESTAMP FROM cal), INTERVAL 12 MONTH)) AS ts)),
d AS (SELECT split_id, datetime, exit, ts, vs, CASE WHEN datetime >= ts THEN 'test' WHEN datetime >= vs THEN 'validation' ELSE 'train' END AS fold FROM dm, b WHERE datetime < te),
s AS (SELECT *, row_number() OVER (PARTITION BY split_id, fold ORDER BY datetime DESC) AS t FROM d WHERE fold = 'test' OR exit < CASE WHEN fold = 'train' THEN vs ELSE ts END)
SELECT CAST(split_id AS INTEGER) AS split_id, datetime, fold FROM s WHERE fold = 'test' OR t > 1""")
def splits_walk_forward(spark, sf_dir):
    return joins.walk_forward(joins.label_dates(joins.calendar_of(monthly_panel(spark, sf_dir)), 1, 1), "1998-01-01", 12, 12, 1)


_RANK = f"(rank() OVER ({D} ORDER BY close) + (count(*) OVER ({D}, close) - 1) / 2.0)"


@query(f"""
SELECT datetime, instrument, {_RANK} AS average_rank, {_RANK} / count(*) OVER ({D}) AS share, ({_RANK} / count(*) OVER ({D}) - 0.5) * 3.46 AS normal, 2 * ({_RANK} - 1) / (count(*) OVER ({D}) - 1) - 1 AS signed,
  ({_RANK} - 0.5) / count(*) OVER ({D}) - 0.5 AS mid, CAST(ceil({_RANK} / count(*) OVER ({D}) * 5) AS INTEGER) AS fifth, 1.0 / count(*) OVER ({D}) AS weight FROM panel""", floats="average_rank share normal signed mid weight")
def xs_ranks(spark, sf_dir):
    c = F.col("close")
    return monthly_panel(spark, sf_dir).select("datetime", "instrument", xs.average_rank(c).alias("average_rank"), xs.percent_rank(c).alias("share"), xs.rank_normal(c).alias("normal"), xs.rank_signed(c).alias("signed"), xs.mid_rank(c, 5)[0].alias("mid"), xs.rank_bucket(c, 5).alias("fifth"), xs.equal_weight().alias("weight"))


@query(f"""
m AS (SELECT *, median(close) OVER ({D}) AS md FROM panel), s AS (SELECT *, median(abs(close - md)) OVER ({D}) AS mad FROM m)
SELECT datetime, instrument, CASE WHEN mad > 0 THEN greatest(least(close, md + 1.5 * mad), md - 1.5 * mad) ELSE close END AS winsorised, CASE WHEN mad > 0 THEN greatest(least((close - md) / (mad * 1.4826), 3), -3) END AS robust,
  CASE WHEN stddev_samp(close) OVER ({D}) > 0 THEN greatest(least((close - avg(close) OVER ({D})) / stddev_samp(close) OVER ({D}), 3), -3) END AS plain FROM s""", floats="winsorised robust plain")
def xs_scores(spark, sf_dir):
    p = xs.winsorised(monthly_panel(spark, sf_dir), "close", "winsorised", 1.5)
    return xs.zscore(xs.zscore(p, "close", "robust"), "close", "plain", robust=False).select("datetime", "instrument", "winsorised", "robust", "plain")


@query(f"""
q AS (SELECT *, quantile_cont(close, [0.2, 0.4, 0.6, 0.8]) OVER ({D}) AS e, count(*) OVER ({D}) AS n FROM panel)
SELECT datetime, instrument, CASE WHEN n >= 5 THEN 1 + len(list_filter(e, lambda x: x < close)) END AS bucket FROM q""")
def xs_buckets(spark, sf_dir):
    return xs.bucket(monthly_panel(spark, sf_dir), "close", "bucket", 5).select("datetime", "instrument", F.col("bucket").cast("long").alias("bucket"))


@query(f"""
SELECT datetime, instrument, close - regr_intercept(close, volume) OVER ({D}) - regr_slope(close, volume) OVER ({D}) * volume AS residual FROM panel""", floats="residual")
def xs_residual(spark, sf_dir):
    return monthly_panel(spark, sf_dir).select("datetime", "instrument", xs.residual(F.col("close"), F.col("volume"), 5).alias("residual"))


@query(f"""
c AS (SELECT *, covar_pop(close, volume) OVER ({D}) AS yx, covar_pop(close, amount) OVER ({D}) AS yz, covar_pop(volume, amount) OVER ({D}) AS xz, var_pop(volume) OVER ({D}) AS xx, var_pop(amount) OVER ({D}) AS zz,
  close - avg(close) OVER ({D}) AS dy, volume - avg(volume) OVER ({D}) AS dx, amount - avg(amount) OVER ({D}) AS dz FROM panel)
SELECT datetime, instrument, dy - (yx * zz - yz * xz) / (xx * zz - xz * xz) * dx - (yz * xx - yx * xz) / (xx * zz - xz * xz) * dz AS residual FROM c""", floats="residual")
def xs_residual_two(spark, sf_dir):
    return monthly_panel(spark, sf_dir).select("datetime", "instrument", xs.residual_two(F.col("close"), F.col("volume"), F.col("amount"), 5).alias("residual"))


@query("SELECT field, count(*) AS rows, count(*) FILTER (WHERE v IS NULL) AS missing, count(*) FILTER (WHERE v IS NULL) / count(*) AS rate FROM (SELECT 'close' AS field, lag(close) OVER (PARTITION BY instrument ORDER BY datetime) AS v FROM panel UNION ALL SELECT 'volume', volume FROM panel) GROUP BY field", floats="rate")
def quality_missing_rates(spark, sf_dir):
    p = monthly_panel(spark, sf_dir).withColumn("close", ts.ref(F.col("close"), 1))
    return quality.missing_rates(p, ["close", "volume"])


ISSUES = f"""r AS (SELECT *, abs(close / nullif(lag(close) OVER ({W}), 0) - 1) AS ret FROM panel),
issues AS (SELECT datetime, instrument, 'price' AS category, 'high_lt_low' AS rule FROM r WHERE high < low UNION ALL SELECT datetime, instrument, 'return', 'abs_daily_return_too_large' FROM r WHERE ret > 0.3
  UNION ALL SELECT datetime, instrument, 'return', 'close_jump_too_large' FROM r WHERE ret > 0.3 UNION ALL SELECT datetime, instrument, 'return', 'suspected_adjustment_error' FROM r WHERE ret > 0.5)"""


@query(f"{ISSUES}\nSELECT * FROM issues")
def quality_row_issues(spark, sf_dir):
    return quality.row_issues(monthly_panel(spark, sf_dir))


@query(f"{ISSUES}\nSELECT category, rule, count(*) AS issues, count(DISTINCT instrument) AS instruments, count(DISTINCT datetime) AS dates FROM issues GROUP BY 1, 2")
def quality_rule_counts(spark, sf_dir):
    return quality.rule_counts(quality.row_issues(monthly_panel(spark, sf_dir)))


@query("""
l AS (SELECT instrument, min(datetime) AS s, max(datetime) AS e, count(close) AS valid FROM panel GROUP BY 1)
SELECT l.instrument, count(*) AS expected, valid, count(*) - valid AS missing, 100.0 * valid / count(*) AS score FROM l JOIN cal ON cal.datetime BETWEEN s AND e GROUP BY l.instrument, valid""", base=DAILY, floats="score")
def quality_availability(spark, sf_dir):
    p = daily_panel(spark, sf_dir)
    return quality.availability(p, joins.calendar_of(p)).drop("zero_volume")


@query(f"""
{LIFE}, c AS (SELECT cal.datetime, count(l.instrument) AS expected FROM cal LEFT JOIN life l ON cal.datetime BETWEEN s AND e GROUP BY 1), h AS (SELECT datetime, count(DISTINCT instrument) AS present FROM panel GROUP BY 1)
SELECT datetime, expected, present, present / nullif(expected, 0) AS coverage FROM c JOIN h USING (datetime)""", floats="coverage")
def quality_date_coverage(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    return quality.date_coverage(p, joins.member_counts(_life(p), joins.calendar_of(p)))


@query("SELECT 'close' AS factor, count(*) AS rows, CAST(1 AS DOUBLE) AS finite_rate, quantile_cont(close, 0.1) AS p10, median(close) AS median, quantile_cont(close, 0.9) AS p90 FROM panel", floats="finite_rate p10 median p90")
def quality_profile(spark, sf_dir):
    return quality.profile(monthly_panel(spark, sf_dir), ["close"])


LIMITS = f"""lim AS (SELECT *, lag(close) OVER ({W}) AS pc, row_number() OVER ({W}) AS age, quantile_cont(amount, [0.2, 0.4, 0.6, 0.8]) OVER ({D}) AS edges, count(*) OVER ({D}) AS n FROM panel),
flag AS (SELECT *, coalesce(close >= pc * 1.098 AND high >= pc * 1.098, false) AS up, coalesce(close <= pc * 0.902 AND low <= pc * 0.902, false) AS down,
  abs(open - high) <= 1e-4 AND abs(high - low) <= 1e-4 AND abs(low - close) <= 1e-4 AS flat, CASE WHEN n >= 5 THEN 1 + len(list_filter(edges, lambda x: x < amount)) END AS bucket FROM lim)"""


@query(f"""
{LIMITS}
SELECT datetime, instrument, up AS is_limit_up, down AS is_limit_down, flat AND (up OR down) AS one_price, CASE WHEN pc IS NULL THEN 'unknown' WHEN down THEN 'limit_down' WHEN up THEN 'limit_up' ELSE 'normal' END AS limit_status FROM flag""")
def tradability_limits(spark, sf_dir):
    return quality.limit_flags(monthly_panel(spark, sf_dir), F.lit(0.1)).select("datetime", "instrument", "is_limit_up", "is_limit_down", "one_price", "limit_status")


@query(f"""
{LIMITS}
SELECT datetime, instrument, NOT (up OR coalesce(bucket <= 1, false) OR age <= 3 OR pc IS NULL OR bucket IS NULL) AS can_buy, NOT (down OR pc IS NULL OR bucket IS NULL) AS can_sell,
  CAST(round(greatest(100.0 - CASE WHEN up OR down THEN 50 ELSE 0 END - CASE WHEN flat AND (up OR down) THEN 30 ELSE 0 END - CASE WHEN bucket <= 1 THEN 20 ELSE 0 END - CASE WHEN age <= 3 THEN 15 ELSE 0 END - CASE WHEN pc IS NULL OR bucket IS NULL THEN 40 ELSE 0 END, 0), 2) AS DOUBLE) AS tradability_score,
  array_to_string(list_filter([CASE WHEN up THEN 'limit_up' END, CASE WHEN down THEN 'limit_down' END, CASE WHEN flat AND (up OR down) THEN 'one_price_limit' END, CASE WHEN bucket <= 1 THEN 'low_liquidity' END, CASE WHEN age <= 3 THEN 'new_listing' END, CASE WHEN pc IS NULL THEN 'unknown_limit' END, CASE WHEN bucket IS NULL THEN 'unknown_liquidity' END], lambda x: x IS NOT NULL), '|') AS disabled_reason FROM flag""", floats="tradability_score")
def tradability_labels(spark, sf_dir):
    return quality.tradability(monthly_panel(spark, sf_dir), F.lit(0.1)).select("datetime", "instrument", "can_buy", "can_sell", "tradability_score", "disabled_reason")


@query(f"""
{LIMITS}, r AS (SELECT instrument, unnest([CASE WHEN up THEN 'limit_up' END, CASE WHEN down THEN 'limit_down' END, CASE WHEN flat AND (up OR down) THEN 'one_price_limit' END, CASE WHEN bucket <= 1 THEN 'low_liquidity' END, CASE WHEN age <= 3 THEN 'new_listing' END, CASE WHEN pc IS NULL THEN 'unknown_limit' END, CASE WHEN bucket IS NULL THEN 'unknown_liquidity' END]) AS reason FROM flag)
SELECT reason, count(*) AS rows, count(DISTINCT instrument) AS instruments FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def tradability_reasons(spark, sf_dir):
    return quality.reason_counts(quality.tradability(monthly_panel(spark, sf_dir), F.lit(0.1)))


UNIVERSE = """sel AS (SELECT datetime AS sd, pos AS upto FROM cal WHERE pos % 6 = 0),
stats AS (SELECT sd, p.instrument, median(amount) AS med, avg(amount) AS m, count(amount) AS valid FROM sel JOIN cal c ON c.pos > upto - 6 AND c.pos <= upto JOIN panel p ON p.datetime = c.datetime GROUP BY 1, 2 HAVING count(amount) >= 4),
snap AS (SELECT sd, instrument, med, valid, row_number() OVER (PARTITION BY sd ORDER BY med DESC, m DESC, instrument) AS rank FROM stats QUALIFY rank <= 20)"""


def _universe(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    cal = joins.calendar_of(p)
    return quality.universe(p, cal, cal.where("pos % 6 = 0"), lookback=6, least=4, top=20), cal


@query(f"{UNIVERSE}\nSELECT sd AS selection_date, instrument, med AS median_amount, valid AS valid_days, CAST(rank AS INTEGER) AS rank FROM snap", floats="median_amount")
def universe_point_in_time(spark, sf_dir):
    return _universe(spark, sf_dir)[0]


@query(f"""
{UNIVERSE}, d AS (SELECT sd, row_number() OVER (ORDER BY sd) AS n FROM (SELECT DISTINCT sd FROM snap)), h AS (SELECT n, instrument FROM snap JOIN d USING (sd)),
ch AS (SELECT coalesce(a.n, b.n + 1) AS n, coalesce(a.instrument, b.instrument) AS instrument, CASE WHEN a.n IS NULL THEN 'exit' ELSE 'enter' END AS change FROM h a FULL JOIN h b ON a.instrument = b.instrument AND a.n = b.n + 1 WHERE a.n IS NULL OR b.n IS NULL)
SELECT sd AS selection_date, instrument, change FROM ch JOIN d USING (n) WHERE n > 1""")
def universe_changes(spark, sf_dir):
    return quality.membership_changes(_universe(spark, sf_dir)[0])


@query(f"""
{UNIVERSE}, d AS (SELECT sd, n, eff, CAST(lead(eff) OVER (ORDER BY n) - INTERVAL 1 DAY AS DATE) AS til FROM (SELECT sd, row_number() OVER (ORDER BY sd) AS n FROM (SELECT DISTINCT sd FROM snap)) JOIN (SELECT datetime AS sd, lead(datetime) OVER (ORDER BY datetime) AS eff FROM cal) USING (sd)),
h AS (SELECT instrument, n, eff, til, n - row_number() OVER (PARTITION BY instrument ORDER BY n) AS i FROM snap JOIN d USING (sd))
SELECT instrument, min(eff) AS start_date, CASE WHEN count(til) = count(*) THEN max(til) ELSE NULL END AS end_date FROM h GROUP BY instrument, i""")
def universe_intervals(spark, sf_dir):
    snap, cal = _universe(spark, sf_dir)
    return quality.to_intervals(snap, cal).select("instrument", F.col("start").alias("start_date"), F.col("end").alias("end_date"))

