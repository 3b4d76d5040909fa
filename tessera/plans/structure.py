"""Queries over the structure of rankings: lags, bands, ages, pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import audits, evaluate, features, joins, structure
from tessera.plans.base import query
from tessera.plans.evaluation import IC, LONG, PAIRS, _ic, _long, _wide
from tessera.plans.panel import LIFE, _life
from tessera.sources.panel import monthly_panel


def _calendar(spark, sf_dir):
    return joins.calendar_of(monthly_panel(spark, sf_dir))


_RANKED = """r AS (SELECT datetime, instrument, pos, rank() OVER (PARTITION BY datetime ORDER BY kmid) + (count(*) OVER (PARTITION BY datetime, kmid) - 1) / 2.0 AS r FROM wide JOIN cal USING (datetime) WHERE kmid IS NOT NULL)"""
_BANDS = """o AS (SELECT datetime, instrument, pos, row_number() OVER (PARTITION BY datetime ORDER BY kmid DESC, instrument) AS place, count(*) OVER (PARTITION BY datetime) AS n FROM wide JOIN cal USING (datetime) WHERE kmid IS NOT NULL),
b AS (SELECT *, CASE WHEN place <= ceil(round(n * 0.1, 9)) THEN 'top' WHEN place <= ceil(round(n * 0.2, 9)) THEN 'next' WHEN place <= ceil(round(n * 0.5, 9)) THEN 'middle' ELSE 'rest' END AS band FROM o)"""


@query(f"""
{LONG}, w AS (SELECT *, rev_1 - avg(rev_1) OVER (PARTITION BY datetime) AS d FROM wide WHERE rev_1 IS NOT NULL AND label IS NOT NULL),
f AS (SELECT datetime, sum(d * label) / nullif(sum(abs(d)), 0) AS y, avg(label) AS x FROM w GROUP BY 1), g AS (SELECT regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta, regr_r2(y, x) AS r2, count(*) AS days FROM f WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT alpha, pow(1 + alpha, 12) - 1 AS annual_alpha, beta, r2, days FROM g""", floats="alpha annual_alpha beta r2")
def evaluate_factor_alpha_beta(spark, sf_dir):
    return structure.alpha_beta(evaluate.factor_returns(_wide(spark, sf_dir), "rev_1", "label"), 12)


@query(f"""
{LONG}, {_RANKED}, l AS (SELECT unnest([1, 5, 10]) AS lag)
SELECT a.datetime, CAST(lag AS INTEGER) AS lag, corr(a.r, b.r) AS autocorrelation, count(*) AS pairs FROM l JOIN r a ON true JOIN r b ON a.instrument = b.instrument AND a.pos = b.pos + lag GROUP BY 1, 2""", floats="autocorrelation")
def evaluate_lagged_autocorrelation(spark, sf_dir):
    return structure.lagged_autocorrelation(_wide(spark, sf_dir), "kmid", _calendar(spark, sf_dir), [1, 5, 10])


@query(f"""
{LONG}, o AS (SELECT *, quantile_cont(rev_1, [0.2, 0.4, 0.6, 0.8]) OVER (PARTITION BY datetime) AS edges FROM wide WHERE rev_1 IS NOT NULL),
top AS (SELECT datetime, instrument, pos FROM o JOIN cal USING (datetime) WHERE rev_1 > edges[4]), l AS (SELECT unnest([1, 5]) AS lag),
s AS (SELECT pos + lag AS pos, lag, count(*) AS earlier FROM top, l GROUP BY 1, 2),
n AS (SELECT a.datetime, a.pos, lag, count(*) AS size, count(*) FILTER (WHERE b.instrument IS NULL) AS entered, count(b.instrument) AS retained FROM l JOIN top a ON true LEFT JOIN top b ON a.instrument = b.instrument AND a.pos = b.pos + lag GROUP BY 1, 2, 3)
SELECT datetime, CAST(lag AS INTEGER) AS lag, size, entered, entered / size AS turnover, earlier, retained, 1 - retained / earlier AS overlap_turnover FROM n JOIN s USING (pos, lag)""", floats="turnover overlap_turnover")
def evaluate_quantile_turnover(spark, sf_dir):
    return structure.quantile_turnover(_wide(spark, sf_dir), "rev_1", 5, _calendar(spark, sf_dir), [1, 5])


@query(f"""
{LONG}, {_BANDS}, d AS (SELECT DISTINCT datetime, pos FROM b),
m AS (SELECT d.datetime, x.band AS origin, coalesce(y.band, 'absent') AS destination FROM b x JOIN d ON d.pos = x.pos + 1 LEFT JOIN b y ON y.instrument = x.instrument AND y.pos = x.pos + 1),
g AS (SELECT datetime, origin, destination, count(*) AS members FROM m GROUP BY 1, 2, 3)
SELECT *, members / sum(members) OVER (PARTITION BY datetime, origin) AS share FROM g""", floats="share")
def evaluate_band_migration(spark, sf_dir):
    return structure.migration(structure.banded(_wide(spark, sf_dir), "kmid", _calendar(spark, sf_dir)))


@query(f"""
{LONG}, {_BANDS}, t AS (SELECT datetime, instrument, pos, pos - row_number() OVER (PARTITION BY instrument ORDER BY pos) AS spell FROM b WHERE band IN ('top', 'next')),
a AS (SELECT *, min(pos) OVER (PARTITION BY instrument, spell) AS start FROM t)
SELECT datetime, count(*) AS members, avg(pos - start + 1) AS age_mean, median(pos - start + 1) AS age_median, max(pos - start + 1) AS age_max, count(*) FILTER (WHERE start = (SELECT min(pos) FROM t)) AS censored FROM a GROUP BY 1""", floats="age_mean age_median")
def evaluate_member_ages(spark, sf_dir):
    return structure.ages(structure.banded(_wide(spark, sf_dir), "kmid", _calendar(spark, sf_dir)).where("band in ('top', 'next')"))


@query(f"""
{LONG}, {_BANDS}, t AS (SELECT datetime, instrument, pos FROM b WHERE band = 'top'), s AS (SELECT datetime, pos, count(*) AS current FROM t GROUP BY 1, 2),
k AS (SELECT x.pos, count(*) AS held FROM t x JOIN t y ON x.instrument = y.instrument AND x.pos = y.pos + 1 GROUP BY 1),
j AS (SELECT a.datetime, b.current AS previous, a.current, coalesce(held, 0) AS retained FROM s a JOIN s b ON a.pos = b.pos + 1 LEFT JOIN k ON k.pos = a.pos)
SELECT *, current - retained AS entries, previous - retained AS exits, retained / previous AS retention, (current - retained) / current AS entry_rate, (previous - retained) / previous AS exit_rate,
       retained / (current + previous - retained) AS jaccard, (retained * abs(1 / current - 1 / previous) + (current - retained) / current + (previous - retained) / previous) / 2 AS churn FROM j""", floats="retention entry_rate exit_rate jaccard churn")
def evaluate_edge_churn(spark, sf_dir):
    return structure.churn(structure.banded(_wide(spark, sf_dir), "kmid", _calendar(spark, sf_dir)).where("band = 'top'"))


_HELD = {"rho": "rho", "abs_rho": "abs(rho)", "n_common": "common", "coverage": "common / universe", "jaccard": "common / nullif(fa + fb - common, 0)"}
_NUMBERS = ", ".join(f"avg(v_{k}) AS mean_{k}, median(v_{k}) AS median_{k}, quantile_cont(v_{k}, 0.1) AS p10_{k}" for k in _HELD)


@query(f"""
{PAIRS}, u AS (SELECT datetime, count(DISTINCT instrument) AS universe FROM long GROUP BY 1), fin AS (SELECT datetime, factor, count(value) AS n FROM long GROUP BY 1, 2),
pr AS (SELECT DISTINCT a.factor AS factor_a, b.factor AS factor_b FROM (SELECT DISTINCT factor FROM long) a JOIN (SELECT DISTINCT factor FROM long) b ON a.factor < b.factor),
j AS (SELECT u.datetime, universe, factor_a, factor_b, rho, coalesce(common, 0) AS common, coalesce(reason, 'insufficient') AS reason, coalesce(x.n, 0) AS fa, coalesce(y.n, 0) AS fb
      FROM u CROSS JOIN pr LEFT JOIN pc USING (datetime, factor_a, factor_b) LEFT JOIN fin x ON x.datetime = u.datetime AND x.factor = factor_a LEFT JOIN fin y ON y.datetime = u.datetime AND y.factor = factor_b),
h AS (SELECT *, {', '.join(f"CASE WHEN rho IS NOT NULL THEN CAST({v} AS DOUBLE) END AS v_{k}" for k, v in _HELD.items())} FROM j),
g AS (SELECT factor_a, factor_b, count(*) AS dates, count(rho) AS valid_dates, count(*) FILTER (WHERE reason = 'insufficient') AS insufficient_dates, count(*) FILTER (WHERE reason = 'constant') AS constant_dates,
      count(*) FILTER (WHERE round(rho, 9) > 0) / nullif(count(rho), 0) AS positive, count(*) FILTER (WHERE round(rho, 9) < 0) / nullif(count(rho), 0) AS negative, {_NUMBERS} FROM h GROUP BY 1, 2)
SELECT *, valid_dates / dates AS valid_fraction, greatest(positive, negative) AS sign_consistency, valid_dates / dates >= 0.8 AND coalesce(p10_coverage >= 0.5, false) AS comparable FROM g""",
       floats="positive negative valid_fraction sign_consistency " + " ".join(f"{n}_{k}" for k in _HELD for n in ("mean", "median", "p10")))
def similarity_pair_overlap(spark, sf_dir):
    return structure.pair_reduction(_long(spark, sf_dir), 5)


@query(f"""
{LIFE}, two AS (SELECT instrument, CAST(min(datetime) AS DATE) AS s, CAST(min(datetime) + INTERVAL 24 MONTH AS DATE) AS e FROM panel GROUP BY 1 UNION ALL SELECT instrument, CAST(min(datetime) + INTERVAL 36 MONTH AS DATE), CAST(max(datetime) - INTERVAL 12 MONTH AS DATE) FROM panel GROUP BY 1),
d1 AS (SELECT DISTINCT instrument, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS day FROM life WHERE s <= e), d2 AS (SELECT DISTINCT instrument, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS day FROM two WHERE s <= e),
r AS (SELECT d1.* FROM d1 LEFT JOIN d2 USING (instrument, day) WHERE d2.day IS NULL), i AS (SELECT instrument, day, day - CAST(row_number() OVER (PARTITION BY instrument ORDER BY day) AS INTEGER) AS g FROM r)
SELECT i.instrument, min(day) AS start_date, max(day) AS end_date, CAST(count(cal.datetime) AS INTEGER) AS keys FROM i LEFT JOIN cal ON cal.datetime = day GROUP BY i.instrument, g""")
def join_interval_difference(spark, sf_dir):
    """What two intervals leave uncovered of a life span, and how many keys of the calendar go with it."""
    p = monthly_panel(spark, sf_dir)
    lo, hi = F.min("datetime"), F.max("datetime")
    two = p.groupBy("instrument").agg(F.array(F.struct(lo.alias("start"), F.add_months(lo, 24).alias("end")), F.struct(F.add_months(lo, 36).alias("start"), F.add_months(hi, -12).alias("end"))).alias("x")).select("instrument", F.inline("x"))
    out = joins.keys_inside(joins.uncovered(_life(p), two), joins.calendar_of(p))
    return out.select("instrument", F.col("start").alias("start_date"), F.col("end").alias("end_date"), "keys")


@query(f"""
{IC}, mr AS (SELECT datetime, avg(r) AS r FROM (SELECT datetime, close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY datetime), 0) - 1 AS r FROM panel) GROUP BY 1),
cs AS (SELECT datetime, CASE WHEN count(r) OVER (ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN product(1 + r) OVER (ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) - 1 END AS c FROM mr),
st AS (SELECT datetime, CASE WHEN c IS NULL THEN 'unknown' WHEN c > 0.02 THEN 'up' WHEN c < -0.02 THEN 'down' ELSE 'sideways' END AS market_state FROM cs)
SELECT factor, market_state, count(*) AS days, avg(rank_ic) AS rank_ic_mean, avg(CASE WHEN round(rank_ic, 9) > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM ic JOIN st USING (datetime) WHERE status = 'ok' GROUP BY 1, 2""", floats="rank_ic_mean win_rate")
def evaluate_state_slices(spark, sf_dir):
    return structure.sliced(_ic(spark, sf_dir), features.market_state(monthly_panel(spark, sf_dir), 3, 0.02), "market_state")


@query(f"""
{LONG}, {_BANDS}, g AS (SELECT b.datetime, band, avg(label) AS m FROM b JOIN wide USING (datetime, instrument) WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT band, count(*) AS days, avg(m) AS mean_label, avg(CASE WHEN round(m, 9) > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM g GROUP BY 1""", floats="mean_label positive")
def evaluate_band_returns(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    return structure.band_returns(structure.banded(wide, "kmid", _calendar(spark, sf_dir)), wide)


_SIZED = "z AS (SELECT wide.*, ln(amount) AS size, amount FROM wide JOIN panel USING (datetime, instrument))"


def _sized(spark, sf_dir):
    amounts = monthly_panel(spark, sf_dir).select("datetime", "instrument", "amount", F.ln("amount").alias("size"))
    return _wide(spark, sf_dir).join(amounts, ["datetime", "instrument"])


@query(f"""
{LONG}, {_SIZED}, s AS (SELECT *, floor(count(*) OVER (PARTITION BY datetime) * 0.2) AS n, row_number() OVER (PARTITION BY datetime ORDER BY rev_1 DESC, instrument) AS hi, row_number() OVER (PARTITION BY datetime ORDER BY rev_1, instrument) AS lo FROM z WHERE rev_1 IS NOT NULL AND size IS NOT NULL),
g AS (SELECT datetime, count(*) FILTER (WHERE hi <= n) AS members, avg(size) FILTER (WHERE hi <= n) AS "long", avg(size) FILTER (WHERE lo <= n) AS "short", avg(size) AS universe FROM s GROUP BY 1)
SELECT *, "long" - "short" AS net FROM g WHERE members > 0""", floats='"long" "short" universe net')
def portfolio_leg_exposure(spark, sf_dir):
    return structure.leg_exposure(_sized(spark, sf_dir), "rev_1", "size", 0.2)


@query(f"""
{LONG}, {_SIZED}, f AS (SELECT *, quantile_cont(amount, 0.5) OVER (PARTITION BY datetime) AS least FROM z WHERE rev_1 IS NOT NULL AND amount IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY rev_1 DESC, instrument) AS r, count(*) OVER (PARTITION BY datetime) AS n FROM f WHERE round(amount, 9) >= round(least, 9))
SELECT datetime, any_value(n) AS eligible, count(*) AS members, avg(label) AS mean_label FROM s WHERE r <= 10 GROUP BY 1""", floats="mean_label")
def portfolio_liquid_selection(spark, sf_dir):
    return structure.liquid_selection(_sized(spark, sf_dir), "rev_1", "amount", 0.5, 10)


@query("""
SELECT instrument, CAST(year(datetime) AS INTEGER) AS year, count(*) AS rows, count(*) FILTER (WHERE open > 0 AND close > 0 AND volume > 0) AS positive, count(*) FILTER (WHERE low <= least(open, close) AND high >= greatest(open, close)) AS ordered,
       count(*) FILTER (WHERE vwap >= low * 0.998 AND vwap <= high * 1.002) AS vwap_inside FROM panel GROUP BY 1, 2""")
def quality_quote_windows(spark, sf_dir):
    return audits.quote_checks(monthly_panel(spark, sf_dir).withColumn("year", F.year("datetime")), ("instrument", "year"))
