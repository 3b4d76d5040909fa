"""Queries over splits, bootstraps, neutralisation, guards and selection boards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import ts, xs
from tessera.operators import audits, boards, evaluate, joins, neutral, portfolio, quality, splits, stats
from tessera.plans.base import query
from tessera.plans.evaluation import EDGES, IC, LONG, NEAR, _ic, _long, _wide
from tessera.plans.panel import LABEL
from tessera.sources.panel import KEYS, monthly_panel

W = "PARTITION BY instrument ORDER BY datetime"
D = "PARTITION BY datetime"


# ------------------------------------------------------------------ bootstraps
def _boot(rows: str, pool: str, samples: int, length: int, seed: str) -> str:
    return f"""{IC}, x AS ({rows}),
sr AS (SELECT factor, count(*) AS days, avg(rank_ic) AS mean FROM x GROUP BY 1 HAVING count(*) >= {max(20, 2 * length)}),
cd AS (SELECT x.factor, pos, rank_ic - mean AS d FROM x JOIN sr USING (factor)), pool AS ({pool}), np AS (SELECT factor, count(*) AS blocks FROM pool GROUP BY 1),
dr AS (SELECT sr.factor, days, mean, s AS sample, CAST('0x' || substr(md5({seed} || '|' || s || '|' || b), 1, 8) AS BIGINT) % blocks AS block, CASE WHEN b = ceil(days / {length}.0) THEN days - (ceil(days / {length}.0) - 1) * {length} ELSE {length} END AS k
  FROM sr JOIN np USING (factor), range(1, {samples + 1}) t(s), range(1, 1000) u(b) WHERE b <= ceil(days / {length}.0)),
m AS (SELECT dr.factor, sample, any_value(days) AS days, any_value(mean) AS mean, sum(cd.d) / any_value(days) AS m FROM dr JOIN pool USING (factor, block) JOIN cd ON cd.factor = dr.factor AND cd.pos BETWEEN start AND start + k - 1 GROUP BY 1, 2)
SELECT factor, any_value(days) AS days, any_value(mean) AS mean, stddev_samp(m) AS standard_error, any_value(mean) - quantile_cont(m, 0.975) AS low, any_value(mean) - quantile_cont(m, 0.025) AS high, (1 + count(*) FILTER (WHERE round(abs(m), 12) >= round(abs(mean), 12))) / {samples + 1} AS p FROM m GROUP BY 1"""


_ROWS = "SELECT factor, datetime, rank_ic, row_number() OVER (PARTITION BY factor ORDER BY datetime) - 1 AS pos FROM ic WHERE status = 'ok'"
_GAPS = "SELECT ic.factor, ic.datetime, rank_ic, cal.pos AS c, row_number() OVER (PARTITION BY factor ORDER BY datetime) - 1 AS pos FROM ic JOIN cal USING (datetime) WHERE status = 'ok' AND cal.pos % 7 <> 0"
_BOOT = "mean standard_error low high p"


@query(_boot(_ROWS, "SELECT x.factor, pos AS block, pos AS start FROM x JOIN sr USING (factor) WHERE pos <= days - 6", 200, 6, "'11|' || sr.factor"), floats=_BOOT)
def stats_block_bootstrap(spark, sf_dir):
    return stats.block_bootstrap(_ic(spark, sf_dir).where("status = 'ok'"), "rank_ic", samples=200, length=6, seed=11)


@query(_boot(_ROWS, "SELECT x.factor, pos AS block, pos AS start FROM x JOIN sr USING (factor) WHERE pos <= days - 4", 100, 4, "'5'"), floats=_BOOT)
def stats_joint_bootstrap(spark, sf_dir):
    return stats.block_bootstrap(_ic(spark, sf_dir).where("status = 'ok'"), "rank_ic", samples=100, length=4, seed=5, joint=True)


@query(_boot(_GAPS, "SELECT factor, row_number() OVER (PARTITION BY factor ORDER BY pos) - 1 AS block, pos AS start FROM (SELECT *, max(pos) OVER (PARTITION BY factor, c - pos) AS last FROM x) WHERE pos + 2 <= last", 100, 3, "'3|' || sr.factor"), floats=_BOOT)
def stats_gap_bootstrap(spark, sf_dir):
    cal = joins.calendar_of(monthly_panel(spark, sf_dir))
    daily = _ic(spark, sf_dir).where("status = 'ok'").join(cal, "datetime").where("pos % 7 <> 0").drop("pos")
    return stats.gap_aware_bootstrap(daily, cal, "rank_ic", samples=100, length=3, seed=3)


@query(f"""
{IC}, x AS ({_ROWS}), sr AS (SELECT factor, count(*) AS days FROM x GROUP BY 1), g AS (SELECT sr.factor, days, s, t FROM sr, range(1, 51) u(s), range(0, 1000) v(t) WHERE t < days),
r AS (SELECT *, t = 0 OR CAST('0x' || substr(md5('9|restart|' || factor || '|' || s || '|' || t), 1, 8) AS BIGINT) * 5 < 4294967296 AS again, CAST('0x' || substr(md5('9|start|' || factor || '|' || s || '|' || t), 1, 8) AS BIGINT) % days AS at FROM g),
h AS (SELECT *, max(CASE WHEN again THEN t END) OVER (PARTITION BY factor, s ORDER BY t ROWS UNBOUNDED PRECEDING) AS t0 FROM r), k AS (SELECT h.factor, h.s, h.days, (r.at + h.t - h.t0) % h.days AS pos FROM h JOIN r ON r.factor = h.factor AND r.s = h.s AND r.t = h.t0),
m AS (SELECT k.factor, k.s, k.days, avg(rank_ic) AS m FROM k JOIN x ON x.factor = k.factor AND x.pos = k.pos GROUP BY 1, 2, 3)
SELECT factor, days, stddev_samp(m) AS standard_error FROM m GROUP BY 1, 2""", floats="standard_error")
def stats_stationary_bootstrap(spark, sf_dir):
    return stats.stationary_bootstrap(_ic(spark, sf_dir).where("status = 'ok'"), "rank_ic", samples=50, mean_length=5, seed=9)


# ------------------------------------------------------------------ splits
def _splits(rolling: bool) -> str:
    start = "CAST(f + to_months(CAST(6 * (k - 1) AS INTEGER)) AS DATE)" if rolling else "f"
    return f"""{LABEL}, f AS (SELECT min(datetime) AS f, max(datetime) AS l FROM cal),
b AS (SELECT 'split_' || lpad(CAST(k AS VARCHAR), 3, '0') AS split_id, {start} AS t, CAST(f + to_months(CAST(18 + 6 * k AS INTEGER)) AS DATE) AS v, CAST(f + to_months(CAST(24 + 6 * k AS INTEGER)) AS DATE) AS s, CAST(f + to_months(CAST(30 + 6 * k AS INTEGER)) AS DATE) AS e FROM f, range(1, 100) r(k) WHERE f + to_months(CAST(24 + 6 * k AS INTEGER)) <= l),
r1 AS (SELECT split_id, datetime, entry, exit, v, s, CASE WHEN datetime >= s THEN 'test' WHEN datetime >= v THEN 'validation' ELSE 'train' END AS fold FROM dm JOIN b ON datetime >= t AND datetime < e),
r2 AS (SELECT *, max(CASE WHEN fold = 'test' THEN datetime END) OVER (PARTITION BY split_id) AS lt FROM r1 WHERE fold = 'test' OR exit IS NOT NULL),
r3 AS (SELECT *, fold <> 'test' AND entry <= lt AND exit >= CASE WHEN fold = 'train' THEN v ELSE s END AS purged FROM r2),
r4 AS (SELECT *, row_number() OVER (PARTITION BY split_id, fold, purged ORDER BY datetime DESC) AS tl FROM r3),
sp AS (SELECT split_id, datetime, fold, CASE WHEN purged THEN 'purged' WHEN fold <> 'test' AND tl <= 1 THEN 'embargoed' ELSE 'kept' END AS fate FROM r4)"""


def _walk(spark, sf_dir, rolling: bool):
    cal = joins.calendar_of(monthly_panel(spark, sf_dir))
    return splits.purged_walk_forward(cal, train_months=24, validation_months=6, test_months=6, step_months=6, lag=1, horizon=1, embargo=1, rolling=rolling), cal


@query(f"{_splits(False)}\nSELECT * FROM sp")
def splits_purged_expanding(spark, sf_dir):
    return _walk(spark, sf_dir, False)[0]


@query(f"{_splits(True)}\nSELECT * FROM sp")
def splits_purged_rolling(spark, sf_dir):
    return _walk(spark, sf_dir, True)[0]


@query(f"""
{_splits(True)}
SELECT split_id, min(datetime) FILTER (WHERE fold = 'train' AND fate = 'kept') AS train_start, max(datetime) FILTER (WHERE fold = 'train' AND fate = 'kept') AS train_end, count(*) FILTER (WHERE fold = 'train' AND fate = 'kept') AS train_dates,
  min(datetime) FILTER (WHERE fold = 'validation' AND fate = 'kept') AS validation_start, max(datetime) FILTER (WHERE fold = 'validation' AND fate = 'kept') AS validation_end, count(*) FILTER (WHERE fold = 'validation' AND fate = 'kept') AS validation_dates,
  min(datetime) FILTER (WHERE fold = 'test') AS test_start, max(datetime) FILTER (WHERE fold = 'test') AS test_end, count(*) FILTER (WHERE fold = 'test') AS test_dates, count(*) FILTER (WHERE fate = 'purged') AS purged_dates, count(*) FILTER (WHERE fate = 'embargoed') AS embargoed_dates FROM sp GROUP BY 1""")
def splits_manifest(spark, sf_dir):
    return splits.split_manifest(_walk(spark, sf_dir, True)[0])


@query(f"""
{_splits(False)}, bad AS (SELECT split_id, datetime, fold, CASE WHEN fate = 'purged' THEN 'kept' ELSE fate END AS fate FROM sp UNION ALL SELECT split_id, datetime, 'train', 'kept' FROM sp WHERE fate = 'embargoed'), u AS (SELECT * FROM bad JOIN dm USING (datetime) WHERE fate = 'kept'),
s AS (SELECT split_id, min(datetime) FILTER (WHERE fold = 'validation') AS vl, max(datetime) FILTER (WHERE fold = 'validation') AS vh, min(datetime) FILTER (WHERE fold = 'test') AS tl, max(datetime) FILTER (WHERE fold = 'test') AS th FROM u GROUP BY 1),
c AS (SELECT count(*) FILTER (WHERE fold = 'train' AND entry <= th AND exit >= tl) AS a, count(*) FILTER (WHERE fold = 'train' AND entry <= vh AND exit >= vl) AS b, count(*) FILTER (WHERE fold = 'validation' AND entry <= th AND exit >= tl) AS c FROM u JOIN s USING (split_id)),
d AS (SELECT count(*) AS d FROM (SELECT 1 FROM u GROUP BY split_id, datetime HAVING count(DISTINCT fold) > 1)), e AS (SELECT count(*) AS e FROM bad x WHERE fate = 'embargoed' AND EXISTS (SELECT 1 FROM u WHERE u.split_id = x.split_id AND u.datetime = x.datetime)),
l AS (SELECT 'train_test_label_overlap' AS check_name, a AS observed_value FROM c UNION ALL SELECT 'train_validation_label_overlap', b FROM c UNION ALL SELECT 'validation_test_label_overlap', c FROM c UNION ALL SELECT 'same_date_cross_fold_count', d FROM d UNION ALL SELECT 'embargo_violation_count', e FROM e)
SELECT check_name, CASE WHEN observed_value = 0 THEN 'pass' ELSE 'fail' END AS status, observed_value FROM l""")
def splits_leakage_audit(spark, sf_dir):
    """An audit of damaged splits: purged dates kept, embargoed dates used once more."""
    own, cal = _walk(spark, sf_dir, False)
    bad = own.withColumn("fate", F.when(F.col("fate") == "purged", "kept").otherwise(F.col("fate"))).unionByName(own.where("fate = 'embargoed'").withColumns({"fold": F.lit("train"), "fate": F.lit("kept")}))
    return splits.leakage_audit(bad, joins.label_dates(cal, 1, 1))


@query(f"""
{_splits(False)}, o AS (SELECT split_id, datetime, exit, row_number() OVER (PARTITION BY split_id ORDER BY datetime) AS p, count(*) OVER (PARTITION BY split_id) AS n FROM sp JOIN dm USING (datetime) WHERE fold = 'train' AND fate = 'kept'),
g AS (SELECT o.*, i AS inner_id, floor(n * x) AS z FROM o, (VALUES (1, 0.6), (2, 0.8), (3, 1.0)) v(i, x) WHERE p <= floor(n * x)), h AS (SELECT *, CASE WHEN p > z - floor(z * 0.25) THEN 'validation' ELSE 'train' END AS fold FROM g),
j AS (SELECT *, min(CASE WHEN fold = 'validation' THEN datetime END) OVER (PARTITION BY split_id, inner_id) AS fv FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY split_id, inner_id, fold ORDER BY datetime DESC) AS t FROM j WHERE fold = 'validation' OR exit < fv),
q AS (SELECT *, count(*) FILTER (WHERE fold = 'train') OVER (PARTITION BY split_id, inner_id) AS a, count(*) FILTER (WHERE fold = 'validation') OVER (PARTITION BY split_id, inner_id) AS b FROM k WHERE t > 1)
SELECT split_id, CAST(inner_id AS INTEGER) AS inner_id, datetime, fold FROM q WHERE a >= 4 AND b >= 4""")
def splits_development(spark, sf_dir):
    own, cal = _walk(spark, sf_dir, False)
    return splits.development_splits(own, joins.label_dates(cal, 1, 1), [0.6, 0.8, 1.0], validation=0.25, embargo=1, least=4)


@query(f"""
{LABEL}, t AS (SELECT y AS year, h AS history, make_date(y, 1, 1) AS b FROM (VALUES (1997), (1999), (2001)) a(y), (VALUES (0), (12)) c(h)),
s AS (SELECT t.*, datetime, row_number() OVER (PARTITION BY year, history ORDER BY datetime DESC) AS r FROM dm JOIN t ON datetime < b AND exit < b)
SELECT CAST(year AS INTEGER) AS year, CAST(history AS INTEGER) AS history, datetime FROM s WHERE history = 0 OR r <= history""")
def splits_protocol_folds(spark, sf_dir):
    return splits.protocol_folds(joins.label_dates(joins.calendar_of(monthly_panel(spark, sf_dir)), 1, 1), [1997, 1999, 2001], [None, 12])


_PERIODS = [("early", dt.date(1995, 1, 1), dt.date(1996, 12, 31)), ("middle", dt.date(1996, 7, 1), dt.date(1999, 6, 30)), ("late", dt.date(1999, 7, 1), dt.date(2002, 12, 31))]


@query(f"""
{LABEL}, p(period, s, e) AS (VALUES ('early', DATE '1995-01-01', DATE '1996-12-31'), ('middle', DATE '1996-07-01', DATE '1999-06-30'), ('late', DATE '1999-07-01', DATE '2002-12-31'))
SELECT period, min(datetime) AS first_date, max(datetime) AS last_date, count(*) AS dates, count(*) FILTER (WHERE exit <= e) AS mature_dates FROM dm JOIN p ON datetime BETWEEN s AND e GROUP BY 1""")
def calendar_periods(spark, sf_dir):
    periods = spark.createDataFrame(_PERIODS, "period string, start date, end date")
    return splits.period_calendar(joins.label_dates(joins.calendar_of(monthly_panel(spark, sf_dir)), 1, 1), periods)


@query("""
s AS (SELECT datetime AS signal_date FROM cal UNION ALL SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem WHERE day(l_shipdate) = 15), n AS (SELECT datetime, lead(datetime) OVER (ORDER BY datetime) AS nx FROM cal)
SELECT signal_date, nx AS execution_date, CASE WHEN n.datetime IS NULL THEN 'not_a_session' WHEN nx IS NULL THEN 'calendar_end' ELSE 'ok' END AS status FROM s LEFT JOIN n ON signal_date = datetime""")
def calendar_execution_days(spark, sf_dir):
    cal = joins.calendar_of(monthly_panel(spark, sf_dir))
    odd = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("signal_date")).where(F.dayofmonth("signal_date") == 15).distinct()
    return splits.execution_days(cal.select(F.col("datetime").alias("signal_date")).union(odd), cal)


@query("""
f AS (SELECT o_orderpriority AS field, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS available, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS used FROM orders)
SELECT field, count(*) AS rows, count(*) FILTER (WHERE available IS NULL OR available > used) AS violations FROM f GROUP BY 1""", base="")
def guard_field_timing(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.to_date("o_orderdate")
    return splits.timing_violations(o.select(F.col("o_orderpriority").alias("field"), F.date_add(day, (F.col("o_orderkey") % 40).cast("int")).alias("available"), F.add_months(F.trunc(day, "month"), 1).alias("used")))


@query("SELECT datetime, instrument, close FROM panel WHERE datetime IN (SELECT datetime FROM cal WHERE pos % 10 = 1)", floats="close")
def guard_allowed_dates(spark, sf_dir):
    p = monthly_panel(spark, sf_dir).select(*KEYS, "close")
    return splits.allowed_dates(p, joins.calendar_of(p).where("pos % 10 = 1"))


@query(f"{_splits(False)}, {IC.split(', ', 0)[0][len(LABEL) + 2 :]}\nSELECT split_id, fold, factor, datetime, rank_ic FROM ic JOIN sp USING (datetime) WHERE fate = 'kept'", floats="rank_ic")
def join_by_split(spark, sf_dir):
    own = _walk(spark, sf_dir, False)[0].where("fate = 'kept'")
    return splits.by_split(_ic(spark, sf_dir), own).select("split_id", "fold", "factor", "datetime", "rank_ic")


@query(f"""
{IC}, m AS (SELECT datetime, factor AS method, rank_ic FROM ic WHERE status = 'ok' AND NOT (factor = 'kmid' AND month(datetime) = 6))
SELECT * FROM m WHERE datetime IN (SELECT datetime FROM m GROUP BY 1 HAVING count(DISTINCT method) = 3)""", floats="rank_ic")
def join_common_window(spark, sf_dir):
    m = _ic(spark, sf_dir).where("status = 'ok' and not (factor = 'kmid' and month(datetime) = 6)").select("datetime", F.col("factor").alias("method"), "rank_ic")
    return splits.common_window(m)


# ------------------------------------------------------------------ neutralisation
_EXPOSED = f"{LONG}, ex AS (SELECT w.datetime, w.instrument, kmid, label, rev_1, ln(v.amount) AS lam, right(w.instrument, 1) AS digit, v.amount, v.high - v.low AS width FROM wide w JOIN panel v USING (datetime, instrument))"


def _exposed(spark, sf_dir):
    p = monthly_panel(spark, sf_dir).select(*KEYS, F.ln("amount").alias("lam"), F.right("instrument", F.lit(1)).alias("digit"), "amount", (F.col("high") - F.col("low")).alias("width"))
    return _wide(spark, sf_dir).join(p, KEYS)


@query(f"""
{_EXPOSED}, v AS (SELECT *, lam - avg(lam) OVER (PARTITION BY datetime, digit) AS x, kmid - avg(kmid) OVER (PARTITION BY datetime, digit) AS y, count(*) OVER ({D}) AS n FROM (SELECT * REPLACE (CASE WHEN digit IN ('1', '2', '3') THEN 'a' ELSE 'b' END AS digit) FROM ex) WHERE kmid IS NOT NULL AND lam IS NOT NULL)
SELECT datetime, instrument, CASE WHEN n >= 6 THEN y - x * sum(x * y) OVER ({D}) / nullif(sum(x * x) OVER ({D}), 0) END AS residual FROM v""", floats="residual")
def neutral_residual_dummies(spark, sf_dir):
    """A numeric exposure and dummies of a group; the SQL takes means of groups off both sides first."""
    e = _exposed(spark, sf_dir).where("kmid is not null").withColumn("digit", F.when(F.col("digit").isin("1", "2", "3"), "a").otherwise("b"))
    return neutral.residual_on(e, "kmid", ["lam"], ["digit"], "residual", 6)


_Z = "CASE WHEN s > 0 AND n >= 2 THEN greatest(least((x - m) / s, 3), -3) END"


def _robust(source: str, x: str, keys: str, into: str) -> str:
    """CTEs that end in ``into``: every column of the source and z."""
    return f"""{into}_m AS (SELECT *, {x} AS x, median({x}) OVER (PARTITION BY {keys}) AS m, count({x}) OVER (PARTITION BY {keys}) AS n FROM {source}),
{into}_s AS (SELECT *, median(abs(x - m)) OVER (PARTITION BY {keys}) * 1.4826 AS s FROM {into}_m), {into} AS (SELECT * EXCLUDE (x, m, n, s), {_Z} AS {into}_z FROM {into}_s)"""


def _clipped(source: str, x: str, into: str) -> str:
    return f"""{into}_m AS (SELECT *, median({x}) OVER ({D}) AS m FROM {source}), {into}_d AS (SELECT *, median(abs({x} - m)) OVER ({D}) AS d FROM {into}_m),
{into} AS (SELECT * EXCLUDE (m, d), CASE WHEN d > 0 THEN greatest(least({x}, m + 4.5 * d), m - 4.5 * d) ELSE {x} END AS {into}_c FROM {into}_d)"""


_BUCKETED = f"""{_EXPOSED}, e1 AS (SELECT *, quantile_cont(amount, [0.5]) OVER ({D}) AS ea, list_sort(list_distinct(quantile_cont(width, [0.0, 0.5, 1.0]) OVER ({D}))) AS ew FROM ex),
bk AS (SELECT * EXCLUDE (ea, ew), 1 + len(list_filter(ea, lambda q: q < amount)) AS liq, CASE WHEN len(ew) > 1 THEN 1 + len(list_filter(list_slice(ew, 2, len(ew) - 1), lambda q: q < width)) END AS vol FROM e1)"""


_VARIED = f"""{_BUCKETED}, r0 AS (SELECT *, rank() OVER ({D} ORDER BY kmid) + (count(kmid) OVER (PARTITION BY datetime, kmid) - 1) / 2.0 AS rk, count(kmid) OVER ({D}) AS nk, avg(kmid) OVER ({D}) AS my, avg(lam) OVER ({D}) AS mx, covar_pop(kmid, lam) OVER ({D}) / nullif(var_pop(lam) OVER ({D}), 0) AS b FROM bk),
{_clipped('r0', 'kmid', 'cl')}, {_robust('cl', 'cl_c', 'datetime', 'za')}, {_robust('za', 'kmid', 'datetime, liq', 'zl')}, {_robust('zl', 'kmid', 'datetime, vol', 'zv')}"""
_RANK, _RESIDUAL = "CASE WHEN nk >= 2 THEN (rk / nk - 0.5) * 3.46 END", "CASE WHEN nk >= 6 THEN kmid - my - b * (lam - mx) END"


@query(f"""
{_VARIED}
SELECT datetime, instrument, kmid AS raw, {_RANK} AS cs_rank, za_z AS cs_zscore, zl_z AS liquidity_bucket_zscore, zv_z AS volatility_bucket_zscore, {_RESIDUAL} AS amount_proxy_residual FROM zv""", floats="raw cs_rank cs_zscore liquidity_bucket_zscore volatility_bucket_zscore amount_proxy_residual")
def neutral_variants(spark, sf_dir):
    """Six of the seven variants against SQL; the seventh, on three exposures, is held against brute force in the tests."""
    return _variants(spark, sf_dir).drop("liquidity_volatility_residual")


def _variants(spark, sf_dir):
    e = xs.bucket(xs.bucket(_exposed(spark, sf_dir), "amount", "liq", 2), "width", "vol", 2)
    return neutral.variants(e, "kmid", liquidity="liq", volatility="vol", proxy="lam", least=6)


@query(f"""
{_VARIED}, o AS (SELECT *, kmid IS NOT NULL AND lam IS NOT NULL AND liq IS NOT NULL AND vol IS NOT NULL AS ok FROM zv), k AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY datetime) AS n_ok FROM o),
c AS (SELECT unnest(['raw', 'cs_rank', 'cs_zscore', 'liquidity_bucket_zscore', 'volatility_bucket_zscore', 'amount_proxy_residual', 'liquidity_volatility_residual']) AS neutralization,
  unnest([count(kmid), count({_RANK}), count(za_z), count(zl_z), count(zv_z), count({_RESIDUAL}), count(*) FILTER (WHERE ok AND n_ok >= 6)]) AS non_null_rows FROM k)
SELECT 'kmid' AS factor, neutralization, 'kmid__' || neutralization AS neutralized_factor, non_null_rows FROM c""")
def neutral_mapping(spark, sf_dir):
    """How many rows each variant has."""
    return neutral.variant_mapping(_variants(spark, sf_dir), "kmid")


_LIQUID = f"""{_EXPOSED}, lv AS (SELECT * FROM (SELECT *, count(*) OVER ({D}) AS nn FROM ex WHERE kmid IS NOT NULL) WHERE nn >= 6),
{_clipped('lv', 'kmid', 'c1')}, {_robust('c1', 'c1_c', 'datetime', 'z1')}, {_clipped('z1', 'lam', 'c2')}, {_robust('c2', 'c2_c', 'datetime', 'z2')}, {_clipped('z2', 'width', 'c3')}, {_robust('c3', 'c3_c', 'datetime', 'z3')},
lc AS (SELECT *, covar_pop(z1_z, z2_z) OVER w AS ab, covar_pop(z1_z, z3_z) OVER w AS ac, covar_pop(z2_z, z3_z) OVER w AS bc, var_pop(z2_z) OVER w AS bb, var_pop(z3_z) OVER w AS cc, avg(z1_z) OVER w AS ma, avg(z2_z) OVER w AS mb, avg(z3_z) OVER w AS mc FROM z3 WINDOW w AS ({D})),
lq AS (SELECT p.datetime, p.instrument, z1_z AS factor_z, z1_z - ma - (ab * cc - ac * bc) / (bb * cc - bc * bc) * (z2_z - mb) - (ac * bb - ab * bc) / (bb * cc - bc * bc) * (z3_z - mc) AS residual FROM panel p LEFT JOIN lc USING (datetime, instrument))"""


def _liquid(spark, sf_dir):
    return neutral.liquidity_residual(_exposed(spark, sf_dir), "kmid", ["lam", "width"], 6)


@query(f"{_LIQUID}\nSELECT * FROM lq", floats="factor_z residual")
def neutral_liquidity_residual(spark, sf_dir):
    return _liquid(spark, sf_dir)


_DIAGNOSED = f"""{_LIQUID}, dg AS (SELECT datetime, count(*) AS rows, count(residual) / count(*) AS coverage, CASE WHEN stddev_samp(residual) > 0 THEN corr(factor_z, residual) END AS correlation, 1 - var_samp(residual) / nullif(var_samp(CASE WHEN residual IS NOT NULL THEN factor_z END), 0) AS r2 FROM lq GROUP BY 1)"""


@query(f"{_DIAGNOSED}\nSELECT * FROM dg", floats="coverage correlation r2")
def neutral_diagnostics(spark, sf_dir):
    return neutral.residual_diagnostics(_liquid(spark, sf_dir))


@query(f"{_DIAGNOSED}\nSELECT count(r2) AS days, avg(coverage) AS coverage, avg(correlation) AS correlation, avg(r2) AS r2 FROM dg", floats="coverage correlation r2")
def neutral_diagnostics_summary(spark, sf_dir):
    return neutral.residual_summary(neutral.residual_diagnostics(_liquid(spark, sf_dir)))


@query(f"""
{_EXPOSED}, q AS (SELECT *, quantile_cont(kmid, [0.01, 0.99]) OVER ({D}) AS e FROM ex), c AS (SELECT *, greatest(least(kmid, e[2]), e[1]) AS x FROM q), z AS (SELECT *, avg(x) OVER ({D}) AS m, stddev_samp(x) OVER ({D}) AS s FROM c)
SELECT datetime, instrument, CASE WHEN s > 0 THEN (x - m) / s END AS score FROM z""", floats="score")
def xs_clipped_score(spark, sf_dir):
    return xs.clipped_zscore(_exposed(spark, sf_dir), "kmid", "score").select(*KEYS, "score")


@query(f"""
{_EXPOSED}, t AS (SELECT *, CASE WHEN digit < '4' THEN 1.0 WHEN digit < '7' THEN 2.0 ELSE 1.0 END AS v FROM ex), m AS (SELECT *, median(v) OVER ({D}) AS m, count(v) OVER ({D}) AS n FROM t), s AS (SELECT *, median(abs(v - m)) OVER ({D}) * 1.4826 AS s, stddev_pop(v) OVER ({D}) AS p FROM m)
SELECT datetime, instrument, CASE WHEN CASE WHEN s > 0 THEN s ELSE p END > 0 AND n >= 2 THEN greatest(least((v - m) / CASE WHEN s > 0 THEN s ELSE p END, 3), -3) END AS score FROM s""", floats="score")
def xs_fallback_score(spark, sf_dir):
    e = _exposed(spark, sf_dir).withColumn("v", F.when(F.col("digit") < "4", 1.0).when(F.col("digit") < "7", 2.0).otherwise(1.0))
    return xs.zscore(e, "v", "score", fall_back=True).select(*KEYS, "score")


@query(f"""
{_EXPOSED}, r AS (SELECT *, row_number() OVER ({D} ORDER BY amount DESC, instrument) AS r, rank() OVER ({D} ORDER BY amount) + (count(*) OVER (PARTITION BY datetime, amount) - 1) / 2.0 AS k, count(*) OVER ({D}) AS n, list_sort(list_distinct(quantile_cont(width, [0.0, 0.25, 0.5, 0.75, 1.0]) OVER ({D}))) AS e FROM ex)
SELECT datetime, instrument, CASE WHEN r <= 3 THEN 'top_3' WHEN r <= 6 THEN '4_6' ELSE 'rest' END AS band, k / n AS size_percentile, CASE WHEN k / n <= 1 / 3.0 THEN 'Small' WHEN k / n <= 2 / 3.0 THEN 'Mid' ELSE 'Large' END AS size, CASE WHEN n >= 4 AND len(e) > 1 THEN CAST(1 + len(list_filter(list_slice(e, 2, len(e) - 1), lambda q: q < width)) AS INTEGER) END AS volatility_bucket FROM r""", floats="size_percentile")
def xs_bands_and_sizes(spark, sf_dir):
    e = xs.bucket(_exposed(spark, sf_dir), "width", "volatility_bucket", 4)
    pct = xs.percent_rank(F.col("amount"))
    return e.select(*KEYS, xs.rank_band(F.col("amount"), F.col("instrument"), [("top_3", 3), ("4_6", 6)], "rest").alias("band"), pct.alias("size_percentile"), xs.size_name(pct).alias("size"), "volatility_bucket")


@query(f"""
{LONG}, v AS (SELECT *, rank() OVER ({D} ORDER BY label) + (count(*) OVER (PARTITION BY datetime, label) - 1) / 2.0 AS r, count(*) OVER ({D}) AS n FROM wide WHERE label IS NOT NULL AND rev_1 IS NOT NULL)
SELECT datetime, instrument, r / n - 0.5 AS target FROM v WHERE n >= 8""", floats="target")
def xs_rank_centred_target(spark, sf_dir):
    return xs.rank_target(_wide(spark, sf_dir).where("rev_1 is not null"), "label", 8)[0]


@query(f"""
{LONG}, v AS (SELECT datetime, count(label) AS pairs FROM wide WHERE rev_1 IS NOT NULL GROUP BY 1)
SELECT datetime, pairs, pairs >= 8 AS eligible FROM v""")
def xs_target_receipt(spark, sf_dir):
    return xs.rank_target(_wide(spark, sf_dir).where("rev_1 is not null"), "label", 8)[1]


# ------------------------------------------------------------------ scores of families
_FAMILIES = "fam(factor, family, composite) AS (VALUES ('rev_1', 'price', 'all'), ('kmid', 'price', 'all'), ('volume_ratio', 'volume', 'all'))"


def _families(spark):
    return spark.createDataFrame([("rev_1", "price", "all"), ("kmid", "price", "all"), ("volume_ratio", "volume", "all")], "factor string, family string, composite string")


@query(f"""
{LONG}, {_FAMILIES}, sg AS (SELECT datetime, instrument, factor, CASE WHEN n > 1 THEN 2 * (r - 1) / (n - 1) - 1 END AS x FROM (SELECT *, rank() OVER (PARTITION BY datetime, factor ORDER BY value) + (count(*) OVER (PARTITION BY datetime, factor, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY datetime, factor) AS n FROM long WHERE value IS NOT NULL)),
f AS (SELECT datetime, instrument, family, composite, avg(x) AS x FROM sg JOIN fam USING (factor) WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) >= ceil(0.5 * CASE family WHEN 'price' THEN 2 ELSE 1 END))
SELECT datetime, instrument, composite, avg(x) AS score, count(*) AS families FROM f GROUP BY ALL HAVING count(*) >= ceil(1.0 * 2)""", floats="score")
def score_hierarchy(spark, sf_dir):
    return portfolio.hierarchy(_long(spark, sf_dir), _families(spark), 0.5, 1.0)


@query(f"""
{LONG}, {_FAMILIES}, sg AS (SELECT datetime, instrument, factor, CASE WHEN n > 1 THEN 2 * (r - 1) / (n - 1) - 1 END AS x FROM (SELECT *, rank() OVER (PARTITION BY datetime, factor ORDER BY value) + (count(*) OVER (PARTITION BY datetime, factor, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY datetime, factor) AS n FROM long WHERE value IS NOT NULL)),
f AS (SELECT datetime, instrument, family, round(avg(x), 12) AS x FROM sg JOIN fam USING (factor) WHERE x IS NOT NULL GROUP BY ALL), g AS (SELECT *, rank() OVER (PARTITION BY datetime, family ORDER BY x) + (count(*) OVER (PARTITION BY datetime, family, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY datetime, family) AS n FROM f)
SELECT datetime, instrument, avg(2 * (r - 1) / (n - 1) - 1) AS score FROM g WHERE n > 1 GROUP BY 1, 2""", floats="score")
def score_sleeves(spark, sf_dir):
    return portfolio.sleeves(_long(spark, sf_dir), _families(spark))


# ------------------------------------------------------------------ pruning, guards and quality
@query(f"""
{EDGES}, both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), o AS (SELECT instrument AS factor, row_number() OVER (ORDER BY round(avg(amount), 2) DESC, instrument) AS i FROM panel GROUP BY 1),
nb AS (SELECT o.i, o.factor, coalesce(list(b) FILTER (WHERE b IS NOT NULL), []) AS others FROM o LEFT JOIN both_ ON a = factor GROUP BY 1, 2),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS kept UNION ALL SELECT nb.i, CASE WHEN list_has_any(kept, others) THEN kept ELSE list_append(kept, factor) END FROM walk JOIN nb ON nb.i = walk.i + 1)
SELECT factor, list_contains((SELECT arg_max(kept, i) FROM walk), factor) AS kept FROM o""")
def select_greedy_pruning(spark, sf_dir):
    panel = monthly_panel(spark, sf_dir)
    board = panel.groupBy(F.col("instrument").alias("factor")).agg(F.round(F.avg("amount"), 2).alias("score"))
    return portfolio.near_pruning(board, panel, "score", **NEAR)


@query(f"""
b AS (SELECT datetime, instrument, close, amount, quantile_cont(amount, [0.2, 0.4, 0.6, 0.8]) OVER ({D}) AS e, count(*) OVER ({D}) AS n, volume FROM panel), k AS (SELECT *, CASE WHEN n >= 5 THEN 1 + len(list_filter(list_distinct(e), lambda q: q < amount)) END AS liq, 50 + CAST(volume AS BIGINT) % 51 AS score FROM b)
SELECT datetime, instrument FROM k WHERE liq >= 2 AND score >= 60 AND CAST(volume AS BIGINT) % 3 > 0 AND CASE WHEN CAST(volume AS BIGINT) % 7 = 0 THEN 'severe' ELSE 'fine' END <> 'severe'""")
def filter_tradable(spark, sf_dir):
    v = F.col("volume").cast("long")
    p = xs.bucket(monthly_panel(spark, sf_dir), "amount", "liquidity_bucket", 5).withColumns({"tradability_score": 50 + v % 51, "can_buy": v % 3 > 0, "data_quality_status": F.when(v % 7 == 0, "severe").when(v % 2 == 0, "fine")})
    return quality.tradable_rows(p, least_bucket=2, least_score=60, excluded=("severe",)).select(*KEYS)


@query(f"""
i AS (SELECT datetime, instrument, abs(close / nullif(lag(close) OVER ({W}), 0) - 1) AS r FROM panel)
SELECT datetime, instrument, 'return' AS category, unnest(CASE WHEN r > 0.5 THEN ['abs_daily_return_too_large', 'close_jump_too_large', 'suspected_adjustment_error'] WHEN r > 0.3 THEN ['abs_daily_return_too_large', 'close_jump_too_large'] ELSE [] END) AS rule FROM i""")
def quality_return_issues(spark, sf_dir):
    return quality.of_categories(quality.row_issues(monthly_panel(spark, sf_dir)), ["return"])


_AVAILABLE = f"""life AS (SELECT instrument, min(pos) AS lo, max(pos) AS hi FROM panel JOIN cal USING (datetime) GROUP BY 1), grid AS (SELECT l.instrument, c.datetime, c.pos, p.close IS NOT NULL AS here, p.volume % 4 = 0 AS quiet FROM life l JOIN cal c ON c.pos BETWEEN lo AND hi LEFT JOIN panel p ON p.instrument = l.instrument AND p.datetime = c.datetime),
gaps AS (SELECT instrument, count(*) AS len FROM (SELECT *, pos - row_number() OVER (PARTITION BY instrument ORDER BY pos) AS g FROM grid WHERE NOT here) GROUP BY instrument, g),
q0 AS (SELECT instrument, datetime, volume % 4 = 0 AS quiet, row_number() OVER ({W}) AS k FROM panel), runs AS (SELECT instrument, count(*) AS len FROM (SELECT *, k - row_number() OVER (PARTITION BY instrument ORDER BY k) AS g FROM q0 WHERE quiet) GROUP BY instrument, g),
av AS (SELECT instrument, count(*) AS expected, count(*) FILTER (WHERE here) AS valid, count(*) FILTER (WHERE NOT here) AS missing, coalesce((SELECT max(len) FROM gaps WHERE gaps.instrument = grid.instrument), 0) AS longest_gap, coalesce((SELECT count(*) FROM gaps WHERE gaps.instrument = grid.instrument), 0) AS gaps,
  coalesce((SELECT max(len) FROM runs WHERE runs.instrument = grid.instrument), 0) AS longest_zero_run, coalesce((SELECT count(*) FROM runs WHERE runs.instrument = grid.instrument), 0) AS zero_runs FROM grid GROUP BY 1),
sc AS (SELECT *, greatest(0, 100 - least(missing / expected, 1) * 60 - CASE WHEN longest_zero_run >= 2 THEN 15 ELSE 0 END - CASE WHEN longest_gap >= 2 THEN 10 ELSE 0 END) AS score FROM av)"""


def _available(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    return quality.availability_runs(p.withColumn("zero", F.col("volume") % 4 == 0), joins.calendar_of(p), long_zero=2, long_gap=2)


@query(f"{_AVAILABLE}\nSELECT * FROM sc", floats="score")
def quality_availability_runs(spark, sf_dir):
    """Runs and gaps; a volume divisible by four stands in for a zero volume."""
    return _available(spark, sf_dir)


_ISSUES = f"iss AS (SELECT datetime, instrument, unnest(CASE WHEN r > 0.5 THEN ['a', 'b', 'c'] WHEN r > 0.3 THEN ['a', 'b'] ELSE [] END) AS rule FROM (SELECT datetime, instrument, abs(close / nullif(lag(close) OVER ({W}), 0) - 1) AS r FROM panel))"


@query(f"""
{_AVAILABLE}, {_ISSUES}, n AS (SELECT instrument, count(*) AS issues, count(DISTINCT rule) AS rules FROM iss GROUP BY 1)
SELECT instrument, score, coalesce(issues, 0) AS issues, coalesce(rules, 0) AS rules, longest_gap >= 2 OR longest_zero_run >= 2 AS structural FROM sc LEFT JOIN n USING (instrument) WHERE coalesce(issues, 0) > 0 OR longest_gap >= 2 OR longest_zero_run >= 2""", floats="score")
def quality_abnormal_instruments(spark, sf_dir):
    issues = quality.of_categories(quality.row_issues(monthly_panel(spark, sf_dir)), ["return"])
    return quality.abnormal_instruments(issues, _available(spark, sf_dir), long_zero=2, long_gap=2)


@query(f"""
{_ISSUES}, c AS (SELECT datetime, count(*) / (SELECT count(DISTINCT instrument) FROM panel) AS coverage FROM panel GROUP BY 1), n AS (SELECT datetime, count(*) AS issues, count(DISTINCT instrument) AS instruments, count(DISTINCT rule) AS rules FROM iss GROUP BY 1)
SELECT datetime, coverage, coalesce(issues, 0) AS issues, coalesce(instruments, 0) AS instruments, coalesce(rules, 0) AS rules FROM c LEFT JOIN n USING (datetime) WHERE coalesce(issues, 0) > 0 OR coverage < 1""", floats="coverage")
def quality_abnormal_dates(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    n = p.select("instrument").distinct().count()
    coverage = p.groupBy("datetime").agg((F.count("*") / n).alias("coverage"))
    return quality.abnormal_dates(quality.of_categories(quality.row_issues(p), ["return"]), coverage)


@query(f"""
{LONG}, t AS (SELECT factor, 'label' AS label, value, label AS y FROM long UNION ALL SELECT factor, 'late', value, CASE WHEN year(datetime) > 1998 THEN label END FROM long)
SELECT factor, label, count(*) AS total_rows, count(*) FILTER (WHERE value IS NOT NULL AND y IS NOT NULL) AS valid_rows, count(*) FILTER (WHERE value IS NOT NULL AND y IS NOT NULL) / count(*) AS coverage, 1 - count(*) FILTER (WHERE value IS NOT NULL AND y IS NOT NULL) / count(*) AS missing_rate, count(*) - count(value) AS factor_missing_rows, count(*) - count(y) AS label_missing_rows FROM t GROUP BY 1, 2""", floats="coverage missing_rate")
def quality_factor_coverage(spark, sf_dir):
    w = _wide(spark, sf_dir).withColumn("late", F.when(F.year("datetime") > 1998, F.col("label")))
    return quality.factor_coverage(w, ["rev_1", "kmid", "volume_ratio"], ["label", "late"])


@query(f"""
{LONG}, p AS (SELECT a.factor AS factor_a, b.factor AS factor_b, a.value AS x, b.value AS y FROM long a JOIN long b ON a.datetime = b.datetime AND a.instrument = b.instrument AND a.factor < b.factor WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
r AS (SELECT factor_a, factor_b, rank() OVER (PARTITION BY factor_a, factor_b ORDER BY x) + (count(*) OVER (PARTITION BY factor_a, factor_b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY factor_a, factor_b ORDER BY y) + (count(*) OVER (PARTITION BY factor_a, factor_b, y) - 1) / 2.0 AS ry FROM p)
SELECT factor_a, factor_b, corr(rx, ry) AS spearman, count(*) AS rows FROM r GROUP BY 1, 2""", floats="spearman")
def evaluate_pooled_correlation(spark, sf_dir):
    return evaluate.pooled_correlation(_wide(spark, sf_dir), ["rev_1", "kmid", "volume_ratio"])


# ------------------------------------------------------------------ boards
_WINDOWS = f"""{_splits(False)}, {IC[len(LABEL) + 2 :]}, wm AS (SELECT split_id, factor, avg(rank_ic) FILTER (WHERE fold = 'train') AS train_mean_ic, avg(rank_ic) FILTER (WHERE fold = 'validation') AS validation_mean_ic, count(*) FILTER (WHERE fold = 'train') AS train_count, count(*) FILTER (WHERE fold = 'validation') AS validation_count
  FROM ic JOIN sp USING (datetime) WHERE fate = 'kept' AND status = 'ok' GROUP BY 1, 2), wf AS (SELECT *, abs(train_mean_ic) > 0.01 AS fdr_pass FROM wm),
ws AS (SELECT *, CAST(coalesce(sign(round(train_mean_ic, 9)), 0) AS INTEGER) AS direction, coalesce(sign(round(train_mean_ic, 9)) <> 0 AND sign(round(train_mean_ic, 9)) = sign(round(validation_mean_ic, 9)), false) AS aligned, train_count >= 5 AND validation_count >= 3 AS enough, coalesce(abs(validation_mean_ic) >= 0.02, false) AS strong FROM wf),
wr AS (SELECT *, aligned AND enough AND strong AND fdr_pass AS selected, CASE WHEN aligned AND enough AND strong AND fdr_pass THEN 'selected' ELSE array_to_string(list_filter([CASE WHEN NOT aligned THEN 'direction_mismatch' END, CASE WHEN NOT enough THEN 'insufficient_dates' END, CASE WHEN NOT strong THEN 'weak_validation_ic' END, CASE WHEN NOT fdr_pass THEN 'fdr_not_passed' END], lambda x: x IS NOT NULL), ';') END AS reason FROM ws)"""


def _windows(spark, sf_dir):
    own = _walk(spark, sf_dir, False)[0].where("fate = 'kept'")
    d = splits.by_split(_ic(spark, sf_dir).where("status = 'ok'"), own)
    side = lambda fold: F.when(F.col("fold") == fold, F.col("rank_ic"))
    m = d.groupBy("split_id", "factor").agg(F.avg(side("train")).alias("train_mean_ic"), F.avg(side("validation")).alias("validation_mean_ic"), F.count(side("train")).alias("train_count"), F.count(side("validation")).alias("validation_count"))
    return boards.select_windows(m.withColumn("fdr_pass", F.abs("train_mean_ic") > 0.01), least_ic=0.02, least_train=5, least_validation=3)


@query(f"{_WINDOWS}\nSELECT split_id, factor, direction, selected, reason FROM wr")
def select_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("split_id", "factor", "direction", "selected", "reason")


@query(f"""
{_WINDOWS}, e AS (SELECT * FROM wr WHERE enough), c AS (SELECT factor, direction, count(*) AS n FROM e WHERE direction <> 0 GROUP BY 1, 2), md AS (SELECT factor, arg_max(direction, (n, -direction)) AS direction, max(n) / sum(n) AS agreement FROM c GROUP BY 1),
s AS (SELECT factor, count(*) AS windows, count(*) FILTER (WHERE enough) AS eligible, avg(CASE WHEN selected THEN 1.0 ELSE 0.0 END) FILTER (WHERE enough) AS frequency, avg(CASE WHEN round(validation_mean_ic * direction, 9) > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE enough) AS positive, min(abs(validation_mean_ic) - abs(train_mean_ic)) FILTER (WHERE selected) AS worst, bool_and(fdr_pass) AS fdr FROM wr GROUP BY 1)
SELECT factor, windows, eligible, coalesce(frequency, 0) AS frequency, coalesce(direction, 0) AS direction, coalesce(agreement, 0) AS agreement, coalesce(positive, 0) AS positive, worst,
  CASE WHEN fdr AND eligible >= 3 AND frequency >= 0.6 AND agreement >= 0.8 AND positive >= 0.6 AND worst >= -0.03 THEN 'stable_core' WHEN eligible >= 3 AND frequency >= 0.3 AND fdr THEN 'conditional_signal' WHEN eligible = 0 OR NOT fdr THEN 'holdout' ELSE 'monitor' END AS role FROM s LEFT JOIN md USING (factor)""", floats="frequency agreement positive worst")
def select_stability_board(spark, sf_dir):
    return boards.stability_board(_windows(spark, sf_dir))
