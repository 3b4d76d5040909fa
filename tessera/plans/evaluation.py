"""Queries over factor evaluation, statistics, boards, redundancy, scores and portfolios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import ts, xs
from tessera.operators import evaluate, joins, linear, portfolio, stats
from tessera.plans.base import query
from tessera.plans.panel import LABEL
from tessera.sources.panel import KEYS, monthly_panel

W = "PARTITION BY instrument ORDER BY datetime"

#: (datetime, instrument, factor, value, label) of three factors and the one-month label.
LONG = f"""{LABEL}, fac AS (SELECT datetime, instrument, -(close / nullif(lag(close) OVER ({W}), 0) - 1) AS rev_1, volume / nullif(lag(volume) OVER ({W}), 0) AS volume_ratio, (close - open) / nullif(open, 0) AS kmid FROM panel),
wide AS (SELECT f.*, label FROM fac f LEFT JOIN lab USING (datetime, instrument)),
long AS (SELECT datetime, instrument, 'rev_1' AS factor, rev_1 AS value, label FROM wide UNION ALL SELECT datetime, instrument, 'volume_ratio', volume_ratio, label FROM wide UNION ALL SELECT datetime, instrument, 'kmid', kmid, label FROM wide)"""

IC = f"""{LONG}, valid AS (SELECT * FROM long WHERE value IS NOT NULL AND label IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY datetime, factor ORDER BY value) + (count(*) OVER (PARTITION BY datetime, factor, value) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY datetime, factor ORDER BY label) + (count(*) OVER (PARTITION BY datetime, factor, label) - 1) / 2.0 AS rl FROM valid),
ic AS (SELECT datetime, factor, CASE WHEN count(*) >= 5 THEN corr(value, label) END AS ic, CASE WHEN count(*) >= 5 THEN corr(rv, rl) END AS rank_ic, count(*) AS pairs, CASE WHEN count(*) < 5 THEN 'insufficient' ELSE 'ok' END AS status FROM ranked GROUP BY 1, 2)"""


def _wide(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    p = joins.position_label(p, joins.calendar_of(p), 1, 1)
    c, v = F.col("close"), F.col("volume")
    return p.select(*KEYS, (-ts.change(c)).alias("rev_1"), (ts.change(v) + 1).alias("volume_ratio"), ((c - F.col("open")) / F.col("open")).alias("kmid"), "label")


def _long(spark, sf_dir):
    return _wide(spark, sf_dir).unpivot([*KEYS, "label"], ["rev_1", "volume_ratio", "kmid"], "factor", "value")


def _ic(spark, sf_dir):
    return evaluate.daily_ic(_long(spark, sf_dir), 5)


@query(f"{IC}\nSELECT datetime, factor, rank_ic, pairs FROM ic WHERE factor = 'rev_1' AND status = 'ok'", floats="rank_ic")
def flagship_reversal(spark, sf_dir):
    """Does last month's unit-price reversal predict the next month's return across suppliers?"""
    wide = _wide(spark, sf_dir).select(*KEYS, F.lit("rev_1").alias("factor"), F.col("rev_1").alias("value"), "label")
    return evaluate.daily_ic(wide, 5).where("status = 'ok'").select("datetime", "factor", "rank_ic", "pairs")


@query(f"{IC}\nSELECT * FROM ic", floats="ic rank_ic")
def evaluate_daily_ic(spark, sf_dir):
    return _ic(spark, sf_dir)


@query(f"""
{IC}
SELECT factor, count(*) AS days, avg(ic) AS ic_mean, avg(ic) / stddev_samp(ic) AS icir, avg(rank_ic) AS rank_ic_mean, avg(rank_ic) / stddev_samp(rank_ic) AS rank_icir, avg(CASE WHEN round(rank_ic, 9) > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(pairs) AS mean_pairs FROM ic WHERE status = 'ok' GROUP BY 1""", floats="ic_mean icir rank_ic_mean rank_icir win_rate mean_pairs")
def evaluate_ic_summary(spark, sf_dir):
    return evaluate.ic_summary(_ic(spark, sf_dir))


GROUPS = f"""{LONG}, rows_ AS (SELECT *, quantile_cont(rev_1, [0.2, 0.4, 0.6, 0.8]) OVER (PARTITION BY datetime) AS e, count(*) OVER (PARTITION BY datetime) AS n FROM wide WHERE rev_1 IS NOT NULL AND label IS NOT NULL),
grp AS (SELECT datetime, CAST(1 + len(list_filter(e, lambda x: x < rev_1)) AS INTEGER) AS bucket, avg(label) AS mean_label, count(*) AS members FROM rows_ WHERE n >= 5 GROUP BY 1, 2)"""


@query(f"{GROUPS}\nSELECT * FROM grp", floats="mean_label")
def evaluate_group_returns(spark, sf_dir):
    return evaluate.group_returns(_wide(spark, sf_dir), "rev_1", "label", 5)


@query(f"""
{GROUPS}, m AS (SELECT bucket, avg(mean_label) AS m FROM grp GROUP BY 1), s AS (SELECT bucket, m, rank() OVER (ORDER BY m) AS r, m >= lag(m) OVER (ORDER BY bucket) AS up FROM m)
SELECT corr(bucket, r) AS monotonicity, count(*) FILTER (WHERE up) AS steps_up, arg_max(m, bucket) - arg_min(m, bucket) AS spread FROM s""", floats="monotonicity spread")
def evaluate_monotonicity(spark, sf_dir):
    return evaluate.monotonicity(evaluate.group_returns(_wide(spark, sf_dir), "rev_1", "label", 5))


@query(f"""
{LONG}, b AS (SELECT datetime, instrument, quantile_cont(rev_1, [0.2, 0.4, 0.6, 0.8]) OVER (PARTITION BY datetime) AS e, count(*) OVER (PARTITION BY datetime) AS n, rev_1 FROM wide WHERE rev_1 IS NOT NULL),
top AS (SELECT datetime, instrument FROM b WHERE n >= 5 AND 1 + len(list_filter(e, lambda x: x < rev_1)) = 5), d AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS k FROM (SELECT DISTINCT datetime FROM top)), h AS (SELECT datetime, instrument, k FROM top JOIN d USING (datetime))
SELECT a.datetime, count(*) AS size, count(*) FILTER (WHERE b.k IS NULL) AS entered, count(*) FILTER (WHERE b.k IS NULL) / count(*) AS turnover FROM h a LEFT JOIN h b ON a.instrument = b.instrument AND a.k = b.k + 1 WHERE a.k > 1 GROUP BY 1""", floats="turnover")
def evaluate_turnover(spark, sf_dir):
    return evaluate.turnover(_wide(spark, sf_dir), "rev_1", 5)


PAIRS = f"""{LONG}, both_ AS (SELECT a.datetime, a.factor AS factor_a, b.factor AS factor_b, a.value AS x, b.value AS y FROM long a JOIN long b ON a.datetime = b.datetime AND a.instrument = b.instrument AND a.factor < b.factor WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY datetime, factor_a, factor_b ORDER BY x) + (count(*) OVER (PARTITION BY datetime, factor_a, factor_b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY datetime, factor_a, factor_b ORDER BY y) + (count(*) OVER (PARTITION BY datetime, factor_a, factor_b, y) - 1) / 2.0 AS ry FROM both_),
pc AS (SELECT datetime, factor_a, factor_b, CASE WHEN count(*) >= 5 THEN corr(rx, ry) END AS rho, count(*) AS common, CASE WHEN count(*) < 5 THEN 'insufficient' ELSE 'ok' END AS reason FROM rk GROUP BY 1, 2, 3)"""


@query(f"{PAIRS}\nSELECT * FROM pc", floats="rho")
def similarity_daily_pairs(spark, sf_dir):
    return evaluate.pair_correlation(_long(spark, sf_dir), 5)


@query(f"{PAIRS}\nSELECT factor_a, factor_b, count(*) AS days, avg(rho) AS mean_rho, median(rho) AS median_rho, quantile_cont(rho, 0.1) AS p10, avg(CASE WHEN round(rho, 9) > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM pc WHERE reason = 'ok' GROUP BY 1, 2", floats="mean_rho median_rho p10 positive")
def similarity_pair_reduction(spark, sf_dir):
    pc = evaluate.pair_correlation(_long(spark, sf_dir), 5).where("reason = 'ok'")
    return pc.groupBy("factor_a", "factor_b").agg(F.count("*").alias("days"), F.avg("rho").alias("mean_rho"), F.percentile("rho", F.lit(0.5)).alias("median_rho"), F.percentile("rho", F.lit(0.1)).alias("p10"), F.avg((F.round("rho", 9) > 0).cast("double")).alias("positive"))


@query(f"""
{LONG}, w AS (SELECT *, rev_1 - avg(rev_1) OVER (PARTITION BY datetime) AS d FROM wide WHERE rev_1 IS NOT NULL AND label IS NOT NULL)
SELECT datetime, sum(d * label) / nullif(sum(abs(d)), 0) AS factor_return, avg(label) AS universe_return FROM w GROUP BY 1""", floats="factor_return universe_return")
def evaluate_factor_returns(spark, sf_dir):
    return evaluate.factor_returns(_wide(spark, sf_dir), "rev_1", "label")


@query(f"""
{LONG}, r AS (SELECT datetime, instrument, rank() OVER (PARTITION BY datetime ORDER BY kmid) + (count(*) OVER (PARTITION BY datetime, kmid) - 1) / 2.0 AS r FROM wide WHERE kmid IS NOT NULL), h AS (SELECT r.*, pos FROM r JOIN cal USING (datetime))
SELECT a.datetime, corr(a.r, b.r) AS autocorrelation FROM h a JOIN h b ON a.instrument = b.instrument AND a.pos = b.pos + 1 GROUP BY 1""", floats="autocorrelation")
def evaluate_rank_autocorrelation(spark, sf_dir):
    return evaluate.rank_autocorrelation(_wide(spark, sf_dir), "kmid", 1)


@query(f"""
{LONG}, s AS (SELECT *, floor(count(*) OVER (PARTITION BY datetime) * 0.2) AS n, row_number() OVER (PARTITION BY datetime ORDER BY rev_1 DESC, instrument) AS hi, row_number() OVER (PARTITION BY datetime ORDER BY rev_1, instrument) AS lo FROM wide WHERE rev_1 IS NOT NULL AND label IS NOT NULL)
SELECT datetime, avg(label) FILTER (WHERE hi <= n) AS long, avg(label) FILTER (WHERE lo <= n) AS short, count(*) FILTER (WHERE hi <= n) AS members, avg(label) FILTER (WHERE hi <= n) - avg(label) FILTER (WHERE lo <= n) AS spread FROM s GROUP BY 1 HAVING count(*) FILTER (WHERE hi <= n) > 0""", floats="long short spread")
def portfolio_long_short(spark, sf_dir):
    return evaluate.long_short(_wide(spark, sf_dir), "rev_1", "label", 0.2)


TOPK = f"""{LONG}, s AS (SELECT *, avg(label) OVER (PARTITION BY datetime) AS u, row_number() OVER (PARTITION BY datetime ORDER BY rev_1 DESC, instrument) AS r FROM wide WHERE rev_1 IS NOT NULL AND label IS NOT NULL),
t AS (SELECT * FROM s WHERE r <= 10), d AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS k FROM (SELECT DISTINCT datetime FROM t)), h AS (SELECT t.*, k FROM t JOIN d USING (datetime)),
day AS (SELECT a.datetime, a.k, avg(a.label) AS gross, count(*) AS members, CASE WHEN a.k = 1 THEN 1.0 ELSE 1 - count(b.k) / count(*) END AS turnover, any_value(a.u) AS u FROM h a LEFT JOIN h b ON a.instrument = b.instrument AND a.k = b.k + 1 GROUP BY 1, 2),
daily AS (SELECT datetime, gross, members, turnover, gross - turnover * 10 / 10000 AS net, gross - turnover * 10 / 10000 - u AS excess FROM day)"""


def _topk(spark, sf_dir):
    return portfolio.top_k(_wide(spark, sf_dir), "rev_1", "label", 10, 10.0)


@query(f"{TOPK}\nSELECT * FROM daily", floats="gross turnover net excess")
def portfolio_top_k(spark, sf_dir):
    return _topk(spark, sf_dir)


@query(f"""
{TOPK}, g AS (SELECT *, product(1 + net) OVER (ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS g FROM daily), t2 AS (SELECT *, greatest(max(g) OVER (ORDER BY datetime ROWS UNBOUNDED PRECEDING), 1) AS top FROM g)
SELECT 'top_10' AS method, count(*) AS days, pow(greatest(product(1 + net), 0), 12.0 / count(*)) - 1 AS annual_return, avg(net) / stddev_samp(net) * sqrt(12.0) AS information_ratio, min(g / top - 1) AS max_drawdown, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM t2""", floats="annual_return information_ratio max_drawdown win_rate")
def portfolio_performance(spark, sf_dir):
    return portfolio.performance(_topk(spark, sf_dir).withColumn("method", F.lit("top_10")), "net", 12)


@query(f"{TOPK}\nSELECT datetime, CAST(b AS DOUBLE) AS bps, gross - turnover * b / 10000 AS net FROM daily, (SELECT unnest([0.0, 10.0, 30.0]) AS b)", floats="bps net")
def portfolio_cost_grid(spark, sf_dir):
    return portfolio.cost_grid(_topk(spark, sf_dir), [0, 10, 30])


@query("""
SELECT datetime, instrument, amount * 0.1 / 0.05 AS capacity, CAST(floor(100000 / (close * 100)) * 100 AS BIGINT) AS lots, greatest(amount * 0.0003, 5) AS fee, CAST(round(CAST(close AS DECIMAL(18,4)) * CAST(0.9 AS DECIMAL(6,4)), 2) AS DOUBLE) AS low_bound, CAST(round(CAST(close AS DECIMAL(18,4)) * CAST(1.1 AS DECIMAL(6,4)), 2) AS DOUBLE) AS high_bound FROM panel""", floats="capacity fee low_bound high_bound")
def portfolio_costs_and_bounds(spark, sf_dir):
    low, high = portfolio.tick_bounds(F.col("close"), 0.1)
    return monthly_panel(spark, sf_dir).select(*KEYS, portfolio.capacity(F.col("amount"), F.lit(0.05), 0.1).alias("capacity"), portfolio.lots(F.lit(100000.0), F.col("close")).cast("long").alias("lots"), portfolio.fee(F.col("amount"), 0.0003, 5.0).alias("fee"), low.cast("double").alias("low_bound"), high.cast("double").alias("high_bound"))


@query(f"""
{LONG}, w(factor, weight) AS (VALUES ('rev_1', 0.5), ('kmid', -0.3), ('volume_ratio', 0.2)),
z AS (SELECT datetime, instrument, factor, CASE WHEN value IS NOT NULL AND max(value) OVER (PARTITION BY datetime, factor) > min(value) OVER (PARTITION BY datetime, factor) THEN greatest(least((value - avg(value) OVER (PARTITION BY datetime, factor)) / stddev_samp(value) OVER (PARTITION BY datetime, factor), 3), -3) END AS z FROM long)
SELECT datetime, instrument, CASE WHEN count(*) >= 2 THEN sum(z * weight) / sum(abs(weight)) END AS score, count(*) AS parts FROM z JOIN w USING (factor) WHERE z IS NOT NULL GROUP BY 1, 2""", floats="score")
def score_composite(spark, sf_dir):
    weights = spark.createDataFrame([("rev_1", 0.5), ("kmid", -0.3), ("volume_ratio", 0.2)], "factor string, weight double")
    return portfolio.composite(_long(spark, sf_dir), weights, 2)


@query(f"""
{IC}, p AS (SELECT factor, CASE WHEN year(datetime) < 1998 THEN 'early' ELSE 'late' END AS family, count(*) AS days, avg(rank_ic) AS m, stddev_samp(rank_ic) AS s FROM ic WHERE status = 'ok' GROUP BY 1, 2),
q AS (SELECT family, factor, least(1.0, round(1 / (1 + abs(m / s * sqrt(days))), 9)) AS p FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, factor) AS i, count(*) OVER (PARTITION BY family) AS m FROM q),
h AS (SELECT *, sum(1.0 / i) OVER (PARTITION BY family) AS h, min(p * m / i) OVER (PARTITION BY family ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM r)
SELECT family, factor, p, least(q, 1.0) AS q_bh, least(q * h, 1.0) AS q_by, least(max((m - i + 1) * p) OVER (PARTITION BY family ORDER BY i ROWS UNBOUNDED PRECEDING), 1.0) AS p_holm FROM h""", floats="p q_bh q_by p_holm")
def stats_multiple_testing(spark, sf_dir):
    d = _ic(spark, sf_dir).where("status = 'ok'").withColumn("family", F.when(F.year("datetime") < 1998, "early").otherwise("late"))
    t = d.groupBy("family", "factor").agg(F.count("*").alias("days"), F.avg("rank_ic").alias("m"), F.stddev_samp("rank_ic").alias("s"))
    t = t.select("family", "factor", F.least(F.lit(1.0), F.round(1 / (1 + F.abs(F.col("m") / F.col("s") * F.sqrt("days"))), 9)).alias("p"))
    return stats.holm(stats.benjamini(t))


HAC = f"""{IC}, n AS (SELECT factor, rank_ic, row_number() OVER (PARTITION BY factor ORDER BY datetime) AS pos FROM ic WHERE status = 'ok'), d AS (SELECT factor, rank_ic, rank_ic - avg(rank_ic) OVER (PARTITION BY factor) AS d, pos FROM n)"""


@query(f"""
{HAC}, l AS (SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2, lag(d, 3) OVER w AS d3 FROM d WINDOW w AS (PARTITION BY factor ORDER BY pos)),
s AS (SELECT factor, count(*) AS days, avg(rank_ic) AS mean, sum(d * d + 2 * 0.75 * d * coalesce(d1, 0) + 2 * 0.5 * d * coalesce(d2, 0) + 2 * 0.25 * d * coalesce(d3, 0)) AS v FROM l GROUP BY 1)
SELECT factor, days, mean, sqrt(greatest(v, 0)) / days AS standard_error, mean / nullif(sqrt(greatest(v, 0)) / days, 0) AS t FROM s""", floats="mean standard_error t")
def stats_hac_mean(spark, sf_dir):
    return stats.hac_mean(_ic(spark, sf_dir).where("status = 'ok'"), "rank_ic", 3).drop("p")


@query(f"""
{HAC}
SELECT a.factor, CAST(b.pos - a.pos AS INTEGER) AS lag, sum(a.d * b.d) / any_value(v) AS autocorrelation FROM d a JOIN d b ON a.factor = b.factor AND b.pos - a.pos BETWEEN 1 AND 3 JOIN (SELECT factor, sum(d * d) AS v FROM d GROUP BY 1) t ON t.factor = a.factor GROUP BY 1, 2""", floats="autocorrelation")
def stats_autocorrelation(spark, sf_dir):
    return stats.autocorrelations(_ic(spark, sf_dir).where("status = 'ok'"), "rank_ic", 3)


@query(f"""
{HAC}, r AS (SELECT a.factor, b.pos - a.pos AS lag, sum(a.d * b.d) / any_value(v) AS r FROM d a JOIN d b ON a.factor = b.factor AND b.pos - a.pos BETWEEN 1 AND 3 JOIN (SELECT factor, sum(d * d) AS v FROM d GROUP BY 1) t ON t.factor = a.factor GROUP BY 1, 2),
i AS (SELECT factor, greatest(1 + 2 * sum((1 - lag / 4.0) * r), 1e-9) AS inflation FROM r GROUP BY 1), n2 AS (SELECT factor, count(*) AS days FROM d GROUP BY 1)
SELECT factor, days, inflation, days / inflation AS effective FROM n2 JOIN i USING (factor)""", floats="inflation effective")
def stats_effective_size(spark, sf_dir):
    return stats.effective_size(_ic(spark, sf_dir).where("status = 'ok'"), "rank_ic", 3)


@query("""
w AS (SELECT datetime, close, sum(amount) OVER (PARTITION BY datetime ORDER BY close, instrument ROWS UNBOUNDED PRECEDING) AS r, sum(amount) OVER (PARTITION BY datetime) AS t FROM panel)
SELECT datetime, min(close) AS weighted_median FROM w WHERE r * 2 >= t GROUP BY 1""", floats="weighted_median")
def stats_weighted_median(spark, sf_dir):
    return stats.weighted_median(monthly_panel(spark, sf_dir), "close", "amount", ["datetime"], "instrument")


BOARD = f"""{IC}, board AS (SELECT factor, count(*) AS days, avg(rank_ic) AS rank_ic_mean, avg(CASE WHEN round(rank_ic, 9) > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM ic WHERE status = 'ok' GROUP BY 1)"""


@query(f"""
{BOARD}, r AS (SELECT *, array_to_string(list_filter([CASE WHEN days < 50 THEN 'few_days' END, CASE WHEN abs(rank_ic_mean) < 0.02 THEN 'weak_ic' END, CASE WHEN greatest(win_rate, 1 - win_rate) < 0.55 THEN 'unstable_sign' END], lambda x: x IS NOT NULL), '|') AS reasons FROM board)
SELECT factor, days, reasons, CASE WHEN reasons = '' THEN 'promote' WHEN len(string_split(reasons, '|')) = 1 THEN 'watch' ELSE 'reject' END AS decision FROM r""")
def select_candidates(spark, sf_dir):
    return portfolio.decision(evaluate.ic_summary(_ic(spark, sf_dir)), least_ic=0.02, least_days=50, least_win=0.55).select("factor", "days", "reasons", "decision")


@query(f"""
{BOARD}, m AS (SELECT factor, 'win_rate' AS metric, win_rate AS value FROM board UNION ALL SELECT factor, 'rank_ic_mean', rank_ic_mean FROM board), rules(rule, metric, op, threshold) AS (VALUES ('wins', 'win_rate', '>=', 0.5), ('strong', 'rank_ic_mean', 'abs>=', 0.02), ('negative', 'rank_ic_mean', '<=', 0.0))
SELECT factor, rule, CASE op WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold ELSE abs(value) >= threshold END AS passed FROM m JOIN rules USING (metric)""")
def select_rule_table(spark, sf_dir):
    rules = spark.createDataFrame([("wins", "win_rate", ">=", 0.5), ("strong", "rank_ic_mean", "abs>=", 0.02), ("negative", "rank_ic_mean", "<=", 0.0)], "rule string, metric string, op string, threshold double")
    board = evaluate.ic_summary(_ic(spark, sf_dir)).unpivot(["factor"], ["win_rate", "rank_ic_mean"], "metric", "value")
    return portfolio.apply_rules(board, rules)


#: Edges between instruments whose closes are close on many dates stand in for correlated factors.
EDGES = "e AS (SELECT a.instrument AS a, b.instrument AS b FROM panel a JOIN panel b ON a.datetime = b.datetime AND a.instrument < b.instrument WHERE abs(a.close - b.close) < 50 GROUP BY 1, 2 HAVING count(*) >= 3)"


NEAR = {"width": 50, "least": 3}


@query(f"""
{EDGES}, both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (SELECT a AS node, a AS reached FROM both_ UNION SELECT w.node, b.b FROM walk w JOIN both_ b ON w.reached = b.a)
SELECT node, min(reached) AS "group" FROM walk GROUP BY 1""")
def select_redundancy_groups(spark, sf_dir):
    return portfolio.near_groups(monthly_panel(spark, sf_dir), **NEAR)


@query(f"""
{LONG}, t AS (SELECT datetime, instrument FROM (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY rev_1 DESC, instrument) AS r FROM wide WHERE rev_1 IS NOT NULL) WHERE r <= 20),
g AS (SELECT t.*, pos, pos - row_number() OVER (PARTITION BY instrument ORDER BY pos) AS i FROM t JOIN cal USING (datetime))
SELECT instrument, min(datetime) AS start_date, max(datetime) AS end_date, count(*) AS duration, max(datetime) = (SELECT max(datetime) FROM cal) AS censored FROM g GROUP BY instrument, i""")
def evaluate_spells(spark, sf_dir):
    w = _wide(spark, sf_dir).where("rev_1 is not null")
    held = w.withColumn("r", F.row_number().over(Window.partitionBy("datetime").orderBy(F.desc("rev_1"), "instrument"))).where("r <= 20")
    return evaluate.spells(held, joins.calendar_of(monthly_panel(spark, sf_dir))).select("instrument", F.col("start").alias("start_date"), F.col("end").alias("end_date"), "duration", "censored")


@query(f"""
{IC}, b AS (SELECT w.*, quantile_cont(v.amount, [1.0::DOUBLE / 3, 2.0::DOUBLE / 3]) OVER (PARTITION BY w.datetime) AS e, v.amount FROM wide w JOIN panel v USING (datetime, instrument)),
c AS (SELECT datetime, instrument, CAST(1 + len(list_filter(e, lambda x: x < amount)) AS INTEGER) AS bucket, rev_1, label FROM b WHERE rev_1 IS NOT NULL AND label IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY datetime, bucket ORDER BY rev_1) + (count(*) OVER (PARTITION BY datetime, bucket, rev_1) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY datetime, bucket ORDER BY label) + (count(*) OVER (PARTITION BY datetime, bucket, label) - 1) / 2.0 AS rl FROM c),
d AS (SELECT datetime, bucket, corr(rv, rl) AS x FROM r GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT bucket, count(*) AS days, avg(x) AS rank_ic_mean FROM d GROUP BY 1""", floats="rank_ic_mean")
def evaluate_bucket_ic(spark, sf_dir):
    w = _wide(spark, sf_dir).join(monthly_panel(spark, sf_dir).select(*KEYS, "amount"), KEYS)
    b = xs.bucket(w, "amount", "bucket", 3).select(*KEYS, "bucket", F.lit("rev_1").alias("factor"), F.col("rev_1").alias("value"), "label")
    return evaluate.daily_ic(b, 5, ("bucket",)).where("status = 'ok'").groupBy("bucket").agg(F.count("*").alias("days"), F.avg("rank_ic").alias("rank_ic_mean"))


@query(f"""
{IC}
SELECT factor, CAST(year(datetime) AS INTEGER) AS year, count(*) AS days, avg(rank_ic) AS mean, median(rank_ic) AS median FROM ic WHERE status = 'ok' GROUP BY 1, 2""", floats="mean median")
def evaluate_year_slices(spark, sf_dir):
    return _ic(spark, sf_dir).where("status = 'ok'").groupBy("factor", F.year("datetime").alias("year")).agg(F.count("*").alias("days"), F.avg("rank_ic").alias("mean"), F.percentile("rank_ic", F.lit(0.5)).alias("median"))


_FEATURES = ["rev_1", "volume_ratio", "kmid"]


@query(f"""
{LONG}, tr AS (SELECT rev_1 AS x1, volume_ratio AS x2, kmid AS x3, label AS y FROM wide WHERE datetime < DATE '1999-01-01' AND rev_1 IS NOT NULL AND volume_ratio IS NOT NULL AND kmid IS NOT NULL AND label IS NOT NULL),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my, stddev_samp(x1) AS s1, stddev_samp(x2) AS s2, stddev_samp(x3) AS s3 FROM tr),
z AS (SELECT (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, (x3 - m3) / s3 AS z3, y - my AS y FROM tr, m),
g AS (SELECT sum(z1 * z1) + 1 AS a, sum(z1 * z2) AS b, sum(z1 * z3) AS c, sum(z2 * z2) + 1 AS d, sum(z2 * z3) AS e, sum(z3 * z3) + 1 AS f, sum(z1 * y) AS t1, sum(z2 * y) AS t2, sum(z3 * y) AS t3 FROM z),
w AS (SELECT ((d * f - e * e) * t1 + (c * e - b * f) * t2 + (b * e - c * d) * t3) / det AS w1, ((c * e - b * f) * t1 + (a * f - c * c) * t2 + (b * c - a * e) * t3) / det AS w2,
             ((b * e - c * d) * t1 + (b * c - a * e) * t2 + (a * d - b * b) * t3) / det AS w3 FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM g))
SELECT datetime, instrument, my + w1 * (rev_1 - m1) / s1 + w2 * (volume_ratio - m2) / s2 + w3 * (kmid - m3) / s3 AS prediction
FROM wide, m, w WHERE datetime >= DATE '1999-01-01' AND rev_1 IS NOT NULL AND volume_ratio IS NOT NULL AND kmid IS NOT NULL""", floats="prediction")
def model_ridge(spark, sf_dir):
    """Ridge on early dates, predictions for later ones; the SQL solves the normal equations by cofactors."""
    w = _wide(spark, sf_dir)
    return portfolio.ridge(w.where("datetime < date'1999-01-01'"), w.where("datetime >= date'1999-01-01'"), _FEATURES, "label", 1.0)


def elastic_net(rows, penalties):
    """Models by split, their validation, the chosen ones and these on the test rows."""
    models = linear.fit(rows.where("role = 'train'"), _FEATURES, "label", penalties)
    validation = linear.scored(linear.predict(rows.where("role = 'validation'"), _FEATURES, models), "label")
    chosen = linear.choose(models, validation)
    return models, validation, chosen, linear.scored(linear.predict(rows.where("role = 'test'"), _FEATURES, chosen), "label")


SPLITS = {str(y): (f"{y - 1}-01-01", f"{y}-01-01", f"{y + 1}-01-01") for y in (1998, 1999, 2000)}
PENALTIES = [linear.Penalty(a, l1) for l1 in (0.1, 0.5, 0.9) for a in (0.0001, 0.001, 0.01, 0.1)]


@query()
def model_elastic_net(spark, sf_dir):
    """Elastic nets on three date splits: the penalty with the best validation coefficient, and its coefficient on later dates."""
    _, _, chosen, test = elastic_net(linear.on_splits(_wide(spark, sf_dir), SPLITS, 2), PENALTIES)
    used = F.size(F.filter("coefficients", lambda c: c != 0)).alias("used")
    best = chosen.select("split", "candidate", "alpha", "l1_ratio", F.col("mean_ic").alias("validation_ic"), used)
    return best.join(test.select("split", F.col("mean_ic").alias("test_ic"), "ic_ir", "days", "coverage"), "split", "left").drop("candidate")


@query(f"""
{LONG}, v AS (SELECT factor, datetime, instrument, value, 1.0 / count(*) OVER (PARTITION BY datetime, factor) AS weight FROM long),
r AS (SELECT factor, value, sum(weight) OVER (PARTITION BY factor ORDER BY value, instrument ROWS UNBOUNDED PRECEDING) AS r, sum(weight) OVER (PARTITION BY factor) AS t FROM v WHERE value IS NOT NULL),
c AS (SELECT factor, min(value) AS center FROM r WHERE r * 2 >= t GROUP BY 1), f AS (SELECT v.factor, center, coalesce(value, center) AS x, weight FROM v JOIN c USING (factor)),
m AS (SELECT factor, any_value(center) AS center, sum(x * weight) / sum(weight) AS mean, sum(x * x * weight) / sum(weight) AS sq FROM f GROUP BY 1)
SELECT factor, center, mean, sqrt(greatest(sq - mean * mean, 0)) AS deviation FROM m""", floats="center mean deviation")
def model_preprocessing_fit(spark, sf_dir):
    return portfolio.fit_preprocessing(_long(spark, sf_dir))
