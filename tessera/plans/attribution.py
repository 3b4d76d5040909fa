"""Queries over attribution, comparison of methods, evidence and selection boards, and scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import xs
from tessera.functions.recurrence import exponential
from tessera.operators import attribution, boards, evaluate, joins, portfolio, quality
from tessera.plans.base import query
from tessera.plans.evaluation import IC, LONG, PAIRS, _ic, _long, _wide
from tessera.plans.research import _EXPOSED, _LIQUID, _exposed, _liquid, _splits, _walk
from tessera.sources.panel import KEYS, join_features, monthly_panel

W = "PARTITION BY instrument ORDER BY datetime"
D = "PARTITION BY datetime"


def _rank(x: str, by: str = "datetime") -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


def _spearman(source: str, x: str, y: str, by: str, least: int, into: str) -> str:
    """CTEs that end in ``into``: by, rho and n of rows that have both."""
    return f"""{into}_r AS (SELECT {by}, {_rank(x, by)} AS rx, {_rank(y, by)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL), {into} AS (SELECT {by}, corr(rx, ry) AS rho, count(*) AS n FROM {into}_r GROUP BY ALL HAVING count(*) >= {least} AND stddev_samp(rx) > 0 AND stddev_samp(ry) > 0)"""


@query(f"""
{LONG}, {_spearman('long', 'value', 'label', 'datetime, factor', 5, 'sp')}, m AS (SELECT datetime, factor, count(*) - count(value) AS factor_missing, count(*) - count(label) AS label_missing, count(*) FILTER (WHERE value IS NOT NULL AND label IS NOT NULL) AS pairs FROM long GROUP BY 1, 2)
SELECT m.datetime, m.factor, factor_missing, label_missing, rho AS rank_ic, pairs FROM m LEFT JOIN sp ON sp.datetime = m.datetime AND sp.factor = m.factor""", floats="rank_ic")
def evaluate_pairwise_missing(spark, sf_dir):
    return attribution.pairwise_ic(_long(spark, sf_dir), 5)


@query(f"""
{IC}, s AS (SELECT *, sign(round(avg(rank_ic) OVER (PARTITION BY factor), 9)) AS d FROM ic WHERE rank_ic IS NOT NULL)
SELECT factor, CAST(d AS DOUBLE) AS direction, count(*) AS days, avg(rank_ic) AS rank_ic_mean, avg(rank_ic * d) AS directional_mean, avg(CASE WHEN round(rank_ic * d, 9) > 0 THEN 1.0 ELSE 0.0 END) AS directional_win_rate, count(*) / (SELECT count(*) FROM cal) AS coverage FROM s GROUP BY 1, 2""", floats="direction rank_ic_mean directional_mean directional_win_rate coverage")
def evaluate_directional_summary(spark, sf_dir):
    dates = joins.calendar_of(monthly_panel(spark, sf_dir)).count()
    return attribution.directional_summary(_ic(spark, sf_dir), dates)


@query(f"""
{_EXPOSED}, lo AS (SELECT datetime, 'kmid' AS factor, kmid AS value, lam, width FROM ex UNION ALL SELECT datetime, 'rev_1', rev_1, lam, width FROM ex), {_spearman('lo', 'value', 'lam', 'datetime, factor', 5, 'a')}, {_spearman('lo', 'value', 'width', 'datetime, factor', 5, 'b')}, u AS (SELECT 'size' AS exposure, * FROM a UNION ALL SELECT 'width', * FROM b)
SELECT factor, exposure, count(*) AS days, avg(rho) AS mean_rho, avg(abs(rho)) AS mean_abs_rho FROM u GROUP BY 1, 2""", floats="mean_rho mean_abs_rho")
def evaluate_exposure_correlation(spark, sf_dir):
    e = _exposed(spark, sf_dir).unpivot([*KEYS, "lam", "width"], ["kmid", "rev_1"], "factor", "value")
    return attribution.exposure_correlation(e, {"size": "lam", "width": "width"}, 5)


@query(f"""
{LONG}, e AS (SELECT datetime, instrument, factor, value, label, quantile_cont(value, [0.5]) OVER (PARTITION BY datetime, factor) AS e, count(*) OVER (PARTITION BY datetime, factor) AS n, min(value) OVER (PARTITION BY datetime, factor) AS lo, max(value) OVER (PARTITION BY datetime, factor) AS hi FROM long WHERE value IS NOT NULL),
q AS (SELECT *, CASE WHEN n >= 2 AND lo < hi THEN CAST(1 + len(list_filter(list_filter(e, lambda x: x > lo AND x < hi), lambda x: x < value)) AS INTEGER) END AS b FROM e), u AS (SELECT datetime, instrument, factor, 'label' AS label, value, b, label AS y FROM q UNION ALL SELECT datetime, instrument, factor, 'double', value, b, 2 * label FROM q)
SELECT datetime, instrument, factor, label, value AS factor_value, b AS factor_quantile, y AS forward_return FROM u WHERE y IS NOT NULL""", floats="factor_value forward_return")
def evaluate_long_table(spark, sf_dir):
    return attribution.evaluator_table(_wide(spark, sf_dir).withColumn("double", F.col("label") * 2), ["rev_1", "kmid", "volume_ratio"], ["label", "double"], 2)


@query(f"""
{LONG}, v AS (SELECT *, list_sort(list_distinct(quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]) OVER (PARTITION BY datetime, factor))) AS e, count(*) OVER (PARTITION BY datetime, factor) AS n FROM long WHERE value IS NOT NULL AND label IS NOT NULL),
b AS (SELECT *, CASE WHEN n >= 4 AND len(e) > 1 THEN 1 + len(list_filter(list_slice(e, 2, len(e) - 1), lambda x: x < value)) END AS b FROM v), s AS (SELECT datetime, factor, count(*) AS pairs, count(DISTINCT value) AS distinct_values, count(DISTINCT b) AS buckets FROM b GROUP BY 1, 2)
SELECT *, pairs >= 6 AND distinct_values > 1 AS ic_day, pairs >= 6 AND distinct_values > 1 AND buckets = 4 AS bucket_day, CASE WHEN pairs < 6 THEN 'insufficient' WHEN distinct_values < 2 THEN 'constant' WHEN buckets < 4 THEN 'too_few_buckets' ELSE 'ok' END AS status FROM s""")
def evaluate_common_samples(spark, sf_dir):
    return attribution.common_samples(_long(spark, sf_dir), 6, 4)


_ERA = "CASE WHEN year(datetime) < 1997 THEN 'a' WHEN year(datetime) < 1999 THEN 'b' ELSE 'c' END"


def _eras(frame):
    y = F.year("datetime")
    return frame.withColumn("era", F.when(y < 1997, "a").when(y < 1999, "b").otherwise("c"))


@query(f"""
{IC}, d AS (SELECT *, {_ERA} AS era FROM ic WHERE rank_ic IS NOT NULL), f AS (SELECT factor, avg(rank_ic) AS mean, sum(rank_ic) AS t, count(*) AS n, sign(round(avg(rank_ic), 9)) AS s FROM d GROUP BY 1),
y AS (SELECT factor, count(*) AS years, avg(CASE WHEN round(m * s, 9) > 0 THEN 1.0 ELSE 0.0 END) AS annual_agreement FROM (SELECT factor, year(datetime) AS y, avg(rank_ic) AS m FROM d GROUP BY 1, 2 HAVING count(*) >= 12) JOIN f USING (factor) GROUP BY 1),
e AS (SELECT factor, max(abs(es)) / nullif(sum(abs(es)), 0) AS largest_era_share, min(es / en * s) AS worst_era, min((t - es) / nullif(n - en, 0) * s) AS worst_without_era FROM (SELECT factor, era, sum(rank_ic) AS es, count(*) AS en FROM d GROUP BY 1, 2) JOIN f USING (factor) GROUP BY 1)
SELECT factor, mean, years, annual_agreement, largest_era_share, worst_era, worst_without_era FROM f LEFT JOIN y USING (factor) LEFT JOIN e USING (factor)""", floats="mean annual_agreement largest_era_share worst_era worst_without_era")
def evaluate_evidence_board(spark, sf_dir):
    return attribution.evidence_board(_eras(_ic(spark, sf_dir)), "rank_ic", "era", 12)


@query(f"""
{IC}, s AS (SELECT factor, year(datetime) AS y, avg(rank_ic) AS mean FROM ic WHERE status = 'ok' GROUP BY 1, 2)
SELECT factor, count(*) AS slices, avg(CASE WHEN round(mean, 9) > 0 THEN 1.0 ELSE 0.0 END) AS positive_share, avg(mean) AS average, stddev_samp(mean) AS deviation, min(mean) AS worst, max(mean) AS best FROM s GROUP BY 1""", floats="positive_share average deviation worst best")
def evaluate_slice_stability(spark, sf_dir):
    s = _ic(spark, sf_dir).where("status = 'ok'").groupBy("factor", F.year("datetime").alias("slice")).agg(F.avg("rank_ic").alias("mean"))
    return attribution.slice_stability(s)


_SIZED = f"{_EXPOSED}, sz AS (SELECT *, p AS pct, CASE WHEN p <= 1 / 3.0 THEN 'Small' WHEN p <= 2 / 3.0 THEN 'Mid' ELSE 'Large' END AS size FROM (SELECT *, ({_rank('amount')}) / count(*) OVER ({D}) AS p FROM ex))"


def _sized(spark, sf_dir):
    pct = xs.percent_rank(F.col("amount"))
    return _exposed(spark, sf_dir).withColumns({"pct": pct, "size": xs.size_name(pct)})


@query(f"""
{_SIZED}, r AS (SELECT *, row_number() OVER ({D} ORDER BY kmid DESC, instrument) AS r FROM sz WHERE kmid IS NOT NULL), d AS (SELECT datetime, k AS cohort, avg(pct) AS p, avg(CASE WHEN size = 'Small' THEN 1.0 ELSE 0.0 END) AS s, avg(CASE WHEN size = 'Mid' THEN 1.0 ELSE 0.0 END) AS m, avg(CASE WHEN size = 'Large' THEN 1.0 ELSE 0.0 END) AS l FROM r JOIN (VALUES (3), (6)) v(k) ON r <= k GROUP BY 1, 2)
SELECT CAST(cohort AS INTEGER) AS cohort, count(*) AS days, avg(p) AS mean_percentile, avg(s) AS small, avg(m) AS mid, avg(l) AS large FROM d GROUP BY 1""", floats="mean_percentile small mid large")
def evaluate_size_exposure(spark, sf_dir):
    return attribution.size_exposure(_sized(spark, sf_dir), "kmid", "pct", "size", [3, 6])


@query(f"""
{_SIZED}, r AS (SELECT datetime, instrument, digit < '5' AS g, row_number() OVER ({D} ORDER BY kmid DESC, instrument) AS r, count(*) OVER ({D}) AS n FROM sz WHERE kmid IS NOT NULL), u AS (SELECT datetime, g, count(*) / any_value(n) AS u, coalesce(count(*) FILTER (WHERE r <= 5), 0) / least(5, any_value(n)) AS t FROM r GROUP BY 1, 2)
SELECT datetime, sum(abs(t - u)) / 2 AS active_share, sum(t * t) AS hhi FROM u GROUP BY 1""", floats="active_share hhi")
def evaluate_active_share(spark, sf_dir):
    return attribution.active_share(_sized(spark, sf_dir).withColumn("g", F.col("digit") < "5"), "kmid", "g", 5)


@query(f"""
{_SIZED}, {_spearman('sz', 'kmid', 'label', 'datetime, size', 3, 'g')}
SELECT 'kmid' AS factor, size, count(*) AS days, avg(rho) AS rank_ic_mean FROM g GROUP BY 2""", floats="rank_ic_mean")
def evaluate_group_ic(spark, sf_dir):
    return attribution.group_ic(_sized(spark, sf_dir).select(*KEYS, "size", F.lit("kmid").alias("factor"), F.col("kmid").alias("value"), "label"), "size", 3)


@query(f"""
{_SIZED}, z AS (SELECT datetime, digit < '5' AS g, label, (kmid - avg(kmid) OVER w) / nullif(stddev_pop(kmid) OVER w, 0) AS a, (pct - avg(pct) OVER w) / nullif(stddev_pop(pct) OVER w, 0) AS b, count(*) OVER w AS n FROM sz WHERE kmid IS NOT NULL AND label IS NOT NULL WINDOW w AS ({D})),
c AS (SELECT datetime, a - avg(a) OVER w AS x, b - avg(b) OVER w AS z, label - avg(label) OVER w AS y FROM z WHERE n >= 6 AND a IS NOT NULL AND b IS NOT NULL WINDOW w AS (PARTITION BY datetime, g)), s AS (SELECT datetime, sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz, sum(x * y) AS xy, sum(z * y) AS zy, count(*) AS rows FROM c GROUP BY 1)
SELECT datetime, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS score_coefficient, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS size_coefficient, rows FROM s WHERE abs(xx * zz - xz * xz) > 1e-9""", floats="score_coefficient size_coefficient")
def evaluate_controlled_regression(spark, sf_dir):
    return attribution.controlled_regression(_sized(spark, sf_dir).withColumn("g", F.col("digit") < "5"), "kmid", "pct", "g", "label", 6)


@query(f"""
{_EXPOSED}, p0 AS (SELECT * FROM (SELECT *, count(*) OVER ({D}) AS n FROM ex WHERE kmid IS NOT NULL AND rev_1 IS NOT NULL AND label IS NOT NULL) WHERE n >= 6),
p1 AS (SELECT *, ({_rank('rev_1')}) / n AS ra, ({_rank('kmid')}) / n AS rb, round(kmid - avg(kmid) OVER ({D}) - covar_pop(kmid, rev_1) OVER ({D}) / nullif(var_pop(rev_1) OVER ({D}), 0) * (rev_1 - avg(rev_1) OVER ({D})), 12) AS le FROM p0), p2 AS (SELECT *, round((ra + rb) / 2, 12) AS bo FROM p1),
p3 AS (SELECT *, {_rank('label')} AS rl, {_rank('le')} AS rr, {_rank('bo')} AS rc FROM p2)
SELECT datetime, corr(ra, rb) AS score_rho, corr(rr, rl) AS residual_ic, corr(ra, rl) AS base_ic, corr(rc, rl) AS combined_ic FROM p3 GROUP BY 1""", floats="score_rho residual_ic base_ic combined_ic")
def evaluate_incremental_ic(spark, sf_dir):
    return attribution.incremental_ic(_exposed(spark, sf_dir), "rev_1", "kmid", "label", 6)


@query(f"""
{IC}, d AS (SELECT {_ERA} AS split_id, factor AS method, rank_ic AS value FROM ic WHERE rank_ic IS NOT NULL), s AS (SELECT split_id, method, avg(value) AS m FROM d GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY split_id ORDER BY round(m, 12) DESC) AS r FROM s), p AS (SELECT method, avg(value) AS pooled_mean FROM d GROUP BY 1)
SELECT method, count(*) AS splits, min(m) AS worst_split, avg(r) AS mean_rank, any_value(pooled_mean) AS pooled_mean, row_number() OVER (ORDER BY any_value(pooled_mean) DESC, method) AS place FROM r JOIN p USING (method) GROUP BY 1""", floats="worst_split mean_rank pooled_mean")
def evaluate_method_summary(spark, sf_dir):
    d = _eras(_ic(spark, sf_dir)).select(F.col("era").alias("split_id"), F.col("factor").alias("method"), "datetime", F.col("rank_ic").alias("value"))
    return attribution.method_summary(d)


@query("""
a AS (SELECT datetime, instrument, close AS x FROM panel WHERE CAST(volume AS BIGINT) % 10 <> 1), b AS (SELECT datetime, instrument, CASE WHEN CAST(volume AS BIGINT) % 8 = 0 THEN close * 1.5 ELSE close + 1e-9 END AS y FROM panel WHERE CAST(volume AS BIGINT) % 10 <> 3)
SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS both, count(*) FILTER (WHERE y IS NULL) AS left_only, count(*) FILTER (WHERE x IS NULL) AS right_only, count(*) FILTER (WHERE abs(x - y) <= 1e-6 + 1e-9 * abs(y)) AS equivalent, max(abs(x - y)) AS largest FROM a FULL JOIN b ON a.datetime = b.datetime AND a.instrument = b.instrument""", floats="largest")
def evaluate_prediction_equivalence(spark, sf_dir):
    p = monthly_panel(spark, sf_dir).withColumn("v", F.col("volume").cast("long"))
    return attribution.prediction_equivalence(p.where("v % 10 <> 1"), p.where("v % 10 <> 3").withColumn("close", F.when(F.col("v") % 8 == 0, F.col("close") * 1.5).otherwise(F.col("close") + 1e-9)), "close", 1e-6, 1e-9)


@query(f"""
{LONG}, p AS (SELECT * FROM (SELECT *, count(*) OVER ({D}) AS n FROM wide WHERE kmid IS NOT NULL AND rev_1 IS NOT NULL AND label IS NOT NULL) WHERE n >= 5), r AS (SELECT datetime, {_rank('kmid')} AS a, {_rank('rev_1')} AS b, {_rank('label')} AS l FROM p)
SELECT datetime, corr(a, l) AS first, corr(b, l) AS second, corr(a, l) - corr(b, l) AS contrast FROM r GROUP BY 1""", floats="first second contrast")
def evaluate_common_days(spark, sf_dir):
    w = _wide(spark, sf_dir)
    arm = lambda c: w.select(*KEYS, F.col(c).alias("prediction"))
    return attribution.common_days(w, {"first": arm("kmid"), "second": arm("rev_1")}, "label", 5)


@query(f"""
{IC}, st(factor, era, s, e, stored) AS (VALUES ('kmid', 'early', DATE '1995-01-01', DATE '1997-12-31', 0.0), ('kmid', 'late', DATE '1998-01-01', DATE '2002-12-31', NULL), ('rev_1', 'early', DATE '1995-01-01', DATE '1997-12-31', 0.5), ('volume_ratio', 'late', DATE '1998-01-01', DATE '2002-12-31', -0.5)), m AS (SELECT factor, era, stored, avg(rank_ic) AS mean FROM ic JOIN st USING (factor) WHERE datetime BETWEEN s AND e AND rank_ic IS NOT NULL GROUP BY ALL)
SELECT factor, era, mean, CAST(stored AS DOUBLE) AS stored, CASE WHEN stored IS NULL THEN 'no_reference' WHEN abs(mean - stored) <= 0.02 THEN 'match' WHEN sign(round(mean, 9)) = sign(stored) THEN 'same_direction' ELSE 'conflict' END AS status FROM m""", floats="mean stored")
def evaluate_era_reconciliation(spark, sf_dir):
    a, b, c, d = dt.date(1995, 1, 1), dt.date(1997, 12, 31), dt.date(1998, 1, 1), dt.date(2002, 12, 31)
    stored = spark.createDataFrame([("kmid", "early", a, b, 0.0), ("kmid", "late", c, d, None), ("rev_1", "early", a, b, 0.5), ("volume_ratio", "late", c, d, -0.5)], "factor string, era string, start date, end date, stored double")
    return attribution.era_reconciliation(_ic(spark, sf_dir).where("rank_ic is not null").select("datetime", "factor", F.col("rank_ic").alias("value")), stored, 0.02)


_GROUPED = f"{_SIZED}, lo AS (SELECT datetime, size, 'kmid' AS factor, kmid AS value, label FROM sz UNION ALL SELECT datetime, size, 'rev_1', rev_1, label FROM sz), {_spearman('lo', 'value', 'label', 'datetime, factor, size', 3, 'g')}, gm AS (SELECT factor, size, count(*) AS days, avg(rho) AS rank_ic_mean FROM g GROUP BY 1, 2)"


def _grouped(spark, sf_dir):
    e = _sized(spark, sf_dir).unpivot([*KEYS, "size", "label"], ["kmid", "rev_1"], "factor", "value")
    return attribution.group_ic(e, "size", 3)


@query(f"{_GROUPED}\nSELECT factor, count(*) AS groups, arg_min(size, rank_ic_mean) AS lowest_group, min(rank_ic_mean) AS lowest, arg_max(size, rank_ic_mean) AS highest_group, max(rank_ic_mean) AS highest, max(rank_ic_mean) - min(rank_ic_mean) AS range FROM gm GROUP BY 1", floats="lowest highest range")
def evaluate_group_extremes(spark, sf_dir):
    return attribution.group_extremes(_grouped(spark, sf_dir), "size")


@query("""
f AS (SELECT DISTINCT instrument AS factor FROM panel), p(ord, pattern, family) AS (VALUES (1, '1$', 'ones'), (2, '[123]$', 'low'), (3, '^S.*[5-7]$', 'middle')), o(factor, family) AS (VALUES ('S000001', 'special')), h AS (SELECT factor, arg_min(family, ord) AS fam FROM f JOIN p ON regexp_matches(factor, pattern) GROUP BY 1)
SELECT f.factor, coalesce(o.family, h.fam, 'other') AS family, CASE WHEN o.family IS NOT NULL THEN 'override' WHEN h.fam IS NOT NULL THEN 'pattern' ELSE 'none' END AS source FROM f LEFT JOIN o ON o.factor = f.factor LEFT JOIN h ON h.factor = f.factor""")
def evaluate_taxonomy(spark, sf_dir):
    f = monthly_panel(spark, sf_dir).select(F.col("instrument").alias("factor")).distinct()
    return attribution.taxonomy(f, spark.createDataFrame([("S000001", "special")], "factor string, family string"), spark.createDataFrame([(1, "1$", "ones"), (2, "[123]$", "low"), (3, "^S.*[5-7]$", "middle")], "order int, pattern string, family string"))


@query(f"""
{IC}, d AS (SELECT factor, rank_ic, unnest(['all', 'year_' || year(datetime), 'era_' || {_ERA}]) AS scope FROM ic WHERE rank_ic IS NOT NULL)
SELECT factor, scope, count(*) AS n, avg(rank_ic) AS mean, median(rank_ic) AS median, quantile_cont(rank_ic, 0.1) AS p10, quantile_cont(rank_ic, 0.9) AS p90 FROM d GROUP BY 1, 2""", floats="mean median p10 p90")
def evaluate_scope_distribution(spark, sf_dir):
    d = _eras(_ic(spark, sf_dir))
    return attribution.scope_distribution(d, "rank_ic", F.col("era"))


_UNIVERSES = "ua AS (SELECT instrument, DATE '1996-01-01' AS s, DATE '1998-06-30' AS e FROM panel WHERE right(instrument, 1) < '4' GROUP BY 1), ub AS (SELECT instrument, DATE '1997-01-01' AS s, DATE '2000-12-31' AS e FROM panel WHERE right(instrument, 1) > '2' GROUP BY 1)"


@query(f"""
{_UNIVERSES}, f AS (SELECT datetime, instrument, EXISTS (SELECT 1 FROM ua WHERE ua.instrument = panel.instrument AND panel.datetime BETWEEN s AND e) AS in_a, EXISTS (SELECT 1 FROM ub WHERE ub.instrument = panel.instrument AND panel.datetime BETWEEN s AND e) AS in_b FROM panel)
SELECT *, CAST(in_a AS INTEGER) + CAST(in_b AS INTEGER) AS memberships, CASE WHEN in_a THEN 'a' WHEN in_b THEN 'b' ELSE 'outside' END AS segment FROM f""")
def join_context_keys(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    own = lambda keep, a, b: p.where(keep).select("instrument").distinct().select("instrument", F.lit(a).cast("date").alias("start"), F.lit(b).cast("date").alias("end"))
    last = F.right("instrument", F.lit(1))
    return attribution.context_keys(p, {"a": own(last < "4", "1996-01-01", "1998-06-30"), "b": own(last > "2", "1997-01-01", "2000-12-31")})


@query("""
a AS (SELECT datetime, instrument, close FROM panel WHERE CAST(volume AS BIGINT) % 4 > 0), b AS (SELECT datetime, instrument, volume FROM panel WHERE CAST(volume AS BIGINT) % 5 > 0), c AS (SELECT datetime, instrument, amount FROM panel WHERE CAST(volume AS BIGINT) % 7 > 0)
SELECT datetime, instrument, close, volume, amount FROM a FULL JOIN b USING (datetime, instrument) FULL JOIN c USING (datetime, instrument)""", floats="close volume amount")
def join_feature_tables(spark, sf_dir):
    p, v = monthly_panel(spark, sf_dir), F.col("volume").cast("long")
    return join_features([p.where(v % 4 > 0).select(*KEYS, "close"), p.where(v % 5 > 0).select(*KEYS, "volume"), p.where(v % 7 > 0).select(*KEYS, "amount")])


@query(f"""
n AS (SELECT *, row_number() OVER ({W}) AS k FROM panel), e AS (SELECT datetime, instrument, k, close AS ema FROM n WHERE k = 1 UNION ALL SELECT n.datetime, n.instrument, n.k, e.ema + 2.0 / 6 * (n.close - e.ema) FROM e JOIN n ON n.instrument = e.instrument AND n.k = e.k + 1)
SELECT datetime, instrument, CASE WHEN k >= 5 THEN ema END AS ema_5 FROM e""", floats="ema_5")
def ts_exponential_mean(spark, sf_dir):
    return exponential(monthly_panel(spark, sf_dir).select(*KEYS, "close"), {"ema_5": (F.col("close"), 2 / 6, 5)}).drop("close")


# ------------------------------------------------------------------ boards
_JUDGED = f"""{_GROUPED}, rg AS (SELECT factor, max(rank_ic_mean) - min(rank_ic_mean) AS context_range FROM gm GROUP BY 1), {IC[IC.index('valid AS') :]}, bd AS (SELECT factor, avg(rank_ic) AS rank_ic_mean, avg(CASE WHEN round(rank_ic, 9) > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM ic WHERE status = 'ok' GROUP BY 1),
jb AS (SELECT bd.*, context_range, CASE WHEN factor = 'kmid' THEN 0.8 ELSE 0.4 END AS turnover FROM bd JOIN rg USING (factor)), jj AS (SELECT *, greatest(win_rate, 1 - win_rate) AS w FROM jb),
jd AS (SELECT factor, rank_ic_mean, win_rate, turnover, context_range, w, CASE WHEN abs(rank_ic_mean) >= 0.03 AND w >= 0.6 THEN 'strong' WHEN w >= 0.55 THEN 'consistent' WHEN abs(rank_ic_mean) < 0.01 THEN 'weak' ELSE 'mixed' END AS label, array_to_string(list_filter([CASE WHEN turnover > 0.7 THEN 'high_turnover' END, CASE WHEN context_range > 0.1 THEN 'unstable_context' END, CASE WHEN w < 0.55 THEN 'unstable_sign' END], lambda x: x IS NOT NULL), '|') AS tags FROM jj)"""


def _judged(spark, sf_dir):
    summary = evaluate.ic_summary(_ic(spark, sf_dir)).select("factor", "rank_ic_mean", "win_rate")
    spread = attribution.group_extremes(_grouped(spark, sf_dir), "size").select("factor", F.col("range").alias("context_range"))
    return boards.judgement(summary.join(spread, "factor").withColumn("turnover", F.when(F.col("factor") == "kmid", 0.8).otherwise(0.4)))


@query(f"{_JUDGED}\nSELECT factor, rank_ic_mean, win_rate, turnover, context_range, label, tags FROM jd", floats="rank_ic_mean win_rate turnover context_range")
def select_judgement(spark, sf_dir):
    return _judged(spark, sf_dir)


@query(f"""
{_JUDGED}
SELECT factor, label, tags, CASE WHEN label = 'strong' OR (label = 'consistent' AND tags = '') THEN 'core' WHEN label = 'consistent' THEN 'diversifier' WHEN label = 'weak' THEN 'excluded' ELSE 'watch' END AS role, 100 * abs(rank_ic_mean) + 10 * w + CASE WHEN label = 'strong' THEN 5 ELSE 0 END - 2 * CASE WHEN tags = '' THEN 0 ELSE len(string_split(tags, '|')) END AS quality FROM jd""", floats="quality")
def select_pool_roles(spark, sf_dir):
    return boards.pool_roles(_judged(spark, sf_dir)).select("factor", "label", "tags", "role", "quality")


@query(f"""
{IC}, a AS (SELECT factor, avg(rank_ic) AS rank_ic_mean, count(*) AS days FROM ic WHERE status = 'ok' GROUP BY 1), b AS (SELECT factor, avg(pairs) AS mean_pairs FROM ic WHERE factor <> 'kmid' AND status = 'ok' GROUP BY 1)
SELECT factor, rank_ic_mean, days, CAST(NULL AS DOUBLE) AS mean_pairs, 'main' AS board_source FROM a UNION ALL SELECT factor, NULL, NULL, mean_pairs, 'probe' FROM b""", floats="rank_ic_mean mean_pairs")
def select_united_boards(spark, sf_dir):
    s = evaluate.ic_summary(_ic(spark, sf_dir))
    return boards.united({"main": s.select("factor", "rank_ic_mean", "days"), "probe": s.where("factor <> 'kmid'").select("factor", "mean_pairs")})


_SIMILAR = f"""{PAIRS}, me AS (SELECT factor_a, factor_b, median(rho) AS exposure FROM pc WHERE reason = 'ok' GROUP BY 1, 2), {IC[IC.index('valid AS') :]}, pf AS (SELECT a.factor AS factor_a, b.factor AS factor_b, corr(a.rank_ic, b.rank_ic) AS performance FROM ic a JOIN ic b ON a.datetime = b.datetime AND a.factor < b.factor WHERE a.rank_ic IS NOT NULL AND b.rank_ic IS NOT NULL GROUP BY 1, 2),
ds AS (SELECT factor_a, factor_b, exposure, performance, 1 - (0.5 * abs(exposure) + 0.5 * abs(performance)) AS distance FROM me JOIN pf USING (factor_a, factor_b))"""


def _similar(spark, sf_dir):
    pc = evaluate.pair_correlation(_long(spark, sf_dir), 5).where("reason = 'ok'").groupBy("factor_a", "factor_b").agg(F.percentile("rho", F.lit(0.5)).alias("exposure"))
    ic = _ic(spark, sf_dir).where("rank_ic is not null").select("datetime", "factor", "rank_ic")
    a, b = ic.toDF("datetime", "factor_a", "x"), ic.toDF("datetime", "factor_b", "y")
    both = a.join(b, "datetime").where("factor_a < factor_b").groupBy("factor_a", "factor_b").agg(F.corr("x", "y").alias("performance"))
    return boards.performance_distance(pc, both)


@query(f"{_SIMILAR}\nSELECT * FROM ds", floats="exposure performance distance")
def similarity_distances(spark, sf_dir):
    return _similar(spark, sf_dir)


@query(f"{_SIMILAR}, b AS (SELECT factor_a AS factor, factor_b AS partner, exposure AS value FROM ds UNION ALL SELECT factor_b, factor_a, exposure FROM ds)\nSELECT factor, partner, value FROM b QUALIFY row_number() OVER (PARTITION BY factor ORDER BY round(abs(value), 9) DESC, partner) = 1", floats="value")
def select_strongest_partner(spark, sf_dir):
    return boards.strongest(_similar(spark, sf_dir), "exposure")


@query(f"""
{_SIMILAR}, m(factor, stratum, coverage, length) AS (VALUES ('kmid', 'x', 1.0, 5), ('rev_1', 'x', 1.0, 5), ('volume_ratio', 'x', 1.0, 5)), b AS (SELECT factor_a AS factor, distance FROM ds UNION ALL SELECT factor_b, distance FROM ds), d AS (SELECT factor, avg(distance) AS d FROM b GROUP BY 1)
SELECT stratum, factor, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY coverage DESC, length, round(d, 9), factor) = 1 THEN 'representative' ELSE 'alternate' END AS role FROM m JOIN d USING (factor)""")
def select_stratum_representatives(spark, sf_dir):
    m = spark.createDataFrame([("kmid", "x", 1.0, 5), ("rev_1", "x", 1.0, 5), ("volume_ratio", "x", 1.0, 5)], "factor string, stratum string, coverage double, length int")
    return boards.stratum_representatives(m, _similar(spark, sf_dir))


@query(f"""
{IC}, m AS (SELECT factor, avg(rank_ic) FILTER (WHERE year(datetime) < 1998) AS early, avg(rank_ic) FILTER (WHERE year(datetime) >= 1998) AS recent FROM ic WHERE status = 'ok' GROUP BY 1)
SELECT factor, early, recent, CASE WHEN early IS NULL OR recent IS NULL THEN 'incomplete' WHEN abs(early) < 0.01 AND abs(recent) < 0.01 THEN 'no_evidence' WHEN sign(round(early, 9)) <> sign(round(recent, 9)) THEN 'conflict' WHEN abs(recent) < 0.01 THEN 'regime_concentrated' WHEN abs(early) < 0.01 THEN 'recent_only' WHEN abs(early) > 2 * abs(recent) THEN 'stronger_early' WHEN abs(recent) > 2 * abs(early) THEN 'weaker_early' ELSE 'persistent' END AS classification FROM m""", floats="early recent")
def select_portability(spark, sf_dir):
    d = _ic(spark, sf_dir).where("status = 'ok'").groupBy("factor", F.when(F.year("datetime") < 1998, "early").otherwise("recent").alias("period")).agg(F.avg("rank_ic").alias("mean"))
    return boards.portability(d, 0.01)


@query(f"""
{_LIQUID}, jn AS (SELECT lq.datetime, kmid, residual, label FROM lq JOIN wide USING (datetime, instrument) WHERE residual IS NOT NULL), {_spearman('jn', 'kmid', 'label', 'datetime', 5, 'a')}, {_spearman('jn', 'round(residual, 12)', 'label', 'datetime', 5, 'b')}, m AS (SELECT (SELECT avg(rho) FROM a) AS raw, (SELECT avg(rho) FROM b) AS residual)
SELECT 'kmid' AS factor, raw, residual, residual / nullif(raw, 0) AS retention, CASE WHEN residual / nullif(raw, 0) >= 0.5 THEN 'keep' WHEN residual / nullif(raw, 0) > 0 THEN 'keep_with_control' ELSE 'drop' END AS action FROM m""", floats="raw residual retention")
def select_raw_against_residual(spark, sf_dir):
    r = _liquid(spark, sf_dir).where("residual is not null").join(_wide(spark, sf_dir).select(*KEYS, "kmid", "label"), KEYS)
    r = portfolio.checkpointed(r.select(*KEYS, "kmid", "residual", "label"))  # read twice
    own = lambda c: evaluate.ic_summary(evaluate.daily_ic(r.select(*KEYS, F.lit("kmid").alias("factor"), c.alias("value"), "label"), 5))
    return boards.raw_against_residual(own(F.col("kmid")), own(F.round("residual", 12)))


@query(f"""
{IC}, a AS (SELECT factor, avg(rank_ic) AS v FROM ic WHERE status = 'ok' AND year(datetime) < 1998 GROUP BY 1), b AS (SELECT factor, avg(rank_ic) AS v FROM ic WHERE status = 'ok' AND year(datetime) >= 1998 GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY v DESC, factor) AS r FROM a), y AS (SELECT *, row_number() OVER (ORDER BY v DESC, factor) AS r FROM b)
SELECT x.factor, x.v AS base, y.v AS other, CAST(y.r - x.r AS INTEGER) AS rank_change, CASE WHEN sign(round(x.v, 9)) <> sign(round(y.v, 9)) THEN 'flipped' WHEN abs(y.r - x.r) <= 1 THEN 'stable' ELSE 'moved' END AS stability FROM x JOIN y ON x.factor = y.factor""", floats="base other")
def select_scenario_comparison(spark, sf_dir):
    d = _ic(spark, sf_dir).where("status = 'ok'")
    own = lambda keep: d.where(keep).groupBy("factor").agg(F.avg("rank_ic").alias("v"))
    return boards.scenario_comparison(own("year(datetime) < 1998"), own("year(datetime) >= 1998"), "v")


@query(f"""
{_GROUPED}, m AS (SELECT factor, 'raw' AS variant, avg(rank_ic_mean) AS v FROM gm GROUP BY 1 UNION ALL SELECT factor, size, rank_ic_mean FROM gm), r AS (SELECT m.factor, m.variant, abs(m.v) - abs(b.v) AS change FROM m JOIN m b ON b.factor = m.factor AND b.variant = 'raw' WHERE m.variant <> 'raw')
SELECT factor, variant, change, CASE WHEN change > 0.005 THEN 'improved' WHEN change < -0.005 THEN 'weakened' ELSE 'similar' END AS effect FROM r""", floats="change")
def select_variant_effects(spark, sf_dir):
    from tessera.operators import neutral

    g = _grouped(spark, sf_dir)
    raw = g.groupBy("factor").agg(F.avg("rank_ic_mean").alias("rank_ic_mean")).withColumn("variant", F.lit("raw"))
    return neutral.variant_effects(g.select("factor", F.col("size").alias("variant"), "rank_ic_mean").unionByName(raw))


@query("""
c AS (SELECT instrument AS name, CASE WHEN right(instrument, 1) < '5' THEN 'live' ELSE 'draft' END AS stage, bool_or(volume > 100) AS enabled FROM panel GROUP BY 1)
SELECT name, stage FROM c WHERE enabled AND stage = 'live' ORDER BY name LIMIT 3""")
def catalog_selection(spark, sf_dir):
    c = monthly_panel(spark, sf_dir).groupBy(F.col("instrument").alias("name")).agg(F.bool_or(F.col("volume") > 100).alias("enabled")).withColumn("stage", F.when(F.right("name", F.lit(1)) < "5", "live").otherwise("draft"))
    return boards.catalog_entries(c, stage="live", most=3).select("name", "stage")


@query("""
f AS (SELECT DISTINCT instrument AS factor FROM panel), d AS (SELECT a.factor AS a, b.factor AS b FROM f a JOIN f b ON right(a.factor, 1) = '1' AND b.factor = 'S' || lpad(CAST(CAST(substr(a.factor, 2) AS INTEGER) + 1 AS VARCHAR), 6, '0'))
SELECT 'full' AS policy, factor FROM f UNION ALL SELECT 'deduplicated', factor FROM f WHERE factor NOT IN (SELECT b FROM d) UNION ALL SELECT 'strict', factor FROM f WHERE factor NOT IN (SELECT b FROM d) AND factor NOT IN (SELECT a FROM d)""")
def catalog_pools(spark, sf_dir):
    f = monthly_panel(spark, sf_dir).select(F.col("instrument").alias("factor")).distinct()
    nxt = F.concat(F.lit("S"), F.lpad((F.substring("factor", 2, 6).cast("int") + 1).cast("string"), 6, "0"))
    pairs = f.where(F.right("factor", F.lit(1)) == "1").select(F.col("factor").alias("factor_a"), nxt.alias("factor_b"))
    return boards.policy_pools(f, pairs.join(f.withColumnRenamed("factor", "factor_b"), "factor_b", "left_semi"))


@query(f"""
{LONG}, p AS (SELECT factor, count(*) AS rows, avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END) AS finite_rate, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM long GROUP BY 1)
SELECT factor, array_to_string(list_filter([CASE WHEN rows < 100 THEN 'few_rows' END, CASE WHEN finite_rate < 0.99 THEN 'low_finite_rate' END, CASE WHEN p10 = p90 THEN 'no_spread' END], lambda x: x IS NOT NULL), '|') AS reasons, rows >= 100 AND finite_rate >= 0.99 AND p10 <> p90 AS eligible FROM p""")
def quality_feature_decisions(spark, sf_dir):
    p = quality.profile(_wide(spark, sf_dir).drop("label"), ["rev_1", "kmid", "volume_ratio"])
    return boards.feature_decisions(p, least_finite=0.99, least_rows=100).select("factor", "reasons", "eligible")


@query(f"""
{_splits(False)}, {LONG[LONG.index('fac AS') :]}, n AS (SELECT datetime, factor, count(value) AS n FROM long GROUP BY 1, 2), s AS (SELECT split_id, factor, count(*) AS dates, count(*) FILTER (WHERE n >= 10) AS qualified FROM n JOIN sp USING (datetime) WHERE fold = 'train' AND fate = 'kept' GROUP BY 1, 2)
SELECT *, qualified / dates >= 0.5 AS eligible FROM s""")
def quality_split_eligibility(spark, sf_dir):
    own = _walk(spark, sf_dir, False)[0].where("fate = 'kept'")
    return boards.split_eligibility(_long(spark, sf_dir), own, 10, 0.5)


# ------------------------------------------------------------------ scores and portfolios
@query("""
b AS (SELECT CAST(year(datetime) AS VARCHAR) AS split, instrument AS factor, greatest(round(sum(amount), 2) - 200000, 0) AS raw FROM panel GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY raw DESC, factor) AS k, count(*) OVER (PARTITION BY split) AS n, sum(raw) OVER (PARTITION BY split ORDER BY raw DESC, factor ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft FROM b),
o AS (SELECT *, coalesce(raw * (1 - 0.15 * (k - 1)) / nullif(lft, 0) > 0.15, false) AS ov FROM k), c AS (SELECT *, min(CAST(ov AS INTEGER)) OVER (PARTITION BY split ORDER BY k ROWS UNBOUNDED PRECEDING) = 1 AS cp FROM o), f AS (SELECT *, sum(CASE WHEN NOT cp THEN raw END) OVER (PARTITION BY split) AS fr, 1 - 0.15 * sum(CAST(cp AS INTEGER)) OVER (PARTITION BY split) AS sh FROM c)
SELECT split, factor, 1.0 / n AS equal_weight, CASE WHEN n * 0.15 < 1 THEN 1.0 / n WHEN cp THEN 0.15 ELSE raw * sh / nullif(fr, 0) END AS weight FROM f""", floats="equal_weight weight")
def weights_by_split(spark, sf_dir):
    b = monthly_panel(spark, sf_dir).groupBy(F.year("datetime").cast("string").alias("split"), F.col("instrument").alias("factor")).agg((F.round(F.sum("amount"), 2) - 200000).alias("stability"))
    return portfolio.split_weights(b.withColumn("eligible", F.lit(True)), 0.15)


_FIT = f"""{LONG}, v AS (SELECT factor, datetime, instrument, value, 1.0 / count(*) OVER (PARTITION BY datetime, factor) AS weight FROM long),
r AS (SELECT factor, value, sum(weight) OVER (PARTITION BY factor ORDER BY value, instrument ROWS UNBOUNDED PRECEDING) AS r, sum(weight) OVER (PARTITION BY factor) AS t FROM v WHERE value IS NOT NULL),
c AS (SELECT factor, min(value) AS center FROM r WHERE r * 2 >= t GROUP BY 1), f AS (SELECT v.*, center, coalesce(value, center) AS x FROM v JOIN c USING (factor)), m AS (SELECT factor, sum(x * weight) / sum(weight) AS mean, sum(x * x * weight) / sum(weight) AS sq FROM f GROUP BY 1)"""


@query(f"{_FIT}\nSELECT datetime, instrument, f.factor, (x - mean) / nullif(sqrt(greatest(sq - mean * mean, 0)), 0) AS value FROM f JOIN m ON m.factor = f.factor", floats="value")
def model_preprocessing_transform(spark, sf_dir):
    long = _long(spark, sf_dir)
    return portfolio.apply_preprocessing(long, portfolio.fit_preprocessing(long))


@query(f"""
{LONG}, t AS (SELECT datetime, instrument, ({_rank('label')}) / count(*) OVER ({D}) - 0.5 AS target FROM wide WHERE label IS NOT NULL), b AS (SELECT w.datetime, w.instrument, w.rev_1, w.kmid, target FROM wide w JOIN t USING (datetime, instrument) JOIN panel p USING (datetime, instrument) WHERE w.rev_1 IS NOT NULL AND w.kmid IS NOT NULL AND CAST(p.volume AS BIGINT) % 3 > 0)
SELECT datetime, instrument, rev_1, kmid, target, 1.0 / n AS weight FROM (SELECT *, count(*) OVER ({D}) AS n FROM b) WHERE n >= 4""", floats="rev_1 kmid target weight")
def model_training_batch(spark, sf_dir):
    w = _wide(spark, sf_dir)
    eligible = monthly_panel(spark, sf_dir).where(F.col("volume").cast("long") % 3 > 0)
    return portfolio.training_batch(w.select(*KEYS, "rev_1", "kmid"), w, eligible, "label", 4)


@query(f"""
b AS (SELECT *, floor(1e6 / count(*) OVER ({D}) / (close * 100)) * 100 AS q FROM panel)
SELECT datetime, count(*) AS names, count(*) FILTER (WHERE q > 0) AS affordable, sum(q * close) AS invested, min(amount) * 0.1 * count(*) AS capacity, count(*) FILTER (WHERE close IS NULL OR amount IS NULL) AS unknown FROM b GROUP BY 1""", floats="invested capacity")
def portfolio_basket_feasibility(spark, sf_dir):
    return portfolio.basket_feasibility(monthly_panel(spark, sf_dir), 1e6)


def _scenario(k: int) -> str:
    return f"s{k} AS (SELECT {k} AS k, datetime, avg(label) AS gross, count(*) AS members FROM s WHERE r <= {k} GROUP BY datetime), d{k} AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS n FROM s{k}), h{k} AS (SELECT s.datetime, instrument, n FROM s JOIN d{k} USING (datetime) WHERE r <= {k}), t{k} AS (SELECT a.datetime, CASE WHEN a.n = 1 THEN 1.0 ELSE 1 - count(b.n) / count(*) END AS turnover FROM h{k} a LEFT JOIN h{k} b ON a.instrument = b.instrument AND a.n = b.n + 1 GROUP BY a.datetime, a.n)"


@query(f"""
{LONG}, s AS (SELECT *, row_number() OVER ({D} ORDER BY rev_1 DESC, instrument) AS r FROM wide WHERE rev_1 IS NOT NULL AND label IS NOT NULL), {_scenario(3)}, {_scenario(6)}, u AS (SELECT k, gross, turnover FROM s3 JOIN t3 USING (datetime) UNION ALL SELECT k, gross, turnover FROM s6 JOIN t6 USING (datetime))
SELECT CAST(k AS INTEGER) AS k, CAST(b AS DOUBLE) AS bps, count(*) AS days, avg(gross - turnover * b / 10000) AS mean_net FROM u, (SELECT unnest([0.0, 20.0]) AS b) GROUP BY 1, 2""", floats="bps mean_net")
def portfolio_scenarios(spark, sf_dir):
    return portfolio.scenarios(_wide(spark, sf_dir), "rev_1", "label", [3, 6], [0, 20])


@query(f"""
{_SIZED}, r AS (SELECT datetime, size, row_number() OVER ({D} ORDER BY kmid DESC, instrument) AS r FROM sz WHERE kmid IS NOT NULL)
SELECT datetime, size AS bucket, count(*) / sum(count(*)) OVER ({D}) AS share FROM r WHERE r <= 5 GROUP BY 1, 2""", floats="share")
def portfolio_bucket_shares(spark, sf_dir):
    return portfolio.bucket_shares(_sized(spark, sf_dir), "kmid", "size", 5)


@query(f"""
{LONG}, w(factor, weight) AS (VALUES ('rev_1', 1.0 / 3), ('kmid', -1.0 / 3), ('volume_ratio', 1.0 / 3)),
z AS (SELECT datetime, instrument, factor, CASE WHEN value IS NOT NULL AND max(value) OVER (PARTITION BY datetime, factor) > min(value) OVER (PARTITION BY datetime, factor) THEN greatest(least((value - avg(value) OVER (PARTITION BY datetime, factor)) / stddev_samp(value) OVER (PARTITION BY datetime, factor), 3), -3) END AS z FROM long)
SELECT datetime, instrument, CASE WHEN count(*) >= 2 THEN sum(z * weight) / sum(abs(weight)) END AS score, count(*) AS parts FROM z JOIN w USING (factor) WHERE z IS NOT NULL GROUP BY 1, 2""", floats="score")
def score_directional(spark, sf_dir):
    d = spark.createDataFrame([("rev_1", 1.0), ("kmid", -1.0), ("volume_ratio", 1.0)], "factor string, direction double")
    return portfolio.directional_score(_long(spark, sf_dir), d, 2)


@query(f"""
{IC}, g(node, grp) AS (VALUES ('kmid', 'x'), ('rev_1', 'x'), ('volume_ratio', 'y')), b AS (SELECT factor, round(0.7 * abs(avg(rank_ic)) + 0.3 * avg(CASE WHEN round(rank_ic, 9) > 0 THEN 1.0 ELSE 0.0 END), 12) AS score FROM ic WHERE status = 'ok' GROUP BY 1)
SELECT grp AS "group", node FROM g JOIN b ON factor = node QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, node) = 1""")
def select_representatives(spark, sf_dir):
    s = evaluate.ic_summary(_ic(spark, sf_dir)).select("factor", F.round(0.7 * F.abs("rank_ic_mean") + 0.3 * F.col("win_rate"), 12).alias("score"))
    return portfolio.representatives(spark.createDataFrame([("kmid", "x"), ("rev_1", "x"), ("volume_ratio", "y")], "node string, group string"), s, "score")
