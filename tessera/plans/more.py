"""Queries over contracts, evidence, reconciliation, set measures and further portfolio rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import audits, evaluate, joins, quality
from tessera.plans.base import query
from tessera.plans.evaluation import IC, LONG, _ic, _long, _wide
from tessera.plans.panel import ISSUES, LIFE, SECOND, W, _life, _second
from tessera.sources.panel import KEYS, monthly_panel


@query("""
c AS (SELECT *, count(*) OVER (PARTITION BY datetime, instrument) AS n FROM panel), v AS (SELECT count(*) FILTER (WHERE datetime IS NULL OR instrument IS NULL) AS a, count(*) FILTER (WHERE n > 1) AS b, count(*) FILTER (WHERE close <= 0) AS d, count(*) FILTER (WHERE high < low) AS e FROM c),
u AS (SELECT 'null_key' AS check_name, a AS observed_value FROM v UNION ALL SELECT 'repeated_key', b FROM v UNION ALL SELECT 'nonpositive_close', d FROM v UNION ALL SELECT 'high_below_low', e FROM v)
SELECT check_name, CASE WHEN observed_value = 0 THEN 'pass' ELSE 'fail' END AS status, observed_value FROM u""")
def contract_panel(spark, sf_dir):
    return audits.panel_contract(monthly_panel(spark, sf_dir))


@query(f"""
{LIFE}, i AS (SELECT instrument, s, e FROM life UNION ALL SELECT instrument, e, CAST(e + INTERVAL 1 MONTH AS DATE) FROM life), b AS (SELECT *, max(e) OVER (PARTITION BY instrument ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
v AS (SELECT count(*) FILTER (WHERE e < s) AS a, count(*) FILTER (WHERE s <= p) AS o FROM b), u AS (SELECT 'reversed' AS check_name, a AS observed_value FROM v UNION ALL SELECT 'overlap', o FROM v)
SELECT check_name, CASE WHEN observed_value = 0 THEN 'pass' ELSE 'fail' END AS status, observed_value FROM u""")
def contract_intervals(spark, sf_dir):
    life = _life(monthly_panel(spark, sf_dir))
    return audits.interval_contract(life.union(life.select("instrument", "end", F.add_months("end", 1))))


@query(f"""
{LONG}
SELECT w.datetime, w.instrument, dm.exit FROM wide w JOIN dm USING (datetime) WHERE label IS NOT NULL AND dm.exit >= DATE '2001-06-01'""")
def guard_label_maturity(spark, sf_dir):
    dates = joins.label_dates(joins.calendar_of(monthly_panel(spark, sf_dir)), 1, 1)
    return audits.maturity_violations(_wide(spark, sf_dir), dates, F.lit("2001-06-01").cast("date")).select("datetime", "instrument", "exit")


@query("""
r AS (SELECT datetime, instrument, row_number() OVER (PARTITION BY datetime ORDER BY md5('3|' || instrument), instrument) AS n FROM panel)
SELECT datetime, instrument FROM r WHERE n <= 5""")
def sample_stratified(spark, sf_dir):
    return audits.stratified_sample(monthly_panel(spark, sf_dir), ["datetime"], "instrument", 5, 3).select("datetime", "instrument")


@query(f"""
{ISSUES}, q AS (SELECT datetime, instrument, count(*) AS n, string_agg(DISTINCT rule, '|' ORDER BY rule) AS rules FROM issues GROUP BY 1, 2)
SELECT p.datetime, p.instrument, coalesce(n, 0) AS issue_count, coalesce(rules, '') AS issue_rules FROM panel p LEFT JOIN q USING (datetime, instrument)""")
def join_quality_flags(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    return audits.with_quality(p, quality.row_issues(p)).select("datetime", "instrument", "issue_count", "issue_rules")


@query("""
t AS (SELECT datetime, instrument, volume > 100 AS can_buy FROM panel WHERE instrument[-1] <> '3')
SELECT p.datetime, p.instrument, coalesce(t.can_buy, false) AS can_buy, CASE WHEN t.can_buy IS NULL THEN 'missing_tradability' ELSE '' END AS disabled_reason FROM panel p LEFT JOIN t USING (datetime, instrument)""")
def join_tradability_defaults(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    t = p.where(F.substring("instrument", -1, 1) != "3").select(*KEYS, (F.col("volume") > 100).alias("can_buy"), F.lit(True).alias("can_sell"), F.lit("").alias("disabled_reason"))
    return audits.with_tradability(p, t).select("datetime", "instrument", "can_buy", "disabled_reason")


@query("""
r(board, s, e, rate) AS (VALUES ('1', DATE '1995-01-01', DATE '1997-12-31', 0.05), ('1', DATE '1998-01-01', NULL, 0.1), ('2', DATE '1995-01-01', DATE '1999-12-31', 0.05), ('2', DATE '1999-01-01', NULL, 0.2)),
j AS (SELECT p.datetime, p.instrument, count(rate) AS matches, max(rate) AS rate FROM panel p LEFT JOIN r ON p.instrument[-1] = board AND p.datetime >= s AND (e IS NULL OR p.datetime <= e) GROUP BY 1, 2)
SELECT datetime, instrument, matches, CAST(CASE WHEN matches = 1 THEN rate END AS DOUBLE) AS rate FROM j""", floats="rate")
def join_dated_rules(spark, sf_dir):
    rules = spark.createDataFrame([("1", "1995-01-01", "1997-12-31", 0.05), ("1", "1998-01-01", None, 0.1), ("2", "1995-01-01", "1999-12-31", 0.05), ("2", "1999-01-01", None, 0.2)], "board string, start string, end string, rate double").withColumns({"start": F.to_date("start"), "end": F.to_date("end")})
    return audits.resolved_rules(monthly_panel(spark, sf_dir).withColumn("board", F.substring("instrument", -1, 1)), rules, ["board"])


@query("""
a AS (SELECT datetime, instrument, volume > 400 AS f FROM panel), b AS (SELECT datetime, instrument, amount > 400000 AS f FROM panel WHERE instrument[-1] <> '3')
SELECT a.datetime, a.instrument, a.f AS one, b.f AS two FROM a JOIN b USING (datetime, instrument) WHERE a.f <> b.f""")
def source_disagreements(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    return audits.disagreements({"one": p.withColumn("f", F.col("volume") > 400), "two": p.where(F.substring("instrument", -1, 1) != "3").withColumn("f", F.col("amount") > 400000)}, "f")


@query(f"""
{SECOND}
SELECT p.instrument, count(*) AS missing, min(p.datetime) AS first_date, max(p.datetime) AS last_date, 'two' AS source FROM panel p LEFT JOIN two USING (datetime, instrument) WHERE c2 IS NULL GROUP BY 1""")
def source_missing_spans(spark, sf_dir):
    return audits.missing_by_source({"one": monthly_panel(spark, sf_dir), "two": _second(spark, sf_dir)})


@query(f"""
{LIFE}, a AS (SELECT p.datetime, p.instrument, CAST(p.datetime - s AS INTEGER) AS age FROM panel p JOIN life USING (instrument))
SELECT datetime, instrument, age, CASE WHEN age < 0 THEN 'unknown' WHEN age <= 60 THEN '0-60' WHEN age <= 120 THEN '61-120' WHEN age <= 250 THEN '121-250' WHEN age <= 500 THEN '251-500' ELSE '501+' END AS age_bucket FROM a""")
def join_listing_age(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    return audits.listing_age(p, _life(p)).select("datetime", "instrument", "age", "age_bucket")


@query(f"""
{LONG}, m AS (SELECT datetime, avg(label) AS b FROM wide GROUP BY 1)
SELECT w.datetime, w.instrument, label - b AS relative FROM wide w JOIN m USING (datetime)""", floats="relative")
def join_benchmark_relative(spark, sf_dir):
    w = _wide(spark, sf_dir)
    return audits.relative_returns(w, w.groupBy("datetime").agg(F.avg("label").alias("benchmark"))).select("datetime", "instrument", "relative")


@query("""
p AS (SELECT event_id, ts, CASE WHEN date_trunc('day', ts) = ts THEN 'unknown' WHEN hour(ts) < 9 THEN 'before_open' ELSE 'after_open' END AS phase FROM events)
SELECT phase, count(*) AS n, min(event_id) AS first_event FROM p GROUP BY 1""", base="")
def calendar_publication_phases(spark, sf_dir):
    return audits.phases(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts").groupBy("phase").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT 'again' AS factor_a, 'close' AS factor_b FROM panel LIMIT 1")
def quality_duplicate_columns(spark, sf_dir):
    p = monthly_panel(spark, sf_dir).withColumn("again", F.col("close"))
    return audits.duplicate_columns(p.unpivot(KEYS, ["close", "again", "open"], "factor", "value"))


@query("""
h AS (SELECT datetime, count(*) / (SELECT count(DISTINCT instrument) FROM panel) AS c FROM panel GROUP BY 1), b AS (SELECT max(datetime) FILTER (WHERE c < 0.6) AS bad FROM h)
SELECT min(datetime) AS frontier FROM h, b WHERE bad IS NULL OR datetime > bad""")
def quality_stable_frontier(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    every = p.select("instrument").distinct().agg(F.count("*").alias("n"))
    cov = p.groupBy("datetime").count().crossJoin(F.broadcast(every)).select("datetime", (F.col("count") / F.col("n")).alias("coverage"))
    return audits.stable_frontier(cov, 0.6)


@query("SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS period, count(DISTINCT o_orderstatus) AS \"values\" FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) > 1", base="")
def quality_conflicts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("period"), "o_orderstatus")
    return audits.conflicts(o, ["cust", "period"], "o_orderstatus")


@query("""
g AS (SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS period, count(*) AS rows, count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_orderpriority) AS b, max(o_orderstatus) AS s, max(o_orderpriority) AS p FROM orders GROUP BY 1, 2)
SELECT cust, period, rows, CASE WHEN a = 1 THEN s END AS status, CASE WHEN b = 1 THEN p END AS priority, concat_ws('|', CASE WHEN a > 1 THEN 'conflict_status' END, CASE WHEN b > 1 THEN 'conflict_priority' END) AS reasons FROM g""", base="")
def quality_event_reconciliation(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("period"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return audits.reconciled(o, ["cust", "period"], ["status", "priority"])


@query("""
SELECT instrument, count(*) AS rows, count(*) FILTER (WHERE open > 0 AND close > 0 AND volume > 0) AS positive, count(*) FILTER (WHERE low <= least(open, close) AND high >= greatest(open, close)) AS ordered, count(*) FILTER (WHERE vwap >= low * 0.998 AND vwap <= high * 1.002) AS vwap_inside FROM panel GROUP BY 1""")
def quality_quote_checks(spark, sf_dir):
    return audits.quote_checks(monthly_panel(spark, sf_dir))


@query(f"""
{LONG}, t AS (SELECT datetime, instrument FROM (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY kmid DESC, instrument) AS r FROM wide WHERE kmid IS NOT NULL) WHERE r <= 15), h AS (SELECT instrument, pos FROM t JOIN cal USING (datetime)),
f AS (SELECT coalesce(a.pos, b.pos + 1) AS pos, a.pos AS now, b.pos AS bef FROM h a FULL JOIN h b ON a.instrument = b.instrument AND a.pos = b.pos + 1)
SELECT cal.datetime, count(now) AS size, count(*) FILTER (WHERE now IS NOT NULL AND bef IS NOT NULL) AS kept, count(*) FILTER (WHERE bef IS NULL) AS entered, count(*) FILTER (WHERE now IS NULL) AS "left", count(*) FILTER (WHERE now IS NOT NULL AND bef IS NOT NULL) / count(*) AS jaccard FROM f JOIN cal USING (pos) WHERE pos > 1 GROUP BY 1""", floats="jaccard")
def evaluate_top_k_retention(spark, sf_dir):
    return audits.top_k_retention(_wide(spark, sf_dir), "kmid", 15)


@query("""
g AS (SELECT datetime, instrument[-1] AS g, sum(amount) AS w FROM panel GROUP BY 1, 2), s AS (SELECT datetime, w / sum(w) OVER (PARTITION BY datetime) AS s FROM g)
SELECT datetime, sum(s * s) AS hhi, max(s) AS top_share FROM s GROUP BY 1""", floats="hhi top_share")
def evaluate_concentration(spark, sf_dir):
    return audits.concentration(monthly_panel(spark, sf_dir).withColumn("g", F.substring("instrument", -1, 1)), "g", "amount")


@query(f"""
{IC}, p(period, s, e) AS (VALUES ('early', DATE '1995-01-01', DATE '1997-12-31'), ('late', DATE '1998-01-01', DATE '2001-12-31'), ('whole', DATE '1995-01-01', DATE '2001-12-31'))
SELECT period, count(rank_ic) AS days, avg(rank_ic) AS mean, median(rank_ic) AS median, avg(rank_ic) / stddev_samp(rank_ic) * sqrt(12.0) AS ratio, avg(CASE WHEN round(rank_ic, 9) > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM ic JOIN p ON datetime BETWEEN s AND e WHERE factor = 'rev_1' AND status = 'ok' GROUP BY 1""", floats="mean median ratio positive")
def evaluate_period_summary(spark, sf_dir):
    p = spark.createDataFrame([("early", "1995-01-01", "1997-12-31"), ("late", "1998-01-01", "2001-12-31"), ("whole", "1995-01-01", "2001-12-31")], "period string, start string, end string").withColumns({"start": F.to_date("start"), "end": F.to_date("end")})
    return audits.period_summary(_ic(spark, sf_dir).where("factor = 'rev_1' and status = 'ok'"), p, "rank_ic", 12)


@query(f"""
{IC}, e AS (SELECT factor, CAST(year(datetime) AS INTEGER) AS era, sum(rank_ic) AS s, count(*) AS n FROM ic WHERE status = 'ok' GROUP BY 1, 2)
SELECT factor, era, s / n AS mean, (sum(s) OVER (PARTITION BY factor) - s) / nullif(sum(n) OVER (PARTITION BY factor) - n, 0) AS others FROM e""", floats="mean others")
def evaluate_leave_one_out(spark, sf_dir):
    return audits.leave_one_out(_ic(spark, sf_dir).where("status = 'ok'").withColumn("era", F.year("datetime")), "era", "rank_ic")


@query(f"""
{IC}
SELECT factor, count(rank_ic) AS n, avg(rank_ic) AS mean, median(rank_ic) AS median, quantile_disc(rank_ic, 0.9) AS p90, max(rank_ic) AS largest FROM ic WHERE status = 'ok' GROUP BY 1""", floats="mean median p90 largest")
def stats_distribution(spark, sf_dir):
    return audits.distribution(_ic(spark, sf_dir).where("status = 'ok'"), "rank_ic", ["factor"])


@query(f"""
{IC}, t AS (SELECT 'all' AS "group", factor AS trial, avg(rank_ic) AS score, len(factor) AS size FROM ic WHERE status = 'ok' GROUP BY 2), b AS (SELECT *, max(score) OVER () AS best FROM t)
SELECT "group", trial, score, CAST(size AS INTEGER) AS size FROM b WHERE score >= best - 0.05 ORDER BY size, score DESC, trial LIMIT 1""", floats="score")
def select_best_trial(spark, sf_dir):
    t = _ic(spark, sf_dir).where("status = 'ok'").groupBy(F.lit("all").alias("group"), F.col("factor").alias("trial")).agg(F.avg("rank_ic").alias("score")).withColumn("size", F.char_length("trial"))
    return audits.best_trial(t, "score", 0.05, "size")


@query(f"""
{LONG}, s AS (SELECT *, quantile_cont(v.amount, [0.2, 0.4, 0.6, 0.8]) OVER (PARTITION BY w.datetime) AS e FROM wide w JOIN panel v USING (datetime, instrument) WHERE rev_1 IS NOT NULL AND label IS NOT NULL),
b AS (SELECT datetime, instrument, label, rev_1, 1 + len(list_filter(e, lambda x: x < amount)) AS bucket FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY datetime, bucket ORDER BY rev_1 DESC, instrument) AS n FROM b)
SELECT datetime, count(*) AS members, avg(label) AS mean_label FROM r WHERE n <= 2 GROUP BY 1""", floats="mean_label")
def portfolio_bucket_balanced(spark, sf_dir):
    """Two best scores of each liquidity bucket."""
    from tessera.functions import xs

    w = _wide(spark, sf_dir).join(monthly_panel(spark, sf_dir).select(*KEYS, "amount"), KEYS).where("rev_1 is not null and label is not null")
    b = xs.bucket(w, "amount", "bucket", 5).where("bucket is not null")
    n = F.row_number().over(Window.partitionBy("datetime", "bucket").orderBy(F.desc("rev_1"), "instrument"))
    return b.withColumn("n", n).where("n <= 2").groupBy("datetime").agg(F.count("*").alias("members"), F.avg("label").alias("mean_label"))


@query(f"""
{LONG}, d AS (SELECT w.*, pos, CAST((pos - 1) // 3 AS BIGINT) AS period FROM wide w JOIN cal USING (datetime)), f AS (SELECT period, instrument FROM (SELECT period, instrument, row_number() OVER (PARTITION BY period ORDER BY kmid DESC, instrument) AS r FROM d WHERE (pos - 1) % 3 = 0 AND kmid IS NOT NULL) WHERE r <= 10)
SELECT d.datetime, avg(label) AS gross, count(label) AS members FROM d JOIN f USING (period, instrument) GROUP BY 1""", floats="gross")
def portfolio_low_frequency(spark, sf_dir):
    """The ten best on every third date, held until the next rebalancing."""
    cal = joins.calendar_of(monthly_panel(spark, sf_dir))
    d = _wide(spark, sf_dir).join(F.broadcast(cal), "datetime").withColumn("period", F.floor((F.col("pos") - 1) / 3))
    r = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("kmid"), "instrument"))
    held = d.where("(pos - 1) % 3 = 0 and kmid is not null").withColumn("r", r).where("r <= 10").select("period", "instrument")
    return d.join(held, ["period", "instrument"]).groupBy("datetime").agg(F.avg("label").alias("gross"), F.count("label").alias("members"))


@query(f"""
{LONG}, c AS (SELECT factor, value, label, datetime, instrument FROM long), h AS (SELECT factor, CASE WHEN year(datetime) % 2 = 0 THEN 'even' ELSE 'odd' END AS slice, value, label, datetime FROM c WHERE value IS NOT NULL AND label IS NOT NULL)
SELECT factor, coalesce(slice, 'all') AS slice, count(*) AS rows, avg(value) AS mean_value, avg(label) AS mean_label FROM h GROUP BY GROUPING SETS ((factor), (factor, slice))""", floats="mean_value mean_label")
def evaluate_grouping_sets(spark, sf_dir):
    h = _long(spark, sf_dir).where("value is not null and label is not null").withColumn("slice", F.when(F.year("datetime") % 2 == 0, "even").otherwise("odd"))
    sets = h.groupingSets([[F.col("factor")], [F.col("factor"), F.col("slice")]], "factor", "slice")
    return sets.agg(F.count("*").alias("rows"), F.avg("value").alias("mean_value"), F.avg("label").alias("mean_label")).withColumn("slice", F.coalesce("slice", F.lit("all")))


@query(f"""
w AS (SELECT datetime, instrument, lead(close) OVER ({W}) / nullif(close, 0) - 1 AS f1, lead(close, 2) OVER ({W}) / nullif(close, 0) - 1 AS f2, -(close / nullif(lag(close) OVER ({W}), 0) - 1) AS v FROM panel),
u AS (SELECT datetime, instrument, 'h1' AS factor, v AS value, f1 AS label FROM w UNION ALL SELECT datetime, instrument, 'h2', v, f2 FROM w), k AS (SELECT * FROM u WHERE value IS NOT NULL AND label IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY datetime, factor ORDER BY value) + (count(*) OVER (PARTITION BY datetime, factor, value) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY datetime, factor ORDER BY label) + (count(*) OVER (PARTITION BY datetime, factor, label) - 1) / 2.0 AS rl FROM k),
d AS (SELECT datetime, factor, corr(rv, rl) AS x FROM r GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT factor AS horizon, count(*) AS days, avg(x) AS rank_ic_mean FROM d GROUP BY 1""", floats="rank_ic_mean")
def evaluate_signal_decay(spark, sf_dir):
    from tessera.functions import ts
    from tessera.functions.guard import ratio

    c = F.col("close")
    w = monthly_panel(spark, sf_dir).select(*KEYS, (ratio(ts.ref(c, -1), c) - 1).alias("h1"), (ratio(ts.ref(c, -2), c) - 1).alias("h2"), (-ts.change(c)).alias("value"))
    long = w.unpivot([*KEYS, "value"], ["h1", "h2"], "factor", "label")
    return evaluate.daily_ic(long, 5).where("status = 'ok'").groupBy(F.col("factor").alias("horizon")).agg(F.count("*").alias("days"), F.avg("rank_ic").alias("rank_ic_mean"))


@query("""
m AS (SELECT instrument, avg(close) AS mean_close FROM panel GROUP BY 1)
SELECT datetime, instrument, mean_close FROM panel JOIN m USING (instrument)""", floats="mean_close")
def join_lookup(spark, sf_dir):
    """Many to one, with the right keys checked to be unique."""
    p = monthly_panel(spark, sf_dir)
    return joins.looked_up(p, p.groupBy("instrument").agg(F.avg("close").alias("mean_close")), ["instrument"]).select("datetime", "instrument", "mean_close")


@query("SELECT datetime, instrument, open, CASE WHEN instrument[-1] = '7' THEN close * 2 END AS close FROM panel", floats="open close")
def join_replaced_columns(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    corrected = p.where(F.substring("instrument", -1, 1) == "7").withColumn("close", F.col("close") * 2)
    return joins.replaced_columns(p.select(*KEYS, "open", "close"), corrected, ["close"])
