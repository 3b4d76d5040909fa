"""Queries over valuation, order flow, statements, tradability, instrument states, universes and audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import fundamentals, joins, market
from tessera.plans.base import query
from tessera.plans.features import _f, _full
from tessera.sources.panel import KEYS, monthly_panel

W = "PARTITION BY instrument ORDER BY datetime"
D = "PARTITION BY datetime"


def _columns(made: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in made.items())


def _made(frame, made: dict[str, str]):
    """Columns by expressions that both engines read alike."""
    return frame.select(*KEYS, *(F.expr(v).alias(k) for k, v in made.items()))


# ------------------------------------------------------------------ factors
_BASIC = {
    "total_mv": "amount * 3 - 200000", "circ_mv": "amount", "pe_ttm": "close - open", "pb": "high - low", "ps_ttm": "vwap / 100", "dv_ttm": "volume - floor(volume / 7) * 7", "turnover_rate_f": "volume / 100", "volume_ratio": "volume / 50",
}
_PRIOR = "(PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_VALUATION = {
    "log_total_cap": "CASE WHEN total_mv > 0 THEN ln(total_mv) END", "log_float_cap": "CASE WHEN circ_mv > 0 THEN ln(circ_mv) END", "float_share": "circ_mv / nullif(total_mv, 0)",
    "earnings_yield": "CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm END", "book_to_price": "CASE WHEN pb > 0 THEN 1 / pb END", "sales_to_price": "CASE WHEN ps_ttm > 0 THEN 1 / ps_ttm END", "dividend_yield": "dv_ttm / 100", "turnover": "t",
    "turnover_mean": _full(f"avg(t) OVER {_f(20)}", "t", 20, 10), "turnover_deviation": _full(f"stddev_samp(t) OVER {_f(20)}", "t", 20, 10), "abnormal_turnover": f"t / nullif(CASE WHEN count(t) OVER {_PRIOR} >= 10 THEN avg(t) OVER {_PRIOR} END, 0) - 1", "volume_ratio": "volume_ratio",
}


@query(f"""
b AS (SELECT datetime, instrument, {_columns(_BASIC)} FROM panel), t AS (SELECT *, turnover_rate_f / 100 AS t FROM b)
SELECT datetime, instrument, {_columns(_VALUATION)} FROM t""", floats=" ".join(_VALUATION))
def features_valuation(spark, sf_dir):
    return fundamentals.valuation(_made(monthly_panel(spark, sf_dir), _BASIC))


_FLOWS = {f"{side}_{s}_amount": f"amount * {a} + {x} * volume" for side, x in (("buy", "high"), ("sell", "low")) for s, a in (("sm", 0.1), ("md", 0.2), ("lg", 0.3), ("elg", 0.4))} | {"net_mf_amount": "(close - open) * volume / 10000", "traded_amount": "amount"}


def _imbalance(*sizes: str) -> str:
    buy, sell = (" + ".join(f"{side}_{s}_amount" for s in sizes) for side in ("buy", "sell"))
    return f"({buy} - ({sell})) / nullif({buy} + {sell}, 0)"


_FLOW = {
    "overall_imbalance": _imbalance("sm", "md", "lg", "elg"), "small_imbalance": _imbalance("sm"), "medium_imbalance": _imbalance("md"), "large_imbalance": _imbalance("lg"), "extra_large_imbalance": _imbalance("elg"),
    "institutional_imbalance": "big", "net_flow": "net", "net_flow_5": _full(f"avg(net) OVER {_f(5)}", "net", 5, 3), "net_flow_20": _full(f"avg(net) OVER {_f(20)}", "net", 20, 10), "institutional_flow_20": _full(f"avg(big) OVER {_f(20)}", "big", 20, 10),
}


@query(f"""
b AS (SELECT datetime, instrument, {_columns(_FLOWS)} FROM panel), t AS (SELECT *, net_mf_amount * 10000 / nullif(traded_amount, 0) AS net, {_imbalance('lg', 'elg')} AS big FROM b)
SELECT datetime, instrument, {_columns(_FLOW)} FROM t""", floats=" ".join(_FLOW))
def features_order_flow(spark, sf_dir):
    return fundamentals.order_flow(_made(monthly_panel(spark, sf_dir), _FLOWS))


_STATEMENT = {
    "information_available_date": "datetime", "revenue": "amount", "cost": "amount * 0.6", "operating_profit": "amount * 0.2", "net_income": "(close - open) * volume", "cashflow": "(high - open) * volume", "market_cap": "close * 1000",
    "total_assets": "amount * 2", "total_liabilities": "amount * 0.9", "equity": "amount * 1.1", "current_assets": "volume * high", "current_liabilities": "volume * low", "cash": "volume", "prior_total_assets": "amount + 10000",
    "prior_revenue": "vwap * 100", "prior_net_income": "(low - open) * volume",
}
_RATIOS = {
    "gross_profitability": ("revenue - cost", "total_assets"), "operating_profitability": ("operating_profit", "total_assets"), "return_on_assets": ("net_income", "total_assets"), "book_leverage": ("total_liabilities", "total_assets"),
    "current_ratio": ("current_assets", "current_liabilities"), "cash_ratio": ("cash", "current_liabilities"), "cashflow_to_assets": ("cashflow", "total_assets"), "cashflow_quality": ("cashflow", "abs(net_income)"), "accruals": ("net_income - cashflow", "total_assets"),
    "cashflow_to_sales": ("cashflow", "revenue"), "gross_margin": ("revenue - cost", "revenue"), "net_margin": ("net_income", "revenue"), "book_to_market": ("equity", "market_cap"), "earnings_to_price": ("net_income", "market_cap"),
    "sales_to_price": ("revenue", "market_cap"), "cashflow_to_price": ("cashflow", "market_cap"),
}
_FACTORS = {k: f"({a}) / nullif({b}, 0)" for k, (a, b) in _RATIOS.items()} | {
    "asset_growth": "total_assets / nullif(prior_total_assets, 0) - 1", "revenue_growth": "revenue / nullif(prior_revenue, 0) - 1", "income_growth": "net_income / nullif(abs(prior_net_income), 0) - sign(prior_net_income)",
}


@query(f"""
s AS (SELECT datetime, instrument, {_columns(_STATEMENT)} FROM panel)
SELECT datetime, instrument, {_columns(_FACTORS)} FROM s""", floats=" ".join(_FACTORS))
def features_statements(spark, sf_dir):
    return fundamentals.statement_factors(_made(monthly_panel(spark, sf_dir), _STATEMENT))


# ------------------------------------------------------------------ statements
_SOURCE = """src AS (SELECT CAST(o_custkey AS VARCHAR) AS ts_code, CAST(year(o_orderdate) - 1 AS VARCHAR) || '1231' AS end_date, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y%m%d') ELSE 'unknown' END AS ann_date,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(CAST(o_orderdate AS DATE) + 1, '%Y%m%d') END AS f_ann_date, CAST(o_orderkey % 2 AS VARCHAR) AS update_flag, CASE o_orderkey % 3 WHEN 0 THEN 'balancesheet' WHEN 1 THEN 'cashflow' ELSE 'income' END AS dataset, CAST(o_orderkey AS VARCHAR) AS source_id, o_totalprice AS amount FROM orders),
pr AS (SELECT *, coalesce(try_strptime(f_ann_date, '%Y%m%d'), try_strptime(ann_date, '%Y%m%d')) AS a, sha256(to_json({'ann_date': ann_date, 'dataset': dataset, 'end_date': end_date, 'f_ann_date': f_ann_date, 'source_id': source_id, 'ts_code': ts_code, 'update_flag': update_flag})) AS row_hash FROM src),
pp AS (SELECT *, CAST(a AS DATE) AS available, CASE WHEN try_strptime(f_ann_date, '%Y%m%d') IS NOT NULL THEN 'f_ann_date' WHEN a IS NOT NULL THEN 'ann_date' END AS available_from, CASE WHEN a IS NULL THEN 'research_pending' ELSE 'authoritative' END AS status, CAST(update_flag AS INTEGER) AS priority,
  row_number() OVER (PARTITION BY ts_code, dataset, end_date ORDER BY a NULLS LAST, CAST(update_flag AS INTEGER), row_hash) AS sequence FROM pr)"""


def _statements(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    text = lambda c: F.date_format(c, "yyyyMMdd")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("ts_code"), F.concat((F.year(day) - 1).cast("string"), F.lit("1231")).alias("end_date"), F.when(key % 11 != 0, text(day)).otherwise("unknown").alias("ann_date"),
        F.when(key % 3 == 0, text(F.date_add(day, 1))).alias("f_ann_date"), (key % 2).cast("string").alias("update_flag"), F.when(key % 3 == 0, "balancesheet").when(key % 3 == 1, "cashflow").otherwise("income").alias("dataset"), key.cast("string").alias("source_id"),
    )
    return fundamentals.prepared_revisions(rows, ["f_ann_date", "ann_date"], ["ts_code", "dataset"])


@query(f"{_SOURCE}\nSELECT ts_code, dataset, end_date, source_id, available, available_from, status, row_hash, priority, sequence FROM pp", base="")
def statements_revisions(spark, sf_dir):
    return _statements(spark, sf_dir).select("ts_code", "dataset", "end_date", "source_id", "available", "available_from", "status", "row_hash", "priority", "sequence")


_WINNERS = f"""{_SOURCE}, wn AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ts_code, dataset, end_date, available) AS same_day, row_number() OVER (PARTITION BY ts_code, dataset, end_date, available ORDER BY priority DESC, sequence DESC) AS r FROM pp WHERE available IS NOT NULL) WHERE r = 1)"""


@query(f"{_WINNERS}\nSELECT ts_code, dataset, end_date, available, source_id, same_day FROM wn", base="")
def statements_winners(spark, sf_dir):
    return fundamentals.winners(_statements(spark, sf_dir), ["ts_code", "dataset"]).select("ts_code", "dataset", "end_date", "available", "source_id", "same_day")


@query(f"""
{_WINNERS}, ev AS (SELECT ts_code AS entity, dataset, available, CAST(strptime(end_date, '%Y%m%d') AS DATE) AS period, source_id AS value FROM wn), whole AS (SELECT entity, period, max(a) AS a FROM (SELECT entity, period, dataset, min(available) AS a FROM ev GROUP BY ALL) GROUP BY 1, 2 HAVING count(*) = 3),
cur AS (SELECT d.entity, d.available, max(w.period) AS period FROM (SELECT DISTINCT entity, available FROM ev) d JOIN whole w ON w.entity = d.entity AND w.a <= d.available GROUP BY 1, 2),
known AS (SELECT c.entity, c.available, c.period, e.dataset, e.period = c.period AS own, arg_max(e.value, e.available) AS value FROM cur c JOIN ev e ON e.entity = c.entity AND e.available <= c.available AND (e.period = c.period OR e.period = CAST(c.period - INTERVAL 12 MONTH AS DATE)) GROUP BY ALL)
SELECT entity, available, period, max(value) FILTER (WHERE own AND dataset = 'income') AS income, max(value) FILTER (WHERE own AND dataset = 'balancesheet') AS balancesheet, max(value) FILTER (WHERE own AND dataset = 'cashflow') AS cashflow, max(value) FILTER (WHERE NOT own AND dataset = 'income') AS prior_income, max(value) FILTER (WHERE NOT own AND dataset = 'balancesheet') AS prior_balancesheet FROM known GROUP BY 1, 2, 3""", base="")
def statements_timeline(spark, sf_dir):
    """What was public of three statements on each public date; values are ids of the source rows."""
    e = fundamentals.winners(_statements(spark, sf_dir), ["ts_code", "dataset"]).select(F.col("ts_code").alias("entity"), "dataset", "available", F.to_date("end_date", "yyyyMMdd").alias("period"), F.col("source_id").alias("value"))
    return fundamentals.event_timeline(e, ["income", "balancesheet", "cashflow"], ["income", "balancesheet"])


@query(f"""
{_SOURCE}, n AS (SELECT dataset, ts_code, end_date, count(*) AS n, count(*) - count(available) AS p FROM pp GROUP BY ALL)
SELECT dataset, CAST(sum(n) AS BIGINT) AS rows, count(DISTINCT ts_code) AS entities, count(*) AS periods, count(*) FILTER (WHERE n > 1) AS revised, max(n) AS most_revisions, CAST(sum(p) AS BIGINT) AS pending FROM n GROUP BY 1""", base="")
def statements_revision_audit(spark, sf_dir):
    return fundamentals.revision_audit(_statements(spark, sf_dir), ["ts_code"], "dataset")


@query("""
k AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS datetime, CAST(o_custkey AS VARCHAR) AS instrument FROM orders), ev AS (SELECT CAST(o_custkey AS VARCHAR) AS instrument, CAST(o_orderdate AS DATE) AS available FROM orders),
l AS (SELECT k.datetime, k.instrument, max(ev.available) AS latest FROM k JOIN ev ON ev.instrument = k.instrument AND ev.available <= k.datetime GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN month(datetime) = 3 THEN datetime + 1 WHEN month(datetime) = 7 THEN latest - 400 ELSE latest END AS available FROM l), b AS (SELECT *, max(available) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
c AS (SELECT 'future_use' AS check_name, count(*) FILTER (WHERE available > datetime) AS observed_value FROM b UNION ALL SELECT 'availability_goes_back', count(*) FILTER (WHERE available < before) FROM b UNION ALL SELECT 'not_the_latest', count(*) FILTER (WHERE available IS DISTINCT FROM latest) FROM b)
SELECT check_name, CASE WHEN observed_value = 0 THEN 'pass' ELSE 'fail' END AS status, observed_value FROM c""", base="")
def statements_pit_audit(spark, sf_dir):
    """Damaged alignments: some values from the future, some too old."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("instrument"), F.to_date("o_orderdate").alias("available"))
    keys = o.select(F.add_months(F.trunc("available", "month"), 1).alias("datetime"), "instrument").distinct()
    rows = joins.as_of(keys, o, "available", []).withColumnRenamed("event_date", "available")
    bad = F.when(F.month("datetime") == 3, F.date_add("datetime", 1)).when(F.month("datetime") == 7, F.date_sub("available", 400)).otherwise(F.col("available"))
    return fundamentals.pit_audit(rows.withColumn("available", bad), o)


# ------------------------------------------------------------------ tradability and market tables
_ISSUED = f"""r0 AS (SELECT *, lag(close) OVER ({W}) AS pc, CAST(volume AS BIGINT) AS v FROM panel), r1 AS (SELECT datetime, instrument, open, high, low, CASE WHEN v % 13 = 0 THEN NULL ELSE close END AS close, CASE WHEN v % 9 = 0 THEN 0 ELSE volume END AS volume, amount, v FROM r0),
r2 AS (SELECT *, lag(close) OVER ({W}) AS pc FROM r1)"""
_LABELS = f"""{_ISSUED}, l1 AS (SELECT *, pc IS NOT NULL AND close IS NOT NULL AS known FROM r2), l2 AS (SELECT *, known AND close >= pc * 1.098 AND high >= pc * 1.098 AS up, known AND close <= pc * 0.902 AND low <= pc * 0.902 AS down FROM l1),
l3 AS (SELECT *, abs(open - high) <= 1e-4 AND abs(high - low) <= 1e-4 AND abs(low - close) <= 1e-4 AS flat, close IS NULL AS cm, list_sort(list_distinct(quantile_cont(amount, [0.0, 0.25, 0.5, 0.75, 1.0]) OVER ({D}))) AS e, count(*) OVER ({D}) AS n, min(CASE WHEN close IS NOT NULL THEN datetime END) OVER (PARTITION BY instrument) AS lst FROM l2),
l4 AS (SELECT *, CASE WHEN n >= 4 AND len(e) > 1 THEN 1 + len(list_filter(list_slice(e, 2, len(e) - 1), lambda q: q < amount)) END AS b, coalesce(up AND flat, false) AS ou, coalesce(down AND flat, false) AS od, cm OR volume = 0 AS su, coalesce(datediff('day', lst, datetime) < 90, true) AS nl, v % 17 = 0 AS pa, v % 19 = 0 AS va FROM l3),
l5 AS (SELECT *, coalesce(b <= 1, false) AS ll, NOT known OR b IS NULL AS un FROM l4)"""


def _issued(spark, sf_dir):
    v = F.col("volume").cast("long")
    p = monthly_panel(spark, sf_dir).withColumn("v", v)
    return p.withColumns({"close": F.when(F.col("v") % 13 != 0, F.col("close")), "volume": F.when(F.col("v") % 9 == 0, 0.0).otherwise(F.col("volume"))})


@query(f"""
{_LABELS}
SELECT datetime, instrument, CAST(b AS INTEGER) AS liquidity_bucket, NOT (su OR pa OR va OR cm OR un OR up OR ll OR nl) AS can_buy, NOT (su OR pa OR va OR cm OR un OR down) AS can_sell,
  greatest(0, 100 - CASE WHEN su THEN 100 ELSE 0 END - CASE WHEN up OR down THEN 50 ELSE 0 END - CASE WHEN ou OR od THEN 30 ELSE 0 END - CASE WHEN ll THEN 20 ELSE 0 END - CASE WHEN nl THEN 15 ELSE 0 END - CASE WHEN pa THEN 50 ELSE 0 END - CASE WHEN va THEN 35 ELSE 0 END - CASE WHEN cm THEN 100 ELSE 0 END - CASE WHEN un THEN 40 ELSE 0 END) AS tradability_score,
  array_to_string(list_filter([CASE WHEN su THEN 'suspended' END, CASE WHEN up THEN 'limit_up' END, CASE WHEN down THEN 'limit_down' END, CASE WHEN ou THEN 'one_price_limit_up' END, CASE WHEN od THEN 'one_price_limit_down' END, CASE WHEN ll THEN 'low_liquidity' END, CASE WHEN nl THEN 'new_listing' END, CASE WHEN pa THEN 'price_anomaly' END, CASE WHEN va THEN 'volume_anomaly' END, CASE WHEN cm THEN 'core_missing' END, CASE WHEN NOT known THEN 'unknown_limit' END, CASE WHEN b IS NULL THEN 'unknown_liquidity' END], lambda x: x IS NOT NULL), '|') AS disabled_reason FROM l5""", floats="tradability_score")
def tradability_full_labels(spark, sf_dir):
    p = _issued(spark, sf_dir)
    issues = p.where("v % 17 = 0").select(*KEYS, F.lit("price").alias("category")).union(p.where("v % 19 = 0").select(*KEYS, F.lit("volume_amount").alias("category")))
    out = market.tradability_labels(p, F.lit(0.1), issues, buckets=4, new_days=90)
    return out.select(*KEYS, "liquidity_bucket", "can_buy", "can_sell", "tradability_score", "disabled_reason")


@query("SELECT datetime, instrument, close / 1.25 AS close, high / 1.25 AS high, volume * 1.25 AS volume FROM panel", floats="close high volume")
def market_raw_units(spark, sf_dir):
    return market.raw_units(monthly_panel(spark, sf_dir).withColumn("factor", F.lit(1.25))).select(*KEYS, "close", "high", "volume")


@query(f"""
{_ISSUED}, g AS (SELECT c.datetime, i.instrument, r.close, r.volume FROM cal c CROSS JOIN (SELECT DISTINCT instrument FROM panel) i LEFT JOIN r1 r ON r.datetime = c.datetime AND r.instrument = i.instrument), s AS (SELECT *, min(CASE WHEN close IS NOT NULL THEN datetime END) OVER (PARTITION BY instrument) AS lo, max(CASE WHEN close IS NOT NULL THEN datetime END) OVER (PARTITION BY instrument) AS hi FROM g)
SELECT datetime, instrument, last_value(close IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS close, coalesce(volume, 0) AS volume, close IS NULL OR coalesce(volume, 0) = 0 AS suspended, NOT (close IS NULL OR coalesce(volume, 0) = 0) AS can_buy, NOT (close IS NULL OR coalesce(volume, 0) = 0) AS can_sell FROM s WHERE datetime BETWEEN lo AND hi""", floats="close volume")
def market_dense_table(spark, sf_dir):
    p = _issued(spark, sf_dir)
    return market.market_table(p, joins.calendar_of(p))


@query(f"""
{_ISSUED}, n AS (SELECT instrument, count(close) AS dates FROM r1 GROUP BY 1)
SELECT instrument, dates FROM n WHERE dates >= (SELECT count(*) FROM cal) * 0.9""")
def market_complete_instruments(spark, sf_dir):
    p = _issued(spark, sf_dir)
    return market.complete_instruments(p, joins.calendar_of(p), 0.9)


@query(f"""
a AS (SELECT instrument, min(datetime) AS anchor_date, 2.0 AS anchor_factor FROM panel WHERE right(instrument, 1) < '6' GROUP BY 1), p AS (SELECT *, round(lag(close) OVER ({W}) * CASE WHEN CAST(volume AS BIGINT) % 5 = 0 THEN 0.98 ELSE 1 END, 6) AS preclose, lag(close) OVER ({W}) AS before FROM panel),
s AS (SELECT p.*, anchor_date, anchor_factor, coalesce(before / nullif(preclose, 0), 1) AS step FROM p LEFT JOIN a USING (instrument) WHERE anchor_date IS NULL OR datetime > anchor_date), t AS (SELECT *, CASE WHEN anchor_date IS NULL AND row_number() OVER ({W}) = 1 THEN 1 / close ELSE step END AS x FROM s)
SELECT datetime, instrument, ln(coalesce(anchor_factor, 1) * product(x) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS log_factor FROM t""", floats="log_factor")
def ts_chained_factor(spark, sf_dir):
    from tessera.functions import ts

    p = monthly_panel(spark, sf_dir)
    anchor = p.where(F.right("instrument", F.lit(1)) < "6").groupBy("instrument").agg(F.min("datetime").alias("anchor_date")).withColumn("anchor_factor", F.lit(2.0))
    pre = F.round(ts.ref(F.col("close"), 1) * F.when(F.col("volume").cast("long") % 5 == 0, 0.98).otherwise(1.0), 6)
    return market.chained_factor(p.withColumn("preclose", pre), anchor).select(*KEYS, F.ln("factor").alias("log_factor"))


@query(f"""
life AS (SELECT instrument, min(datetime) AS s, max(CASE WHEN right(instrument, 1) = '3' THEN DATE '2000-06-01' END) AS e FROM panel GROUP BY 1), r(board, s, e, rule_id) AS (VALUES ('main', DATE '1990-01-01', DATE '1997-12-31', 'm1'), ('main', DATE '1998-01-01', NULL, 'm2'), ('growth', DATE '1990-01-01', DATE '1999-12-31', 'g1'), ('growth', DATE '1999-01-01', NULL, 'g2')),
p AS (SELECT p.datetime, p.instrument, CASE WHEN right(p.instrument, 1) < '5' THEN 'main' ELSE 'growth' END AS board, p.datetime >= life.s AS listed, coalesce(p.datetime > life.e, false) AS delisted, c.pos - l.pos AS age FROM panel p JOIN cal c USING (datetime) JOIN life USING (instrument) JOIN cal l ON l.datetime = life.s)
SELECT p.datetime, p.instrument, p.board, listed, delisted, age, CASE WHEN count(rule_id) = 1 THEN max(rule_id) END AS rule_id FROM p LEFT JOIN r ON r.board = p.board AND p.datetime >= r.s AND (r.e IS NULL OR p.datetime <= r.e) GROUP BY ALL""")
def market_instrument_states(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    life = p.groupBy("instrument").agg(F.min("datetime").alias("start"), F.max(F.when(F.right("instrument", F.lit(1)) == "3", F.lit("2000-06-01").cast("date"))).alias("end"))
    rules = spark.createDataFrame([("main", dt.date(1990, 1, 1), dt.date(1997, 12, 31), "m1"), ("main", dt.date(1998, 1, 1), None, "m2"), ("growth", dt.date(1990, 1, 1), dt.date(1999, 12, 31), "g1"), ("growth", dt.date(1999, 1, 1), None, "g2")], "board string, start date, end date, rule_id string")
    return market.instrument_states(p, life, joins.calendar_of(p), rules)


@query(f"SELECT datetime, instrument, CASE WHEN count(volume) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5 THEN avg(volume) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END * 0.1 AS tradable_volume FROM panel", floats="tradable_volume")
def market_participation(spark, sf_dir):
    return market.participation_volume(monthly_panel(spark, sf_dir), 5, 0.1)


_FACTS = """f AS (SELECT instrument, 'amount' AS field, datetime + 5 AS visible, amount AS value FROM panel UNION ALL SELECT instrument, 'age', datetime, CAST(year(datetime) - 1994 AS DOUBLE) FROM panel WHERE month(datetime) = 6 UNION ALL SELECT instrument, 'suspended', datetime, CAST(CAST(volume AS BIGINT) % 4 = 0 AS INTEGER) FROM panel UNION ALL SELECT instrument, 'delisted', DATE '2000-01-01', 1.0 FROM panel WHERE right(instrument, 1) = '2' GROUP BY instrument)"""


@query(f"""
{_FACTS}, h AS (SELECT p.datetime, p.instrument, field, arg_max(f.value, (f.visible, f.value)) AS v FROM panel p JOIN f ON f.instrument = p.instrument AND f.visible <= p.datetime GROUP BY 1, 2, 3),
w AS (SELECT p.datetime, p.instrument, max(v) FILTER (WHERE field = 'age') AS age, max(v) FILTER (WHERE field = 'amount') AS am, max(v) FILTER (WHERE field = 'delisted') AS de, max(v) FILTER (WHERE field = 'suspended') AS su FROM panel p LEFT JOIN h USING (datetime, instrument) GROUP BY 1, 2),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN age IS NULL THEN 'age_unknown' END, CASE WHEN age < 3 THEN 'too_young' END, CASE WHEN am IS NULL THEN 'amount_unknown' END, CASE WHEN am < 50000 THEN 'illiquid' END, CASE WHEN de = 1 THEN 'delisted' END, CASE WHEN su = 1 THEN 'suspended' END], lambda x: x IS NOT NULL), '|') AS reasons FROM w)
SELECT datetime, instrument, reasons = '' AS entry, reasons, CASE WHEN de = 1 THEN 'sell' WHEN su = 1 THEN 'hold' WHEN am < 50000 THEN 'reduce' ELSE 'keep' END AS action FROM r""")
def market_eligibility(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    fact = lambda f, field, visible, value: f.select("instrument", F.lit(field).alias("field"), visible.alias("visible"), value.cast("double").alias("value"))
    d = F.col("datetime")
    facts = fact(p, "amount", F.date_add(d, 5), F.col("amount")).union(fact(p.where(F.month(d) == 6), "age", d, F.year(d) - 1994)).union(fact(p, "suspended", d, (F.col("volume").cast("long") % 4 == 0).cast("int")))
    facts = facts.union(fact(p.where(F.right("instrument", F.lit(1)) == "2").select("instrument").distinct(), "delisted", F.lit("2000-01-01").cast("date"), F.lit(1.0)))
    return market.eligibility(p.select(*KEYS), facts, least_age=3, least_amount=50000)


@query(f"""
p AS (SELECT *, lag(close) OVER ({W}) AS before FROM panel), b AS (SELECT *, CAST(round(CAST(before AS DECIMAL(18,4)) * CAST(0.9 AS DECIMAL(6,4)), 2) AS DOUBLE) AS lo, CAST(round(CAST(before AS DECIMAL(18,4)) * CAST(1.1 AS DECIMAL(6,4)), 2) AS DOUBLE) AS hi FROM p), q AS (SELECT *, CASE WHEN CAST(volume AS BIGINT) % 5 > 0 THEN lo END AS ql, CASE WHEN CAST(volume AS BIGINT) % 3 = 0 THEN hi + 1 ELSE hi END AS qh FROM b)
SELECT datetime, instrument, volume = 0 AS suspended, lo AS low_bound, hi AS high_bound, CASE WHEN before IS NULL THEN 'no_reference' WHEN ql IS NULL THEN 'no_quote' WHEN abs(ql - lo) <= 0.005 AND abs(qh - hi) <= 0.005 THEN 'agreed' ELSE 'mismatch' END AS limit_state FROM q""", floats="low_bound high_bound")
def market_session_records(spark, sf_dir):
    from tessera.functions import ts
    from tessera.operators.portfolio import tick_bounds

    p = monthly_panel(spark, sf_dir)
    low, high = tick_bounds(ts.ref(F.col("close"), 1), 0.1)
    v = F.col("volume").cast("long")
    q = p.select(*KEYS, F.when(v % 5 > 0, low.cast("double")).alias("quoted_low"), (high.cast("double") + F.when(v % 3 == 0, 1).otherwise(0)).alias("quoted_high"))
    return market.session_records(p, 0.1, q)


_TWO = """s AS (SELECT datetime, instrument, close, CASE WHEN CAST(volume AS BIGINT) % 6 = 0 THEN 0 ELSE volume END AS volume FROM panel WHERE CAST(volume AS BIGINT) % 10 <> 1), l AS (SELECT datetime, instrument, CASE WHEN CAST(volume AS BIGINT) % 8 = 0 THEN close * 1.5 ELSE close END AS close, CASE WHEN CAST(volume AS BIGINT) % 6 = 0 THEN 0 ELSE volume END AS volume FROM panel WHERE CAST(volume AS BIGINT) % 10 <> 3),
st AS (SELECT coalesce(s.datetime, l.datetime) AS datetime, coalesce(s.instrument, l.instrument) AS instrument, CASE WHEN l.close IS NULL THEN 'source_only' WHEN s.close IS NULL THEN 'local_only' WHEN s.volume = 0 AND l.volume = 0 THEN 'suspended' WHEN abs(s.close - l.close) <= 0.001 * abs(s.close) THEN 'agreed' ELSE 'conflict' END AS status FROM s FULL JOIN l ON s.datetime = l.datetime AND s.instrument = l.instrument)"""


def _two(spark, sf_dir):
    p = monthly_panel(spark, sf_dir).withColumn("v", F.col("volume").cast("long")).withColumn("volume", F.when(F.col("v") % 6 == 0, 0.0).otherwise(F.col("volume")))
    return market.quote_status(p.where("v % 10 <> 1"), p.where("v % 10 <> 3").withColumn("close", F.when(F.col("v") % 8 == 0, F.col("close") * 1.5).otherwise(F.col("close"))), 0.001)


@query(f"{_TWO}\nSELECT * FROM st")
def market_quote_status(spark, sf_dir):
    return _two(spark, sf_dir)


@query(f"""
{_TWO}, g AS (SELECT st.*, pos, pos - row_number() OVER (PARTITION BY instrument, status ORDER BY pos) AS g FROM st JOIN cal USING (datetime))
SELECT instrument, status, min(datetime) AS start_date, max(datetime) AS end_date, count(*) AS sessions FROM g GROUP BY instrument, status, g""")
def market_status_segments(spark, sf_dir):
    out = market.status_segments(_two(spark, sf_dir), joins.calendar_of(monthly_panel(spark, sf_dir)))
    return out.select("instrument", "status", F.col("start").alias("start_date"), F.col("end").alias("end_date"), "sessions")


# ------------------------------------------------------------------ universes and audits
@query("""
w AS (SELECT instrument, avg(amount) AS mean_amount, count(amount) AS days FROM panel WHERE datetime BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1 HAVING count(amount) >= 12)
SELECT *, row_number() OVER (ORDER BY mean_amount DESC, instrument) AS rank FROM w QUALIFY rank <= 20""", floats="mean_amount")
def universe_static(spark, sf_dir):
    return market.static_universe(monthly_panel(spark, sf_dir), "1997-01-01", "1998-12-31", 12, 20)


_LIVES = "lf AS (SELECT instrument, min(datetime) AS s, max(datetime) AS e FROM panel GROUP BY 1), mb AS (SELECT instrument, CAST(s - INTERVAL 2 MONTH AS DATE) AS s, CAST(s + INTERVAL 24 MONTH AS DATE) AS e FROM lf WHERE right(instrument, 1) < '5' UNION ALL SELECT instrument, CAST(s + INTERVAL 20 MONTH AS DATE), CAST(s + INTERVAL 40 MONTH AS DATE) FROM lf UNION ALL SELECT 'X' || instrument, s, e FROM lf WHERE right(instrument, 1) = '1')"


def _lives(spark, sf_dir):
    life = monthly_panel(spark, sf_dir).groupBy("instrument").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"))
    first = life.where(F.right("instrument", F.lit(1)) < "5").select("instrument", F.add_months("start", -2).alias("start"), F.add_months("start", 24).alias("end"))
    second = life.select("instrument", F.add_months("start", 20).alias("start"), F.add_months("start", 40).alias("end"))
    third = life.where(F.right("instrument", F.lit(1)) == "1").select(F.concat(F.lit("X"), "instrument").alias("instrument"), "start", "end")
    return life, first.union(second).union(third)


@query(f"{_LIVES}\nSELECT substr(instrument, 1, 6) AS prefix, count(DISTINCT instrument) AS instruments, count(*) AS spans, min(s) AS first_date, max(e) AS last_date FROM mb GROUP BY 1")
def universe_summary(spark, sf_dir):
    return market.universe_summary(_lives(spark, sf_dir)[1], 6)


@query(f"""
{_LIVES}, b AS (SELECT mb.*, max(mb.e) OVER (PARTITION BY mb.instrument ORDER BY mb.s, mb.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lf.s AS ls, lf.e AS le FROM mb LEFT JOIN lf USING (instrument))
SELECT instrument, s AS start_date, e AS end_date, unnest(list_filter([CASE WHEN ls IS NULL THEN 'no_life' END, CASE WHEN s < ls OR e > le THEN 'outside_life' END, CASE WHEN s <= before THEN 'overlap' END], lambda x: x IS NOT NULL)) AS issue FROM b""")
def universe_membership_issues(spark, sf_dir):
    life, members = _lives(spark, sf_dir)
    return market.membership_issues(members, life).select("instrument", F.col("start").alias("start_date"), F.col("end").alias("end_date"), "issue")


@query(f"""
{_LIVES}, a AS (SELECT DISTINCT datetime, instrument FROM cal JOIN lf ON datetime BETWEEN s AND e), b AS (SELECT DISTINCT datetime, instrument FROM cal JOIN mb ON datetime BETWEEN s AND e)
SELECT coalesce(a.datetime, b.datetime) AS datetime, count(*) FILTER (WHERE a.instrument IS NOT NULL AND b.instrument IS NOT NULL) AS both, count(*) FILTER (WHERE b.instrument IS NULL) AS left_only, count(*) FILTER (WHERE a.instrument IS NULL) AS right_only FROM a FULL JOIN b ON a.datetime = b.datetime AND a.instrument = b.instrument GROUP BY 1""")
def universe_active_sets(spark, sf_dir):
    life, members = _lives(spark, sf_dir)
    return market.active_sets(life, members, joins.calendar_of(monthly_panel(spark, sf_dir)))


@query(f"""
f AS (SELECT datetime, instrument, CASE WHEN CAST(volume AS BIGINT) % 7 = 0 THEN 1.0 WHEN CAST(volume AS BIGINT) % 7 = 1 THEN 1.01 ELSE 2.0 END AS factor FROM panel), s AS (SELECT *, abs(factor / lag(factor) OVER ({W}) - 1) AS s FROM f)
SELECT instrument, count(*) AS rows, count(*) FILTER (WHERE s > 1e-9) AS changes, count(*) FILTER (WHERE s > 0.05) AS breaks FROM s GROUP BY 1""")
def quality_adjustment_changes(spark, sf_dir):
    v = F.col("volume").cast("long") % 7
    return market.adjustment_changes(monthly_panel(spark, sf_dir).withColumn("factor", F.when(v == 0, 1.0).when(v == 1, 1.01).otherwise(2.0)), 0.05)


@query("""
s AS (SELECT instrument AS partition_id, year(datetime) AS segment_id, CASE WHEN year(datetime) % 3 = 0 THEN max(datetime) ELSE min(datetime) END AS s, CASE WHEN year(datetime) % 3 = 0 THEN min(datetime) ELSE max(datetime) + 40 END AS e FROM panel GROUP BY instrument, year(datetime)),
b AS (SELECT *, max(e) OVER (PARTITION BY partition_id ORDER BY s, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT partition_id, CAST(segment_id AS INTEGER) AS segment_id, unnest(list_filter([CASE WHEN e < s THEN 'reversed' END, CASE WHEN s <= before THEN 'overlap' END], lambda x: x IS NOT NULL)) AS issue FROM b""")
def quality_segment_issues(spark, sf_dir):
    y, odd = F.year("datetime"), F.year("datetime") % 3 == 0
    g = monthly_panel(spark, sf_dir).groupBy(F.col("instrument").alias("partition_id"), y.alias("segment_id")).agg(F.min("datetime").alias("lo"), F.max("datetime").alias("hi"))
    odd = F.col("segment_id") % 3 == 0
    return market.segment_issues(g.select("partition_id", "segment_id", F.when(odd, F.col("hi")).otherwise(F.col("lo")).alias("start"), F.when(odd, F.col("lo")).otherwise(F.date_add("hi", 40)).alias("end")))


@query("""
f AS (SELECT instrument, 'digit' AS field, right(instrument, 1) AS value FROM panel UNION ALL SELECT instrument, 'year', CASE WHEN month(datetime) > 2 THEN CAST(year(datetime) AS VARCHAR) END FROM panel), n AS (SELECT field, instrument, count(*) AS n, count(value) AS p, count(DISTINCT value) AS d FROM f GROUP BY 1, 2)
SELECT field, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(p) AS BIGINT) AS present, count(*) FILTER (WHERE d = 1 AND p > 1) AS constant FROM n GROUP BY 1""")
def quality_backfill_audit(spark, sf_dir):
    p = monthly_panel(spark, sf_dir).select(*KEYS, F.right("instrument", F.lit(1)).alias("digit"), F.when(F.month("datetime") > 2, F.year("datetime")).alias("year"))
    return market.backfill_audit(p, ["digit", "year"])


@query("""
d AS (SELECT datetime, round(avg(close), 6) AS v FROM panel GROUP BY 1), q AS (SELECT quantile_cont(v, [1.0::DOUBLE / 3, 2.0::DOUBLE / 3]) AS q FROM d), w(win, s, e) AS (VALUES ('a', DATE '1995-01-01', DATE '1997-12-31'), ('b', DATE '1997-06-01', DATE '2002-01-01'))
SELECT win AS "window", count(*) FILTER (WHERE v <= q[1]) AS low, count(*) FILTER (WHERE v > q[1] AND v <= q[2]) AS middle, count(*) FILTER (WHERE v > q[2]) AS high FROM d JOIN w ON datetime BETWEEN s AND e, q GROUP BY 1""")
def quality_regime_coverage(spark, sf_dir):
    d = monthly_panel(spark, sf_dir).groupBy("datetime").agg(F.round(F.avg("close"), 6).alias("v"))
    w = spark.createDataFrame([("a", dt.date(1995, 1, 1), dt.date(1997, 12, 31)), ("b", dt.date(1997, 6, 1), dt.date(2002, 1, 1))], "window string, start date, end date")
    return market.regime_coverage(d, "v", w)

