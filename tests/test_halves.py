"""Prices over quantities that are halves in the seventh digit: the panel and its SQL round them alike, and up."""

import datetime as dt

import duckdb

from tessera.plans.base import MONTHLY
from tessera.sources.panel import monthly_panel

PRICES = [16505.19, 67639.37, 34167.63, 66642.79, 8541.13]


def test_halves_of_unit_prices(spark, tmp_path):
    rows = [(i, i, 1, 32.0, p, dt.datetime(1997, 1, 2)) for i, p in enumerate(PRICES)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = [(515.787188,), (2113.730313,), (1067.738438,), (2082.587188,), (266.910313,)]
    for column in ("open", "high", "low", "close", "vwap"):
        assert con.sql(f"WITH {MONTHLY} SELECT {column} FROM panel ORDER BY instrument").fetchall() == want
        assert [tuple(r) for r in monthly_panel(spark, str(tmp_path)).orderBy("instrument").select(column).collect()] == want
