"""Scores of suppliers that appear late, and panels of orders that have a line number twice: the query and its SQL give the same rows."""

import datetime as dt
import random

import duckdb
import pytest

from tessera.plans import registry
from tessera.plans.base import MONTHLY
from tessera.sources.panel import monthly_panel

LINE = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"


def written(spark, path, rows):
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("query", ["score_composite", "score_directional"])
def test_missing_values_are_no_parts(spark, tmp_path, query):
    """Supplier 4's first month has no month before it, so only kmid of its three values is there; DuckDB's least skips NULL."""
    rng = random.Random(5)
    rows = [(m * 10 + s, s, i, float(rng.randint(1, 50)), round(rng.uniform(900, 90000), 2), dt.datetime(1997, m, 3)) for m in (1, 2, 3) for s in range(5) if s < 4 or m > 1 for i in (1, 2)]
    con = written(spark, tmp_path, rows)
    want = con.sql(f"SELECT datetime, instrument, score, parts FROM ({registry.oracle_sql()[query]}) ORDER BY ALL").fetchall()
    got = [tuple(r) for r in registry.queries()[query](spark, str(tmp_path)).select("datetime", "instrument", "score", "parts").orderBy("datetime", "instrument").collect()]
    assert (dt.date(1997, 2, 1), "S000004", None, 1) in got
    assert got == want


def test_a_line_number_twice(spark, tmp_path):
    """Among equal line numbers of an order, the price and then the quantity decide which comes first."""
    lines = [(7, 1, 1, q, p, dt.datetime(1997, 1, 2)) for p in (30.0, 10.0, 20.0) for q in (4.0, 1.0, 2.0)]
    for i in range(2):
        con = written(spark, tmp_path / str(i), lines[:: 1 - 2 * i])
        assert con.sql(f"WITH {MONTHLY} SELECT open, close FROM panel").fetchall() == [(10.0, 7.5)]
        assert [tuple(r) for r in monthly_panel(spark, str(tmp_path / str(i))).select("open", "close").collect()] == [(10.0, 7.5)]
