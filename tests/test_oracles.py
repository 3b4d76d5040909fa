"""Every query with SQL gives DuckDB's rows; queries without SQL give some rows of a stable schema."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def cell(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return "missing"
        if isinstance(v, bool) or str(type(v).__name__).startswith("bool"):
            return str(bool(v))
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return v if isinstance(v, str) else repr(round(float(v), 5) + 0.0)

    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck):
    got = registry.queries()[name](spark, DIR)
    rows = got.toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(rows) > 0
        return
    want = duck.sql(sql).df()
    columns = sorted(want.columns)
    assert sorted(rows.columns) == columns
    assert plain(rows, columns) == plain(want, columns)
