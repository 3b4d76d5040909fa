"""Registration of queries with their SQL, and the common table expressions both sides start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def six_digits(x: str) -> str:
    """Nine digits first and halves in decimals: prices over quantities are often halves in the seventh digit, which noise would decide."""
    return f"CAST(round(TRY_CAST({x} AS DECIMAL(38, 9)), 6) AS DOUBLE)"


#: Panels of FIXTURES.md, section B, as common table expressions.
_UNIT = "l_extendedprice / l_quantity"
# an order may have a line number twice
_AT = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity"
MONTHLY = f"""panel AS (
  SELECT *, {six_digits('amount / volume')} AS vwap FROM (
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS datetime, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS instrument,
           {six_digits(f'first({_UNIT} {_AT})')} AS open,
           {six_digits(f'max({_UNIT})')} AS high, {six_digits(f'min({_UNIT})')} AS low,
           {six_digits(f'last({_UNIT} {_AT})')} AS close,
           sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
    FROM lineitem GROUP BY 1, 2)
), cal AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS pos FROM (SELECT DISTINCT datetime FROM panel))"""

DAILY = """panel AS (
  SELECT CAST(ts AS DATE) AS datetime, 'U' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS instrument,
         round(first(value ORDER BY ts, event_id), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low,
         round(last(value ORDER BY ts, event_id), 6) AS close, CAST(count(*) AS DOUBLE) AS volume, round(sum(value), 4) AS amount
  FROM events GROUP BY 1, 2
), cal AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS pos FROM (SELECT DISTINCT datetime FROM panel))"""


def rounded(frame: DataFrame) -> DataFrame:
    """Doubles to six digits: sums in another order change the last bits."""
    return frame.select(*(F.round(f"`{c}`", 6).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in frame.dtypes))


def query(sql: str | None = None, base: str = MONTHLY, floats: str = ""):
    """Registers a function of (spark, sf_dir) under its name; ``floats``: the columns that the SQL rounds to six digits."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            # adding zero turns a negative zero into zero
            body, each = sql.strip(), ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in floats.split())
            head = "" if body.startswith("SELECT") else body[: body.index("\nSELECT")]
            select = body[len(head) :].strip() if head else body
            ctes = ", ".join(x for x in (base, head.strip().rstrip(",")) if x)
            ORACLES[f.__name__] = f"{f'WITH RECURSIVE {ctes}' if ctes else ''}\nSELECT * {f'REPLACE ({each}) ' if each else ''}FROM (\n{select}\n)"
        return f

    return register
