"""Panels: long tables keyed by (datetime, instrument), their readers, writers and derivation from order lines and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.guard import finite, ratio

KEYS = ["datetime", "instrument"]
INTERVALS = T.StructType([T.StructField("instrument", T.StringType()), T.StructField("start", T.DateType()), T.StructField("end", T.DateType())])


def six_digits(x: Column) -> Column:
    """Nine digits first: a half in the seventh digit, as prices over quantities often have, isn't decided by noise."""
    return F.round(F.round(x, 9), 6)


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month x supplier: open, high, low, close, volume, amount, vwap of unit prices."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")  # an order may have a line number twice
    unit = ratio(F.col("l_extendedprice"), F.col("l_quantity"))
    out = line.select(
        F.trunc("l_shipdate", "month").alias("datetime"), F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("instrument"),
        at.alias("at"), unit.alias("u"), "l_quantity", "l_extendedprice",
    ).groupBy(*KEYS).agg(
        six_digits(F.min_by("u", "at")).alias("open"), six_digits(F.max("u")).alias("high"), six_digits(F.min("u")).alias("low"), six_digits(F.max_by("u", "at")).alias("close"),
        F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount"),
    )
    return out.withColumn("vwap", six_digits(ratio(F.col("amount"), F.col("volume"))))


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day x user of events: open, high, low, close, volume (events), amount; with natural gaps."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.struct("ts", "event_id")
    return e.groupBy(F.to_date("ts").alias("datetime"), F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("instrument")).agg(
        F.round(F.min_by("value", at), 6).alias("open"), F.round(F.max("value"), 6).alias("high"), F.round(F.min("value"), 6).alias("low"), F.round(F.max_by("value", at), 6).alias("close"),
        F.count("*").cast("double").alias("volume"), F.round(F.sum("value"), 4).alias("amount"),
    )


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None, *, columns: list[str] | None = None, start: str | None = None, end: str | None = None, instruments: DataFrame | None = None) -> DataFrame:
    """A panel's rows in a closed date range; filters and columns reach the Parquet scan.  ``instruments``: a universe."""
    out = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if start:
        out = out.where(F.col("datetime") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("datetime") <= F.lit(end).cast("date"))
    if columns:
        out = out.select(*KEYS, *columns)
    return out.join(instruments.select("instrument").distinct(), "instrument", "left_semi") if instruments is not None else out


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (instrument, start, end)."""
    return spark.read.schema(INTERVALS).option("sep", "\t").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A typed CSV with a header; columns that the header lacks stop the plan.  Cells that can't be read are NULL: ``bad_cells``."""
    head = spark.read.option("header", True).csv(path)
    if missing := [f for f in schema.fieldNames() if f not in head.columns]:
        raise ValueError(f"missing columns: {missing}")
    return head.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields))


def bad_cells(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(column, bad): how many cells of a CSV with a header ``read_csv`` turns into NULL, as they can't be read in their type."""
    head = spark.read.option("header", True).csv(path)
    counts = head.agg(*(F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name) for f in schema.fields))
    return counts.unpivot([], schema.fieldNames(), "column", "bad")


def write_parquet(frame: DataFrame, path: str) -> None:
    frame.withColumn("year", F.year("datetime")).write.partitionBy("year").option("compression", "zstd").mode("overwrite").parquet(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.option("header", True).mode("overwrite").csv(path)


def join_features(tables: list[DataFrame]) -> DataFrame:
    """Column-partitioned tables of the same keys, side by side."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, KEYS, "full_outer")
    return out


def to_long(frame: DataFrame, columns: list[str], name: str = "factor", value: str = "value") -> DataFrame:
    return frame.unpivot(KEYS, columns, name, value)


def to_wide(frame: DataFrame, values: list[str], column: str) -> DataFrame:
    """One row for each date, one column for each of the given instruments."""
    return frame.groupBy("datetime").pivot("instrument", values).agg(F.first(column))


def row_id(*columns: str):
    """A digest of key columns."""
    return F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256)


def normalise_bars(raw: DataFrame, source: str, names: dict[str, str], volume_scale: float = 1.0, amount_scale: float = 1.0) -> DataFrame:
    """A provider's bars in one schema: renamed, scaled, with the previous close and a row id."""
    from tessera.functions import ts

    out = raw.select(*(F.col(old).alias(new) for new, old in names.items()))
    out = out.withColumns({"volume": finite(F.col("volume")) * volume_scale, "amount": finite(F.col("amount")) * amount_scale})
    out = out.withColumn("previous_close", ts.ref(F.col("close"), 1)).withColumn("source", F.lit(source))
    return out.withColumn("source_row_id", row_id("source", "instrument", "datetime"))


def normalise_keys(frame: DataFrame) -> DataFrame:
    """Midnight dates and upper-case ids; rows without a key and repeated keys are left out."""
    out = frame.withColumns({"datetime": F.to_date("datetime"), "instrument": F.upper(F.trim("instrument"))}).dropna(subset=KEYS)
    single = out.groupBy(*KEYS).count().where("count = 1").select(*KEYS)
    return out.join(single, KEYS, "left_semi")


def instrument_code(c):
    """Codes like 000001.SZ, sz.000001, sz000001 or 000001 in the notation SZ000001."""
    t = F.upper(F.trim(c))
    digits, letters = F.regexp_extract(t, r"(\d{6})", 1), F.regexp_extract(t, r"(SH|SZ|BJ)", 1)
    guess = F.when(digits.rlike("^[69]"), "SH").when(digits.rlike("^[48]"), "BJ").otherwise("SZ")
    return F.when(digits != "", F.concat(F.when(letters != "", letters).otherwise(guess), digits))
