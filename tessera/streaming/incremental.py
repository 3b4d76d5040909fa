"""Incremental jobs: daily bars appended behind a coverage gate, and metrics that wait for their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import joins
from tessera.operators.evaluate import daily_ic
from tessera.sources.panel import KEYS


def coverage(batch: DataFrame, expected: DataFrame) -> DataFrame:
    """(datetime, present, expected, ready share) of a batch against the members expected on each date."""
    have = batch.where("close is not null").groupBy("datetime").agg(F.count_distinct("instrument").alias("present"))
    return have.join(expected, "datetime", "left").withColumn("share", F.try_divide(F.col("present").cast("double"), F.col("members")))


def append_bars(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, expected: DataFrame, least: float, delay: str = "7 days"):
    """A streaming query: bars of a folder, repeated keys dropped within the watermark, dates under the coverage left out.

    A batch is one write of whole dates; its id names the folder, so that a repeated batch overwrites itself.
    """
    bars = spark.readStream.schema(schema).parquet(source).withColumn("__t", F.col("datetime").cast("timestamp"))
    bars = bars.withWatermark("__t", delay).dropDuplicatesWithinWatermark([*KEYS]).drop("__t")

    def write(batch: DataFrame, number: int) -> None:
        ready = coverage(batch, expected).where(F.col("share") >= least).select("datetime")
        batch.join(ready, "datetime", "left_semi").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mature_metrics(predictions: DataFrame, panel: DataFrame, calendar: DataFrame, recorded: DataFrame | None, lag: int, hold: int, least: int) -> DataFrame:
    """Daily information coefficients of the dates whose labels have matured and aren't recorded yet."""
    dates = joins.label_dates(calendar, lag, hold).where("not terminal")
    if recorded is not None:
        dates = dates.join(recorded.select("datetime").distinct(), "datetime", "left_anti")
    label = joins.exact_label(panel, dates).select(*KEYS, "label")
    due = predictions.join(F.broadcast(dates.select("datetime")), "datetime").join(label, KEYS, "left")
    return daily_ic(due.select(*KEYS, F.lit("prediction").alias("factor"), F.col("prediction").alias("value"), "label"), least)


def metrics_stream(spark: SparkSession, predictions: str, labels: str, calendar: DataFrame, target: str, checkpoint: str, *, lag: int, hold: int, least: int, delay: str = "2 days", files: int | None = None):
    """A streaming query: predictions of one folder wait for the labels of another; each date's information coefficient is
    written once, when labels have come that are due ``delay`` after it.

    ``predictions`` holds (datetime, instrument, prediction), ``labels`` (datetime, instrument, label); both are parquet.  The
    date on which a label is due follows from the calendar and is the event time.  Predictions run ahead, so the labels alone
    have a watermark.  State is one row of values a date, dropped when the date is written.  Labels that come later than that are left out, as are dates outside the
    calendar; a repeated key counts once (its largest value).  A batch's number names its folder, so a repeated batch
    overwrites itself.
    """
    # one row a date
    due = F.broadcast(joins.label_dates(calendar, lag, hold).where("not terminal").select("datetime", F.col("exit").cast("timestamp").alias("due")))
    key = "datetime date, instrument string, "

    def source(path: str, value: str) -> DataFrame:
        reader = spark.readStream.schema(f"{key}{value} double")
        rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
        both = {c: F.col(c) if c == value else F.lit(None).cast("double") for c in ("prediction", "label")}
        return rows.join(due, "datetime").select(*KEYS, *(x.alias(c) for c, x in both.items()), "due")

    # the first side's event time is that of the union
    rows = source(labels, "label").withWatermark("due", delay).unionByName(source(predictions, "prediction"))
    whole = rows.groupBy("due", "datetime").agg(F.collect_list(F.struct("instrument", "prediction", "label")).alias("rows"))

    def write(batch: DataFrame, number: int) -> None:
        pairs = batch.select("datetime", F.inline("rows")).groupBy(*KEYS).agg(F.max("prediction").alias("value"), F.max("label").alias("label"))
        daily_ic(pairs.withColumn("factor", F.lit("prediction")), least).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return whole.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
