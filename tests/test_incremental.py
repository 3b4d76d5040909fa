import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.streaming import incremental


def bars(spark, days):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(d), f"S{i}", 10.0 + i + (d * (i + 3)) % 7, float(i)) for d in days for i in range(8)]
    return spark.createDataFrame(rows, "datetime date, instrument string, close double, prediction double")


def test_appended_bars_skip_days_of_low_coverage_and_repeated_keys(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    whole = bars(spark, range(5)).where("not (datetime = date'2020-01-03' and instrument > 'S2')")
    whole.unionByName(whole.where("instrument = 'S1'")).write.parquet(source)
    expected = whole.select("datetime").distinct().withColumn("members", F.lit(8))
    incremental.append_bars(spark, source, whole.schema, target, str(tmp_path / "c"), expected, 0.9).awaitTermination()
    got = spark.read.parquet(target).drop("batch")
    want = whole.where("datetime <> date'2020-01-03'")
    assert sorted(got.collect()) == sorted(want.collect())


def test_metrics_by_steps_equal_those_of_one_run(spark):
    p = bars(spark, range(12))
    cal = joins.calendar_of(p)
    whole = incremental.mature_metrics(p, p, cal, None, 1, 2, 3)
    early = p.where("datetime <= date'2020-01-08'")
    first = incremental.mature_metrics(early, early, joins.calendar_of(early), None, 1, 2, 3)
    second = incremental.mature_metrics(p, p, cal, first, 1, 2, 3)
    key = lambda rows: sorted((r.datetime, None if r.rank_ic is None else round(r.rank_ic, 9), r.pairs) for r in rows)
    assert key(first.collect() + second.collect()) == key(whole.collect())


def test_streamed_metrics_wait_for_late_labels_and_come_once(spark, tmp_path):
    p = bars(spark, range(14))
    cal = joins.calendar_of(p)
    dates = joins.label_dates(cal, 1, 2).where("not terminal")
    label = joins.exact_label(p, dates).select("datetime", "instrument", "label").where("label is not null").join(dates.select("datetime"), "datetime")
    predictions, labels, target, checkpoint = (str(tmp_path / x) for x in ("p", "l", "t", "c"))
    p.select("datetime", "instrument", "prediction").repartition(3, "datetime").write.parquet(predictions)
    # labels come date by date, but two instruments' a day late, and one row twice
    day = F.col("datetime")
    held = label.withColumn("arrives", F.when(F.col("instrument") > "S5", F.date_add(day, 1)).otherwise(day))
    held = held.unionByName(held.where("instrument = 'S1'"))
    arrivals = [r.arrives for r in held.select("arrives").distinct().orderBy("arrives").collect()]

    def deliver(some):
        for d in some:
            held.where(F.col("arrives") == F.lit(d)).drop("arrives").coalesce(1).write.mode("append").parquet(labels)

    def run():
        q = incremental.metrics_stream(spark, predictions, labels, cal, target, checkpoint, lag=1, hold=2, least=3, files=1)
        q.awaitTermination()
        assert q.exception() is None

    schema = "datetime date, factor string, ic double, rank_ic double, pairs long, status string"
    read = lambda: spark.read.schema(schema).parquet(f"{target}/*") if (tmp_path / "t").exists() else spark.createDataFrame([], schema)
    key = lambda rows: sorted((r.datetime, None if r.rank_ic is None else round(r.rank_ic, 9), r.pairs) for r in rows)
    deliver(arrivals[:5])
    run()
    early = read().collect()
    deliver(arrivals[5:])
    run()
    got = read().collect()
    want = key(incremental.mature_metrics(p, p, cal, None, 1, 2, 3).collect())
    assert len({r.datetime for r in got}) == len(got) and 0 < len(early) < len(got)
    assert key(got) == want[: len(got)] and len(got) >= len(want) - 3  # the last dates still wait
