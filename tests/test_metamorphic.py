"""Future rows, row order and unrelated rows don't change what was known before."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import ts, xs
from tessera.operators import evaluate, features, joins, portfolio, quality, stats
from tessera.sources import panel as src


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for i in range(6):
        for d in range(30):
            if (i * 7 + d) % 11:
                x = 10 + i + ((d * 37 + i * 13) % 17) / 3
                rows.append((dt.date(2020, 1, 1) + dt.timedelta(d), f"S{i}", x, x + 1, x - 1, x + 0.5, float(d + i + 1), float((d + 1) * (i + 2)), x))
    return spark.createDataFrame(rows, "datetime date, instrument string, open double, high double, low double, close double, volume double, amount double, vwap double").cache()


WINDOWS = {
    "mean": lambda: ts.mean(F.col("close"), 4), "rank": lambda: ts.rank(F.col("close"), 4), "drawdown": lambda: ts.drawdown(F.col("close"), 5), "trend": lambda: ts.trend(F.col("close"), 5, "slope"),
    "corr": lambda: ts.corr(F.col("close"), F.col("volume"), 5), "fill": lambda: ts.forward_fill(F.col("close")), "prior": lambda: ts.prior_mean(F.col("volume"), 3), "argmax": lambda: ts.arg_max(F.col("high"), 4),
}


def known(frame, column):
    return sorted((r.datetime, r.instrument, None if r[column] is None else round(r[column], 9)) for r in frame.select("datetime", "instrument", column).collect())


@pytest.mark.parametrize("name", WINDOWS)
def test_windows_never_look_ahead(name, panel):
    cut = dt.date(2020, 1, 20)
    whole = panel.withColumn("x", WINDOWS[name]()).where(F.col("datetime") <= cut)
    part = panel.where(F.col("datetime") <= cut).withColumn("x", WINDOWS[name]())
    assert known(whole, "x") == known(part, "x")


@pytest.mark.parametrize("name", WINDOWS)
def test_windows_ignore_row_order_and_other_instruments(name, panel):
    want = known(panel.where("instrument in ('S1', 'S2')").withColumn("x", WINDOWS[name]()), "x")
    shuffled = panel.orderBy(F.rand(3)).withColumn("x", WINDOWS[name]()).where("instrument in ('S1', 'S2')")
    assert known(shuffled, "x") == want


def test_cross_sections_ignore_other_dates(panel):
    day = dt.date(2020, 1, 9)
    one = xs.bucket(xs.zscore(panel.where(F.col("datetime") == day), "close", "z"), "close", "b", 3).withColumn("r", xs.average_rank(F.col("close")))
    all_ = xs.bucket(xs.zscore(panel, "close", "z"), "close", "b", 3).withColumn("r", xs.average_rank(F.col("close"))).where(F.col("datetime") == day)
    for c in ("z", "b", "r"):
        assert known(one, c) == known(all_, c)


def test_missing_rows_do_not_shorten_the_horizon(spark):
    d = [dt.date(2020, 1, i) for i in range(1, 6)]
    p = spark.createDataFrame([(x, "A", 10.0 + i) for i, x in enumerate(d) if i != 2] + [(x, "B", 20.0) for x in d], "datetime date, instrument string, close double")
    out = {(r.instrument, r.datetime): r.label for r in joins.exact_label(p, joins.label_dates(joins.calendar_of(p), 1, 1)).collect()}
    assert out["A", d[0]] is None and out["A", d[1]] is None  # the exit or entry price of the third day isn't there
    assert out["B", d[0]] == 0.0


def test_ranks_average_ties_and_constants_have_no_score(spark):
    p = spark.createDataFrame([(dt.date(2020, 1, 1), x, v) for x, v in zip("abcde", (1.0, 2.0, 2.0, None, 5.0), strict=True)], "datetime date, instrument string, v double")
    got = {r.instrument: r.r for r in p.withColumn("r", xs.average_rank(F.col("v"))).collect()}
    assert got == {"a": 1.0, "b": 2.5, "c": 2.5, "d": None, "e": 4.0}
    flat = xs.zscore(p.withColumn("v", F.lit(3.0)), "v", "z")
    assert {r.z for r in flat.collect()} == {None}
    assert evaluate.daily_ic(flat.select("datetime", "instrument", F.lit("f").alias("factor"), F.col("v").alias("value"), F.rand(1).alias("label")), 2).first().status == "constant"


def test_snapshots_intervals_and_grid_agree(panel):
    cal = joins.calendar_of(panel)
    snap = quality.universe(panel, cal, cal.where("pos % 5 = 0"), lookback=5, least=3, top=3)
    spans = quality.to_intervals(snap, cal)
    grid = joins.key_grid(spans.withColumn("end", F.coalesce("end", F.lit("2020-01-30").cast("date"))), cal)
    want = {r.selection_date for r in snap.select("selection_date").collect()}
    for d in sorted(want)[:-1]:
        members = {r.instrument for r in snap.where(F.col("selection_date") == d).collect()}
        after = {r.instrument for r in grid.where(F.col("datetime") == d + dt.timedelta(1)).collect()}
        assert members == after


def test_splits_keep_labels_inside_their_fold(panel):
    cal = joins.calendar_of(panel)
    dates = joins.label_dates(cal, 1, 2)
    s = joins.walk_forward(dates.withColumn("datetime", F.col("datetime")), "2020-01-20", 1, 0, 1).join(dates, "datetime")
    assert s.where("fold = 'train' and exit >= date'2020-01-20'").isEmpty()
    assert not s.where("fold = 'test'").isEmpty()


def test_capped_weights(spark):
    w = portfolio.capped_weights(spark.createDataFrame([("s", f, r) for f, r in (("a", 8.0), ("b", 1.0), ("c", 1.0))], "split string, factor string, raw double"), 0.5)
    got = {r.factor: round(r.weight, 9) for r in w.collect()}
    assert got == {"a": 0.5, "b": 0.25, "c": 0.25}


def test_bootstrap_is_reproducible_and_covers_the_mean(spark):
    d = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(i), f, ((i * 31 + k) % 13) / 13 - 0.4) for i in range(60) for k, f in enumerate("ab")], "datetime date, factor string, v double")
    one, two = (stats.block_bootstrap(d, "v", samples=100, length=5, seed=4).orderBy("factor").collect() for _ in range(2))
    assert [[x if isinstance(x, str) else round(x, 9) for x in r] for r in one] == [[x if isinstance(x, str) else round(x, 9) for x in r] for r in two]
    assert all(r.low <= r["mean"] <= r.high and 0 <= r.p <= 1 for r in one)


def test_indicators_do_not_look_ahead(panel):
    cut = dt.date(2020, 1, 25)
    a = features.kama(panel, "close", 5, 2, 10).where(F.col("datetime") <= cut)
    b = features.kama(panel.where(F.col("datetime") <= cut), "close", 5, 2, 10)
    assert known(a, "kama") == known(b, "kama")


def test_redundancy_groups_and_pruning(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    assert {r.node: r.group for r in portfolio.redundancy_groups(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    board = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0), ("z", 0.0)], "factor string, score double")
    assert {r.factor for r in portfolio.greedy_pruning(board, edges, "score").where("kept").collect()} == {"b", "z"}


def test_readers_and_writers(spark, panel, tmp_path):
    src.write_parquet(panel, str(tmp_path / "p"))
    back = src.scan(spark, str(tmp_path / "p"), columns=["close"], start="2020-01-05", end="2020-01-10")
    assert back.count() == panel.where("datetime between date'2020-01-05' and date'2020-01-10'").count()
    (tmp_path / "i.txt").write_text("S1\t2020-01-01\t2020-01-05\nS2\t2020-01-03\t2020-02-01\n")
    assert src.read_intervals(spark, str(tmp_path / "i.txt")).where("start > end").isEmpty()
    src.write_csv(panel.select("datetime", "instrument", "close"), str(tmp_path / "c"))
    typed = src.read_csv(spark, str(tmp_path / "c"), panel.select("datetime", "instrument", "close").schema)
    assert typed.count() == panel.count() and typed.where("close is null").isEmpty()
    with pytest.raises(ValueError, match="missing columns"):
        src.read_csv(spark, str(tmp_path / "c"), panel.schema)
