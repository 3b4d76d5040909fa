"""Steps whose work must grow with their input: no join by a handful of keys, no frame to the end of a large group, no pairs of dates."""

import random

import pytest

from tessera.operators import portfolio, stats
from tessera.plans import registry

DIR = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["score_hierarchy", "score_sleeves", "score_composite", "score_directional", "model_preprocessing_transform"])
def test_factor_tables_are_broadcast(spark, query):
    assert "SortMergeJoin" not in plan(registry.queries()[query](spark, DIR))


@pytest.mark.parametrize("query", ["score_composite", "score_directional"])
def test_equal_values_have_no_spread(query):
    """A deviation above zero may be rounding noise of equal values; the largest above the smallest can't."""
    assert "stddev_samp(value) OVER (PARTITION BY datetime, factor) > 0" not in registry.oracle_sql()[query]


def test_zero_shares_are_not_capped(spark):
    rows = [("s", f, r) for f, r in zip("abcde", (5.0, 5.0, 5.0, 0.0, 0.0))]
    out = {r.factor: r.weight for r in portfolio.capped_weights(spark.createDataFrame(rows, "split string, factor string, raw double"), 0.3).collect()}
    assert out == {"a": 0.3, "b": 0.3, "c": 0.3, "d": None, "e": None}


def test_pooled_weighted_median(spark):
    rng = random.Random(3)
    rows = [(g, f"i{i}", None if rng.random() < 0.1 else round(rng.gauss(0, 3), 1), rng.choice((0.0, 0.25, 1.0, 2.0))) for g in "ab" for i in range(700)] + [("c", "i", 1.0, 1.0)]
    t = spark.createDataFrame(rows, "factor string, instrument string, value double, weight double")
    want = stats.weighted_median(t, "value", "weight", ["factor"], "instrument").collect()
    assert sorted(stats.pooled_weighted_median(t, "value", "weight", "factor", 16).collect()) == sorted(want)


@pytest.mark.parametrize("query", ["evaluate_pooled_correlation", "select_raw_against_residual"])
def test_rows_read_several_times_are_written_once(spark, query):
    assert "FileScan" not in plan(registry.queries()[query](spark, DIR))


def test_eligibility_joins_no_pairs_of_dates(spark):
    assert "Join" not in plan(registry.queries()["market_eligibility"](spark, DIR))


def test_sixth_digit_isn_t_decided_by_noise(spark):
    """A coefficient of -0.0546875 at sf0.01: a half in its seventh digit, give or take rounding noise."""
    import duckdb

    path, sql = "/root/testdata/sf0.01", registry.oracle_sql()["features_alpha_vocabulary"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet'")
    where = "instrument = 'S000012' AND datetime = DATE '2001-02-01'"
    want = con.sql(f"SELECT alpha_026 FROM ({sql}) WHERE {where}").fetchall()
    assert [tuple(r) for r in registry.queries()["features_alpha_vocabulary"](spark, path).where(where).select("alpha_026").collect()] == [(0.054688,)] == want


def test_cross_sections_are_sorted_once_in_partitions_of_their_own(spark):
    """Each of the two ranks has one window over few cross-sections, not two sorts of all that Spark merges into a task."""
    text = plan(registry.queries()["score_sleeves"](spark, DIR))
    assert text.count("REPARTITION_BY_NUM") == 2
    assert text.count("- Window [") == 3  # one more along the instruments


def test_ranks_of_a_date_are_not_sorted_side_by_side(spark):
    """One window for all ranks of a level; one for each would sort wide rows again and again inside a task."""
    text = plan(registry.queries()["features_alpha_vocabulary"](spark, DIR))
    assert text.count("- Window [rank(") <= 3
    assert text.count("REPARTITION_BY_NUM") == 6


def test_cross_sections_keep_rows_and_columns(spark):
    from tessera.operators.formulas import SparkVocabulary, cross_sections

    rows = [(d, i, x, x is not None and x < 9, g, f"{d}{i}") for d in "ab" for i, x, g in (("p", 1.0, "u"), ("q", 3.0, "v"), ("r", 1.0, "u"), ("s", None, None), ("t", 9.0, "u"))]
    panel, v = spark.createDataFrame(rows, "datetime string, instrument string, x double, eligible boolean, g string, own string"), SparkVocabulary("eligible")
    x = panel["x"]
    out = cross_sections(panel, ["own", "x"], {"r": v.date_rank(x), "s": v.date_scale(x), "d": v.date_demean(x + x, "g")}).orderBy("datetime", "instrument").collect()
    want = {"p": (1.0, 0.5, 0.2, 0.0), "q": (3.0, 1.0, 0.6, 0.0), "r": (1.0, 0.5, 0.2, 0.0), "s": (None,) * 4, "t": (9.0, None, None, None)}
    assert [tuple(r) for r in out] == [(d, i, f"{d}{i}", *want[i]) for d in "ab" for i in "pqrst"]


def shuffled(spark, frame) -> int:
    """Bytes that a run of the frame writes to shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup(f"shuffled {id(frame)}", "")
    frame.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    sc._jsc.clearJobGroup()
    tracker, store, done = sc.statusTracker(), sc._jsc.sc().statusStore(), set()
    for job in tracker.getJobIdsForGroup(f"shuffled {id(frame)}"):
        done |= {i for i in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(i).numCompletedTasks}
    return sum(store.lastStageAttempt(i).shuffleWriteBytes() for i in done)


def test_formulas_shuffle_little_beside_their_panel(spark):
    """Windows that the last formulas alone read don't travel through each cross-section, nor does each rank with keys of its own."""
    path = "/root/testdata/sf0.01"
    formulas, panel = (shuffled(spark, registry.queries()[q](spark, path)) for q in ("features_alpha_vocabulary", "panel_monthly"))
    assert 0 < formulas < 12 * panel


def test_average_ranks_of_arrays():
    import numpy as np

    from tessera.operators.formulas import _twice_ranked

    x, nan = np.array([2.0, 0.0, 9.0, -0.0, 2.0, 2.0, np.nan, np.nan]), float("nan")
    known = np.array([True, True, False, True, True, True, True, True])
    assert _twice_ranked(x, known).tolist() == [8, 3, 0, 3, 8, 8, 13, 13]
    assert _twice_ranked(np.array([nan, nan]), np.array([False, False])).tolist() == [0, 0]


def test_dates_without_values_or_groups(spark):
    """Ranks, scales and means of a date that has none, only zeros, or a missing group and date."""
    from tessera.operators.formulas import SparkVocabulary, cross_sections

    rows = [("a", "p", None, True, "u"), ("b", "p", 0.0, True, None), ("b", "q", 0.0, True, None), ("c", "p", 4.0, False, "u"), (None, "p", 2.0, True, None), (None, "q", 4.0, True, "u")]
    panel, v = spark.createDataFrame(rows, "datetime string, instrument string, x double, eligible boolean, g string"), SparkVocabulary("eligible")
    x = panel["x"]
    words = {"r": v.date_rank(x), "s": v.date_scale(x), "d": v.date_demean(x, "g")}
    out = {tuple(r)[:2]: tuple(r)[2:] for r in cross_sections(panel, ["x"], words).collect()}
    assert out == {("a", "p"): (None,) * 4, ("b", "p"): (0.0, 0.75, None, 0.0), ("b", "q"): (0.0, 0.75, None, 0.0), ("c", "p"): (4.0, None, None, None), (None, "p"): (2.0, 0.5, 2 / 6, 0.0), (None, "q"): (4.0, 1.0, 4 / 6, 0.0)}
    beside = cross_sections(panel, [], words, ("eligible", "x"), ("r", "s", "d")).collect()
    assert {tuple(r)[:2]: tuple(r)[2:] for r in beside} == {k: w[1:] for k, w in out.items()}
