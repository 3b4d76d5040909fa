"""Boards: decisions, labels and look-ups over summaries of factors.  Factors number in the hundreds; windows and dates of theirs
are reduced before they get here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.guard import ratio
from tessera.operators.audits import guard_columns
from tessera.operators.portfolio import reasons


def _sign(c: str):
    return F.coalesce(F.signum(F.round(c, 9)), F.lit(0.0)).cast("int")


def select_windows(metrics: DataFrame, *, least_ic: float, least_train: int, least_validation: int) -> DataFrame:
    """Adds direction, enough, selected and reason to (split_id, factor, train_mean_ic, validation_mean_ic, train_count,
    validation_count, fdr_pass).  Columns of test periods stop the job."""
    m = guard_columns(metrics).withColumn("direction", _sign("train_mean_ic"))
    aligned = (F.col("direction") != 0) & (F.col("direction") == _sign("validation_mean_ic"))
    enough = (F.col("train_count") >= least_train) & (F.col("validation_count") >= least_validation)
    strong = F.coalesce(F.abs("validation_mean_ic") >= least_ic, F.lit(False))
    why = F.array_compact(F.array(*(F.when(~c, F.lit(n)) for c, n in ((aligned, "direction_mismatch"), (enough, "insufficient_dates"), (strong, "weak_validation_ic"), (F.col("fdr_pass"), "fdr_not_passed")))))
    m = m.withColumns({"enough": enough, "__why": why})
    selected = F.size("__why") == 0
    return m.withColumns({"selected": selected, "reason": F.when(selected, "selected").otherwise(F.array_join("__why", ";"))}).drop("__why")


def stability_board(windows: DataFrame, *, least_windows: int = 3, least_frequency: float = 0.6, least_agreement: float = 0.8, least_positive: float = 0.6, most_degradation: float = 0.03) -> DataFrame:
    """(factor, windows, eligible, frequency, direction, agreement, positive, worst, role) over a factor's windows."""
    e = windows.where("enough")
    c = e.where("direction <> 0").groupBy("factor", "direction").agg(F.count("*").alias("n"))
    mode = c.groupBy("factor").agg(F.max_by("direction", F.struct("n", F.negative("direction"))).alias("direction"), ratio(F.max("n"), F.sum("n")).alias("agreement"))
    inside = lambda cond: F.avg(F.when(F.col("enough"), cond.cast("double")))
    s = windows.groupBy("factor").agg(
        F.count("*").alias("windows"), F.count_if("enough").alias("eligible"), inside(F.col("selected")).alias("frequency"), inside(F.round(F.col("validation_mean_ic") * F.col("direction"), 9) > 0).alias("positive"),
        F.min(F.when(F.col("selected"), F.abs("validation_mean_ic") - F.abs("train_mean_ic"))).alias("worst"), F.bool_and("fdr_pass").alias("__fdr"),
    )
    s = s.join(mode, "factor", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("frequency", "positive", "agreement", "direction")})
    many = F.col("eligible") >= least_windows
    stable = F.col("__fdr") & many & (F.col("frequency") >= least_frequency) & (F.col("agreement") >= least_agreement) & (F.col("positive") >= least_positive) & F.coalesce(F.col("worst") >= -most_degradation, F.lit(False))
    role = F.when(stable, "stable_core").when(many & (F.col("frequency") >= 0.3) & F.col("__fdr"), "conditional_signal").when((F.col("eligible") == 0) | ~F.col("__fdr"), "holdout").otherwise("monitor")
    return s.withColumn("role", role).drop("__fdr")


def judgement(board: DataFrame) -> DataFrame:
    """Adds label and tags to (factor, rank_ic_mean, win_rate, turnover, context_range): strong, consistent, weak or mixed."""
    strong, wins = F.abs("rank_ic_mean") >= 0.03, F.greatest(F.col("win_rate"), 1 - F.col("win_rate"))
    label = F.when(strong & (wins >= 0.6), "strong").when(wins >= 0.55, "consistent").when(F.abs("rank_ic_mean") < 0.01, "weak").otherwise("mixed")
    return board.withColumns({"label": label, "tags": reasons((F.col("turnover") > 0.7, "high_turnover"), (F.col("context_range") > 0.1, "unstable_context"), (wins < 0.55, "unstable_sign"))})


def united(boards: dict[str, DataFrame]) -> DataFrame:
    """Boards of several sources in one table with all their columns; what a source lacks is NULL."""
    out = None
    for n, t in boards.items():
        own = t.withColumn("board_source", F.lit(n))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def performance_distance(pairs: DataFrame, ic_pairs: DataFrame, weight: float = 0.5) -> DataFrame:
    """(factor_a, factor_b, exposure, performance, distance): one less the weighted mean of absolute exposure similarity (median daily
    rank correlation) and performance similarity (correlation of daily ICs)."""
    both = pairs.join(ic_pairs, ["factor_a", "factor_b"])
    return both.withColumn("distance", 1 - (weight * F.abs("exposure") + (1 - weight) * F.abs("performance")))


def portability(means: DataFrame, least: float) -> DataFrame:
    """(factor, early, recent, classification) from (factor, period, mean) with periods early and recent."""
    s = lambda c: F.signum(F.round(c, 9))
    out = means.groupBy("factor").pivot("period", ["early", "recent"]).agg(F.first("mean"))
    e, r = F.col("early"), F.col("recent")
    small = (F.abs(e) < least) & (F.abs(r) < least)
    kind = F.when(e.isNull() | r.isNull(), "incomplete").when(small, "no_evidence").when(s(e) != s(r), "conflict").when(F.abs(r) < least, "regime_concentrated").when(F.abs(e) < least, "recent_only").when(F.abs(e) > 2 * F.abs(r), "stronger_early").when(F.abs(r) > 2 * F.abs(e), "weaker_early").otherwise("persistent")
    return out.withColumn("classification", kind)


def raw_against_residual(raw: DataFrame, residual: DataFrame) -> DataFrame:
    """(factor, raw, residual, retention, action) of summaries (factor, rank_ic_mean): keep what retains half, drop what turns."""
    both = raw.select("factor", F.col("rank_ic_mean").alias("raw")).join(residual.select("factor", F.col("rank_ic_mean").alias("residual")), "factor")
    share = ratio(F.col("residual"), F.col("raw"))
    return both.withColumn("retention", share).withColumn("action", F.when(F.col("retention") >= 0.5, "keep").when(F.col("retention") > 0, "keep_with_control").otherwise("drop"))


def scenario_comparison(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """(factor, base, other, rank_change, stability) of two summaries: ranks by value, largest first, ties by name."""
    r = F.row_number().over(Window.orderBy(F.desc(value), "factor"))
    x, y = a.select("factor", F.col(value).alias("base"), r.alias("__a")), b.select("factor", F.col(value).alias("other"), r.alias("__b"))
    out = x.join(y, "factor").withColumn("rank_change", F.col("__b") - F.col("__a")).drop("__a", "__b")
    same = F.signum(F.round("base", 9)) == F.signum(F.round("other", 9))
    return out.withColumn("stability", F.when(~same, "flipped").when(F.abs("rank_change") <= 1, "stable").otherwise("moved"))


def stratum_representatives(members: DataFrame, distances: DataFrame) -> DataFrame:
    """(stratum, factor, role): in each stratum the member of the best coverage, then the shortest formula, then the least mean distance
    to the others, then the first name, stands for it; the rest are alternates.  ``distances``: (factor_a, factor_b, distance)."""
    both = distances.select("factor_a", "factor_b", "distance").union(distances.select("factor_b", "factor_a", "distance"))
    place = members.select(F.col("factor").alias("factor_b"), F.col("stratum").alias("__s"))
    mean = both.join(place, "factor_b").join(members.select(F.col("factor").alias("factor_a"), "stratum"), "factor_a").where(F.col("__s") == F.col("stratum")).groupBy(F.col("factor_a").alias("factor")).agg(F.avg("distance").alias("__d"))
    w = Window.partitionBy("stratum").orderBy(F.desc("coverage"), "length", F.coalesce(F.round("__d", 9), F.lit(0.0)), "factor")
    return members.join(mean, "factor", "left").withColumn("__r", F.row_number().over(w)).select("stratum", "factor", F.when(F.col("__r") == 1, "representative").otherwise("alternate").alias("role"))


def pool_roles(board: DataFrame) -> DataFrame:
    """Adds role and quality to a judged board: the first rule that holds; quality is a weighted score with a bonus and penalties."""
    role = F.when(F.col("label") == "strong", "core").when((F.col("label") == "consistent") & (F.col("tags") == ""), "core").when(F.col("label") == "consistent", "diversifier").when(F.col("label") == "weak", "excluded").otherwise("watch")
    tags = F.when(F.col("tags") == "", 0).otherwise(F.size(F.split("tags", r"\|")))
    quality = 100 * F.abs("rank_ic_mean") + 10 * F.greatest(F.col("win_rate"), 1 - F.col("win_rate")) + F.when(F.col("label") == "strong", 5).otherwise(0) - 2 * tags
    return board.withColumns({"role": role, "quality": quality})


def strongest(pairs: DataFrame, value: str) -> DataFrame:
    """(factor, partner, value): for each factor the other one of the largest absolute value, ties by name; pairs are (factor_a, factor_b)."""
    both = pairs.select(F.col("factor_a").alias("factor"), F.col("factor_b").alias("partner"), F.col(value).alias("value")).union(pairs.select("factor_b", "factor_a", value))
    w = Window.partitionBy("factor").orderBy(F.desc(F.round(F.abs("value"), 9)), "partner")
    return both.where("value is not null").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def catalog_entries(catalog: DataFrame, *, stage: str | None = None, names: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Enabled entries of a catalogue by stage and names; the first ``most`` by name."""
    out = catalog.where("enabled")
    if stage is not None:
        out = out.where(F.col("stage") == stage)
    if names is not None:
        out = out.where(F.col("name").isin(names))
    return out if most is None else out.orderBy("name").limit(most)


def policy_pools(catalog: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(policy, factor): all factors, those without the later ones of duplicate pairs, and those in no pair."""
    f = catalog.select("factor").distinct()
    later, either = duplicates.select(F.col("factor_b").alias("factor")), duplicates.select(F.col("factor_a").alias("factor")).union(duplicates.select("factor_b"))
    pools = {"full": f, "deduplicated": f.join(later.distinct(), "factor", "left_anti"), "strict": f.join(either.distinct(), "factor", "left_anti")}
    out = None
    for n, t in pools.items():
        own = t.select(F.lit(n).alias("policy"), "factor")
        out = own if out is None else out.union(own)
    return out


def feature_decisions(profile: DataFrame, *, least_finite: float, least_rows: int) -> DataFrame:
    """Adds eligible and reasons to (factor, rows, finite_rate, median, p10, p90)."""
    why = reasons((F.col("rows") < least_rows, "few_rows"), (F.col("finite_rate") < least_finite, "low_finite_rate"), (F.col("p10") == F.col("p90"), "no_spread"))
    return profile.withColumn("reasons", why).withColumn("eligible", F.col("reasons") == "")


def split_eligibility(long: DataFrame, assignments: DataFrame, least_pairs: int, least_share: float) -> DataFrame:
    """(split_id, factor, dates, qualified, eligible): the share of a split's train dates on which a factor has enough values."""
    t = assignments.where("fold = 'train'").select("split_id", "datetime")
    n = long.groupBy("datetime", "factor").agg(F.count("value").alias("n")).join(F.broadcast(t), "datetime")
    out = n.groupBy("split_id", "factor").agg(F.count("*").alias("dates"), F.count_if(F.col("n") >= least_pairs).alias("qualified"))
    return out.withColumn("eligible", F.col("qualified") / F.col("dates") >= least_share)
