"""Neutralisation: residuals against numeric and dummy-coded exposures, the variants of a factor, and diagnostics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import xs
from tessera.functions.guard import correlation, ratio
from tessera.sources.panel import KEYS


def residuals_on(frame: DataFrame, factors: dict[str, str], numeric: list[str], coded: list[str], least: int = 50) -> DataFrame:
    """Keys and, for each factor, its least-squares residual of each date under the name that ``factors`` gives it.

    The design is a constant, numeric exposures and one dummy for each value of the coded ones, built once a date.  Factors that
    miss the same rows are solved together: one factorisation with a right-hand side for each.  Designs without full rank
    have the solution of least length, whose residuals are the same.  Rows that lack a side have none; so have
    dates under ``least`` rows or exposures + 2.  A date's cross-section is one group: as many rows as there are instruments.
    """
    names = list(factors)

    def one_date(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        x = [column(f"x{i}").astype(float) for i in range(len(numeric))]
        usable = np.all([~np.isnan(v) for v in x], axis=0) if x else np.ones(len(table), bool)
        for i in range(len(coded)):
            codes = pc.index_in(table.column(f"k{i}"), pc.unique(table.column(f"k{i}").drop_null())).to_numpy(zero_copy_only=False)
            x += [(codes == v).astype(float) for v in np.unique(codes[~np.isnan(codes)] if codes.dtype.kind == "f" else codes)]
        design = np.column_stack([np.ones(len(table)), *x])
        y = np.column_stack([column(f"y{j}").astype(float) for j in range(len(names))])
        out = np.full(y.shape, np.nan)
        valid = ~np.isnan(y) & usable[:, None]
        groups: dict[bytes, list[int]] = {}
        for j in range(len(names)):
            groups.setdefault(np.packbits(valid[:, j]).tobytes(), []).append(j)
        for own in groups.values():
            rows = valid[:, own[0]]
            if rows.sum() >= max(least, design.shape[1] + 1):
                a, many = design[rows], y[np.ix_(rows, own)]
                out[np.ix_(rows, own)] = many - a @ np.linalg.lstsq(a, many, rcond=None)[0]
        made = [pa.array(out[:, j], mask=np.isnan(out[:, j])) for j in range(len(names))]
        return pa.table([table.column("datetime"), table.column("instrument"), *made], names=[*KEYS, *(factors[n] for n in names)])

    double = lambda c, n: F.col(c).cast("double").alias(n)
    rows = frame.select(
        *KEYS, *(double(c, f"y{j}") for j, c in enumerate(names)), *(double(c, f"x{i}") for i, c in enumerate(numeric)), *(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(coded))
    )
    schema = "datetime date, instrument string, " + ", ".join(f"`{factors[n]}` double" for n in names)
    return rows.groupBy("datetime").applyInArrow(one_date, schema)


def residual_on(frame: DataFrame, factor: str, numeric: list[str], coded: list[str], into: str, least: int = 50) -> DataFrame:
    """(datetime, instrument, into): ``residuals_on`` of one factor."""
    return residuals_on(frame, {factor: into}, numeric, coded, least)


def variants(frame: DataFrame, factor: str, *, liquidity: str, volatility: str, proxy: str, least: int = 50) -> DataFrame:
    """Keys and the seven variants of a factor: raw, rank-normalised, robust z-score of clipped values, z-scores inside
    liquidity and volatility buckets, residual on the log amount, residual on both buckets and the log amount."""
    out = frame.withColumn("cs_rank", xs.rank_normal(F.col(factor)))
    out = xs.zscore(xs.winsorised(out, factor, "__clipped"), "__clipped", "cs_zscore")
    out = xs.zscore(out, factor, "liquidity_bucket_zscore", keys=("datetime", liquidity))
    out = xs.zscore(out, factor, "volatility_bucket_zscore", keys=("datetime", volatility))
    out = out.withColumn("amount_proxy_residual", xs.residual(F.col(factor), F.col(proxy), least))
    last = residual_on(out, factor, [liquidity, volatility, proxy], [], "liquidity_volatility_residual", least)
    names = ("cs_rank", "cs_zscore", "liquidity_bucket_zscore", "volatility_bucket_zscore", "amount_proxy_residual")
    return out.select(*KEYS, F.col(factor).alias("raw"), *names).join(last, KEYS)


def variant_mapping(frame: DataFrame, factor: str) -> DataFrame:
    """(factor, neutralization, neutralized_factor, non_null_rows) of a table of variants."""
    names = [c for c in frame.columns if c not in KEYS]
    counts = frame.agg(*(F.count(c).alias(c) for c in names)).unpivot([], names, "neutralization", "non_null_rows")
    return counts.select(F.lit(factor).alias("factor"), "neutralization", F.concat(F.lit(f"{factor}__"), "neutralization").alias("neutralized_factor"), "non_null_rows")


def liquidity_residual(frame: DataFrame, factor: str, proxies: list[str], least: int = 50) -> DataFrame:
    """Keys, ``factor_z`` and ``residual``: the clipped robust z-score of the factor on those of the proxies, all taken on
    rows that have every side.  Proxies constant on a date are left out; dates under ``least`` such rows have none."""
    rows = frame.dropna(subset=[factor, *proxies]).withColumn("__n", F.count(F.lit(1)).over(xs.over())).where(F.col("__n") >= least)
    for c in (factor, *proxies):
        rows = xs.zscore(xs.winsorised(rows, c, "__w"), "__w", f"{c}_z").drop("__w")
    rows = rows.withColumns({f"{p}_z": F.coalesce(f"{p}_z", F.when(F.count(f"{p}_z").over(xs.over()) == 0, 0.0)) for p in proxies})
    left = residual_on(rows, f"{factor}_z", [f"{p}_z" for p in proxies], [], "residual", least)
    return frame.select(*KEYS).join(rows.select(*KEYS, F.col(f"{factor}_z").alias("factor_z")).join(left, KEYS), KEYS, "left")


def residual_diagnostics(pairs: DataFrame) -> DataFrame:
    """(datetime, rows, coverage, correlation, r2) from (datetime, factor_z, residual): R2 is one less the share of variance left."""
    both = F.col("factor_z").isNotNull() & F.col("residual").isNotNull()
    var = lambda c: F.var_samp(F.when(both, F.col(c)))
    return pairs.groupBy("datetime").agg(
        F.count("*").alias("rows"), ratio(F.count("residual"), F.count("*")).alias("coverage"), correlation("factor_z", "residual").alias("correlation"), (1 - ratio(var("residual"), var("factor_z"))).alias("r2"),
    )


def residual_summary(daily: DataFrame) -> DataFrame:
    """One row: days with residuals, mean coverage, correlation and R2."""
    return daily.agg(F.count("r2").alias("days"), F.avg("coverage").alias("coverage"), F.avg("correlation").alias("correlation"), F.avg("r2").alias("r2"))


def variant_effects(summary: DataFrame, slack: float = 0.005) -> DataFrame:
    """(factor, variant, change, effect) from (factor, variant, rank_ic_mean): each variant's absolute mean against the raw one's."""
    raw = summary.where("variant = 'raw'").select("factor", F.abs("rank_ic_mean").alias("__raw"))
    out = summary.where("variant <> 'raw'").join(raw, "factor").withColumn("change", F.abs("rank_ic_mean") - F.col("__raw"))
    return out.select("factor", "variant", "change", F.when(F.col("change") > slack, "improved").when(F.col("change") < -slack, "weakened").otherwise("similar").alias("effect"))
