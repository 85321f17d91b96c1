"""Realised variance estimators and jump tests over ticks.

One day of one hot series can hold a large share of all ticks, so every tick-level frame
runs inside fixed-size blocks with a halo (``in_blocks``); what leaves a block are sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.special import norm_tail2
from barograph.functions.windows import (
    KEY,
    TIME,
    by_series,
    drop_halo,
    in_blocks,
    lag,
    lead,
    trailing,
    whole_series,
)

YEAR = 252
BANDWIDTH = 8


def day_block():
    return Window.partitionBy(KEY, "day", "block").orderBy("rn")


def tick_returns(
    ticks: DataFrame, slot_width: int, lookback: int = BANDWIDTH + 2, block_rows: int = 200_000
) -> DataFrame:
    """Log return to the tick before on the same day, in blocks that still carry their halo.

    ``slot_width`` is the width of the pre-sort bucket in units of ``seq``; choose it so
    that a bucket of the busiest day fits a task.
    """
    slotted = ticks.withColumn("slot", F.floor(F.col("seq") / slot_width))
    cut = in_blocks(slotted, [KEY, "day"], "slot", ["seq", "price"], lookback, block_rows)
    ratio = F.try_divide("price", F.lag("price").over(day_block()))
    return cut.withColumn("log_ret", F.ln(ratio))


def parzen(h: int, bandwidth: int) -> float:
    x = h / (bandwidth + 1)
    return 1 - 6 * x * x + 6 * x**3 if x <= 0.5 else 2 * (1 - x) ** 3


def realised_measures(returns: DataFrame, bandwidth: int = BANDWIDTH) -> DataFrame:
    """Realised variance, bipower variation, realised kernel and moments, one row per day.

    The kernel is symmetric, so each autocovariance is taken once and counted twice.
    Days with fewer than ``bandwidth + 2`` returns fall back to realised variance.
    """
    r = F.col("log_ret")
    lagged = returns.withColumns({f"_r{h}": F.lag("log_ret", h).over(day_block()) for h in range(1, bandwidth + 1)})
    kernel = sum(
        (
            F.lit(2 * parzen(h, bandwidth)) * F.coalesce(F.sum(r * F.col(f"_r{h}")), F.lit(0.0))
            for h in range(1, bandwidth + 1)
        ),
        F.sum(r * r),
    )
    days = (
        lagged.filter(~F.col("halo") & r.isNotNull())
        .groupBy(KEY, F.col("day").alias(TIME))
        .agg(
            F.count(r).alias("m"),
            F.sum(r * r).alias("rv"),
            (F.sum(F.abs(r) * F.abs(F.col("_r1"))) * (math.pi / 2)).alias("bv"),
            kernel.alias("_kernel"),
            F.sum(F.pow(r, F.lit(3.0))).alias("sum_r3"),
            F.sum(F.pow(r, F.lit(4.0))).alias("sum_r4"),
        )
    )
    rk = F.when(F.col("m") < bandwidth + 2, F.col("rv")).otherwise(
        F.greatest("_kernel", F.lit(0.0))
    )
    return days.withColumn("rk", rk).drop("_kernel")


def jump_variation(days: DataFrame) -> DataFrame:
    jump = F.when(F.col("bv").isNotNull(), F.greatest(F.col("rv") - F.col("bv"), F.lit(0.0)))
    return days.withColumns(
        {
            "jump_var": jump,
            "jump_ratio": jump / (F.col("rv") + 1e-12),
            "cont_var": F.col("bv"),
            **{f"{c}_ann": F.col(c) * YEAR for c in ("rv", "bv", "rk")},
        }
    )


# Fixed value: asymptotic variance factor of the bipower jump test, pi^2/4 + pi - 5,
# times the optional (pi/2)^2 used by default.
BNS_ZETA = math.pi**2 / 4 + math.pi - 5
BNS_PHI = BNS_ZETA * (math.pi / 2) ** 2


def bns_test(
    days: DataFrame, bars_per_day: int = 78, level: float = 0.01, phi: float = BNS_PHI
) -> DataFrame:
    """Jump test on the relative gap between realised variance and bipower variation."""
    se = math.sqrt(phi / bars_per_day) * (F.col("rv") + 1e-12)
    df = days.withColumn("j_stat", (F.col("rv") - F.col("bv")) / se)
    df = df.withColumn("p_value", norm_tail2(F.col("j_stat")))
    return df.withColumn(
        "jump_detected", F.coalesce((F.col("p_value") < level).cast("int"), F.lit(0))
    )


def lee_mykland(returns: DataFrame, window: int = 20, block_rows: int = 200_000) -> DataFrame:
    """Bar-level jump test: the return against local bipower volatility of the bars before.

    The window runs across days. Bars are renumbered over the whole series, in blocks, and
    the number of bars that sets the threshold comes with the numbering.
    """
    bars = drop_halo(
        returns.filter(F.col("log_ret").isNotNull())
        .withColumn("_slot", F.struct("day", "block"))
        .select(KEY, "day", "_slot", F.col("rn").alias("bar"), "log_ret", "halo", "block")
    )
    cut = in_blocks(bars, [KEY], "_slot", ["bar"], window + 1, block_rows)
    w = Window.partitionBy(KEY, "block").orderBy("rn")
    size = F.abs("log_ret")
    cut = cut.withColumns({"_a": size, "_p": size * F.lag(size).over(w)})
    local = F.sum("_p").over(w.rowsBetween(-(window - 1), -1)) * (math.pi / 2)
    n = F.col("key_rows").cast("double")
    c = F.sqrt(2 * F.ln(n))
    threshold = c - F.ln(F.ln(n)) / (2 * c)
    cut = cut.withColumn("l_stat", F.col("_a") / F.sqrt(local / (window - 1) + 1e-12))
    cut = cut.withColumn("jump_bar", (F.col("l_stat") > threshold).cast("int"))
    out = drop_halo(cut).filter(F.col("rn") > window)
    return out.select(KEY, "day", "bar", "log_ret", "l_stat", "jump_bar")


def jump_days(bars: DataFrame) -> DataFrame:
    return bars.groupBy(KEY, F.col("day").alias(TIME)).agg(
        F.sum("jump_bar").alias("n_jump_bars"),
        F.max("l_stat").alias("max_l_stat"),
        F.count(F.lit(1)).alias("n_bars"),
        F.max("jump_bar").alias("jump_day_lm"),
        F.avg("jump_bar").alias("jump_intensity"),
    )


def test_agreement(bns: DataFrame, lm: DataFrame) -> DataFrame:
    """Days seen by both tests, and days on which both saw a jump."""
    both = bns.select(KEY, TIME, "jump_detected").join(
        lm.select(KEY, TIME, "jump_day_lm"), [KEY, TIME]
    )
    return both.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("common_days"),
        F.sum("jump_detected").alias("bns_days"),
        F.sum("jump_day_lm").alias("lm_days"),
        F.count_if((F.col("jump_detected") == 1) & (F.col("jump_day_lm") == 1)).alias("both_days"),
    )


def combine_tests(days: DataFrame, bns: DataFrame, lm: DataFrame) -> DataFrame:
    return days.join(
        bns.select(KEY, TIME, "j_stat", "p_value", "jump_detected"), [KEY, TIME], "left"
    ).join(
        lm.select(KEY, TIME, "n_jump_bars", "max_l_stat", "jump_day_lm", "jump_intensity"),
        [KEY, TIME],
        "left",
    )


def _losses(actual: Column, forecast: Column) -> dict[str, Column]:
    h = F.greatest(forecast, F.lit(1e-8))
    v = F.greatest(actual, F.lit(1e-8))
    return {
        "mse": F.avg(F.pow(actual - forecast, F.lit(2.0))),
        "qlike": F.avg(F.ln(h) + v / h),
        "n": F.count(F.lit(1)),
    }


def estimators_as_forecasts(
    merged: DataFrame, estimators: list[str], target: str = "rv_ann", min_rows: int = 10
) -> DataFrame:
    """Every estimator of the row before as a forecast of the row after."""
    df = merged.withColumns(
        {"_y": lead(target), **{f"_f_{e}": lag(e) for e in estimators}}
    )
    long = df.select(KEY, "_y", *[F.col(f"_f_{e}").alias(e) for e in estimators]).unpivot(
        [KEY, "_y"], estimators, "estimator", "forecast"
    )
    loss = _losses(F.col("_y"), F.col("forecast"))
    return (
        long.dropna("any")
        .groupBy(KEY, "estimator")
        .agg(*[c.alias(k) for k, c in loss.items()])
        .filter(F.col("n") >= min_rows)
    )


def loss_by_jump_day(
    merged: DataFrame, estimators: list[str], target: str = "rv_ann", min_rows: int = 5
) -> DataFrame:
    df = merged.withColumns(
        {
            "_y": lead(target),
            "day_type": F.when(F.coalesce("jump_detected", F.lit(0)) == 1, "Jump").otherwise("No-Jump"),
            **{f"_f_{e}": lag(e) for e in estimators},
        }
    )
    long = df.select(
        KEY, "day_type", "_y", *[F.col(f"_f_{e}").alias(e) for e in estimators]
    ).unpivot([KEY, "day_type", "_y"], estimators, "estimator", "forecast")
    loss = _losses(F.col("_y"), F.col("forecast"))
    return (
        long.dropna("any")
        .groupBy(KEY, "day_type", "estimator")
        .agg(*[c.alias(k) for k, c in loss.items()])
        .filter(F.col("n") >= min_rows)
    )


def realised_moments(days: DataFrame, min_ticks: int = 5) -> DataFrame:
    """Realised skewness and kurtosis per day; null with too few returns, 0 without variance."""
    enough, m = F.col("m") >= min_ticks, F.col("m").cast("double")
    flat = F.col("rv") <= 1e-20
    rs = F.sqrt(m) * F.col("sum_r3") / (F.pow("rv", F.lit(1.5)) + 1e-20)
    rk = m * F.col("sum_r4") / (F.pow("rv", F.lit(2.0)) + 1e-20)
    return days.select(
        KEY,
        TIME,
        F.when(enough, F.col("rv")).alias("rv"),
        F.when(enough, F.when(flat, 0.0).otherwise(rs)).alias("rs"),
        F.when(enough, F.when(flat, 0.0).otherwise(rk)).alias("rk"),
        F.when(enough, F.col("sum_r3")).alias("rs_raw"),
        F.when(enough, F.col("sum_r4")).alias("rk_raw"),
        F.when(enough, F.col("rv") * YEAR).alias("rv_ann"),
    )


MOMENT_FEATURES = (
    "rv_lag_1", "rv_lag_5", "rv_lag_21", "rs_lag1", "rk_lag1", "rs_lag5", "rk_lag5",
    "rs_lag21", "rk_lag21", "left_skew_flag", "lev_interaction",
)


def moment_features(daily: DataFrame, moments: DataFrame) -> DataFrame:
    """HAR terms joined with lags and means of the realised moments, complete rows only."""
    m = moments.select(KEY, TIME, "rs", "rk", lead("rv_ann").alias("_next"))
    df = daily.select(KEY, TIME, "rv").join(m, [KEY, TIME], "left")
    out = {
        "rv_lag_1": lag("rv"),
        "rv_lag_5": trailing(F.avg, "rv", 5, skip=1),
        "rv_lag_21": trailing(F.avg, "rv", 21, skip=1),
        "target": F.coalesce(F.col("_next"), lead("rv")),
        "left_skew_flag": F.coalesce((lag("rs") < 0).cast("double"), F.lit(0.0)),
    }
    for c in ("rs", "rk"):
        out[f"{c}_lag1"] = lag(c)
        out[f"{c}_lag5"] = trailing(F.avg, c, 5, 3, skip=1)
        out[f"{c}_lag21"] = trailing(F.avg, c, 21, 10, skip=1)
    df = df.withColumns(out).withColumn(
        "lev_interaction", F.col("left_skew_flag") * F.col("rv_lag_1")
    )
    full = df.dropna("any", subset=[*MOMENT_FEATURES, "target"])
    return full.select(KEY, TIME, *MOMENT_FEATURES, "target").withColumn(
        "pos", F.row_number().over(by_series())
    )


def bar_profile(returns: DataFrame) -> DataFrame:
    """Mean absolute return by position in the day."""
    return (
        returns.filter(~F.col("halo") & F.col("log_ret").isNotNull())
        .groupBy(KEY, F.col("rn").alias("bar"))
        .agg(F.avg(F.abs("log_ret")).alias("mean_abs_ret"), F.count(F.lit(1)).alias("n"))
    )


def jump_split(days: DataFrame, bins: int = 40) -> DataFrame:
    """Annualised variance on jump and other days: level and a histogram over a common range."""
    kind = F.when(F.col("jump_detected") == 1, "Jump").otherwise("No-Jump").alias("day_type")
    rows = days.filter(F.col("rv_ann").isNotNull()).select(KEY, kind, "rv_ann")
    low = F.min("rv_ann").over(whole_series())
    high = F.max("rv_ann").over(whole_series())
    placed = rows.withColumns({"_lo": low, "_hi": high}).withColumn(
        "bin",
        F.least(
            F.floor(F.try_divide(F.col("rv_ann") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins),
            F.lit(bins - 1),
        ),
    )
    return placed.groupBy(KEY, "day_type", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rv_ann").alias("mean_rv_ann")
    )


def skew_trend(moments: DataFrame) -> DataFrame:
    """Line of next-day variance on realised skewness, with the 1st to 99th percentile range."""
    df = moments.withColumn("_y", lead("rv_ann")).filter(
        F.col("rs").isNotNull() & F.col("_y").isNotNull()
    )
    return df.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("_y", "rs").alias("slope"),
        F.regr_intercept("_y", "rs").alias("intercept"),
        F.percentile("rs", F.lit(0.01)).alias("rs_p01"),
        F.percentile("rs", F.lit(0.99)).alias("rs_p99"),
    )
