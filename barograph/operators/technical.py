"""Technical indicators and volatility-surface features, all lagged one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.windows import (
    KEY,
    by_series,
    ewm_mean,
    kurt_corrected,
    lag,
    skew_corrected,
    trailing,
)

TINY = 1e-6


def true_range(bars: DataFrame) -> DataFrame:
    before = lag("close")
    span = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)
    )
    return bars.withColumn("true_range", span)


def atr(bars: DataFrame, windows=(5, 14, 21)) -> DataFrame:
    df = true_range(bars)
    df = df.withColumns(
        {f"atr_{k}d": trailing(F.avg, "true_range", k, skip=1) for k in windows}
    )
    return df.withColumns(
        {f"atr_norm_{k}d": F.col(f"atr_{k}d") / (lag("close") + TINY) for k in windows}
    )


def bollinger(bars: DataFrame, window: int = 20) -> DataFrame:
    """Band width and position of the close inside the band, one row back."""
    mean = trailing(F.avg, "close", window, skip=1)
    sd = trailing(F.stddev_samp, "close", window, skip=1)
    return bars.withColumns(
        {
            f"bb_width_{window}d": 2 * sd / (mean + TINY),
            f"bb_pct_b_{window}d": (lag("close") - (mean - 2 * sd)) / (4 * sd + TINY),
        }
    )


def rsi(bars: DataFrame, window: int = 14) -> DataFrame:
    df = bars.withColumn("_step", F.col("close") - lag("close"))
    up = F.when(F.col("_step").isNotNull(), F.greatest("_step", F.lit(0.0)))
    down = F.when(F.col("_step").isNotNull(), -F.least("_step", F.lit(0.0)))
    df = df.withColumns({"_up": up, "_down": down})
    ratio = trailing(F.avg, "_up", window, skip=1) / (
        trailing(F.avg, "_down", window, skip=1) + 1e-10
    )
    df = df.withColumn(f"rsi_{window}d", 100 - 100 / (1 + ratio))
    return df.withColumn("rsi_extreme_dist", F.abs(F.col(f"rsi_{window}d") - 50)).drop(
        "_step", "_up", "_down"
    )


def price_gap(bars: DataFrame, windows=(10, 50)) -> DataFrame:
    out = {}
    for k in windows:
        mean = trailing(F.avg, "close", k, skip=1)
        out[f"price_ma_gap_{k}d"] = (lag("close") - mean) / (mean + TINY)
    df = bars.withColumns(out)
    return df.withColumns(
        {f"price_ma_gap_abs_{k}d": F.abs(F.col(f"price_ma_gap_{k}d")) for k in windows}
    )


def macd(bars: DataFrame, fast: int = 12, slow: int = 26) -> DataFrame:
    df = ewm_mean(bars, "_fast", "close", fast, fast)
    df = ewm_mean(df, "_slow", "close", slow, slow)
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = df.withColumns(
        {
            "macd_norm": lag(F.col("macd") / (F.col("close") + TINY)),
            "macd_delta": (lag("macd") - lag("macd", 2)) / (lag("close") + TINY),
        }
    )
    return df.withColumn("macd_abs_norm", F.abs("macd_norm"))


def volume_ratio(df: DataFrame, window: int = 21, min_rows: int = 10) -> DataFrame:
    mean = trailing(F.avg, "volume", window, min_rows, skip=1)
    df = df.withColumn(f"vol_ratio_{window}d", lag("volume") / (mean + TINY))
    return df.withColumn(
        "vol_x_ret_lag_1", F.col(f"vol_ratio_{window}d") * F.abs(lag("log_return"))
    )


def sign_streak(df: DataFrame) -> DataFrame:
    """How many rows before this one share the sign of the row before it, in one unbroken run."""
    sign = F.signum("log_return")
    df = df.withColumn("_sign", sign)
    breaks = F.when(F.col("_sign").eqNullSafe(lag("_sign")) & (F.col("_sign") != 0), 0).otherwise(1)
    df = df.withColumn("_break", breaks)
    df = df.withColumn(
        "_run", F.sum("_break").over(by_series().rowsBetween(Window.unboundedPreceding, 0))
    )
    df = df.withColumn("_len", F.row_number().over(by_series(KEY, "_run")) - 1)
    return df.withColumn("return_streak", lag("_len")).drop("_sign", "_break", "_run", "_len")


def technical_features(df: DataFrame) -> DataFrame:
    """All indicators; frames over one series share one sort."""
    for step in (atr, bollinger, rsi, price_gap, macd, volume_ratio, sign_streak):
        df = step(df)
    return df


def term_slopes(df: DataFrame) -> DataFrame:
    """Ratios of short to long volatility, one row back."""
    return df.withColumns(
        {
            f"ts_slope_{a}_{b}": lag(f"vol_c2c_{a}d") / (lag(f"vol_c2c_{b}d") + 1e-10)
            for a, b in ((5, 21), (21, 63), (5, 63))
        }
    )


def vol_of_vol(df: DataFrame, windows=(10, 21)) -> DataFrame:
    return df.withColumns({f"vov_{k}d": trailing(F.stddev_samp, "rv", k, skip=1) for k in windows})


def range_spread(df: DataFrame, window: int = 21) -> DataFrame:
    """Garman-Klass minus Parkinson volatility, plain and relative."""
    gk, park = lag(f"vol_gk_{window}d"), lag(f"vol_park_{window}d")
    df = df.withColumn(f"park_gk_spread_{window}d", gk - park)
    return df.withColumn(
        "park_gk_spread_norm", F.col(f"park_gk_spread_{window}d") / (gk + 1e-10)
    )


def rolling_shape(df: DataFrame, window: int = 21, min_rows: int = 15) -> DataFrame:
    """Bias-corrected rolling skewness and kurtosis of the lagged return."""
    frame = by_series().rowsBetween(-window, -1)
    x = F.col("log_return")
    enough = F.count(x).over(frame) >= min_rows
    return df.withColumns(
        {
            f"realized_skew_{window}d": F.when(enough, skew_corrected(x)(frame)),
            f"realized_kurt_{window}d": F.when(enough, kurt_corrected(x)(frame)),
        }
    )


def up_down_ratio(df: DataFrame, window: int = 21, min_rows: int = 10) -> DataFrame:
    r = F.col("log_return")
    up = F.when(r.isNotNull(), F.pow(F.greatest(r, F.lit(0.0)), F.lit(2.0)) * 252)
    down = F.when(r.isNotNull(), F.pow(F.least(r, F.lit(0.0)), F.lit(2.0)) * 252)
    df = df.withColumns({"_up": up, "_down": down})
    return df.withColumn(
        f"updown_vol_ratio_{window}d",
        trailing(F.avg, "_up", window, min_rows, skip=1)
        / (trailing(F.avg, "_down", window, min_rows, skip=1) + 1e-10),
    ).drop("_up", "_down")


def jump_count(df: DataFrame, window: int = 21, min_rows: int = 10, sigmas: float = 3.0) -> DataFrame:
    """Lagged returns beyond ``sigmas`` of their own rolling deviation, counted over the window."""
    sd = trailing(F.stddev_samp, "log_return", window, min_rows, skip=1)
    hit = F.coalesce((F.abs(lag("log_return")) > sigmas * sd).cast("double"), F.lit(0.0))
    df = df.withColumn("_hit", hit)
    return df.withColumn(f"jump_count_{window}d", trailing(F.sum, "_hit", window, min_rows)).drop(
        "_hit"
    )


def surface_features(df: DataFrame) -> DataFrame:
    for step in (term_slopes, vol_of_vol, range_spread, rolling_shape, up_down_ratio, jump_count):
        df = step(df)
    return df
