"""Returns, lags, volatility estimators and the feature tables built from them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.functions.windows import (
    KEY,
    TIME,
    by_series,
    ewm_mean,
    lag,
    lead,
    trailing,
    whole_series,
)

YEAR = 252
HAR = ("rv_lag_1", "rv_lag_5", "rv_lag_21")


def with_returns(bars: DataFrame) -> DataFrame:
    """Add ``pos``, ``simple_return``, ``log_return`` and annualised daily variance ``rv``."""
    ratio = F.try_divide("close", lag("close"))
    return (
        bars.withColumns(
            {
                "pos": F.row_number().over(by_series()),
                "simple_return": ratio - 1,
                "log_return": F.ln(ratio),
            }
        ).withColumn("rv", F.pow("log_return", F.lit(2.0)) * YEAR)
    )


def with_volatility(df: DataFrame, windows: Sequence[int] = (5, 21, 63)) -> DataFrame:
    """Close-to-close, Parkinson and Garman-Klass volatility for every window length."""
    high_low = F.pow(F.ln(F.try_divide("high", "low")), F.lit(2.0))
    close_open = F.pow(F.ln(F.try_divide("close", "open")), F.lit(2.0))
    df = df.withColumns(
        {
            "_hl2": high_low,
            "gk_daily_var": 0.5 * high_low - (2 * math.log(2) - 1) * close_open,
        }
    )
    out = {}
    for k in windows:
        out[f"vol_c2c_{k}d"] = trailing(F.stddev_samp, "log_return", k) * math.sqrt(YEAR)
        out[f"vol_park_{k}d"] = F.sqrt(
            trailing(F.avg, "_hl2", k) * (YEAR / (4 * math.log(2)))
        )
        out[f"vol_gk_{k}d"] = F.sqrt(
            F.greatest(trailing(F.avg, "gk_daily_var", k), F.lit(0.0)) * YEAR
        )
    return df.withColumns(out).drop("_hl2")


def with_target(df: DataFrame) -> DataFrame:
    """Next row's variance."""
    return df.withColumn("target", lead("rv"))


def with_lags(
    df: DataFrame, rv_lags: Sequence[int] = (1, 2, 3, 5, 10, 21), ret_lags: Sequence[int] = (1, 2, 3, 5)
) -> DataFrame:
    return df.withColumns(
        {
            **{f"rv_lag{k}": lag("rv", k) for k in rv_lags},
            **{f"ret_lag{k}": lag("log_return", k) for k in ret_lags},
        }
    )


def with_har(df: DataFrame, spans: Sequence[int] = (5, 21)) -> DataFrame:
    """Lagged variance and its means over the rows before the current one."""
    return df.withColumns(
        {
            "rv_lag_1": lag("rv"),
            **{f"rv_lag_{k}": trailing(F.avg, "rv", k, skip=1) for k in spans},
            "abs_ret_lag1": F.abs(lag("log_return")),
        }
    )


def har_table(df: DataFrame) -> DataFrame:
    """Complete rows of the HAR features and target, renumbered ``pos`` 1..n per series."""
    cols = [*HAR, "abs_ret_lag1", "target"]
    full = with_target(with_har(df)).dropna("any", subset=cols)
    return full.select(KEY, TIME, "rv", "log_return", *cols).withColumn(
        "pos", F.row_number().over(by_series())
    )


BASE_FEATURES = (
    *[f"rv_lag{k}" for k in (1, 2, 3, 5, 10, 21)],
    *[f"ret_lag{k}" for k in (1, 2, 3, 5)],
    "roll_vol_5",
    "roll_vol_21",
    "rv_ewm_10",
    "abs_ret_lag1",
)


def with_ewm_variance(df: DataFrame, span: int = 10, min_rows: int = 5) -> DataFrame:
    """Exponentially weighted mean of the lagged variance."""
    return ewm_mean(df.withColumn("_rv1", lag("rv")), f"rv_ewm_{span}", "_rv1", span, min_rows).drop(
        "_rv1"
    )


def base_features(df: DataFrame) -> DataFrame:
    """The general feature matrix with target; incomplete rows dropped."""
    df = with_ewm_variance(with_target(with_lags(df)))
    df = df.withColumns(
        {
            "roll_vol_5": trailing(F.stddev_samp, "log_return", 5, skip=1) * math.sqrt(YEAR),
            "roll_vol_21": trailing(F.stddev_samp, "log_return", 21, skip=1) * math.sqrt(YEAR),
            "abs_ret_lag1": F.abs(lag("log_return")),
        }
    )
    return (
        df.dropna("any", subset=[*BASE_FEATURES, "target"])
        .select(KEY, TIME, *BASE_FEATURES, "target")
        .withColumn("pos", F.row_number().over(by_series()))
    )


def with_semivariance(df: DataFrame) -> DataFrame:
    """Variance split by the sign of the return, with lag 1 and 5/21-row means."""
    df = df.withColumns(
        {
            "rv_pos": F.pow(F.greatest("log_return", F.lit(0.0)), F.lit(2.0)) * YEAR,
            "rv_neg": F.pow(F.least("log_return", F.lit(0.0)), F.lit(2.0)) * YEAR,
        }
    )
    # greatest/least skip nulls, so restore the null of the first row
    df = df.withColumns(
        {c: F.when(F.col("log_return").isNotNull(), F.col(c)) for c in ("rv_pos", "rv_neg")}
    )
    out = {}
    for side in ("pos", "neg"):
        out[f"rv_{side}_lag_1"] = lag(f"rv_{side}")
        for k in (5, 21):
            out[f"rv_{side}_lag_{k}"] = trailing(F.avg, f"rv_{side}", k, skip=1)
    return df.withColumns(out)


def with_leverage(df: DataFrame) -> DataFrame:
    """Lagged negative return and the 5-row balance of falls against rises."""
    r = F.col("log_return")
    falls = F.when(r.isNotNull(), F.least(r, F.lit(0.0)))
    rises = F.when(r.isNotNull(), F.greatest(r, F.lit(0.0)))
    frame = by_series().rowsBetween(-5, -1)
    return df.withColumns(
        {
            "leverage_term": lag(falls),
            "ret_asym_5": F.when(
                F.count(r).over(frame) >= 3,
                F.abs(F.sum(falls).over(frame)) - F.sum(rises).over(frame),
            ),
        }
    )


AHAR_SETS = {
    "HAR": HAR,
    "AHAR": ("rv_pos_lag_1", "rv_neg_lag_1", "rv_pos_lag_5", "rv_neg_lag_5", "rv_lag_21"),
    "L-HAR": (*HAR, "leverage_term"),
    "Full-AHAR": (
        "rv_pos_lag_1", "rv_neg_lag_1", "rv_pos_lag_5", "rv_neg_lag_5",
        "rv_lag_21", "leverage_term", "ret_asym_5",
    ),
}


def ahar_table(df: DataFrame) -> DataFrame:
    cols = sorted({c for s in AHAR_SETS.values() for c in s})
    full = with_target(with_leverage(with_semivariance(with_har(df))))
    full = full.dropna("any", subset=[*cols, "rv_pos_lag_21", "rv_neg_lag_21", "target"])
    return full.select(KEY, TIME, *cols, "target").withColumn(
        "pos", F.row_number().over(by_series())
    )


def split_tail(df: DataFrame, test_rows: int = 500, val_share: float | None = None) -> DataFrame:
    """Label rows ``train``, ``val`` or ``test``: the tail is the test, then a share is validation.

    Counts come from the same window partition as the row number, so nothing is collected.
    """
    rows = F.count(F.lit(1)).over(whole_series())
    pos = F.row_number().over(by_series())
    df = df.withColumns({"_rows": rows, "_at": pos})
    train_end = F.col("_rows") - test_rows
    label = F.when(F.col("_at") > train_end, "test")
    if val_share is not None:
        label = label.when(F.col("_at") > F.floor(train_end * (1 - val_share)), "val")
    return df.withColumn("split", label.otherwise("train")).drop("_rows", "_at")


def scale_on_train(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise by the mean and population deviation of the training rows of the series."""
    train = F.col("split") == "train"
    stats = df.groupBy(KEY).agg(
        *[F.avg(F.when(train, F.col(c))).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(F.when(train, F.col(c))).alias(f"_s_{c}") for c in columns],
    )
    joined = df.join(stats, KEY)
    return joined.withColumns(
        {
            f"{c}_scaled": (F.col(c) - F.col(f"_m_{c}"))
            / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
            for c in columns
        }
    ).drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def sequences(df: DataFrame, columns: Sequence[str], length: int = 22) -> DataFrame:
    """The ``length`` rows before each row as an array of feature arrays, plus its target."""
    w = by_series().rowsBetween(-length, -1)
    row = F.array(*[F.col(c) for c in columns])
    full = df.dropna("any", subset=list(columns))
    return full.withColumn("window", F.collect_list(row).over(w)).filter(
        F.size("window") == length
    )
