"""Data quality and descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.special import norm_quantile
from barograph.functions.windows import (
    KEY,
    TIME,
    by_series,
    kurt_corrected,
    skew_corrected,
    whole_series,
)


def quality_report(bars: DataFrame) -> DataFrame:
    """One row per series with counts of everything that looks wrong."""
    fields = ("open", "high", "low", "close", "volume")
    missing = sum((F.col(c).isNull().cast("int") for c in fields), F.lit(0))
    low, high = F.col("low"), F.col("high")
    bad = (high < low) | (F.col("open") < low) | (F.col("open") > high)
    bad = bad | (F.col("close") < low) | (F.col("close") > high)
    negative = F.least("open", "high", "low", "close") < 0
    report = bars.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(TIME).alias("start"),
        F.max(TIME).alias("end"),
        F.sum(missing).alias("missing_cells"),
        (F.count(TIME) - F.count_distinct(TIME)).alias("duplicate_dates"),
        F.count_if(F.dayofweek(TIME).isin(1, 7)).alias("non_bdays"),
        F.count_if(negative).alias("neg_prices"),
        F.count_if(F.col("volume") == 0).alias("zero_volume"),
        F.count_if(bad).alias("bad_ohlc"),
        F.min("close").alias("close_min"),
        F.max("close").alias("close_max"),
    )
    faults = sum(
        (F.col(c) for c in ("missing_cells", "duplicate_dates", "neg_prices", "bad_ohlc")), F.lit(0)
    )
    return report.withColumn("status", F.when(faults > 0, "CHECK").otherwise("OK"))


def return_summary(df: DataFrame, value: str = "log_return") -> DataFrame:
    x = F.col(value)
    return df.groupBy(KEY).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        skew_corrected(x)().alias("skew"),
        kurt_corrected(x)().alias("kurt"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        (F.stddev_samp(x) * F.sqrt(F.lit(252.0))).alias("ann_vol"),
    )


def volatility_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(KEY).agg(
        F.avg("vol_c2c_21d").alias("ann_vol_21d"),
        F.avg("vol_c2c_63d").alias("ann_vol_63d"),
        F.avg("vol_park_21d").alias("parkinson_21d"),
        F.avg("vol_gk_21d").alias("garman_klass_21d"),
        F.max("vol_c2c_21d").alias("max_rv_21d"),
        F.min("vol_c2c_21d").alias("min_rv_21d"),
    )


def recent_coverage(df: DataFrame, columns: Sequence[str], rows: int = 5) -> DataFrame:
    """Non-null count per feature in the last ``rows`` rows of each series."""
    back = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME)))
    return (
        df.withColumn("_back", back)
        .filter(F.col("_back") <= rows)
        .groupBy(KEY)
        .agg(*[F.count(c).alias(c) for c in columns])
        .unpivot([KEY], list(columns), "feature", "present")
    )


def qq_points(df: DataFrame, value: str) -> DataFrame:
    """Ordered values against normal quantiles at the medians of uniform order statistics."""
    x = F.col(value)
    rows = df.filter(x.isNotNull()).select(KEY, TIME, x.alias("sample"))
    w = Window.partitionBy(KEY).orderBy("sample", TIME)
    rows = rows.withColumns(
        {
            "_i": F.row_number().over(w).cast("double"),
            "_n": F.count(F.lit(1)).over(whole_series()).cast("double"),
        }
    )
    i, n = F.col("_i"), F.col("_n")
    top = F.pow(F.lit(0.5), F.lit(1.0) / n)
    p = F.when(i == n, top).when(i == 1, 1 - top).otherwise((i - 0.3175) / (n + 0.365))
    return rows.withColumn("p", p).withColumn("theoretical", norm_quantile(F.col("p"))).drop("_i", "_n")


def qq_line(points: DataFrame) -> DataFrame:
    return points.groupBy(KEY).agg(
        F.regr_slope("sample", "theoretical").alias("slope"),
        F.regr_intercept("sample", "theoretical").alias("intercept"),
        F.corr("sample", "theoretical").alias("r"),
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts and density over ``bins`` equal bins of each series' own range; the top edge is included.

    Every row with a value falls into a bin. A series of one repeated value has a range of one around it.
    """
    x = F.col(value)
    rows = df.filter(x.isNotNull())
    span = rows.groupBy(KEY).agg(F.min(x).alias("_low"), F.max(x).alias("_high"))
    flat = F.col("_low") == F.col("_high")
    span = span.select(
        KEY,
        F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low")).alias("_low"),
        F.when(flat, F.lit(1.0)).otherwise(F.col("_high") - F.col("_low")).alias("_range"),
    ).withColumn("_width", F.col("_range") / bins)
    bucket = F.least(F.floor((x - F.col("_low")) / F.col("_width")), F.lit(bins - 1))
    return (
        rows.join(span, KEY)
        .groupBy(KEY, "_width", bucket.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("density", F.col("n") / F.sum("n").over(whole_series()) / F.col("_width"))
        .drop("_width")
    )


def density_overlay(df: DataFrame, value: str) -> DataFrame:
    """Normal parameters, and the Student t that shares the excess kurtosis."""
    x = F.col(value)
    base = df.groupBy(KEY).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.kurtosis(x).alias("kurt")
    )
    dof = F.greatest(F.lit(3), F.floor(6 / F.greatest("kurt", F.lit(0.5)) + 4).cast("int"))
    base = base.withColumn("t_df", dof)
    return base.withColumn(
        "t_scale", F.col("std") * F.sqrt((F.col("t_df") - 2) / F.col("t_df"))
    )


def normalised_price(bars: DataFrame, base: float = 1.0) -> DataFrame:
    """Close rebased to the first close of the series."""
    first = F.first("close").over(by_series().rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("norm_close", base * F.try_divide(F.col("close"), first))
