"""Distribution drift and model monitoring.

Windows are row numbers inside a series. A row of the sample belongs to one drift window;
reference rows are only repeated for the scores whose bins depend on the window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.windows import KEY, TIME, by_series, stack, whole_series
from barograph.operators.hypothesis import ks_two_sample

REF_ROWS = 756
WIN_ROWS = 63
PSI_WARN, PSI_ALERT = 0.10, 0.25


def drift_windows(
    df: DataFrame, ref_rows: int = REF_ROWS, win_rows: int = WIN_ROWS, keys: Sequence[str] = (KEY,)
) -> DataFrame:
    """Add ``window``: -1 for the reference rows, 0, 1, ... for full windows after them."""
    w = Window.partitionBy(*keys)
    pos = F.row_number().over(w.orderBy(TIME))
    df = df.withColumns({"_at": pos, "_rows": F.count(F.lit(1)).over(w)})
    window = F.when(F.col("_at") <= ref_rows, -1).otherwise(
        F.floor((F.col("_at") - ref_rows - 1) / win_rows)
    )
    full = ref_rows + (F.col("window") + 1) * win_rows <= F.col("_rows")
    df = df.withColumn("window", window.cast("int"))
    return df.filter((F.col("window") == -1) | full).drop("_at", "_rows")


def window_dates(windows: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    return windows.filter(F.col("window") >= 0).groupBy(*keys, "window").agg(
        F.max(TIME).alias("date")
    )


def psi(
    windows: DataFrame, value: str, keys: Sequence[str] = (KEY,), bins: int = 10, eps: float = 1e-8
) -> DataFrame:
    """Population stability index of every window over the reference quantile bins."""
    keys = list(keys)
    steps = [i / bins for i in range(1, bins)]
    ref = windows.filter(F.col("window") == -1)
    cuts = ref.groupBy(*keys).agg(
        F.percentile(value, F.array(*[F.lit(q) for q in steps])).alias("_cuts")
    )
    # bin = number of inner cut points at or below the value; repeated cuts leave empty bins
    binned = windows.join(cuts, keys).withColumn(
        "_bin", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))
    )
    shares = binned.groupBy(*keys, "window").agg(
        F.array(
            *[F.count_if(F.col("_bin") == b) / F.count(F.lit(1)) + eps for b in range(bins)]
        ).alias("_p")
    )
    base = shares.filter(F.col("window") == -1).select(*keys, F.col("_p").alias("_ref"))
    now = shares.filter(F.col("window") >= 0).join(base, keys)
    terms = F.zip_with("_p", "_ref", lambda c, r: (c - r) * F.ln(c / r))
    return now.select(
        *keys, "window", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("psi")
    )


def against_reference(windows: DataFrame, value: str) -> DataFrame:
    """Sample rows of every window together with a copy of the reference rows."""
    last = F.max("window").over(whole_series())
    is_ref = F.col("window") == -1
    rows = windows.select(KEY, "window", F.col(value).alias("value"), is_ref.alias("is_ref"), last.alias("_last"))
    rows = rows.filter(F.col("_last") >= 0)
    targets = F.when(F.col("is_ref"), F.sequence(F.lit(0), F.col("_last"))).otherwise(F.array("window"))
    return rows.select(KEY, F.explode(targets).alias("window"), "value", "is_ref")


def jensen_shannon(both: DataFrame, bins: int = 50, eps: float = 1e-10) -> DataFrame:
    """Divergence of window and reference over ``bins`` equal bins of their common range."""
    w = Window.partitionBy(KEY, "window")
    rows = both.withColumns(
        {
            "_lo": F.min("value").over(w), "_hi": F.max("value").over(w),
            "_nr": F.count_if("is_ref").over(w), "_nc": F.count_if(~F.col("is_ref")).over(w),
        }
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    rows = rows.withColumn(
        "_bin", F.least(F.floor(F.try_divide(F.col("value") - F.col("_lo"), width)), F.lit(bins - 1))
    )
    counts = rows.groupBy(KEY, "window", "_bin").agg(
        F.count_if("is_ref").alias("_r"), F.count_if(~F.col("is_ref")).alias("_c"),
        F.first("_nr").alias("_nr"), F.first("_nc").alias("_nc"), F.first(width).alias("_w"),
    )
    # densities scaled back to shares, as a histogram density divided by its sum
    total = F.lit(1.0) / F.col("_w")
    p = F.col("_r") / F.col("_nr") * total / (total + eps)
    q = F.col("_c") / F.col("_nc") * total / (total + eps)
    m = (p + q) / 2
    part = p * F.ln((p + eps) / (m + eps)) + q * F.ln((q + eps) / (m + eps))
    return counts.groupBy(KEY, "window").agg(F.greatest(0.5 * F.sum(part), F.lit(0.0)).alias("jsd"))


def psi_level(score: Column) -> Column:
    return F.when(score >= PSI_ALERT, "major").when(score >= PSI_WARN, "moderate").otherwise("stable")


def drift_scan(df: DataFrame, value: str, ref_rows: int = REF_ROWS, win_rows: int = WIN_ROWS) -> DataFrame:
    """Stability index, divergence and distribution test of every window, with flag and level."""
    rows = df.filter(F.col(value).isNotNull()).select(KEY, TIME, value)
    windows = drift_windows(rows, ref_rows, win_rows)
    both = against_reference(windows, value)
    on = [KEY, "window"]
    out = (
        window_dates(windows)
        .join(psi(windows, value), on)
        .join(jensen_shannon(both), on)
        .join(ks_two_sample(both, on, "value", "is_ref").select(*on, "ks_stat", "ks_pvalue"), on)
    )
    flag = ((F.col("psi") >= PSI_WARN) | (F.col("ks_pvalue") < 0.05)).cast("int")
    return out.withColumns({"drift_flag": flag, "psi_level": psi_level(F.col("psi"))})


def feature_drift(
    df: DataFrame, features: Sequence[str], ref_rows: int = REF_ROWS, win_rows: int = WIN_ROWS
) -> DataFrame:
    """Stability index per feature and window."""
    windows = drift_windows(df.select(KEY, TIME, *features), ref_rows, win_rows)
    long = windows.unpivot([KEY, TIME, "window"], list(features), "feature", "value")
    return psi(long, "value", (KEY, "feature")).join(window_dates(windows), [KEY, "window"])


def drift_summary(scan: DataFrame) -> DataFrame:
    return scan.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("drift_flag").alias("n_drifts"), F.max("psi").alias("psi_max")
    )


# --- monitoring ----------------------------------------------------------------------


def _losses(floor: float = 1e-8) -> dict[str, Column]:
    h, v = F.greatest("pred", F.lit(floor)), F.greatest("actual", F.lit(floor))
    return {
        "rmse": F.sqrt(F.avg(F.pow(F.col("actual") - F.col("pred"), F.lit(2.0)))),
        "qlike": F.avg(F.ln(h) + v / h),
    }


def numbered(predictions: DataFrame) -> DataFrame:
    """Valid predictions numbered from 0 per series."""
    return predictions.filter(F.col("pred").isNotNull()).withColumn(
        "_at", F.row_number().over(by_series()) - 1
    )


def monitor_baseline(
    predictions: DataFrame, rows: int = WIN_ROWS, sigmas: float = 2.0, spread: float = 0.20
) -> DataFrame:
    """Losses of the first ``rows`` predictions and the alert limit above them."""
    base = numbered(predictions).filter(F.col("_at") < rows).groupBy(KEY).agg(
        *[c.alias(f"baseline_{k}") for k, c in _losses().items()], F.count(F.lit(1)).alias("n")
    )
    return base.withColumn("alert_upper_rmse", F.col("baseline_rmse") * (1 + sigmas * spread))


def monitor_windows(predictions: DataFrame, rows: int = WIN_ROWS, step: int | None = None) -> DataFrame:
    """Losses and health of full windows after the baseline; a row serves ``rows / step`` windows."""
    step = step or rows // 3
    r = F.col("_at") - rows
    after = numbered(predictions).filter(F.col("_at") >= rows)
    last = F.floor(r / step)
    first = F.greatest(F.lit(0), F.floor((r - rows) / step) + 1)
    placed = after.withColumn("window", F.explode(F.sequence(first, last)))
    size = F.abs("pred")
    out = placed.groupBy(KEY, "window").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(TIME).alias("date"),
        *[c.alias(k) for k, c in _losses().items()],
        (F.stddev_pop("pred") < 1e-8).cast("int").alias("health_all_same"),
        F.max((F.col("pred") < 0).cast("int")).alias("health_has_negative"),
        (F.max(size) > 10 * F.avg(size)).cast("int").alias("health_extreme_outlier"),
    )
    return out.filter(F.col("n") == rows)


def as_of(left: DataFrame, right: DataFrame, on: str, value: str, out: str) -> DataFrame:
    """Latest ``value`` of the right side at or before the left row's date, per series.

    One union and one window: both sides are sorted together and the last seen value is
    carried forward, so a left row costs the same whatever the gap.
    """
    fields = left.columns
    a = left.select(KEY, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.struct(*fields).alias("_row"),
                    F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(KEY, F.col(on).alias("_t"), F.lit(0).alias("_side"),
                     F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(KEY).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = stack(a, b).withColumn(out, F.last("_v", ignorenulls=True).over(w))
    return both.filter(F.col("_side") == 1).select("_row.*", out)


def monitor_log(
    predictions: DataFrame, rv_drift: DataFrame, feature_psi: DataFrame, rows: int = WIN_ROWS
) -> DataFrame:
    """One record per window: losses, drift at the window's end, health, and the alert level."""
    windows = monitor_windows(predictions, rows).join(
        monitor_baseline(predictions, rows).drop("n"), KEY
    )
    worst = feature_psi.groupBy(KEY, "date").agg(F.max("psi").alias("psi"))
    log = as_of(windows, rv_drift.select(KEY, "date", "psi"), "date", "psi", "psi_rv")
    log = as_of(log, worst, "date", "psi", "psi_feat_max")
    health = F.greatest("health_all_same", "health_has_negative", "health_extreme_outlier")
    drifted = (F.coalesce("psi_rv", F.lit(0.0)) >= PSI_WARN) | (
        F.coalesce("psi_feat_max", F.lit(0.0)) >= PSI_WARN
    )
    log = log.withColumns(
        {
            "perf_alert": (F.col("rmse") > F.col("alert_upper_rmse")).cast("int"),
            "drift_alert": drifted.cast("int"),
            "health_alert": health,
        }
    )
    return log.withColumn("alert_level", alert_level("perf_alert", "drift_alert", "health_alert"))


def alert_level(*flags: str) -> Column:
    total = sum((F.col(f) for f in flags), F.lit(0))
    return F.when(total == 0, "GREEN").when(total == 1, "YELLOW").otherwise("RED")


def alert_rates(log: DataFrame) -> DataFrame:
    def share(level: str) -> Column:
        return F.avg(F.when(F.col("alert_level") == level, 100.0).otherwise(0.0))

    return log.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total_windows"),
        share("GREEN").alias("green_pct"),
        share("YELLOW").alias("yellow_pct"),
        share("RED").alias("red_pct"),
        *[F.sum(f).alias(f"{f}s") for f in ("perf_alert", "drift_alert", "health_alert")],
    )
