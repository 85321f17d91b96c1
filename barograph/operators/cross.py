"""Features across series: correlation, dispersion, beta, factor split, spillover, regimes.

Cross-series work starts from a wide panel over a *named* list of series (one row per
date), so no pairs are formed inside a group and nothing is joined to itself. Asset and
market pairs, or a target and its others, are then laid out long with ``inline``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.windows import (
    KEY,
    TIME,
    by_series,
    correlation,
    decayed_sum,
    lag,
    lead,
    trailing,
    trailing2,
    whole_series,
)

PANEL = "panel_id"


def panel_line():
    """Date order over a whole panel: one row per date, so the calendar bounds it."""
    return Window.partitionBy(PANEL).orderBy(TIME)


def keyed_panel(panel: DataFrame) -> DataFrame:
    return panel if PANEL in panel.columns else panel.withColumn(PANEL, F.lit("all"))


def attach_panel(df: DataFrame, panel: DataFrame) -> DataFrame:
    """Left join of the wide panel by date; dates outside the panel get nulls."""
    return df.join(panel, TIME, "left")


def own_value(series: Sequence[str]) -> Column:
    """The panel column of the row's own series."""
    out = F.lit(None).cast("double")
    for s in series:
        out = F.when(F.col(KEY) == s, F.col(s)).otherwise(out)
    return out


def rolling_correlation(
    df: DataFrame, panel: DataFrame, series: Sequence[str], window: int = 21, min_rows: int = 15
) -> DataFrame:
    """Rolling correlation of every series with every other named series, one row back."""
    joined = attach_panel(df, panel)
    others = F.array(
        *[F.struct(F.lit(s).alias("other"), F.col(s).alias("_y")) for s in series]
    )
    long = joined.select(KEY, TIME, own_value(series).alias("_x"), F.inline(others)).filter(
        F.col("other") != F.col(KEY)
    )
    w = by_series(KEY, "other")
    return long.select(
        KEY, "other", TIME,
        trailing2(F.corr, "_x", "_y", window, min_rows, skip=1, w=w).alias("roll_corr"),
    )


def dispersion(df: DataFrame, panel: DataFrame, series: Sequence[str]) -> DataFrame:
    """Deviation across the panel per date, one row back, and its 5-row mean."""
    mean = sum((F.col(s) for s in series), F.lit(0.0)) / len(series)
    spread = F.sqrt(
        sum((F.pow(F.col(s) - mean, F.lit(2.0)) for s in series), F.lit(0.0)) / (len(series) - 1)
    )
    out = attach_panel(df, panel.select(TIME, spread.alias("_spread")))
    out = out.withColumn("cross_asset_dispersion", lag("_spread")).drop("_spread")
    return out.withColumn(
        "dispersion_5d_avg", trailing(F.avg, "cross_asset_dispersion", 5, 3)
    )


def benchmark_context(df: DataFrame, benchmark: str, value: str, out: str) -> DataFrame:
    """Another series' lagged column by date. One benchmark row per date keeps the side small."""
    side = (
        df.filter(F.col(KEY) == benchmark)
        .select(TIME, lag(value).alias(out), KEY)
        .drop(KEY)
    )
    return df.join(side, TIME, "left")


def rolling_beta(
    df: DataFrame, panel: DataFrame, series: Sequence[str], benchmark: str,
    window: int = 21, min_rows: int = 15,
) -> DataFrame:
    """Beta to the benchmark over lagged returns, and the deviation of that beta."""
    out = attach_panel(df, panel).withColumns(
        {"_x": own_value(series), "_m": F.col(benchmark)}
    )
    cov = trailing2(F.covar_samp, "_x", "_m", window, min_rows, skip=1)
    var = trailing(F.var_samp, "_m", window, min_rows, skip=1)
    out = out.withColumn(f"rolling_beta_{window}d", cov / (var + 1e-12))
    return out.withColumn(
        f"beta_instability_{window}d",
        trailing(F.stddev_samp, f"rolling_beta_{window}d", window, 10),
    ).drop("_x", "_m", *series)


def spread_features(
    df: DataFrame, panel: DataFrame, long: str, short: str, window: int = 21, min_rows: int = 10
) -> DataFrame:
    """Rolling mean and deviation of the return spread of two series."""
    side = panel.select(TIME, (F.col(long) - F.col(short)).alias("_spread"))
    return attach_panel(df, side).withColumns(
        {
            "spread_mean": trailing(F.avg, "_spread", window, min_rows, skip=1),
            "spread_vol": trailing(F.stddev_samp, "_spread", window, min_rows, skip=1),
        }
    ).drop("_spread")


def bull_regime(df: DataFrame, panel: DataFrame, benchmark: str) -> DataFrame:
    """Whether the benchmark's 50-row mean was above its 200-row mean one panel row ago."""
    line = panel_line()
    p = keyed_panel(panel).withColumn(
        "_level", F.exp(F.sum(benchmark).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    )
    fast = trailing(F.avg, "_level", 50, 40, w=line)
    slow = trailing(F.avg, "_level", 200, 150, w=line)
    flag = F.coalesce((fast > slow).cast("double"), F.lit(0.0))
    p = p.withColumn("_flag", flag)
    side = p.select(TIME, F.lag("_flag").over(line).alias("bull_regime_flag"))
    return df.join(side, TIME, "left")


# --- beta and factor split -----------------------------------------------------------


def market_pairs(panel: DataFrame, series: Sequence[str], market: str) -> DataFrame:
    """Rows ``(series_id, t, r, m)`` for every named series but the market."""
    cells = [
        F.struct(F.lit(s).alias(KEY), F.col(s).alias("r"), F.col(market).alias("m"))
        for s in series
        if s != market
    ]
    return panel.select(TIME, F.inline(F.array(*cells)))


def ols_beta(pairs: DataFrame, window: int = 22) -> DataFrame:
    cov = trailing2(F.covar_samp, "r", "m", window)
    var = trailing(F.var_samp, "m", window)
    return pairs.withColumn("ols_beta", F.try_divide(cov, var))


def ewma_beta(pairs: DataFrame, decay: float = 0.94, seed_rows: int = 22) -> DataFrame:
    """Exponentially weighted beta, seeded by the moments of the first rows."""
    pos = F.row_number().over(by_series())
    df = pairs.withColumn("_p", pos)
    early = F.col("_p") <= seed_rows
    r0, m0 = F.when(early, F.col("r")), F.when(early, F.col("m"))
    df = df.withColumns(
        {
            "_cov0": F.covar_samp(r0, m0).over(whole_series()),
            "_var0": F.var_pop(m0).over(whole_series()),
        }
    )

    def feed(seed: str, step: Column) -> Column:
        return F.when(F.col("_p") == seed_rows, F.col(seed)).when(
            F.col("_p") > seed_rows, (1 - decay) * step
        )

    df = decayed_sum(
        df,
        {
            "_cov": feed("_cov0", F.col("r") * F.col("m")),
            "_var": feed("_var0", F.col("m") * F.col("m")),
        },
        decay,
    )
    beta = F.when((F.col("_p") > seed_rows) & (F.col("_var") > 0), F.col("_cov") / F.col("_var"))
    return df.withColumn("ewma_beta", beta).drop("_p", "_cov0", "_var0", "_cov", "_var")


def beta_feature(pairs: DataFrame, method: str = "ewma") -> DataFrame:
    """Beta known before the row: the estimate of the row before."""
    df = ewma_beta(pairs) if method == "ewma" else ols_beta(pairs)
    return df.withColumn("beta", lag(f"{method}_beta"))


def factor_split(df: DataFrame) -> DataFrame:
    """Explained and own part of the return and of its square; the share clipped to [0, 1]."""
    explained = F.col("beta") * F.col("m")
    own = F.col("r") - explained
    total = F.pow("r", F.lit(2.0))
    share = F.pow(explained, F.lit(2.0)) / F.nullif(total, F.lit(0.0))
    return df.withColumns(
        {
            "r_explained": explained,
            "r_idio": own,
            "rv_total": total,
            "rv_market": F.pow(explained, F.lit(2.0)),
            "rv_idio": F.pow(own, F.lit(2.0)),
            "frac_market_explained": F.when(
                share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
            ),
        }
    )


def factor_panel(panel: DataFrame, series: Sequence[str], market: str) -> DataFrame:
    cols = ("rv_total", "rv_market", "rv_idio", "frac_market_explained", "beta")
    out = factor_split(beta_feature(market_pairs(panel, series, market)))
    return out.select(KEY, TIME, *cols).dropna("any")


# --- spillover and index features ----------------------------------------------------


def target_and_others(panel: DataFrame, series: Sequence[str]) -> DataFrame:
    """Rows ``(series_id, t, own, other_1, other_2, ...)``: each named series as the target."""
    cells = []
    for s in series:
        others = [o for o in series if o != s]
        cells.append(
            F.struct(
                F.lit(s).alias(KEY),
                F.col(s).alias("own"),
                *[F.col(o).alias(f"other_{i}") for i, o in enumerate(others, 1)],
            )
        )
    return panel.select(TIME, F.inline(F.array(*cells)))


def spillover_features(panel: DataFrame, series: Sequence[str]) -> DataFrame:
    """HAR terms of the target plus lag, 5-row mean and clipped ratio of every other series."""
    df = target_and_others(panel, series)
    out = {
        "rv_lag_1": lag("own"),
        "rv_lag_5": trailing(F.avg, "own", 5, skip=1),
        "rv_lag_21": trailing(F.avg, "own", 21, skip=1),
        "target": lead("own"),
    }
    for i in range(1, len(series)):
        o = f"other_{i}"
        out[f"cross_{i}_lag1"] = lag(o)
        out[f"cross_{i}_lag5"] = trailing(F.avg, o, 5, skip=1)
        ratio = lag(o) / (lag("own") + 1e-10)
        out[f"ratio_{i}_lag1"] = F.when(
            ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(10.0))
        )
    return df.withColumns(out)


def index_features(df: DataFrame, index: DataFrame, value: str) -> DataFrame:
    """Features of a sparse index carried forward by date: lag, mean, deviation, high flag."""
    joined = df.join(index.select(TIME, F.col(value).alias("_raw")), TIME, "left")
    joined = joined.withColumn(
        "_index",
        F.last("_raw", ignorenulls=True).over(by_series().rowsBetween(Window.unboundedPreceding, 0)),
    )
    level = joined.groupBy(KEY).agg(F.percentile("_index", F.lit(0.75)).alias("_high"))
    out = joined.join(level, KEY).withColumns(
        {
            "index_lag1": lag("_index"),
            "index_lag5": trailing(F.avg, "_index", 5, 3, skip=1),
            "index_vol_21": trailing(F.stddev_samp, "_index", 21, 10, skip=1),
            "high_index": F.coalesce((lag("_index") > F.col("_high")).cast("double"), F.lit(0.0)),
        }
    )
    return out.drop("_raw", "_index", "_high")


def regime_features(df: DataFrame, regimes: DataFrame) -> DataFrame:
    """Yesterday's regime and its probabilities; 1 and a third where unknown."""
    probs = ("post_low", "post_med", "post_high")
    joined = df.join(regimes.select(KEY, TIME, "regime", *probs), [KEY, TIME], "left")
    return joined.withColumns(
        {
            "regime_lag1": F.coalesce(lag("regime"), F.lit(1)),
            **{f"{p}_lag1": F.coalesce(lag(p), F.lit(1.0 / 3)) for p in probs},
        }
    )


def target_correlations(df: DataFrame, features: Sequence[str], target: str = "target") -> DataFrame:
    """Correlation of every feature with the target, one pass over the rows."""
    wide = df.groupBy(KEY).agg(*[correlation(f, target).alias(f) for f in features])
    return wide.unpivot([KEY], list(features), "feature", "corr")
