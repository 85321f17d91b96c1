"""Conditional variance models by a grid scan, and what is read off the best one.

GARCH and GJR variances are linear recursions in known terms, so every (series, parameter)
pair is a decayed sum over windows. EGARCH is not linear: there the returns of a series,
bounded by the calendar, are folded in the JVM with ``aggregate`` over a sorted array.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.windows import KEY, TIME, by_series, decayed_sum, stack, trailing, whole_series

GRID_ALPHA = (0.03, 0.05, 0.10)
GRID_GAMMA = (0.0, 0.05, 0.10)
GRID_BETA = (0.80, 0.85, 0.90)
EGARCH_ALPHA = (0.05, 0.10, 0.20)
EGARCH_GAMMA = (-0.10, -0.05, 0.0)
EGARCH_BETA = (0.90, 0.95, 0.97)
PARAMS = ("model", "alpha", "gamma", "beta")


def _grid(model: Column, alphas, gammas, betas, bound: float | None) -> list[Column]:
    return [
        F.struct(
            model.alias("model"), F.lit(a).alias("alpha"), F.lit(g).alias("gamma"), F.lit(b).alias("beta")
        )
        for a, g, b in itertools.product(alphas, gammas, betas)
        if bound is None or a + b + g / 2 < bound
    ]


def returns_pct(df: DataFrame, value: str = "log_return") -> DataFrame:
    """Demeaned returns in per cent with their sample variance."""
    r = df.filter(F.col(value).isNotNull()).select(KEY, TIME, (F.col(value) * 100).alias("r"))
    w = whole_series()
    r = r.withColumn("e", F.col("r") - F.avg("r").over(w))
    return r.withColumn("s2", F.avg(F.col("e") * F.col("e")).over(w))


def garch_variances(df: DataFrame) -> DataFrame:
    """Conditional variance for every grid point of GARCH (gamma 0) and GJR, variance targeted."""
    name = F.lit("GARCH")
    cells = [
        *_grid(name, GRID_ALPHA, (0.0,), GRID_BETA, 1.0),
        *_grid(F.lit("GJR-GARCH"), GRID_ALPHA, [g for g in GRID_GAMMA if g > 0], GRID_BETA, 1.0),
    ]
    rows = returns_pct(df).select("*", F.inline(F.array(*cells)))
    rows = rows.withColumn(
        "omega", F.col("s2") * (1 - F.col("alpha") - F.col("beta") - F.col("gamma") / 2)
    )
    keys = (KEY, *PARAMS)
    w = by_series(*keys)
    e1 = F.lag("e").over(w)
    rise = (F.col("alpha") + F.when(e1 < 0, F.col("gamma")).otherwise(0.0)) * e1 * e1
    feed = F.when(F.row_number().over(w) == 1, F.col("s2")).otherwise(F.col("omega") + rise)
    rows = rows.withColumn("_feed", feed)
    return decayed_sum(rows, {"h": F.col("_feed")}, F.col("beta"), keys).drop("_feed")


def _scored(rows: DataFrame, n_params: Column) -> DataFrame:
    """Gaussian log-likelihood and information criteria per series and grid point."""
    h = F.greatest("h", F.lit(1e-12))
    ll = -0.5 * F.sum(F.lit(math.log(2 * math.pi)) + F.ln(h) + F.col("e") * F.col("e") / h)
    out = rows.groupBy(KEY, *PARAMS).agg(
        F.count(F.lit(1)).alias("n"), F.first("omega").alias("omega"), ll.alias("loglik")
    )
    k = n_params
    return out.withColumns(
        {
            "aic": 2 * k - 2 * F.col("loglik"),
            "bic": k * F.ln(F.col("n").cast("double")) - 2 * F.col("loglik"),
        }
    )


def garch_scan(df: DataFrame) -> DataFrame:
    k = F.when(F.col("model") == "GARCH", 3).otherwise(4)
    out = _scored(garch_variances(df), k)
    return out.withColumn("persistence", F.col("alpha") + F.col("beta") + F.col("gamma") / 2)


def egarch_scan(df: DataFrame) -> DataFrame:
    """EGARCH log-likelihoods; the long-run level is set to the sample variance."""
    arrays = (
        returns_pct(df)
        .groupBy(KEY)
        .agg(
            F.first("s2").alias("s2"),
            F.count(F.lit(1)).alias("n"),
            F.array_sort(F.collect_list(F.struct(TIME, "e"))).alias("_a"),
        )
        .withColumn("_e", F.transform("_a", lambda s: s["e"]))
        .drop("_a")
    )
    grid = _grid(F.lit("EGARCH"), EGARCH_ALPHA, EGARCH_GAMMA, EGARCH_BETA, None)
    rows = arrays.select("*", F.inline(F.array(*grid)))
    rows = rows.withColumn("omega", (1 - F.col("beta")) * F.ln("s2"))
    mean_abs = math.sqrt(2 / math.pi)

    def step(acc: Column, e: Column) -> Column:
        z = e / F.exp(acc["lh"] / 2)
        nxt = (
            F.col("omega") + F.col("beta") * acc["lh"]
            + F.col("alpha") * (F.abs(z) - mean_abs) + F.col("gamma") * z
        )
        return F.struct(
            nxt.alias("lh"),
            (acc["ll"] - 0.5 * (math.log(2 * math.pi) + acc["lh"] + z * z)).alias("ll"),
        )

    start = F.struct(F.ln("s2").alias("lh"), F.lit(0.0).alias("ll"))
    out = rows.withColumn("loglik", F.aggregate("_e", start, step)["ll"])
    return out.select(
        KEY, *PARAMS, "n", "omega", "loglik",
        (8 - 2 * F.col("loglik")).alias("aic"),
        (4 * F.ln(F.col("n").cast("double")) - 2 * F.col("loglik")).alias("bic"),
        F.col("beta").alias("persistence"),
    )


def volatility_scan(df: DataFrame) -> DataFrame:
    return stack(garch_scan(df), egarch_scan(df))


def best_models(scan: DataFrame, *by: str, criterion: str = "aic") -> DataFrame:
    """Lowest criterion per series (and ``by``)."""
    w = Window.partitionBy(KEY, *by).orderBy(criterion, *PARAMS)
    return scan.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def news_impact(params: DataFrame, points: int = 100, reach: float = 5.0) -> DataFrame:
    """Next variance for shocks on an even grid, for every fitted parameter row."""
    step = 2 * reach / (points - 1)
    rows = params.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "eps", F.lit(-reach) + F.col("_i") * step
    )
    a, b, g, o, e = (F.col(c) for c in ("alpha", "beta", "gamma", "omega", "eps"))
    level = F.greatest(o / (1 - a - b - 0.5 * g + 1e-10), F.lit(1e-4))
    linear = o + (a + F.when(e < 0, g).otherwise(0.0)) * e * e + b * level
    log_level = o / (1 - F.abs(b) + 1e-10)
    z = e / F.sqrt(F.greatest(F.exp(log_level), F.lit(1e-6)))
    expo = F.exp(o + a * (F.abs(z) - math.sqrt(2 / math.pi)) + g * z + b * log_level)
    return rows.select(
        KEY, "model", F.col("_i").alias("point"), "eps",
        F.when(F.col("model") == "EGARCH", expo).otherwise(linear).alias("h_next"),
    )


def conditional_against_realised(df: DataFrame, alpha: float, beta: float, window: int = 20) -> DataFrame:
    """GARCH volatility for given parameters against rolling realised volatility, in per cent a year."""
    rows = returns_pct(df).withColumns({"alpha": F.lit(alpha), "beta": F.lit(beta)})
    w = by_series()
    e1 = F.lag("e").over(w)
    feed = F.when(F.row_number().over(w) == 1, F.col("s2")).otherwise(
        F.col("s2") * (1 - alpha - beta) + alpha * e1 * e1
    )
    rows = decayed_sum(rows.withColumn("_feed", feed), {"h": F.col("_feed")}, beta)
    rows = rows.withColumns(
        {
            "conditional_vol": F.sqrt(F.col("h") * 252),
            "realised_vol": trailing(F.stddev_samp, "r", window) * math.sqrt(252),
        }
    ).filter(F.col("realised_vol").isNotNull())
    gap = F.col("realised_vol") - F.col("conditional_vol")
    return rows.groupBy(KEY).agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.corr("realised_vol", "conditional_vol").alias("corr"),
        F.max_by(TIME, F.struct(gap, F.col(TIME))).alias("worst_date"),
        F.max(gap).alias("worst_gap"),
    )
