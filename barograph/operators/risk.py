"""Covariance, dynamic correlation and portfolio risk in pair-long form ``(t, i, j, ...)``.

Pairs come from a named list of series. Every covariance or correlation entry is its own
linear recursion, so pairs spread over the cluster and no matrix state exists.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.special import NORMAL_QUANTILE
from barograph.functions.windows import KEY, TIME, by_series, decayed_sum, lag, whole_series
from barograph.operators.hypothesis import christoffersen, kupiec
from barograph.sources.bars import panel_pairs, series_pairs

YEAR = 252
PAIR = ("i", "j")


def pair_line():
    return by_series(*PAIR)


def matrix_pairs(panel: DataFrame, series: Sequence[str]) -> DataFrame:
    """Upper triangle with diagonal: ``(t, i, j, x, y)``."""
    return panel_pairs(panel, series_pairs(series, diagonal=True))


def rolling_covariance(pairs: DataFrame, window: int = 21) -> DataFrame:
    """Annualised covariance over the ``window`` rows that end two rows before the date."""
    w = pair_line().rowsBetween(-(window + 1), -2)
    cov = F.when(F.count("x").over(w) == window, F.covar_samp("x", "y").over(w) * YEAR)
    return pairs.select(TIME, *PAIR, cov.alias("cov")).filter(F.col("cov").isNotNull())


def ewma_covariance(pairs: DataFrame, decay: float = 0.94, seed_rows: int = 21) -> DataFrame:
    """Annualised exponentially weighted covariance, seeded by the first rows."""
    df = pairs.withColumn("_p", F.row_number().over(pair_line()))
    early = F.col("_p") <= seed_rows
    df = df.withColumns(
        {
            "_seed": F.covar_samp(F.when(early, F.col("x")), F.when(early, F.col("y"))).over(
                whole_series(*PAIR)
            ),
            "_step": F.lag(F.col("x") * F.col("y")).over(pair_line()) * (1 - decay),
        }
    )
    feed = F.when(F.col("_p") == seed_rows, F.col("_seed")).when(
        F.col("_p") > seed_rows, F.col("_step")
    )
    df = decayed_sum(df, {"_cov": feed}, decay, PAIR)
    return df.filter(F.col("_p") > seed_rows).select(
        TIME, *PAIR, (F.col("_cov") * YEAR).alias("cov")
    )


def to_correlation(cov: DataFrame, value: str = "cov", out: str = "corr", *keys: str) -> DataFrame:
    """Divide every entry by the two diagonal entries of its date (and ``keys``)."""
    at = [*keys, TIME]
    diag = cov.filter(F.col("i") == F.col("j"))
    di = diag.select(*at, "i", F.col(value).alias("_vi"))
    dj = diag.select(*at, "j", F.col(value).alias("_vj"))
    scale = F.greatest(F.sqrt(F.col("_vi") * F.col("_vj")), F.lit(1e-12))
    return (
        cov.join(di, [*at, "i"])
        .join(dj, [*at, "j"])
        .withColumn(out, F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col(value) / scale))
        .drop("_vi", "_vj")
    )


def correlation_columns(corr: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One column per named pair."""
    return corr.groupBy(TIME).agg(
        *[
            F.max(F.when((F.col("i") == a) & (F.col("j") == b), F.col("corr"))).alias(f"corr_{a}_{b}")
            for a, b in pairs
        ]
    )


def ewma_volatility(
    df: DataFrame, value: str = "log_return", decay: float = 0.94, seed_rows: int = 21
) -> DataFrame:
    """Daily volatility per series; the first value is the population deviation of the seed."""
    df = df.filter(F.col(value).isNotNull())
    df = df.withColumn("_p", F.row_number().over(by_series()))
    seed = F.var_pop(F.when(F.col("_p") <= seed_rows, F.col(value))).over(whole_series())
    step = lag(F.pow(value, F.lit(2.0))) * (1 - decay)
    df = df.withColumns({"_seed": seed, "_step": step})
    feed = F.when(F.col("_p") == 1, F.col("_seed")).otherwise(F.col("_step"))
    df = decayed_sum(df, {"_var": feed}, decay)
    return df.withColumns(
        {"ewma_vol": F.sqrt(F.greatest("_var", F.lit(1e-12))), "vol_pos": F.col("_p")}
    ).drop("_p", "_seed", "_step", "_var")


def standardised_residuals(vols: DataFrame, value: str = "log_return", burn_in: int = 21) -> DataFrame:
    return vols.filter(F.col("vol_pos") > burn_in).withColumn(
        "resid", F.col(value) / F.col("ewma_vol")
    )


def _dcc_feed(df: DataFrame, a: Column, b: Column, keys: Sequence[str]) -> DataFrame:
    w = by_series(*keys)
    df = df.withColumns(
        {
            "_p": F.row_number().over(w),
            "qbar": F.covar_samp("x", "y").over(whole_series(*keys)),
            "_xy": F.lag(F.col("x") * F.col("y")).over(w),
        }
    )
    step = (1 - a - b) * F.col("qbar") + a * F.col("_xy")
    return df.withColumn("_feed", F.when(F.col("_p") == 1, F.col("qbar")).otherwise(step))


def dcc(pairs: DataFrame, a: float, b: float) -> DataFrame:
    """Dynamic conditional correlation for given parameters: columns ``q`` and ``corr``."""
    df = _dcc_feed(pairs, F.lit(a), F.lit(b), PAIR)
    df = decayed_sum(df, {"q": F.col("_feed")}, b, PAIR)
    return to_correlation(df.select(TIME, *PAIR, "x", "y", "qbar", "q"), "q")


DCC_A = (0.01, 0.03, 0.05, 0.07, 0.10)
DCC_B = (0.80, 0.85, 0.90, 0.93, 0.95)


def dcc_grid(
    pairs: DataFrame, series: Sequence[str],
    a_grid: Sequence[float] = DCC_A, b_grid: Sequence[float] = DCC_B,
) -> DataFrame:
    """Log-likelihood of every parameter pair with ``a + b < 0.99``; all run in parallel."""
    grid = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
            for a in a_grid
            for b in b_grid
            if a + b < 0.99
        ]
    )
    df = pairs.select(TIME, *PAIR, "x", "y", F.inline(grid))
    keys = ("a", "b", *PAIR)
    df = _dcc_feed(df, F.col("a"), F.col("b"), keys)
    df = decayed_sum(df, {"q": F.col("_feed")}, F.col("b"), keys)
    corr = to_correlation(df.select("a", "b", TIME, *PAIR, "x", "q"), "q", "corr", "a", "b")
    order = series_pairs(series, diagonal=True)

    def cell(i: str, j: str, c: str) -> Column:
        return F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col(c)))

    per_date = corr.groupBy("a", "b", TIME).agg(
        F.array(*[cell(i, j, "corr") for i, j in order]).alias("r"),
        F.array(*[cell(i, i, "x") for i in series]).alias("e"),
    )
    k = len(series)
    upper = np.triu_indices(k)

    @F.pandas_udf("double")
    def term(r: pd.Series, e: pd.Series) -> pd.Series:
        vals, es = np.array(r.tolist(), float), np.array(e.tolist(), float)
        mats = np.zeros((len(vals), k, k))
        mats[:, upper[0], upper[1]] = vals
        mats[:, upper[1], upper[0]] = vals
        sign, logdet = np.linalg.slogdet(mats)
        # a correlation matrix that isn't positive definite rules its grid point out; it may be singular
        sound = sign > 0
        out = np.full(len(vals), -np.inf)
        es, mats = es[sound], mats[sound]
        quad = np.einsum("ni,ni->n", es, np.linalg.solve(mats, es[..., None])[..., 0])
        out[sound] = -0.5 * (logdet[sound] + quad - np.einsum("ni,ni->n", es, es))
        return pd.Series(out)

    return per_date.groupBy("a", "b").agg(F.sum(term("r", "e")).alias("loglik")).withColumn(
        "persistence", F.col("a") + F.col("b")
    )


def dcc_choice(grid: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("a", "b", "persistence", "loglik"), F.struct("loglik", "a", "b"))
    return grid.agg(best.alias("s")).select("s.*")


def next_correlation(dcc_rows: DataFrame, a: float, b: float) -> DataFrame:
    """One step ahead from the last date of every pair."""
    last = dcc_rows.groupBy(*PAIR).agg(
        F.max(TIME).alias(TIME), F.max_by(F.struct("x", "y", "q", "qbar"), TIME).alias("s")
    )
    q = (1 - a - b) * F.col("s.qbar") + a * F.col("s.x") * F.col("s.y") + b * F.col("s.q")
    return to_correlation(last.select(TIME, *PAIR, q.alias("q_next")), "q_next")


def full_correlation(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*PAIR).agg(F.corr("x", "y").alias("_c")).select(
        *PAIR, F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("_c")).alias("corr")
    )


# --- portfolio -----------------------------------------------------------------------


def _weight(weights: dict[str, float], key: str) -> Column:
    out = F.lit(None).cast("double")
    for s, v in weights.items():
        out = F.when(F.col(key) == s, F.lit(v)).otherwise(out)
    return out


def portfolio_return(panel: DataFrame, weights: dict[str, float]) -> DataFrame:
    total = sum((F.col(s) * v for s, v in weights.items()), F.lit(0.0))
    return panel.select(TIME, total.alias("portfolio_return"))


def portfolio_volatility(
    vol_pairs: DataFrame, corr: DataFrame, weights: dict[str, float], on: Sequence[str], out: str
) -> DataFrame:
    """``sqrt(w' D R D w)`` per date; ``corr`` joins on ``(i, j)`` or ``(t, i, j)``."""
    joined = vol_pairs.join(corr.select(*on, "corr"), list(on))
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    part = twice * _weight(weights, "i") * _weight(weights, "j") * F.col("x") * F.col("y")
    var = F.sum(part * F.col("corr"))
    return joined.groupBy(TIME).agg(F.sqrt(F.greatest(var, F.lit(1e-12))).alias(out))


def with_var(df: DataFrame, vol: str, alphas: Sequence[float] = (0.05, 0.01)) -> DataFrame:
    """Gaussian value at risk and expected shortfall, one row per tail level."""
    cells = []
    for a in alphas:
        z = NORMAL_QUANTILE[a]
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        cells.append(
            F.struct(
                F.lit(a).alias("alpha"), F.lit(z).alias("_z"), F.lit(-density / a).alias("_t")
            )
        )
    out = df.select("*", F.inline(F.array(*cells)))
    return out.withColumns(
        {"var": F.col("_z") * F.col(vol), "cvar": F.col("_t") * F.col(vol)}
    ).drop("_z", "_t")


def series_var_rows(vols: DataFrame, vol: str, test_rows: int = 500) -> DataFrame:
    """Test tail per series: return against the tail level from yesterday's volatility."""
    df = vols.withColumn("daily_vol", lag(F.sqrt(F.greatest(F.pow(vol, F.lit(2.0)), F.lit(1e-12)) / YEAR)))
    df = df.filter(F.col("log_return").isNotNull() & F.col("daily_vol").isNotNull())
    back = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME)))
    df = df.withColumn("_back", back).filter(F.col("_back") <= test_rows)
    df = with_var(df.select(KEY, TIME, F.col("log_return").alias("actual"), "daily_vol"), "daily_vol")
    return df.withColumn("violation", (F.col("actual") < F.col("var")).cast("int"))


def var_backtest(rows: DataFrame, key: str = KEY) -> DataFrame:
    """Violations, both tests and mean tail levels per key and tail level."""
    keys = [key, "alpha"]
    level = rows.groupBy(*keys).agg(F.avg("var").alias("mean_var"), F.avg("cvar").alias("mean_cvar"))
    return (
        kupiec(rows, keys)
        .join(christoffersen(rows, keys).select(*keys, "p_ind", "independent"), keys)
        .join(level, keys)
    )


def diversification(
    vols: DataFrame, weights: dict[str, float], dcc_vol: DataFrame, ccc_vol: DataFrame
) -> DataFrame:
    """Weighted sum of single volatilities against the portfolio's."""
    total = vols.withColumn("_w", _weight(weights, KEY)).groupBy(TIME).agg(
        F.sum(F.col("_w") * F.col("ewma_vol")).alias("weighted_sum_vol")
    )
    out = dcc_vol.join(total, TIME).join(ccc_vol, TIME)
    return out.withColumn(
        "diversification_benefit", F.col("weighted_sum_vol") - F.col("port_vol_dcc")
    )


def extreme_dates(panel: DataFrame, series: Sequence[str], corr: DataFrame) -> DataFrame:
    """Correlation matrix of the calmest and the most stressed date by total absolute return."""
    stress = sum((F.abs(F.col(s)) for s in series), F.lit(0.0))
    dates = panel.join(corr.select(TIME).distinct(), TIME, "left_semi").agg(
        F.min_by(TIME, stress).alias("calm"), F.max_by(TIME, stress).alias("stressed")
    )
    picked = dates.select(
        F.inline(
            F.array(
                F.struct(F.lit("calm").alias("kind"), F.col("calm").alias(TIME)),
                F.struct(F.lit("stressed").alias("kind"), F.col("stressed").alias(TIME)),
            )
        )
    )
    return corr.join(picked, TIME).select("kind", TIME, *PAIR, "corr")
