"""Vector autoregression and connectedness from aggregated moments.

One row of moments per window holds everything a fit needs; the k x k algebra of many
windows runs in parallel on those rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions import linalg
from barograph.functions.windows import TIME
from barograph.operators.cross import PANEL, keyed_panel, panel_line

HORIZON = 10


def lag_names(series: Sequence[str], lags: int) -> list[str]:
    return [f"{s}_lag{k}" for k in range(1, lags + 1) for s in series]


def var_table(panel: DataFrame, series: Sequence[str], lags: int) -> DataFrame:
    """Panel rows with ``lags`` lags of every series and the row number ``pos``."""
    w = panel_line()
    df = keyed_panel(panel).withColumn("pos", F.row_number().over(w))
    return df.withColumns(
        {f"{s}_lag{k}": F.lag(s, k).over(w) for k in range(1, lags + 1) for s in series}
    )


def var_algebra(n: int, mean: np.ndarray, cov: np.ndarray, k: int, lags: int):
    """Coefficients (lags, k, k), intercepts and residual covariance (maximum likelihood)."""
    x = slice(k, k + k * lags)
    b = np.linalg.solve(cov[x, x], cov[x, :k])
    sigma = cov[:k, :k] - cov[:k, x] @ b
    coefs = b.T.reshape(k, lags, k).transpose(1, 0, 2)
    return coefs, mean[:k] - mean[x] @ b, sigma


def impulse_responses(coefs: np.ndarray, sigma: np.ndarray, steps: int) -> np.ndarray:
    """Responses (steps + 1, response, shock) to orthogonal one-deviation shocks."""
    lags, k, _ = coefs.shape
    psi = [np.eye(k)]
    for h in range(1, steps + 1):
        psi.append(sum(psi[h - j] @ coefs[j - 1] for j in range(1, min(h, lags) + 1)))
    return np.stack(psi) @ np.linalg.cholesky(sigma)


def variance_shares(coefs: np.ndarray, sigma: np.ndarray, horizon: int) -> np.ndarray:
    theta = (impulse_responses(coefs, sigma, horizon - 1) ** 2).sum(axis=0)
    return theta / theta.sum(axis=1, keepdims=True)


def var_moments(table: DataFrame, series: Sequence[str], lags: int) -> DataFrame:
    return linalg.grouped_moments(table, [PANEL], [*series, *lag_names(series, lags)])


def _names(series: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in series]), index + 1)


def var_lag_order(panel: DataFrame, series: Sequence[str], max_lags: int = 10) -> DataFrame:
    """AIC of every order up to ``max_lags`` on the common sample; the best is marked."""
    k = len(series)
    m = var_moments(var_table(panel, series, max_lags), series, max_lags)

    @F.pandas_udf("array<struct<lags:int,aic:double>>")
    def criteria(n: pd.Series, mean: pd.Series, comoment: pd.Series) -> pd.Series:
        out = []
        for count, mu, c in zip(n, mean, comoment):
            mu, cov = linalg.unpack(mu, c)
            rows = []
            for p in range(1, max_lags + 1):
                sub = slice(0, k + k * p)
                _, _, sigma = var_algebra(count, mu[sub], cov[sub, sub], k, p)
                aic = np.linalg.slogdet(sigma)[1] + 2.0 / count * (p * k * k + k)
                rows.append({"lags": p, "aic": float(aic)})
            out.append(rows)
        return pd.Series(out)

    rows = m.select(PANEL, "n", F.inline(criteria("n", "mean", "comoment")))
    best = F.row_number().over(Window.partitionBy(PANEL).orderBy("aic", "lags")) == 1
    return rows.withColumn("is_best", best)


def var_coefficients(panel: DataFrame, series: Sequence[str], lags: int) -> DataFrame:
    """Rows ``(equation, regressor, lag, coef)``; the constant has lag 0."""
    k = len(series)
    m = var_moments(var_table(panel, series, lags), series, lags)

    @F.pandas_udf("array<struct<i:int,j:int,lag:int,coef:double>>")
    def solve(n: pd.Series, mean: pd.Series, comoment: pd.Series) -> pd.Series:
        out = []
        for count, mu, c in zip(n, mean, comoment):
            mu, cov = linalg.unpack(mu, c)
            coefs, const, _ = var_algebra(count, mu, cov, k, lags)
            rows = [{"i": i, "j": -1, "lag": 0, "coef": float(const[i])} for i in range(k)]
            rows += [
                {"i": i, "j": j, "lag": p + 1, "coef": float(coefs[p, i, j])}
                for p in range(lags) for i in range(k) for j in range(k)
            ]
            out.append(rows)
        return pd.Series(out)

    rows = m.select("n", F.inline(solve("n", "mean", "comoment")))
    return rows.select(
        _names(series, F.col("i")).alias("equation"),
        F.when(F.col("lag") == 0, "const").otherwise(_names(series, F.greatest("j", F.lit(0)))).alias("regressor"),
        "lag", "coef", "n",
    )


def irf(panel: DataFrame, series: Sequence[str], lags: int, steps: int = 20) -> DataFrame:
    """Orthogonal impulse responses ``(response, shock, period, irf)``."""
    k = len(series)
    m = var_moments(var_table(panel, series, lags), series, lags)

    @F.pandas_udf("array<struct<i:int,j:int,period:int,irf:double>>")
    def respond(n: pd.Series, mean: pd.Series, comoment: pd.Series) -> pd.Series:
        out = []
        for count, mu, c in zip(n, mean, comoment):
            mu, cov = linalg.unpack(mu, c)
            coefs, _, sigma = var_algebra(count, mu, cov, k, lags)
            sigma = sigma * count / (count - k * lags - 1)
            r = impulse_responses(coefs, sigma, steps)
            out.append(
                [
                    {"i": i, "j": j, "period": h, "irf": float(r[h, i, j])}
                    for h in range(steps + 1) for i in range(k) for j in range(k)
                ]
            )
        return pd.Series(out)

    rows = m.select(F.inline(respond("n", "mean", "comoment")))
    return rows.select(
        _names(series, F.col("i")).alias("response"), _names(series, F.col("j")).alias("shock"), "period", "irf"
    )


def _shares(k: int, lags: int, horizon: int, alone: bool = False):
    """Shares of a fit; where there is none they are null, or with ``alone`` each series explains itself equally."""

    @F.pandas_udf("array<struct<i:int,j:int,share:double>>")
    def shares(n: pd.Series, mean: pd.Series, comoment: pd.Series) -> pd.Series:
        out = []
        for count, mu, c in zip(n, mean, comoment):
            try:
                if count < (lags + 1) * k + 10 - lags:
                    raise np.linalg.LinAlgError("window too short")
                mu, cov = linalg.unpack(mu, c)
                coefs, _, sigma = var_algebra(count, mu, cov, k, lags)
                s = variance_shares(coefs, sigma, horizon)
            except np.linalg.LinAlgError:
                s = np.eye(k) / k if alone else None
            out.append(
                [{"i": i, "j": j, "share": None if s is None else float(s[i, j])} for i in range(k) for j in range(k)]
            )
        return pd.Series(out)

    return shares


def fevd(panel: DataFrame, series: Sequence[str], lags: int, horizon: int = HORIZON) -> DataFrame:
    """Shares ``(i, j, share)`` of the forecast error variance of i due to shocks in j."""
    m = var_moments(var_table(panel, series, lags), series, lags)
    rows = m.select(F.inline(_shares(len(series), lags, horizon)("n", "mean", "comoment")))
    return rows.select(
        _names(series, F.col("i")).alias("i"), _names(series, F.col("j")).alias("j"), "share"
    )


def connectedness(shares: DataFrame, *keys: str) -> DataFrame:
    """FROM, TO and NET of every series after each row of shares is scaled to one."""
    row = Window.partitionBy(*keys, "i") if keys else Window.partitionBy("i")
    scaled = shares.withColumn("s", F.col("share") / F.greatest(F.sum("share").over(row), F.lit(1e-10)))
    off = F.when(F.col("i") != F.col("j"), F.col("s")).otherwise(0.0)
    received = scaled.groupBy(*keys, F.col("i").alias("series")).agg(F.sum(off).alias("from_others"))
    sent = scaled.groupBy(*keys, F.col("j").alias("series")).agg(F.sum(off).alias("to_others"))
    out = received.join(sent, [*keys, "series"])
    return out.withColumn("net", F.col("to_others") - F.col("from_others"))


def total_connectedness(shares: DataFrame, *keys: str) -> DataFrame:
    """Off-diagonal shares over the number of series."""
    off = F.sum(F.when(F.col("i") != F.col("j"), F.col("share")).otherwise(0.0))
    return shares.groupBy(*keys).agg((off / F.count_distinct("i")).alias("tci"))


def rolling_shares(
    panel: DataFrame, series: Sequence[str], window: int = 252, step: int = 21, horizon: int = HORIZON
) -> DataFrame:
    """One-lag variance shares over every ``window`` rows, moved by ``step``, labelled by the last date.

    Block sums of ``step`` rows are added over the window. The first row of a window gives
    its lag only, so head rows of blocks are summed apart and the oldest head is left out.
    """
    if window % step:
        raise ValueError("window must be a multiple of step")
    k, blocks = len(series), window // step
    cols = [*series, *lag_names(series, 1)]
    rows = var_table(panel, series, 1).withColumns(
        {"block": F.floor((F.col("pos") - 1) / step), "_head": (F.col("pos") - 1) % step == 0}
    )
    centre = rows.groupBy(PANEL).agg(*[F.avg(s).alias(f"_c_{s}") for s in series])
    rows = rows.join(centre, PANEL)
    dev = {c: F.coalesce(F.col(c) - F.col(f"_c_{c.rsplit('_lag', 1)[0]}"), F.lit(0.0)) for c in cols}
    rows = rows.select(
        PANEL, TIME, "block", "_head", F.count(F.lit(1)).over(Window.partitionBy(PANEL)).alias("_rows"),
        *[d.alias(f"_d{i}") for i, d in enumerate(dev.values())],
        *[F.col(f"_c_{s}") for s in series],
    )
    pairs = linalg.triangle(len(cols))
    terms = {"n": F.lit(1.0)}
    terms.update({f"s{i}": F.col(f"_d{i}") for i in range(len(cols))})
    terms.update({f"p{i}_{j}": F.col(f"_d{i}") * F.col(f"_d{j}") for i, j in pairs})
    sums = rows.groupBy(PANEL, "block").agg(
        F.max(TIME).alias(TIME),
        F.max("_rows").alias("_rows"),
        *[F.max(f"_c_{s}").alias(f"_c_{s}") for s in series],
        *[F.sum(F.when(F.col("_head"), 0.0).otherwise(e)).alias(f"_body_{t}") for t, e in terms.items()],
        *[F.sum(F.when(F.col("_head"), e).otherwise(0.0)).alias(f"_head_{t}") for t, e in terms.items()],
    )
    w = Window.partitionBy(PANEL).orderBy("block")
    body, head = w.rowsBetween(-(blocks - 1), 0), w.rowsBetween(-(blocks - 2), 0)
    run = sums.select(
        PANEL, TIME, "block", "_rows", *[F.col(f"_c_{s}") for s in series],
        *[(F.sum(f"_body_{t}").over(body) + F.sum(f"_head_{t}").over(head)).alias(t) for t in terms],
    ).filter(
        (F.col("block") >= blocks - 1) & ((F.col("block") + 1) * step < F.col("_rows"))
    )
    n = F.col("n")
    centres = [F.col(f"_c_{c.rsplit('_lag', 1)[0]}") for c in cols]
    mean = F.array(*[c + F.col(f"s{i}") / n for i, c in enumerate(centres)])
    com = F.array(
        *[F.col(f"p{i}_{j}") / n - F.col(f"s{i}") / n * F.col(f"s{j}") / n for i, j in pairs]
    )
    out = run.select(TIME, F.inline(_shares(k, 1, horizon, alone=True)(n.cast("bigint"), mean, com)))
    return out.select(
        TIME, _names(series, F.col("i")).alias("i"), _names(series, F.col("j")).alias("j"), "share"
    )


def rolling_connectedness(shares: DataFrame) -> DataFrame:
    """Date by series rows with the total index of the date."""
    return connectedness(shares, TIME).join(total_connectedness(shares, TIME), TIME)
