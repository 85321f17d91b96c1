"""Regression from grouped moments.

Rows never travel to Python. Spark aggregates means and co-moments per key (combined
map-side, so one huge key costs no more than many small ones), and an Arrow UDF solves
the small k x k system on one row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_SCHEMA = (
    "struct<coef:array<double>,beta:array<double>,se:array<double>,intercept:double,"
    "rss:double,tss:double,r2:double,n:bigint>"
)


def triangle(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _quoted(name: str) -> str:
    return f"`{name}`"


def grouped_moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``n``, ``mean`` and ``comoment`` (population covariances, upper triangle) per key.

    Rows with a null in any of ``columns`` are left out of every moment. One map-side
    combined pass over plain product sums: a sum keeps one number per pair where a
    covariance aggregate keeps four, and wide tables have hundreds of pairs. About
    ``16 - 2 log10(mean / deviation)`` digits remain, so centre a column first when its
    mean is thousands of deviations.
    """
    complete = df.dropna("any", subset=list(columns))
    names = [_quoted(c) for c in columns]
    pairs = triangle(len(columns))
    sums = ", ".join(f"sum({c})" for c in names)
    products = ", ".join(f"sum({names[i]} * {names[j]})" for i, j in pairs)
    agg = complete.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"array({sums})").alias("_s"),
        F.expr(f"array({products})").alias("_p"),
    )
    left = ", ".join(str(i) for i, _ in pairs)
    right = ", ".join(str(j) for _, j in pairs)
    return agg.select(*keys, "n", F.expr("transform(_s, s -> s / n)").alias("mean"), "_p").select(
        *keys,
        "n",
        "mean",
        F.expr(
            f"transform(sequence(0, {len(pairs) - 1}), k -> "
            f"_p[k] / n - mean[array({left})[k]] * mean[array({right})[k]])"
        ).alias("comoment"),
    )


def running_moments(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    columns: Sequence[str],
    frame_blocks: int | None = None,
) -> DataFrame:
    """Moments of every expanding (or last ``frame_blocks``) run of blocks, one row per block.

    Each row is read once: block sums first, then a running sum over blocks. Values are
    centred on the key mean before they are squared, to keep the sums well conditioned.
    """
    complete = df.dropna("any", subset=list(columns))
    pairs = triangle(len(columns))
    centre = complete.groupBy(*keys).agg(*[F.avg(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    spots = range(len(columns))
    shifted = complete.join(centre, list(keys)).select(
        *keys,
        block,
        *[F.col(f"_c{i}") for i in spots],
        *[F.expr(f"{_quoted(c)} - _c{i} AS _d{i}") for i, c in enumerate(columns)],
    )
    sums = shifted.groupBy(*keys, block).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.expr(f"first(_c{i}) AS _c{i}") for i in spots],
        *[F.expr(f"sum(_d{i}) AS _s{i}") for i in spots],
        *[F.expr(f"sum(_d{i} * _d{j}) AS _p{i}_{j}") for i, j in pairs],
    )
    part, order = ", ".join(_quoted(k) for k in keys), _quoted(block)
    start = "UNBOUNDED" if frame_blocks is None else str(frame_blocks - 1)
    over = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {start} PRECEDING AND CURRENT ROW)"
    run = sums.selectExpr(
        *[_quoted(k) for k in keys],
        order,
        f"sum(_n) {over} AS n",
        *[f"_c{i}" for i in spots],
        *[f"sum(_s{i}) {over} AS _s{i}" for i in spots],
        *[f"sum(_p{i}_{j}) {over} AS _p{i}_{j}" for i, j in pairs],
    )
    mean = ", ".join(f"_c{i} + _s{i} / n" for i in spots)
    comoment = ", ".join(f"_p{i}_{j} / n - (_s{i} / n) * (_s{j} / n)" for i, j in pairs)
    return run.selectExpr(
        *[_quoted(k) for k in keys], order, "n", f"array({mean}) AS mean", f"array({comoment}) AS comoment"
    )


def unpack(mean: np.ndarray, comoment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = np.asarray(mean, float)
    k = len(mean)
    cov = np.zeros((k, k))
    cov[np.triu_indices(k)] = np.asarray(comoment, float)
    return mean, cov + np.triu(cov, 1).T


def pooled(parts: Sequence[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of several blocks together, from ``(n, mean, covariance)`` of each."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    cov = sum(p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts) / n
    return n, mean, cov


def solve_fit(
    n: int, mean: np.ndarray, cov: np.ndarray, xs: Sequence[int], y: int, alpha: float, scaled: bool
) -> dict:
    """Ridge (``alpha`` 0: least squares) with a free intercept, from moments."""
    xs = list(xs)
    sxx = cov[np.ix_(xs, xs)] * n
    sxy = cov[xs, y] * n
    sd = np.sqrt(np.maximum(np.diag(sxx) / n, 0.0)) if scaled else np.ones(len(xs))
    sd = np.where(sd > 0, sd, 1.0)
    a = sxx / np.outer(sd, sd) + alpha * np.eye(len(xs))
    b = sxy / sd
    try:
        w = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        w = np.linalg.lstsq(a, b, rcond=None)[0]
    beta = w / sd
    tss = float(cov[y, y] * n)
    rss = float(tss - 2 * beta @ sxy + beta @ sxx @ beta)
    dof = n - len(xs) - 1
    se = np.full(len(xs), np.nan)
    if alpha == 0 and dof > 0:
        with np.errstate(invalid="ignore"):
            se = np.sqrt(np.diag(np.linalg.pinv(sxx)) * max(rss, 0.0) / dof)
    return {
        "coef": w.tolist(),
        "beta": beta.tolist(),
        "se": se.tolist(),
        "intercept": float(mean[y] - beta @ mean[xs]),
        "rss": rss,
        "tss": tss,
        "r2": 1.0 - rss / tss if tss > 0 else None,
        "n": int(n),
    }


def fit_column(
    n: Column, mean: Column, comoment: Column, xs: Sequence[int], y: int,
    alpha: float = 0.0, scaled: bool = False,
) -> Column:
    """Fit ``y`` on ``xs`` (positions in the moment columns) for every row of moments."""
    xs = list(xs)

    @F.pandas_udf(FIT_SCHEMA)
    def fit(n: pd.Series, mean: pd.Series, comoment: pd.Series) -> pd.DataFrame:
        rows = []
        for count, m, c in zip(n, mean, comoment):
            mu, cov = unpack(m, c)
            rows.append(solve_fit(count, mu, cov, xs, y, alpha, scaled))
        return pd.DataFrame(
            rows, columns=["coef", "beta", "se", "intercept", "rss", "tss", "r2", "n"]
        )

    return fit(n, mean, comoment)


def fit(
    moments: DataFrame, columns: Sequence[str], xs: Sequence[str], y: str,
    alpha: float = 0.0, scaled: bool = False, out: str = "fit",
) -> DataFrame:
    at = {c: i for i, c in enumerate(columns)}
    return moments.withColumn(
        out,
        fit_column(
            F.col("n"), F.col("mean"), F.col("comoment"), [at[x] for x in xs], at[y], alpha, scaled
        ),
    )


def fit_many(
    moments: DataFrame, columns: Sequence[str], specs: dict[str, tuple[Sequence[str], float, bool]], y: str
) -> DataFrame:
    """One row per moment row and named ``(features, alpha, scaled)``: columns ``model``, ``fit``."""
    at = {c: i for i, c in enumerate(columns)}
    jobs = [(name, [at[x] for x in xs], alpha, scaled) for name, (xs, alpha, scaled) in specs.items()]
    target = at[y]

    @F.pandas_udf(f"array<struct<model:string,fit:{FIT_SCHEMA}>>")
    def fits(n: pd.Series, mean: pd.Series, comoment: pd.Series) -> pd.Series:
        out = []
        for count, m, c in zip(n, mean, comoment):
            mu, cov = unpack(m, c)
            out.append(
                [
                    {"model": name, "fit": solve_fit(count, mu, cov, xs, target, alpha, scaled)}
                    for name, xs, alpha, scaled in jobs
                ]
            )
        return pd.Series(out)

    keep = [c for c in moments.columns if c not in ("mean", "comoment")]
    return moments.select(*keep, "mean", F.inline(fits("n", "mean", "comoment")))


def masked_fit_column(
    n: Column, mean: Column, comoment: Column, used: Column, base: Sequence[int],
    extra: Sequence[int], y: int,
) -> Column:
    """Least squares on ``base`` plus the first ``used`` of ``extra``, chosen per row."""
    base, extra = list(base), list(extra)

    @F.pandas_udf(FIT_SCHEMA)
    def fit(n: pd.Series, mean: pd.Series, comoment: pd.Series, used: pd.Series) -> pd.DataFrame:
        rows = []
        for count, m, c, k in zip(n, mean, comoment, used):
            mu, cov = unpack(m, c)
            rows.append(solve_fit(count, mu, cov, base + extra[: int(k)], y, 0.0, False))
        return pd.DataFrame(
            rows, columns=["coef", "beta", "se", "intercept", "rss", "tss", "r2", "n"]
        )

    return fit(n, mean, comoment, used)


def linear_score(fit_col: str, xs: Sequence[str]) -> Column:
    """Prediction column of a fit joined to feature rows."""
    total = F.col(f"{fit_col}.intercept")
    for i, x in enumerate(xs):
        total = total + F.col(f"{fit_col}.beta")[i] * F.col(x)
    return total
