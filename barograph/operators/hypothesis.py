"""Statistical tests on series, losses and violations.

Every test reduces to aggregates per key; only tails without a closed form and small
solves touch Arrow, on one row per test.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions import linalg
from barograph.functions.special import (
    chi2_tail_1,
    chi2_tail_3,
    chi2_tail_even_odd,
    f_tail,
    t_tail2,
)
from barograph.functions.windows import KEY, TIME, by_series, correlation, lag, lead, trailing, whole_series
from barograph.sources.bars import panel_pairs

# --- stationarity --------------------------------------------------------------------

# MacKinnon (2010) critical values of the unit-root t test with a constant,
# as b0 + b1/T + b2/T^2 + b3/T^3.
ADF_CRITICAL = {
    "crit_1pct": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5pct": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10pct": (-2.56677, -1.5384, -2.809, 0.0),
}


def _adf_columns(df: DataFrame, value: str, lags: int, *keys: str) -> DataFrame:
    w = by_series(KEY, *keys)
    df = df.filter(F.col(value).isNotNull())
    df = df.withColumns(
        {
            "_level": F.lag(value).over(w),
            "_diff": F.col(value) - F.lag(value).over(w),
            "_row": F.row_number().over(w),
        }
    )
    return df.withColumns({f"_diff{k}": F.lag("_diff", k).over(w) for k in range(1, lags + 1)})


def _adf_result(fitted: DataFrame, *keys: str) -> DataFrame:
    n = F.col("fit.n").cast("double")
    crit = {
        name: F.lit(b[0]) + F.lit(b[1]) / n + F.lit(b[2]) / (n * n) + F.lit(b[3]) / (n * n * n)
        for name, b in ADF_CRITICAL.items()
    }
    out = fitted.select(
        KEY,
        *keys,
        (F.col("fit.beta")[0] / F.col("fit.se")[0]).alias("statistic"),
        "used",
        F.col("fit.n").alias("nobs"),
        *[c.alias(k) for k, c in crit.items()],
        *(["icbest"] if "icbest" in fitted.columns else []),
    )
    return out.withColumn("stationary", F.col("statistic") < F.col("crit_5pct"))


def adf_fixed(df: DataFrame, value: str, lags: int, *keys: str) -> DataFrame:
    """Augmented Dickey-Fuller statistic with a constant and a given number of lags."""
    cols = ["_level", *[f"_diff{k}" for k in range(1, lags + 1)], "_diff"]
    rows = _adf_columns(df, value, lags, *keys)
    m = linalg.grouped_moments(rows, [KEY, *keys], cols)
    m = linalg.fit(m, cols, cols[:-1], "_diff").withColumn("used", F.lit(lags))
    return _adf_result(m, *keys)


def adf(df: DataFrame, value: str, max_lag: int = 10, *keys: str) -> DataFrame:
    """Augmented Dickey-Fuller test with the lag length chosen by AIC.

    All lag lengths are compared on the common sample from one moment matrix (nested
    blocks), then the chosen model is fitted again on every row it can use.
    """
    diffs = [f"_diff{k}" for k in range(1, max_lag + 1)]
    cols = ["_level", *diffs, "_diff"]
    rows = _adf_columns(df, value, max_lag, *keys)
    y = len(cols) - 1

    @F.pandas_udf("struct<used:int,icbest:double>")
    def choose(n: pd.Series, mean: pd.Series, comoment: pd.Series) -> pd.DataFrame:
        out = []
        for count, m, c in zip(n, mean, comoment):
            mu, cov = linalg.unpack(m, c)
            best = (np.inf, 0)
            for k in range(max_lag + 1):
                rss = linalg.solve_fit(count, mu, cov, range(k + 1), y, 0.0, False)["rss"]
                aic = count * (np.log(2 * np.pi * max(rss, 1e-300) / count) + 1) + 2 * (k + 2)
                best = min(best, (aic, k))
            out.append({"used": best[1], "icbest": best[0]})
        return pd.DataFrame(out, columns=["used", "icbest"])

    common = linalg.grouped_moments(rows, [KEY, *keys], cols)
    chosen = common.select(KEY, *keys, choose("n", "mean", "comoment").alias("c")).select(
        KEY, *keys, "c.*"
    )
    again = rows.join(chosen, [KEY, *keys]).filter(F.col("_row") >= F.col("used") + 2)
    masked = again.withColumns(
        {
            d: F.when(F.col("used") >= k, F.col(d)).otherwise(0.0)
            for k, d in enumerate(diffs, start=1)
        }
    )
    final = linalg.grouped_moments(masked, [KEY, *keys, "used", "icbest"], cols).withColumn(
        "fit",
        linalg.masked_fit_column(
            F.col("n"), F.col("mean"), F.col("comoment"), F.col("used"),
            [0], range(1, max_lag + 1), y,
        ),
    )
    return _adf_result(final, *keys)


# --- autocorrelation -----------------------------------------------------------------


def acf(df: DataFrame, value: str, lags: int = 40, *keys: str) -> DataFrame:
    """Autocorrelations at lags 1..``lags`` with the 95 % band of white noise.

    One window for the lag columns and one aggregation; rows are not multiplied.
    """
    w = by_series(KEY, *keys)
    rows = df.filter(F.col(value).isNotNull())
    rows = rows.withColumn("_d", F.col(value) - F.avg(value).over(whole_series(KEY, *keys)))
    rows = rows.withColumns({f"_d{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    base = F.sum(F.col("_d") * F.col("_d"))
    wide = rows.groupBy(KEY, *keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.try_divide(F.sum(F.col("_d") * F.col(f"_d{k}")), base).alias(str(k)) for k in range(1, lags + 1)],
    )
    long = wide.unpivot([KEY, *keys, "n"], [str(k) for k in range(1, lags + 1)], "lag", "acf")
    return long.withColumns(
        {"lag": F.col("lag").cast("int"), "band": F.lit(1.96) / F.sqrt(F.col("n").cast("double"))}
    )


def ljung_box(acf_rows: DataFrame, lags: Sequence[int], *keys: str) -> DataFrame:
    """Portmanteau statistic at the given lags from autocorrelation rows."""
    w = by_series(KEY, *keys, order="lag").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("n").cast("double")
    term = F.pow("acf", F.lit(2.0)) / (n - F.col("lag"))
    df = acf_rows.withColumn("lb_stat", n * (n + 2) * F.sum(term).over(w))
    df = df.filter(F.col("lag").isin(list(lags)))
    p = F.lit(None).cast("double")
    for k in lags:
        p = F.when(F.col("lag") == k, chi2_tail_even_odd(F.col("lb_stat"), k)).otherwise(p)
    return df.select(KEY, *keys, "lag", "lb_stat", p.alias("p_value"))


def pacf(acf_rows: DataFrame, *keys: str) -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion on one ACF array per series."""
    arrays = acf_rows.groupBy(KEY, *keys).agg(
        F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("_a"), F.first("band").alias("band")
    ).withColumn("_rho", F.transform("_a", lambda s: s["acf"]))

    @F.pandas_udf("array<double>")
    def durbin_levinson(rho: pd.Series) -> pd.Series:
        out = []
        for r in rho:
            r = np.asarray(r, float)
            phi, values = np.zeros(0), []
            for k in range(1, len(r) + 1):
                top = r[k - 1] - phi @ r[:k - 1][::-1]
                last = top / (1.0 - phi @ r[: k - 1])
                phi = np.append(phi - last * phi[::-1], last)
                values.append(float(last))
            out.append(values)
        return pd.Series(out)

    return arrays.select(
        KEY, *keys, "band", F.posexplode(durbin_levinson("_rho")).alias("_k", "pacf")
    ).select(KEY, *keys, (F.col("_k") + 1).alias("lag"), "pacf", "band")


# --- forecast comparison -------------------------------------------------------------


def loss_differentials(
    predictions: DataFrame, models: Sequence[str], loss: str = "mse"
) -> DataFrame:
    """``d = loss(label1) - loss(label2)`` for the pairs of a named list of models.

    Forecasts of one date are laid side by side in one aggregation; the pairs come from the
    list, not from a self-join.
    """
    gap = F.col("actual") - F.col("pred")
    if loss not in ("mse", "mae"):
        raise ValueError(f"loss must be 'mse' or 'mae', got {loss!r}")
    cost = F.pow(gap, F.lit(2.0)) if loss == "mse" else F.abs(gap)
    wide = (
        predictions.filter(F.col("model").isin(list(models)))
        .groupBy(KEY, TIME)
        .agg(*[F.max(F.when(F.col("model") == m, cost)).alias(m) for m in models])
    )
    cells = [
        F.struct(
            F.lit(a).alias("label1"), F.lit(b).alias("label2"), (F.col(a) - F.col(b)).alias("d")
        )
        for i, a in enumerate(models)
        for b in models[i + 1 :]
    ]
    return wide.select(KEY, TIME, F.inline(F.array(*cells))).filter(F.col("d").isNotNull())


def newey_west(d: DataFrame, keys: Sequence[str], value: str = "d") -> DataFrame:
    """Mean, count and Bartlett-weighted long-run variance with ``floor(T^(1/3))`` lags.

    Each row meets the row k places before it by an equi-join on the row number, so the
    number of lags may grow with the series.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    rows = d.select(*keys, TIME, value).withColumns(
        {
            "_pos": F.row_number().over(w.orderBy(TIME)),
            "_n": F.count(F.lit(1)).over(w),
            "_c": F.col(value) - F.avg(value).over(w),
            "_mean": F.avg(value).over(w),
        }
    )
    # cbrt of a perfect cube can fall just short, hence the nudge
    rows = rows.withColumn("_lags", F.floor(F.cbrt("_n") + 1e-9).cast("int"))
    now = rows.select(*keys, "_n", "_mean", "_lags", "_pos", "_c").withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.col("_lags")))
    ).withColumn("_at", F.col("_pos") - F.col("_k"))
    before = rows.select(*keys, F.col("_pos").alias("_at"), F.col("_c").alias("_b"))
    gamma = (
        now.join(before, [*keys, "_at"])
        .groupBy(*keys, "_n", "_mean", "_lags", "_k")
        .agg(F.avg(F.col("_c") * F.col("_b")).alias("_g"))
    )
    weight = F.when(F.col("_k") == 0, 1.0).otherwise(
        2.0 * (1 - F.col("_k") / (F.col("_lags") + 1))
    )
    return gamma.groupBy(*keys).agg(
        F.first("_n").alias("n"),
        F.first("_mean").alias("mean_d"),
        F.first("_lags").alias("lags"),
        F.greatest(F.sum(weight * F.col("_g")), F.lit(1e-12)).alias("hac_var"),
    )


def diebold_mariano(d: DataFrame, horizon: int = 1) -> DataFrame:
    """Equal accuracy test with the small-sample correction; keys series, label1, label2."""
    nw = newey_west(d, [KEY, "label1", "label2"])
    n = F.col("n").cast("double")
    fix = F.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n)
    out = nw.withColumn("dm_stat", F.col("mean_d") / F.sqrt(F.col("hac_var") / n) * fix)
    out = out.withColumn("p_value", t_tail2(F.col("dm_stat"), n - 1))
    return out.withColumns(
        {
            "significant": F.col("p_value") < 0.05,
            "better_model": F.when(F.col("mean_d") > 0, F.col("label2")).otherwise(F.col("label1")),
        }
    )


def win_matrix(dm: DataFrame, models: Sequence[str]) -> DataFrame:
    """Significant wins, winner by loser, over all series."""
    loser = F.when(F.col("better_model") == F.col("label1"), F.col("label2")).otherwise(F.col("label1"))
    return (
        dm.filter("significant")
        .select(F.col("better_model").alias("winner"), loser.alias("loser"))
        .groupBy("winner")
        .pivot("loser", list(models))
        .count()
        .na.fill(0)
    )


def p_value_matrix(dm: DataFrame, models: Sequence[str]) -> DataFrame:
    """Symmetric matrix of p-values per series, 1 on the diagonal."""
    both = F.array(
        F.struct(F.col("label1").alias("a"), F.col("label2").alias("b")),
        F.struct(F.col("label2").alias("a"), F.col("label1").alias("b")),
    )
    wide = dm.select(KEY, "p_value", F.inline(both)).groupBy(KEY, F.col("a").alias("model")).pivot("b", list(models)).agg(F.first("p_value"))
    return wide.withColumns(
        {m: F.when(F.col("model") == m, 1.0).otherwise(F.col(m)) for m in models}
    )


def loss_t_test(d: DataFrame) -> DataFrame:
    """One-sample t test of a zero mean loss differential."""
    out = d.groupBy(KEY, "label1", "label2").agg(
        F.count("d").alias("n"),
        F.avg("d").alias("mean_d"),
        (F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("d").cast("double")))).alias("t_stat"),
    )
    out = out.withColumn("p_value", t_tail2(F.col("t_stat"), F.col("n") - 1))
    return out.withColumns(
        {
            "significant": F.col("p_value") < 0.05,
            "better_model": F.when(F.col("t_stat") > 0, F.col("label2")).otherwise(F.col("label1")),
        }
    )


# --- leverage ------------------------------------------------------------------------


def lagged_correlations(df: DataFrame, lags: Sequence[int] = (1, 2, 3, 5, 10, 21)) -> DataFrame:
    """Correlation of the variance with the return, its square and size ``lag`` rows before."""
    lagged = df.withColumns({f"_r{k}": lag("log_return", k) for k in lags})
    wide = lagged.groupBy(KEY).agg(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("lag"),
                    F.corr("rv", f"_r{k}").alias("corr_r_rv"),
                    F.corr(F.col("rv"), F.pow(f"_r{k}", F.lit(2.0))).alias("corr_r2_rv"),
                    F.corr(F.col("rv"), F.abs(f"_r{k}")).alias("corr_abs_rv"),
                    F.count(F.when(F.col("rv").isNotNull(), F.col(f"_r{k}"))).alias("n"),
                )
                for k in lags
            ]
        ).alias("_rows")
    )
    out = wide.select(KEY, F.inline("_rows"))
    r = F.col("corr_r_rv")
    t = r * F.sqrt(F.col("n").cast("double") - 2) / F.sqrt(F.nullif(1 - r * r, F.lit(0.0)))
    return out.withColumn("tstat_r_rv", F.when(F.abs(r) < 1, t))


def asymmetric_regression(df: DataFrame, lags: Sequence[int] = (1, 5, 21)) -> DataFrame:
    """Next variance on the positive and negative part of a lagged return.

    The contrast variance uses the uncentred cross-products of the two parts.
    """
    next_rv = lead("rv")
    parts = []
    for k in lags:
        r = lag("log_return", k)
        parts.append(
            F.struct(
                F.lit(k).alias("lag"),
                F.when(r.isNotNull(), F.greatest(r, F.lit(0.0))).alias("r_pos"),
                F.when(r.isNotNull(), F.least(r, F.lit(0.0))).alias("r_neg"),
                next_rv.alias("rv_next"),
            )
        )
    rows = df.select(KEY, F.array(*parts).alias("_p")).select(KEY, F.inline("_p"))
    cols = ["r_pos", "r_neg", "rv_next"]
    m = linalg.fit(linalg.grouped_moments(rows, [KEY, "lag"], cols), cols, cols[:2], "rv_next")
    n = F.col("n").cast("double")
    mean, c = F.col("mean"), F.col("comoment")
    pp = n * (c[0] + mean[0] * mean[0])
    nn = n * (c[3] + mean[1] * mean[1])
    pn = n * (c[1] + mean[0] * mean[1])
    det = pp * nn - pn * pn
    contrast = F.col("fit.rss") / (n - 3) * (pp + nn + 2 * pn) / F.nullif(det, F.lit(0.0))
    b_pos, b_neg = F.col("fit.beta")[0], F.col("fit.beta")[1]
    out = m.select(
        KEY,
        "lag",
        "n",
        b_pos.alias("beta_pos"),
        b_neg.alias("beta_neg"),
        (b_neg - b_pos).alias("asymmetry"),
        ((b_pos - b_neg) / F.sqrt(F.greatest(contrast, F.lit(1e-20)))).alias("t_asym"),
        F.col("fit.r2").alias("r2"),
    )
    out = out.withColumn("p_asym", t_tail2(F.col("t_asym"), F.col("n") - 3))
    return out.withColumn(
        "leverage_confirmed", (F.col("beta_neg") < F.col("beta_pos")) & (F.col("p_asym") < 0.05)
    )


def sign_bias_table(df: DataFrame, window: int = 21, min_rows: int = 10) -> DataFrame:
    """Squared standardised return with the sign terms of the one before."""
    eps = F.try_divide(F.col("log_return"), trailing(F.stddev_samp, "log_return", window, min_rows))
    rows = df.withColumn("_e", eps).filter(F.col("_e").isNotNull())
    rows = rows.withColumn("_l", lag("_e")).filter(F.col("_l").isNotNull())
    below = F.when(F.col("_l") < 0, 1.0).otherwise(0.0)
    return rows.select(
        KEY,
        TIME,
        F.pow("_e", F.lit(2.0)).alias("eps_sq"),
        below.alias("s_neg"),
        (below * F.col("_l")).alias("neg_int"),
        ((1 - below) * F.col("_l")).alias("pos_int"),
    )


def sign_bias_test(df: DataFrame) -> DataFrame:
    cols = ["s_neg", "neg_int", "pos_int", "eps_sq"]
    m = linalg.grouped_moments(sign_bias_table(df), [KEY], cols)
    m = linalg.fit(m, cols, cols[:3], "eps_sq")
    out = m.select(
        KEY,
        "n",
        (F.col("n") * F.col("fit.r2")).alias("lm_stat"),
        *[F.col("fit.beta")[i].alias(f"coef_{c}") for i, c in enumerate(cols[:3])],
    )
    out = out.withColumn("p_value", chi2_tail_3(F.col("lm_stat")))
    return out.withColumn("reject_symmetry", F.col("p_value") < 0.05)


# --- Granger -------------------------------------------------------------------------


def _granger_rows(panel: DataFrame, pairs: Sequence[tuple[str, str]], max_lag: int) -> DataFrame:
    """Rows per (cause, effect) with lags of both, ``y`` the effect and ``x`` the cause."""
    long = panel_pairs(panel, pairs).select(
        F.col("i").alias("cause"), F.col("j").alias("effect"), TIME,
        F.col("x"), F.col("y"),
    )
    w = Window.partitionBy("cause", "effect").orderBy(TIME)
    long = long.withColumn("_pos", F.row_number().over(w))
    return long.withColumns(
        {
            **{f"y{k}": F.lag("y", k).over(w) for k in range(1, max_lag + 1)},
            **{f"x{k}": F.lag("x", k).over(w) for k in range(1, max_lag + 1)},
        }
    )


def granger_fits(
    panel: DataFrame, pairs: Sequence[tuple[str, str]], max_lag: int = 5
) -> DataFrame:
    """Restricted and unrestricted fits for every pair and lag order, each on its own sample."""
    rows = _granger_rows(panel, pairs, max_lag)
    ys = [f"y{k}" for k in range(1, max_lag + 1)]
    xs = [f"x{k}" for k in range(1, max_lag + 1)]
    by_lag = rows.withColumn("n_lags", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).filter(
        F.col("_pos") > F.col("n_lags")
    )
    masked = by_lag.withColumns(
        {
            f"{c}{k}": F.when(F.col("n_lags") >= k, F.col(f"{c}{k}")).otherwise(0.0)
            for c in ("y", "x")
            for k in range(1, max_lag + 1)
        }
    )
    cols = [*ys, *xs, "y"]
    m = linalg.grouped_moments(masked, ["cause", "effect", "n_lags"], cols)

    @F.pandas_udf("struct<rss_r:double,rss_ur:double,r2_r:double,r2_ur:double>")
    def fit(n: pd.Series, mean: pd.Series, comoment: pd.Series, p: pd.Series) -> pd.DataFrame:
        out = []
        for count, mu, c, k in zip(n, mean, comoment, p):
            mu, cov = linalg.unpack(mu, c)
            own = list(range(int(k)))
            both = own + [max_lag + i for i in range(int(k))]
            r = linalg.solve_fit(count, mu, cov, own, 2 * max_lag, 0.0, False)
            u = linalg.solve_fit(count, mu, cov, both, 2 * max_lag, 0.0, False)
            out.append((r["rss"], u["rss"], r["r2"], u["r2"]))
        return pd.DataFrame(out, columns=["rss_r", "rss_ur", "r2_r", "r2_ur"])

    out = m.select(
        "cause", "effect", "n_lags", "n", fit("n", "mean", "comoment", "n_lags").alias("f")
    ).select("cause", "effect", "n_lags", "n", "f.*")
    n = F.col("n").cast("double")
    return out.withColumn(
        "aic", n * F.ln(F.col("rss_ur") / n) + 2 * (2 * F.col("n_lags") + 1)
    )


def granger_lag_choice(fits: DataFrame) -> DataFrame:
    return fits.groupBy("cause", "effect").agg(
        F.min_by("n_lags", F.struct("aic", "n_lags")).alias("best_lag"), F.min("aic").alias("best_aic")
    )


def granger_test(fits: DataFrame) -> DataFrame:
    """F test of the cause's lags at the lag order with the lowest AIC."""
    best = Window.partitionBy("cause", "effect").orderBy("aic", "n_lags")
    df = fits.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == 1).drop("_r")
    q, n = F.col("n_lags").cast("double"), F.col("n").cast("double")
    dof = n - 2 * q - 1
    stat = ((F.col("rss_r") - F.col("rss_ur")) / q) / (F.col("rss_ur") / dof)
    df = df.withColumn("f_stat", F.when(F.col("rss_ur") >= 1e-20, stat))
    df = df.withColumn("p_value", f_tail(F.col("f_stat"), q, dof))
    return df.withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def rolling_granger(
    panel: DataFrame, pairs: Sequence[tuple[str, str]], window: int = 252
) -> DataFrame:
    """One-lag Granger F over the ``window`` rows before each date.

    The first row of a window gives its lag only, so each fit uses ``window - 1`` rows and
    the two nested fits have closed forms in the window's co-moments.
    """
    rows = _granger_rows(panel, pairs, 1)
    part = "PARTITION BY cause, effect ORDER BY t"
    names = ("y", "y1", "x1")
    rows = rows.selectExpr(
        "*", *[f"{c} - avg({c}) OVER (PARTITION BY cause, effect) AS _d{i}" for i, c in enumerate(names)]
    )
    # a window sum is the difference of two running sums: a row costs the same for any window
    terms = {"_n": "CASE WHEN y1 IS NOT NULL THEN 1 ELSE 0 END"}
    full = "CASE WHEN y1 IS NOT NULL THEN {} ELSE 0 END"
    terms |= {f"_s{i}": full.format(f"_d{i}") for i in range(3)}
    terms |= {f"_p{i}{j}": full.format(f"_d{i} * _d{j}") for i, j in linalg.triangle(3)}
    rows = rows.selectExpr(
        "cause", "effect", TIME, "_pos", *[f"sum({e}) OVER ({part}) AS {c}" for c, e in terms.items()]
    )
    rows = rows.selectExpr(
        "cause", "effect", TIME, "_pos",
        *[f"lag({c}, 1) OVER ({part}) - lag({c}, {window}, 0) OVER ({part}) AS {c}" for c in terms],
    ).filter(F.col("_pos") > window)

    def co(i: int, j: int) -> str:
        return f"_p{i}{j} / _n - _s{i} / _n * _s{j} / _n"

    rows = rows.selectExpr(
        "cause", "effect", TIME, "cast(_n AS double) AS _n",
        f"{co(0, 0)} AS _yy", f"{co(1, 1)} AS _11", f"{co(2, 2)} AS _22",
        f"{co(0, 1)} AS _y1", f"{co(0, 2)} AS _y2", f"{co(1, 2)} AS _12",
    )
    zero = F.lit(0.0)
    rss_r = F.col("_yy") - F.col("_y1") * F.col("_y1") / F.nullif(F.col("_11"), zero)
    det = F.nullif(F.col("_11") * F.col("_22") - F.col("_12") * F.col("_12"), zero)
    explained = (
        F.col("_y1") * (F.col("_22") * F.col("_y1") - F.col("_12") * F.col("_y2"))
        + F.col("_y2") * (F.col("_11") * F.col("_y2") - F.col("_12") * F.col("_y1"))
    ) / det
    rss_ur = F.col("_yy") - explained
    dof = F.col("_n") - 3
    out = rows.select(
        "cause", "effect", TIME, F.col("_n").cast("bigint").alias("n"),
        (F.try_divide(rss_r - rss_ur, rss_ur) * dof).alias("f_stat"), dof.alias("_dof"),
    )
    out = out.withColumn("p_value", f_tail(F.col("f_stat"), F.lit(1.0), F.col("_dof")))
    return out.withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False))).drop("_dof")


# --- violations ----------------------------------------------------------------------


def _xlogy(x: Column, y: Column) -> Column:
    """x ln y, 0 where x is 0."""
    return F.when(x == 0, 0.0).otherwise(x * F.ln(y))


def kupiec(violations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unconditional coverage; keys must include ``alpha``, rows carry ``violation`` 0/1."""
    out = violations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("violation").alias("x")
    )
    n, x, a = F.col("n").cast("double"), F.col("x").cast("double"), F.col("alpha")
    rate = x / n
    null = _xlogy(n - x, 1 - a) + _xlogy(x, a)
    alt = _xlogy(n - x, 1 - rate) + _xlogy(x, rate)
    edge = (F.col("x") == 0) | (F.col("x") == F.col("n"))
    out = out.withColumn("lr_stat", F.when(edge, 0.0).otherwise(-2 * (null - alt)))
    return out.withColumns(
        {
            "observed_rate": rate,
            "p_value": F.when(edge, 1.0).otherwise(chi2_tail_1(F.col("lr_stat"))),
        }
    ).withColumn("well_calibrated", F.col("p_value") >= 0.05)


def christoffersen(violations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Independence of violations from the four transition counts."""
    w = Window.partitionBy(*keys).orderBy(TIME)
    rows = violations.withColumn("_b", F.lag("violation").over(w))
    out = rows.groupBy(*keys).agg(
        *[
            F.count_if((F.col("_b") == a) & (F.col("violation") == b)).alias(f"n{a}{b}")
            for a in (0, 1)
            for b in (0, 1)
        ]
    )
    c = {k: F.col(k).cast("double") for k in ("n00", "n01", "n10", "n11")}
    zero = F.lit(0.0)
    p01 = c["n01"] / F.nullif(c["n00"] + c["n01"], zero)
    p11 = c["n11"] / F.nullif(c["n10"] + c["n11"], zero)
    p = (c["n01"] + c["n11"]) / F.nullif(c["n00"] + c["n01"] + c["n10"] + c["n11"], zero)
    null = _xlogy(c["n00"] + c["n10"], 1 - p) + _xlogy(c["n01"] + c["n11"], p)
    alt = (
        _xlogy(c["n00"], 1 - p01) + _xlogy(c["n01"], p01)
        + _xlogy(c["n10"], 1 - p11) + _xlogy(c["n11"], p11)
    )
    enough = (
        (F.col("n00") + F.col("n01") > 0) & (F.col("n10") + F.col("n11") > 0)
        & (F.col("n01") > 0) & (F.col("n11") > 0)
    )
    out = out.withColumn("lr_ind", F.when(enough, -2 * (null - alt)))
    out = out.withColumn("p_ind", F.when(enough, chi2_tail_1(F.col("lr_ind"))))
    return out.withColumn("independent", F.coalesce(F.col("p_ind") >= 0.05, F.lit(True)))


# --- distributions and ranks ---------------------------------------------------------


def ks_tail(stat: Column, n1: Column, n2: Column, terms: int = 20) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    x = F.sqrt(n1 * n2 / (n1 + n2)) * stat
    total = F.lit(0.0)
    for j in range(1, terms + 1):
        total = total + (2.0 if j % 2 else -2.0) * F.exp(-2.0 * j * j * x * x)
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def ks_two_sample(rows: DataFrame, keys: Sequence[str], value: str, is_reference: str) -> DataFrame:
    """Largest gap of the two distribution functions per key.

    Equal values are counted together first, so ties step once and a repeated value costs
    one row.
    """
    keys = list(keys)
    counts = rows.groupBy(*keys, value).agg(
        F.count_if(F.col(is_reference)).alias("_r"), F.count_if(~F.col(is_reference)).alias("_c")
    )
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    counts = counts.withColumns(
        {
            "_n1": F.sum("_r").over(whole), "_n2": F.sum("_c").over(whole),
            "_c1": F.sum("_r").over(run), "_c2": F.sum("_c").over(run),
        }
    )
    gap = F.abs(F.try_divide("_c1", "_n1") - F.try_divide("_c2", "_n2"))
    out = counts.groupBy(*keys).agg(
        F.max(gap).alias("ks_stat"), F.first("_n1").alias("n_ref"), F.first("_n2").alias("n_cur")
    )
    return out.withColumn(
        "ks_pvalue",
        ks_tail(F.col("ks_stat"), F.col("n_ref").cast("double"), F.col("n_cur").cast("double")),
    )


def rank_stability(history: DataFrame, window: str, item: str, score: str) -> DataFrame:
    """Spearman correlation of the scores of adjacent windows, ties at their mean rank.

    The p-value is that of Student t with two degrees of freedom less than items; windows count
    the items scored in both.
    """
    w = Window.partitionBy(KEY, window)
    ranks = history.filter(F.col(score).isNotNull()).withColumn(
        "_rank",
        F.rank().over(w.orderBy(score))
        + (F.count(F.lit(1)).over(Window.partitionBy(KEY, window, score)) - 1) / 2,
    )
    before = Window.partitionBy(KEY, item).orderBy(window)
    pairs = ranks.withColumns(
        {"_prev": F.lag("_rank").over(before), "_pw": F.lag(window).over(before)}
    ).filter(F.col("_pw") == F.col(window) - 1)
    rho = pairs.groupBy(KEY, window).agg(
        correlation("_prev", "_rank").alias("spearman_rho"), F.count(F.lit(1)).alias("n")
    )
    stat = F.col("spearman_rho") * F.sqrt(
        F.try_divide(F.col("n") - 2, F.greatest(1 - F.col("spearman_rho") * F.col("spearman_rho"), F.lit(1e-300)))
    )
    return rho.withColumn("p_value", F.when(F.col("n") > 2, t_tail2(stat, F.col("n") - 2)))
