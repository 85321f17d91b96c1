"""Statistical tests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barograph.operators import hypothesis as hy
from barograph.operators import returns as rt
from barograph.operators import risk as rk
from barograph.plans import sqltext as sq
from barograph.plans.cross import PV, rv_panel
from barograph.plans.evaluation import MODELS, PRED, predictions
from barograph.plans.market import HAR_TABLE, _VOL, sql_r
from barograph.plans.registry import register_reusing as register
from barograph.plans.registry import shared
from barograph.plans.tables import SERIES, rets, vols
from barograph.sources.bars import series_pairs

lag, roll, W = sq.lag, sq.roll, sq.W
NAMES = tuple(MODELS)
ORDERED = series_pairs(SERIES, ordered=True)


@shared()
def stacked(s, d):
    """Returns and squared returns as two named series per key."""
    r = rets(s, d).filter(F.col("log_return").isNotNull())
    cells = F.array(
        F.struct(F.lit("r").alias("series"), F.col("log_return").alias("value")),
        F.struct(F.lit("r2").alias("series"), F.pow("log_return", F.lit(2.0)).alias("value")),
    )
    return r.select("series_id", "t", F.inline(cells))


STACK = (
    "st AS (SELECT series_id, t, 'r' AS series, log_return AS value FROM r WHERE log_return IS NOT NULL "
    "UNION ALL SELECT series_id, t, 'r2', log_return * log_return FROM r WHERE log_return IS NOT NULL)"
)
_P = "series_id, series"
_ADF_D = [f"d{k}" for k in range(1, 6)]
ADF5 = (
    STACK,
    f"a1 AS (SELECT *, {lag('value', 1, _P)} AS lv, value - {lag('value', 1, _P)} AS df FROM st)",
    "a2 AS (SELECT *, " + ", ".join(f"{lag('df', k, _P)} AS d{k}" for k in range(1, 6)) + " FROM a1)",
    *sq.ridge("a2", _P, ["lv", *_ADF_D], "df", 0, False, "fu", "d5 IS NOT NULL"),
    *sq.ridge("a2", _P, _ADF_D, "df", 0, False, "fr", "d5 IS NOT NULL"),
)
register(
    "x1_adf_fixed_lag",
    "series_id:s series:s statistic:5 used:i nobs:i crit_1pct:6 crit_5pct:6 crit_10pct:6 stationary:b",
    lambda s, d: hy.adf_fixed(stacked(s, d), "value", 5, "series"),
    sql_r(
        "SELECT *, statistic < crit_5pct AS stationary FROM (SELECT fu.series_id, fu.series, "
        "sign(fu.b0) * sqrt((fr.rss - fu.rss) / (fu.rss / (fu.n - 7))) AS statistic, 5 AS used, fu.n AS nobs, "
        + ", ".join(
            f"{b[0]} + {b[1]} / fu.n + {b[2]} / pow(fu.n, 2) + {b[3]} / pow(fu.n, 3) AS {c}"
            for c, b in hy.ADF_CRITICAL.items()
        )
        + " FROM fu JOIN fr USING (series_id, series))",
        *ADF5,
    ),
)
register(
    "x1_adf",
    "series_id:s series:s statistic:5 used:i nobs:i crit_1pct:6 crit_5pct:6 crit_10pct:6 icbest:3 stationary:b",
    lambda s, d: hy.adf(stacked(s, d), "value", 10, "series"),
)


def acf_sql(lags: int) -> tuple[str, ...]:
    return (
        STACK,
        f"ac0 AS (SELECT *, value - avg(value) OVER (PARTITION BY {_P}) AS dv FROM st)",
        "ac1 AS (SELECT *, " + ", ".join(f"{lag('dv', k, _P)} AS l{k}" for k in range(1, lags + 1)) + " FROM ac0)",
        "ac AS ("
        + " UNION ALL ".join(
            f"SELECT series_id, series, {k} AS lag, count(*) AS n, sum(dv * l{k}) / sum(dv * dv) AS acf, "
            "1.96 / sqrt(count(*)) AS band FROM ac1 GROUP BY 1, 2"
            for k in range(1, lags + 1)
        )
        + ")",
    )


def _chi2_sql(x: str, k: int) -> str:
    h = f"(greatest({x}, 0) / 2)"
    if k % 2 == 0:
        return f"exp(-{h}) * (" + " + ".join(f"pow({h}, {i}) / {math.factorial(i)}.0" for i in range(k // 2)) + ")"
    tail = " + ".join(f"pow({h}, {i - 0.5}) / {math.gamma(i + 0.5)!r}" for i in range(1, (k - 1) // 2 + 1))
    return f"{sq.chi2_1(x)}" + (f" + exp(-{h}) * ({tail})" if tail else "")


register(
    "x2_ljung_box",
    "series_id:s series:s lag:i lb_stat:4 p_value:5",
    lambda s, d: hy.ljung_box(hy.acf(stacked(s, d), "value", 20, "series"), range(1, 21), "series"),
    sql_r(
        "SELECT *, CASE " + " ".join(f"WHEN lag = {k} THEN {_chi2_sql('lb_stat', k)}" for k in range(1, 21))
        + " END AS p_value FROM (SELECT *, CAST(n AS DOUBLE) * (n + 2) * sum(acf * acf / (n - lag)) OVER "
        f"(PARTITION BY {_P} ORDER BY lag) AS lb_stat FROM ac)",
        *acf_sql(20),
    ),
)
register(
    "x3_acf",
    "series_id:s series:s lag:i n:i acf:6 band:6",
    lambda s, d: hy.acf(stacked(s, d), "value", 40, "series"),
    sql_r("SELECT * FROM ac", *acf_sql(40)),
)
def _pacf_sql(lags: int) -> tuple[str, ...]:
    """Durbin-Levinson level by level: level k has the coefficients a1..ak of its order, the last one is kept."""
    out = [
        *acf_sql(lags),
        f"pc0 AS (SELECT {_P}, any_value(band) AS band, " + ", ".join(f"max(acf) FILTER (lag = {k}) AS r{k}" for k in range(1, lags + 1))
        + f" FROM ac GROUP BY {_P})",
    ]
    fixed = ", ".join([_P, "band", *(f"r{k}" for k in range(1, lags + 1))])
    for k in range(1, lags + 1):
        top = f"r{k}" + "".join(f" - a{j} * r{k - j}" for j in range(1, k))
        bottom = "1.0" + "".join(f" - a{j} * r{j}" for j in range(1, k))
        kept = "".join(f", p{j}" for j in range(1, k))
        old = "".join(f", a{j}" for j in range(1, k))
        new = "".join(f", a{j} - p{k} * a{k - j} AS a{j}" for j in range(1, k))
        out.append(f"pb{k} AS (SELECT {fixed}{kept}{old}, ({top}) / ({bottom}) AS p{k} FROM pc{k - 1})")
        out.append(f"pc{k} AS (SELECT {fixed}{kept}, p{k}{new}, p{k} AS a{k} FROM pb{k})")
    return tuple(out)


register(
    "x4_pacf",
    "series_id:s series:s lag:i pacf:6 band:6",
    lambda s, d: hy.pacf(hy.acf(stacked(s, d), "value", 40, "series"), "series"),
    sql_r(
        " UNION ALL ".join(f"SELECT {_P}, {k} AS lag, p{k} AS pacf, band FROM pc40" for k in range(1, 41)), *_pacf_sql(40)
    ),
)


def diffs(s, d, loss="mse"):
    return hy.loss_differentials(predictions(s, d), NAMES, loss)


def _dm_ctes(loss: str = "mse") -> tuple[str, ...]:
    cost = "pow(actual - pred, 2)" if loss == "mse" else "abs(actual - pred)"
    k = "series_id, label1, label2"
    pairs = ", ".join(
        f"('{a}', '{b}')" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]
    )
    return (
        *PRED,
        f"ls AS (SELECT series_id, t, model, {cost} AS c FROM pr)",
        f"dd AS (SELECT a.series_id, a.t, label1, label2, a.c - b.c AS d FROM (VALUES {pairs}) v(label1, label2) "
        "JOIN ls a ON a.model = label1 JOIN ls b ON b.model = label2 AND a.series_id = b.series_id AND a.t = b.t)",
        f"dn AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY t) AS pos, count(*) OVER (PARTITION BY {k}) AS n, "
        f"avg(d) OVER (PARTITION BY {k}) AS md, d - avg(d) OVER (PARTITION BY {k}) AS c FROM dd)",
        "dl AS (SELECT *, CAST(floor(cbrt(n) + 1e-9) AS INTEGER) AS lags FROM dn)",
        f"dg AS (SELECT {', '.join('a.' + x for x in k.split(', '))}, a.n, a.md, a.lags, a.pos - b.pos AS k, avg(a.c * b.c) AS g "
        "FROM dl a JOIN dl b ON a.series_id = b.series_id AND a.label1 = b.label1 AND a.label2 = b.label2 "
        "AND b.pos BETWEEN a.pos - a.lags AND a.pos GROUP BY ALL)",
        f"nw AS (SELECT {k}, max(n) AS n, max(md) AS mean_d, max(lags) AS lags, greatest(sum(CASE WHEN k = 0 THEN 1.0 "
        f"ELSE 2 * (1 - CAST(k AS DOUBLE) / (lags + 1)) END * g), 1e-12) AS hac_var FROM dg GROUP BY {k})",
        "dm AS (SELECT *, CASE WHEN mean_d > 0 THEN label2 ELSE label1 END AS better_model, "
        "mean_d / sqrt(hac_var / n) * sqrt((CAST(n AS DOUBLE) - 1) / n) AS dm_stat FROM nw)",
    )


register(
    "x5_newey_west",
    "series_id:s label1:s label2:s n:i lags:i mean_d:2 hac_var:-4",
    lambda s, d: hy.newey_west(diffs(s, d), ["series_id", "label1", "label2"]),
    sql_r("SELECT * FROM nw", *_dm_ctes()),
)
# Fixed value: two-sided 5 % Student t critical value at 499 degrees of freedom.
_T499 = 1.9647293909876649
_DM = "series_id:s label1:s label2:s n:i mean_d:2 dm_stat:5 better_model:s"
register(
    "x6_diebold_mariano_mae",
    _DM,
    lambda s, d: hy.diebold_mariano(diffs(s, d, "mae")),
    sql_r("SELECT * FROM dm", *_dm_ctes("mae")),
)
register(
    "x7_all_model_pairs",
    _DM + " significant:b",
    lambda s, d: hy.diebold_mariano(diffs(s, d)),
    sql_r(f"SELECT *, n = 500 AND abs(dm_stat) > {_T499} AS significant FROM dm", *_dm_ctes()),
)
register(
    "x8_win_matrix",
    "winner:s " + " ".join(f"{m}:i" for m in NAMES),
    lambda s, d: hy.win_matrix(hy.diebold_mariano(diffs(s, d)), NAMES),
    sql_r(
        "SELECT better_model AS winner, "
        + ", ".join(f"count(*) FILTER (better_model <> '{m}' AND '{m}' IN (label1, label2)) AS \"{m}\"" for m in NAMES)
        + f" FROM dm WHERE abs(dm_stat) > {_T499} GROUP BY 1",
        *_dm_ctes(),
    ),
)
register(
    "x9_p_value_matrix",
    "series_id:s model:s " + " ".join(f"{m}:6" for m in NAMES),
    lambda s, d: hy.p_value_matrix(hy.diebold_mariano(diffs(s, d)), NAMES),
)
register(
    "x10_loss_t_test",
    "series_id:s label1:s label2:s n:i mean_d:2 t_stat:5 better_model:s",
    lambda s, d: hy.loss_t_test(diffs(s, d)),
    sql_r(
        "SELECT *, CASE WHEN t_stat > 0 THEN label2 ELSE label1 END AS better_model FROM (SELECT series_id, label1, label2, "
        "count(*) AS n, avg(d) AS mean_d, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t_stat FROM dd GROUP BY 1, 2, 3)",
        *_dm_ctes(),
    ),
)
_LAGS = (1, 2, 3, 5, 10, 21)
register(
    "x11_lagged_correlations",
    "series_id:s lag:i n:i corr_r_rv:6 corr_r2_rv:6 corr_abs_rv:6 tstat_r_rv:5",
    lambda s, d: hy.lagged_correlations(rets(s, d)),
    sql_r(
        "SELECT *, CASE WHEN abs(corr_r_rv) < 1 THEN corr_r_rv * sqrt(n - 2) / sqrt(1 - corr_r_rv * corr_r_rv) END AS tstat_r_rv FROM ("
        + " UNION ALL ".join(
            f"SELECT series_id, {k} AS lag, corr(rv, l) AS corr_r_rv, corr(rv, l * l) AS corr_r2_rv, corr(rv, abs(l)) AS corr_abs_rv, "
            f"count(CASE WHEN rv IS NOT NULL THEN l END) AS n FROM (SELECT *, {lag('log_return', k)} AS l FROM r) GROUP BY series_id"
            for k in _LAGS
        )
        + ")"
    ),
)
_AS = (
    "ag AS ("
    + " UNION ALL ".join(
        f"SELECT series_id, {k} AS lag, greatest(l, 0) AS r_pos, least(l, 0) AS r_neg, y AS rv_next FROM "
        f"(SELECT series_id, {lag('log_return', k)} AS l, {sq.lead('rv')} AS y FROM r) WHERE l IS NOT NULL AND y IS NOT NULL"
        for k in (1, 5, 21)
    )
    + ")",
    *sq.ridge("ag", "series_id, lag", ["r_pos", "r_neg"], "rv_next", 0, False, "af"),
    "aq AS (SELECT series_id, lag, sum(r_pos * r_pos) AS pp, sum(r_neg * r_neg) AS nn, sum(r_pos * r_neg) AS pn FROM ag GROUP BY 1, 2)",
)
register(
    "x12_asymmetric_regression",
    "series_id:s lag:i n:i beta_pos:4 beta_neg:4 asymmetry:4 t_asym:5 r2:6",
    lambda s, d: hy.asymmetric_regression(rets(s, d)),
    sql_r(
        "SELECT series_id, lag, n, b0 AS beta_pos, b1 AS beta_neg, b1 - b0 AS asymmetry, 1 - rss / tss AS r2, "
        "(b0 - b1) / sqrt(greatest(rss / (n - 3) * (pp + nn + 2 * pn) / (pp * nn - pn * pn), 1e-20)) AS t_asym "
        "FROM af JOIN aq USING (series_id, lag)",
        *_AS,
    ),
)
_EN = (
    f"en0 AS (SELECT *, log_return / nullif({roll('stddev_samp', 'log_return', 21, 10)}, 0) AS e FROM r)",
    f"en1 AS (SELECT *, {lag('e')} AS l FROM en0 WHERE e IS NOT NULL)",
    "en AS (SELECT series_id, t, e * e AS eps_sq, CASE WHEN l < 0 THEN 1.0 ELSE 0.0 END AS s_neg, least(l, 0) AS neg_int, "
    "greatest(l, 0) AS pos_int FROM en1 WHERE l IS NOT NULL)",
    *sq.ridge("en", "series_id", ["s_neg", "neg_int", "pos_int"], "eps_sq", 0, False, "ef"),
)
register(
    "x13_sign_bias",
    "series_id:s n:i lm_stat:5 p_value:5 reject_symmetry:b coef_s_neg:6 coef_neg_int:6 coef_pos_int:6",
    lambda s, d: hy.sign_bias_test(rets(s, d)),
    sql_r(
        "SELECT *, p_value < 0.05 AS reject_symmetry FROM (SELECT *, "
        f"{sq.chi2_3('lm_stat')} AS p_value FROM (SELECT series_id, n, n * (1 - rss / tss) AS lm_stat, "
        "b0 AS coef_s_neg, b1 AS coef_neg_int, b2 AS coef_pos_int FROM ef))",
        *_EN,
    ),
)


def _granger_ctes(max_lag: int = 5) -> tuple[str, ...]:
    k = "cause, effect"
    out = [
        PV,
        "gp AS ("
        + " UNION ALL ".join(
            f"SELECT '{i}' AS cause, '{j}' AS effect, t, \"{i}\" AS x, \"{j}\" AS y FROM pv" for i, j in ORDERED
        )
        + ")",
        "gl AS (SELECT *, row_number() OVER (PARTITION BY cause, effect ORDER BY t) AS pos, "
        + ", ".join(
            f"lag({c}, {q}) OVER (PARTITION BY cause, effect ORDER BY t) AS {c}{q}"
            for c in ("y", "x")
            for q in range(1, max_lag + 1)
        )
        + " FROM gp)",
    ]
    for q in range(1, max_lag + 1):
        ys, xs = [f"y{i}" for i in range(1, q + 1)], [f"x{i}" for i in range(1, q + 1)]
        out += sq.ridge("gl", k, ys, "y", 0, False, f"gr{q}", f"pos > {q}")
        out += sq.ridge("gl", k, ys + xs, "y", 0, False, f"gu{q}", f"pos > {q}")
    out.append(
        "gf AS ("
        + " UNION ALL ".join(
            f"SELECT u.cause, u.effect, {q} AS n_lags, u.n, r.rss AS rss_r, u.rss AS rss_ur, 1 - r.rss / r.tss AS r2_r, "
            f"1 - u.rss / u.tss AS r2_ur, u.n * ln(u.rss / u.n) + 2 * {2 * q + 1} AS aic FROM gu{q} u JOIN gr{q} r USING (cause, effect)"
            for q in range(1, max_lag + 1)
        )
        + ")"
    )
    out.append(
        "gb AS (SELECT *, ((rss_r - rss_ur) / n_lags) / (rss_ur / (n - 2 * n_lags - 1)) AS f_stat FROM "
        "(SELECT *, row_number() OVER (PARTITION BY cause, effect ORDER BY aic) AS o FROM gf) WHERE o = 1)"
    )
    return tuple(out)


@shared()
def gfits(s, d):
    return hy.granger_fits(rv_panel(rets(s, d)), ORDERED)


register(
    "x14_granger",
    "cause:s effect:s n_lags:i n:i f_stat:4 r2_ur:6 r2_r:6",
    lambda s, d: hy.granger_test(gfits(s, d)),
    sql_r("SELECT * FROM gb", *_granger_ctes()),
)
register(
    "x15_granger_lag_choice",
    "cause:s effect:s best_lag:i best_aic:3",
    lambda s, d: hy.granger_lag_choice(gfits(s, d)),
    sql_r("SELECT cause, effect, n_lags AS best_lag, aic AS best_aic FROM gb", *_granger_ctes()),
)
_G251 = "(PARTITION BY cause, effect ORDER BY t ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING)"
register(
    "x16_rolling_granger",
    "cause:s effect:s t:d n:i f_stat:4",
    lambda s, d: hy.rolling_granger(rv_panel(rets(s, d)), ORDERED),
    sql_r(
        "SELECT cause, effect, t, n, (rss_r - rss_ur) / rss_ur * (n - 3) AS f_stat FROM (SELECT *, yy - y1_ * y1_ / aa AS rss_r, "
        "yy - (y1_ * (bb * y1_ - ab * y2_) + y2_ * (aa * y2_ - ab * y1_)) / (aa * bb - ab * ab) AS rss_ur FROM (SELECT cause, effect, t, pos, "
        f"count(y1) OVER w AS n, covar_pop(y, y) OVER w AS yy, covar_pop(y1, y1) OVER w AS aa, covar_pop(x1, x1) OVER w AS bb, "
        f"covar_pop(y, y1) OVER w AS y1_, covar_pop(y, x1) OVER w AS y2_, covar_pop(y1, x1) OVER w AS ab FROM gl WINDOW w AS {_G251}) WHERE pos > 252)",
        *_granger_ctes(1)[:3],
    ),
)

VAR_SQL = (
    f"vr0 AS (SELECT series_id, t, log_return AS actual, {lag('sqrt(greatest(pow(vol_c2c_21d, 2), 1e-12) / 252)')} AS daily_vol FROM v)",
    "vr1 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS back FROM vr0 WHERE actual IS NOT NULL AND daily_vol IS NOT NULL)",
    "vr AS (SELECT series_id, t, alpha, actual, daily_vol, z * daily_vol AS var, -(exp(-z * z / 2) / sqrt(2 * pi())) / alpha * daily_vol AS cvar, "
    "CASE WHEN actual < z * daily_vol THEN 1 ELSE 0 END AS violation FROM vr1, (VALUES "
    "(CAST(0.05 AS DOUBLE), CAST(-1.6448536269514722 AS DOUBLE)), (CAST(0.01 AS DOUBLE), CAST(-2.3263478740408408 AS DOUBLE))) z(alpha, z) WHERE back <= 500)",
)


def violation_tests(src: str, key: str) -> tuple[str, ...]:
    xl = lambda x, y: f"CASE WHEN {x} = 0 THEN 0 ELSE {x} * ln({y}) END"
    k = f"{key}, alpha"
    return (
        f"kp0 AS (SELECT {k}, CAST(count(*) AS DOUBLE) AS n, CAST(sum(violation) AS DOUBLE) AS x FROM {src} GROUP BY ALL)",
        f"kp1 AS (SELECT *, CASE WHEN x = 0 OR x = n THEN 0 ELSE -2 * (({xl('(n - x)', '(1 - alpha)')}) + ({xl('x', 'alpha')}) - ({xl('(n - x)', '(1 - x / n)')}) - ({xl('x', '(x / n)')})) END AS lr_stat FROM kp0)",
        f"kp AS (SELECT *, x / n AS observed_rate, CASE WHEN x = 0 OR x = n THEN 1.0 ELSE {sq.chi2_1('lr_stat')} END AS p_value FROM kp1)",
        f"ch0 AS (SELECT *, lag(violation) OVER (PARTITION BY {k} ORDER BY t) AS b FROM {src})",
        f"ch1 AS (SELECT {k}, "
        + ", ".join(
            f"CAST(count(*) FILTER (b = {a} AND violation = {c}) AS DOUBLE) AS n{a}{c}" for a in (0, 1) for c in (0, 1)
        )
        + " FROM ch0 GROUP BY ALL)",
        f"ch2 AS (SELECT *, n01 / nullif(n00 + n01, 0) AS p01, n11 / nullif(n10 + n11, 0) AS p11, (n01 + n11) / nullif(n00 + n01 + n10 + n11, 0) AS p FROM ch1)",
        f"ch3 AS (SELECT *, CASE WHEN n00 + n01 > 0 AND n10 + n11 > 0 AND n01 > 0 AND n11 > 0 THEN -2 * (({xl('(n00 + n10)', '(1 - p)')}) + ({xl('(n01 + n11)', 'p')}) "
        f"- ({xl('n00', '(1 - p01)')}) - ({xl('n01', 'p01')}) - ({xl('n10', '(1 - p11)')}) - ({xl('n11', 'p11')})) END AS lr_ind FROM ch2)",
        f"ch AS (SELECT *, coalesce(p_ind >= 0.05, TRUE) AS independent FROM (SELECT *, CASE WHEN lr_ind IS NOT NULL THEN {sq.chi2_1('lr_ind')} END AS p_ind FROM ch3))",
    )


@shared()
def var_rows(s, d):
    return rk.series_var_rows(vols(s, d), "vol_c2c_21d")


register(
    "x17_kupiec",
    "series_id:s alpha:2 n:i x:i lr_stat:5 observed_rate:6 p_value:5 well_calibrated:b",
    lambda s, d: hy.kupiec(var_rows(s, d), ["series_id", "alpha"]),
    sql_r("SELECT *, p_value >= 0.05 AS well_calibrated FROM kp", _VOL, *VAR_SQL, *violation_tests("vr", "series_id")),
)
register(
    "x18_christoffersen",
    "series_id:s alpha:2 n00:i n01:i n10:i n11:i lr_ind:5 p_ind:5 independent:b",
    lambda s, d: hy.christoffersen(var_rows(s, d), ["series_id", "alpha"]),
    sql_r("SELECT * FROM ch", _VOL, *VAR_SQL, *violation_tests("vr", "series_id")),
)


def halves(s, d):
    """First 756 rows of the HAR table as the reference, the rest as the sample."""
    return rt.har_table(rets(s, d)).select("series_id", "rv", (F.col("pos") <= 756).alias("is_ref"))


def ks_p_sql(stat: str, n1: str, n2: str) -> str:
    x = f"(sqrt(CAST({n1} AS DOUBLE) * {n2} / ({n1} + {n2})) * {stat})"
    total = " + ".join(f"({2.0 if j % 2 else -2.0}) * exp(-2.0 * {j * j} * {x} * {x})" for j in range(1, 21))
    return f"CASE WHEN {x} < 0.2 THEN 1.0 ELSE least(greatest({total}, 0.0), 1.0) END"


register(
    "x19_ks_two_sample",
    "series_id:s ks_stat:8 n_ref:i n_cur:i ks_pvalue:6",
    lambda s, d: hy.ks_two_sample(halves(s, d), ["series_id"], "rv", "is_ref"),
    sql_r(
        f"SELECT *, {ks_p_sql('ks_stat', 'n_ref', 'n_cur')} AS ks_pvalue FROM (SELECT series_id, max(abs(a - b)) AS ks_stat, max(n1) AS n_ref, max(n2) AS n_cur FROM ("
        "SELECT series_id, n1, n2, CAST(count(*) FILTER (hpos <= 756) OVER w AS DOUBLE) / n1 AS a, "
        "CAST(count(*) FILTER (hpos > 756) OVER w AS DOUBLE) / n2 AS b FROM (SELECT *, count(*) FILTER (hpos <= 756) OVER (PARTITION BY series_id) AS n1, "
        "count(*) FILTER (hpos > 756) OVER (PARTITION BY series_id) AS n2 FROM ht) WINDOW w AS (PARTITION BY series_id ORDER BY rv RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1)",
        HAR_TABLE,
    ),
)
