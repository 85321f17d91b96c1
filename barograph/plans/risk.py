"""Covariance, dynamic correlation and portfolio risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.operators import risk as rk
from barograph.plans import sqltext as sq
from barograph.plans.cross import PN, ret_panel
from barograph.plans.hypothesis import VAR_SQL, var_rows, violation_tests
from barograph.plans.market import _VOL, sql_r
from barograph.plans.registry import register_reusing as register
from barograph.plans.registry import shared
from barograph.plans.tables import SERIES, rets
from barograph.sources.bars import aligned_panel, series_pairs

UPPER = series_pairs(SERIES, diagonal=True)
OFF = series_pairs(SERIES)
WEIGHTS = {s: 1.0 / 3 for s in SERIES}
A, B = 0.05, 0.90


@shared()
def pairs(s, d):
    return rk.matrix_pairs(ret_panel(rets(s, d)), SERIES)


def _pairs_cte(name: str, src: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT t, '{i}' AS i, '{j}' AS j, \"{i}\" AS x, \"{j}\" AS y FROM {src}" for i, j in UPPER
    )
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY t) AS pos FROM ({rows}))"


PP = _pairs_cte("pp", "pn")


def _corr_sql(src: str, value: str, out: str) -> str:
    return (
        f"{out} AS (SELECT m.*, CASE WHEN m.i = m.j THEN 1.0 ELSE m.{value} / greatest(sqrt(a.{value} * b.{value}), 1e-12) END AS corr "
        f"FROM {src} m JOIN {src} a ON a.i = m.i AND a.j = m.i AND a.t = m.t JOIN {src} b ON b.i = m.j AND b.j = m.j AND b.t = m.t)"
    )


ROLL = (
    PP,
    "rc AS (SELECT t, i, j, covar_samp(x, y) OVER w * 252 AS cov FROM pp WHERE TRUE "
    "WINDOW w AS (PARTITION BY i, j ORDER BY t ROWS BETWEEN 22 PRECEDING AND 2 PRECEDING) QUALIFY count(x) OVER w = 21)",
)
register(
    "k1_rolling_covariance",
    "t:d i:s j:s cov:4",
    lambda s, d: rk.rolling_covariance(pairs(s, d)),
    sql_r("SELECT * FROM rc", PN, *ROLL),
)
EWC = (
    PP,
    "ws AS (SELECT i, j, covar_samp(x, y) AS c0 FROM pp WHERE pos <= 21 GROUP BY 1, 2)",
    "wf AS (SELECT pp.*, CASE WHEN pos = 21 THEN c0 WHEN pos > 21 THEN 0.06 * lag(x * y) OVER (PARTITION BY pp.i, pp.j ORDER BY t) END AS f FROM pp JOIN ws USING (i, j))",
    sq.decayed("wf", "wd", "f", 0.94, 620, keys="i, j"),
    "wc AS (SELECT wd.t, wd.i, wd.j, v * 252 AS cov FROM wd JOIN pp USING (i, j, t) WHERE pos > 21)",
)
register(
    "k2_ewma_covariance",
    "t:d i:s j:s cov:4",
    lambda s, d: rk.ewma_covariance(pairs(s, d)),
    sql_r("SELECT * FROM wc", PN, *EWC),
)
register(
    "k3_correlation",
    "t:d i:s j:s corr:6",
    lambda s, d: rk.to_correlation(rk.rolling_covariance(pairs(s, d))),
    sql_r("SELECT * FROM co", PN, *ROLL, _corr_sql("rc", "cov", "co")),
)
register(
    "k3_correlation_columns",
    "t:d " + " ".join(f"corr_{a}_{b}:6" for a, b in OFF),
    lambda s, d: rk.correlation_columns(rk.to_correlation(rk.rolling_covariance(pairs(s, d))), OFF),
    sql_r(
        "SELECT t, " + ", ".join(f"max(corr) FILTER (i = '{a}' AND j = '{b}') AS \"corr_{a}_{b}\"" for a, b in OFF) + " FROM co GROUP BY t",
        PN, *ROLL, _corr_sql("rc", "cov", "co"),
    ),
)


@shared()
def panel_long(s, d):
    """The aligned panel as rows per series, so that all series share their dates."""
    return ret_panel(rets(s, d)).unpivot(["t"], list(SERIES), "series_id", "log_return")


@shared()
def ewma_vols(s, d):
    return rk.ewma_volatility(panel_long(s, d))


VOLS = (
    "pl AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS pos FROM ("
    + " UNION ALL ".join(f"SELECT '{x}' AS series_id, t, \"{x}\" AS log_return FROM pn" for x in SERIES)
    + "))",
    "vf AS (SELECT pl.*, CASE WHEN pos = 1 THEN v0 ELSE 0.06 * pow(lag(log_return) OVER (PARTITION BY pl.series_id ORDER BY t), 2) END AS f "
    "FROM pl JOIN (SELECT series_id, var_pop(log_return) AS v0 FROM pl WHERE pos <= 21 GROUP BY 1) q ON pl.series_id = q.series_id)",
    sq.decayed("vf", "vd", "f", 0.94, 620),
    "ev AS (SELECT pl.*, sqrt(greatest(v, 1e-12)) AS ewma_vol FROM pl JOIN vd USING (series_id, t))",
    "rs AS (SELECT *, log_return / ewma_vol AS resid FROM ev WHERE pos > 21)",
)
register(
    "k4_ewma_volatility",
    "series_id:s t:d ewma_vol:6",
    ewma_vols,
    sql_r("SELECT * FROM ev", PN, *VOLS),
)
register(
    "k5_standardised_residuals",
    "series_id:s t:d resid:6",
    lambda s, d: rk.standardised_residuals(ewma_vols(s, d)),
    sql_r("SELECT * FROM rs", PN, *VOLS),
)


@shared()
def resid_pairs(s, d):
    e = rk.standardised_residuals(ewma_vols(s, d))
    return rk.matrix_pairs(aligned_panel(e, "resid", SERIES), SERIES)


def _wide(name: str, src: str, value: str) -> str:
    return f"{name} AS (SELECT t, " + ", ".join(f"max({value}) FILTER (series_id = '{x}') AS \"{x}\"" for x in SERIES) + f" FROM {src} GROUP BY t)"


DCC = (
    *VOLS,
    _wide("rw", "rs", "resid"),
    _pairs_cte("ep", "rw"),
    "qb AS (SELECT i, j, covar_samp(x, y) AS qbar FROM ep GROUP BY 1, 2)",
    f"qf AS (SELECT ep.*, qbar, CASE WHEN pos = 1 THEN qbar ELSE (1 - {A} - {B}) * qbar + {A} * lag(x * y) OVER (PARTITION BY ep.i, ep.j ORDER BY t) END AS f FROM ep JOIN qb USING (i, j))",
    sq.decayed("qf", "qd", "f", B, 360, keys="i, j"),
    "qq AS (SELECT qf.t, qf.i, qf.j, x, y, qbar, v AS q FROM qf JOIN qd USING (i, j, t))",
    _corr_sql("qq", "q", "dc"),
)


@shared()
def dcc_rows(s, d):
    return rk.dcc(resid_pairs(s, d), A, B)


register(
    "k6_dcc",
    "t:d i:s j:s q:6 corr:6",
    dcc_rows,
    sql_r("SELECT * FROM dc", PN, *DCC),
)
# the likelihood of three series with determinant and inverse in closed form
_CELLS = ", ".join(
    f"max({c}) FILTER (i = '{i}' AND j = '{j}') AS {n}"
    for c, n, i, j in (
        *(("q", f"q{m}{n}", SERIES[m], SERIES[n]) for m in range(3) for n in range(m, 3)),
        *(("x", f"e{m}", SERIES[m], SERIES[m]) for m in range(3)),
    )
)
_R = ", ".join(f"q{m}{n} / greatest(sqrt(q{m}{m} * q{n}{n}), 1e-12) AS r{m}{n}" for m, n in ((0, 1), (0, 2), (1, 2)))
DCC_GRID = (
    *DCC[:8],  # up to the average product of residuals
    "gr AS (SELECT * FROM (VALUES "
    + ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a in rk.DCC_A for b in rk.DCC_B if a + b < 0.99)
    + ") v(a, b))",
    "gf AS (SELECT a, b, t, ep.i, ep.j, pos, x, CASE WHEN pos = 1 THEN qbar ELSE (1 - a - b) * qbar "
    "+ a * lag(x * y) OVER (PARTITION BY a, b, ep.i, ep.j ORDER BY t) END AS f FROM ep JOIN qb USING (i, j) CROSS JOIN gr)",
    "gq AS (SELECT *, pow(b, pos) * sum(f * pow(b, -pos)) OVER (PARTITION BY a, b, i, j ORDER BY t ROWS UNBOUNDED PRECEDING) AS q FROM gf)",
    f"gw AS (SELECT a, b, t, {_CELLS} FROM gq GROUP BY 1, 2, 3)",
    f"gc AS (SELECT *, {_R} FROM gw)",
    "gd AS (SELECT *, 1 + 2 * r01 * r02 * r12 - r01 * r01 - r02 * r02 - r12 * r12 AS det FROM gc)",
    "gl AS (SELECT a, b, a + b AS persistence, sum(-0.5 * (ln(det) + ((1 - r12 * r12) * e0 * e0 + (1 - r02 * r02) * e1 * e1 "
    "+ (1 - r01 * r01) * e2 * e2 + 2 * (r02 * r12 - r01) * e0 * e1 + 2 * (r01 * r12 - r02) * e0 * e2 "
    "+ 2 * (r01 * r02 - r12) * e1 * e2) / det - e0 * e0 - e1 * e1 - e2 * e2)) AS loglik FROM gd GROUP BY 1, 2)",
)
register(
    "k7_dcc_grid",
    "a:2 b:2 persistence:2 loglik:3",
    lambda s, d: rk.dcc_grid(resid_pairs(s, d), SERIES),
    sql_r("SELECT * FROM gl", PN, *DCC_GRID),
)
register(
    "k7_dcc_choice",
    "a:2 b:2 persistence:2 loglik:3",
    lambda s, d: rk.dcc_choice(rk.dcc_grid(resid_pairs(s, d), SERIES)),
    sql_r("SELECT * FROM gl ORDER BY loglik DESC, a DESC, b DESC LIMIT 1", PN, *DCC_GRID),
)
register(
    "k8_next_correlation",
    "t:d i:s j:s q_next:6 corr:6",
    lambda s, d: rk.next_correlation(dcc_rows(s, d), A, B),
    sql_r(
        "SELECT * FROM nc2",
        PN, *DCC,
        f"nc AS (SELECT i, j, max(t) AS t, (1 - {A} - {B}) * arg_max(qbar, t) + {A} * arg_max(x * y, t) + {B} * arg_max(q, t) AS q_next FROM qq GROUP BY 1, 2)",
        _corr_sql("nc", "q_next", "nc2"),
    ),
)
_PR = "(\"A\" + \"N\" + \"R\") / 3.0"
register(
    "k9_portfolio_return",
    "t:d portfolio_return:6",
    lambda s, d: rk.portfolio_return(ret_panel(rets(s, d)), WEIGHTS),
    sql_r(f"SELECT t, {_PR} AS portfolio_return FROM pn", PN),
)


@shared()
def vol_pairs(s, d):
    return rk.matrix_pairs(aligned_panel(ewma_vols(s, d), "ewma_vol", SERIES), SERIES)


@shared()
def ccc_vol(s, d):
    return rk.portfolio_volatility(
        vol_pairs(s, d), rk.full_correlation(pairs(s, d)), WEIGHTS, ("i", "j"), "port_vol_ccc"
    )


@shared()
def dcc_vol(s, d):
    return rk.portfolio_volatility(vol_pairs(s, d), dcc_rows(s, d), WEIGHTS, ("t", "i", "j"), "port_vol_dcc")


PORT = (
    PP, *DCC,
    _wide("vw", "ev", "ewma_vol"),
    _pairs_cte("vp", "vw"),
    "fc AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE corr(x, y) END AS corr FROM pp GROUP BY 1, 2)",
    "cv AS (SELECT t, sqrt(greatest(sum(CASE WHEN i = j THEN 1.0 ELSE 2.0 END / 9.0 * x * y * corr), 1e-12)) AS port_vol_ccc FROM vp JOIN fc USING (i, j) GROUP BY t)",
    "dv2 AS (SELECT vp.t, sqrt(greatest(sum(CASE WHEN vp.i = vp.j THEN 1.0 ELSE 2.0 END / 9.0 * vp.x * vp.y * corr), 1e-12)) AS port_vol_dcc FROM vp JOIN dc USING (t, i, j) GROUP BY vp.t)",
)
register(
    "k10_ccc_volatility", "t:d port_vol_ccc:6", ccc_vol, sql_r("SELECT * FROM cv", PN, *PORT)
)
register(
    "k11_dcc_volatility", "t:d port_vol_dcc:6", dcc_vol, sql_r("SELECT * FROM dv2", PN, *PORT)
)
register(
    "k12_gaussian_var",
    "series_id:s t:d alpha:2 var:6 cvar:6",
    var_rows,
    sql_r("SELECT * FROM vr", _VOL, *VAR_SQL),
)
_BT = "alpha:2 n:i x:i observed_rate:6 p_value:5 well_calibrated:b p_ind:5 independent:b mean_var:6 mean_cvar:6"


def _backtest_sql(key: str, src: str) -> str:
    return (
        f"SELECT kp.*, p_value >= 0.05 AS well_calibrated, p_ind, independent, mean_var, mean_cvar FROM kp JOIN ch USING ({key}, alpha) "
        f"JOIN (SELECT {key}, alpha, avg(var) AS mean_var, avg(cvar) AS mean_cvar FROM {src} GROUP BY ALL) m USING ({key}, alpha)"
    )


register(
    "k13_series_var_backtest",
    f"series_id:s {_BT}",
    lambda s, d: rk.var_backtest(var_rows(s, d)),
    sql_r(_backtest_sql("series_id", "vr"), _VOL, *VAR_SQL, *violation_tests("vr", "series_id")),
)


def portfolio_var(s, d):
    both = dcc_vol(s, d).join(ccc_vol(s, d), "t").join(
        rk.portfolio_return(ret_panel(rets(s, d)), WEIGHTS), "t"
    )
    long = both.select(
        "t", F.col("portfolio_return").alias("actual"),
        F.inline(
            F.array(
                F.struct(F.lit("CCC").alias("method"), F.col("port_vol_ccc").alias("vol")),
                F.struct(F.lit("DCC").alias("method"), F.col("port_vol_dcc").alias("vol")),
            )
        ),
    )
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("t")))
    tail = long.withColumn("_back", back).filter(F.col("_back") <= 500)
    rows = rk.with_var(tail, "vol")
    return rows.withColumn("violation", (F.col("actual") < F.col("var")).cast("int"))


PVAR = (
    f"pb AS (SELECT t, {_PR} AS actual, port_vol_ccc, port_vol_dcc FROM pn JOIN cv USING (t) JOIN dv2 USING (t))",
    "pm2 AS (SELECT t, 'CCC' AS method, actual, port_vol_ccc AS vol FROM pb UNION ALL SELECT t, 'DCC', actual, port_vol_dcc FROM pb)",
    "pt AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY t DESC) AS back FROM pm2)",
    "pvr AS (SELECT method, t, alpha, z * vol AS var, -(exp(-z * z / 2) / sqrt(2 * pi())) / alpha * vol AS cvar, CASE WHEN actual < z * vol THEN 1 ELSE 0 END AS violation FROM pt, "
    "(VALUES (CAST(0.05 AS DOUBLE), CAST(-1.6448536269514722 AS DOUBLE)), (CAST(0.01 AS DOUBLE), CAST(-2.3263478740408408 AS DOUBLE))) z(alpha, z) WHERE back <= 500)",
)
register(
    "k13_portfolio_var_backtest",
    f"method:s {_BT}",
    lambda s, d: rk.var_backtest(portfolio_var(s, d), "method"),
    sql_r(_backtest_sql("method", "pvr"), PN, *PORT, *PVAR, *violation_tests("pvr", "method")),
)
register(
    "k14_diversification",
    "t:d weighted_sum_vol:6 port_vol_dcc:6 port_vol_ccc:6 diversification_benefit:6",
    lambda s, d: rk.diversification(ewma_vols(s, d), WEIGHTS, dcc_vol(s, d), ccc_vol(s, d)),
    sql_r(
        "SELECT t, weighted_sum_vol, port_vol_dcc, port_vol_ccc, weighted_sum_vol - port_vol_dcc AS diversification_benefit FROM dv2 JOIN cv USING (t) "
        "JOIN (SELECT t, sum(ewma_vol / 3.0) AS weighted_sum_vol FROM ev GROUP BY t) USING (t)",
        PN, *PORT,
    ),
)
register(
    "k15_extreme_dates",
    "kind:s t:d i:s j:s corr:6",
    lambda s, d: rk.extreme_dates(ret_panel(rets(s, d)), SERIES, dcc_rows(s, d)),
    sql_r(
        "SELECT kind, dc.t, i, j, corr FROM dc JOIN (SELECT 'calm' AS kind, arg_min(t, a) AS t FROM ex UNION ALL SELECT 'stressed', arg_max(t, a) FROM ex) USING (t)",
        PN, *DCC,
        'ex AS (SELECT t, abs("A") + abs("N") + abs("R") AS a FROM pn WHERE t IN (SELECT t FROM dc))',
    ),
)
register(
    "k16_full_correlation",
    "i:s j:s corr:6",
    lambda s, d: rk.full_correlation(pairs(s, d)),
    sql_r("SELECT * FROM fc", PN, PP, "fc AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE corr(x, y) END AS corr FROM pp GROUP BY 1, 2)"),
)
