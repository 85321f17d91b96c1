"""Cross-series features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.operators import cross as cr
from barograph.operators import returns as rt
from barograph.plans import sqltext as sq
from barograph.plans.market import BASE_SQL, _VOL, sql_r
from barograph.plans.registry import register_reusing as register
from barograph.plans.registry import shared
from barograph.plans.tables import BENCHMARK, SERIES, rets, vols
from barograph.sources.bars import aligned_panel

lag, roll, roll2, W = sq.lag, sq.roll, sq.roll2, sq.W


def ret_panel(df):
    return aligned_panel(df, "log_return", SERIES)


def rv_panel(df):
    return aligned_panel(df, "rv", SERIES)


def panel_cte(name: str, value: str) -> str:
    cells = ", ".join(
        f"max({value}) FILTER (series_id = '{s}') AS \"{s}\"" for s in SERIES
    )
    whole = " AND ".join(f'"{s}" IS NOT NULL' for s in SERIES)
    return f"{name} AS (SELECT * FROM (SELECT t, {cells} FROM r GROUP BY t) WHERE {whole})"


PN, PV = panel_cte("pn", "log_return"), panel_cte("pv", "rv")
OWN = "CASE " + " ".join(f"WHEN r.series_id = '{s}' THEN pn.\"{s}\"" for s in SERIES) + " END"
JOINED = (
    f"j AS (SELECT r.*, pn.\"A\", pn.\"N\", pn.\"R\", {OWN} AS x FROM r LEFT JOIN pn ON r.t = pn.t)"
)

register(
    "m7_rolling_correlation",
    "series_id:s other:s t:d roll_corr:6",
    lambda s, d: cr.rolling_correlation(rets(s, d), ret_panel(rets(s, d)), SERIES),
    sql_r(
        f"SELECT series_id, other, t, {roll2('corr', 'x', 'y', 21, 15, skip=1, part='series_id, other')} "
        "AS roll_corr FROM ("
        + " UNION ALL ".join(
            f"SELECT series_id, '{o}' AS other, t, x, \"{o}\" AS y FROM j WHERE series_id <> '{o}'"
            for o in SERIES
        )
        + ")",
        PN, JOINED,
    ),
)
register(
    "m8_dispersion",
    "series_id:s t:d cross_asset_dispersion:6 dispersion_5d_avg:6",
    lambda s, d: cr.dispersion(rets(s, d), ret_panel(rets(s, d)), SERIES),
    sql_r(
        f"SELECT series_id, t, cross_asset_dispersion, {roll('avg', 'cross_asset_dispersion', 5, 3)} "
        f"AS dispersion_5d_avg FROM (SELECT series_id, t, {lag('sp')} AS cross_asset_dispersion FROM "
        "(SELECT j.*, list_aggregate([\"A\", \"N\", \"R\"], 'stddev_samp') AS sp FROM j))",
        PN, JOINED,
    ),
)
register(
    "m9_benchmark_context",
    "series_id:s t:d bench_vol:5",
    lambda s, d: cr.benchmark_context(vols(s, d), BENCHMARK, "vol_c2c_21d", "bench_vol"),
    sql_r(
        "SELECT v.series_id, v.t, b.x AS bench_vol FROM v LEFT JOIN (SELECT t, "
        f"{lag('vol_c2c_21d')} AS x FROM v WHERE series_id = '{BENCHMARK}') b ON v.t = b.t",
        _VOL,
    ),
)
_BETA = (
    f"bt AS (SELECT series_id, t, {roll2('covar_samp', 'x', 'mk', 21, 15, skip=1)} / "
    f"({roll('var_samp', 'mk', 21, 15, skip=1)} + 1e-12) AS rolling_beta_21d FROM "
    f"(SELECT *, \"{BENCHMARK}\" AS mk FROM j))"
)
register(
    "m10_rolling_beta",
    "series_id:s t:d rolling_beta_21d:6 beta_instability_21d:5",
    lambda s, d: cr.rolling_beta(rets(s, d), ret_panel(rets(s, d)), SERIES, BENCHMARK),
    sql_r(
        f"SELECT *, {roll('stddev_samp', 'rolling_beta_21d', 21, 10)} AS beta_instability_21d FROM bt",
        PN, JOINED, _BETA,
    ),
)
register(
    "m11_series_spread",
    "series_id:s t:d spread_mean:6 spread_vol:6",
    lambda s, d: cr.spread_features(rets(s, d), ret_panel(rets(s, d)), "R", "N"),
    sql_r(
        f"SELECT series_id, t, {roll('avg', 'sp', 21, 10, skip=1)} AS spread_mean, "
        f"{roll('stddev_samp', 'sp', 21, 10, skip=1)} AS spread_vol FROM "
        '(SELECT *, "R" - "N" AS sp FROM j)',
        PN, JOINED,
    ),
)
_BULL = (
    "lv AS (SELECT t, 'all' AS series_id, exp(sum(\"N\") OVER (ORDER BY t)) AS level FROM pn)",
    f"fl AS (SELECT t, series_id, CASE WHEN {roll('avg', 'level', 50, 40)} > "
    f"{roll('avg', 'level', 200, 150)} THEN 1.0 ELSE 0.0 END AS flag FROM lv)",
)
register(
    "m12_bull_regime",
    "series_id:s t:d bull_regime_flag:1",
    lambda s, d: cr.bull_regime(rets(s, d), ret_panel(rets(s, d)), BENCHMARK),
    sql_r(
        "SELECT r.series_id, r.t, b.bull_regime_flag FROM r LEFT JOIN (SELECT t, "
        "lag(flag) OVER (ORDER BY t) AS bull_regime_flag FROM fl) b ON r.t = b.t",
        PN, *_BULL,
    ),
)


@shared()
def pairs(s, d):
    return cr.market_pairs(ret_panel(rets(s, d)), SERIES, BENCHMARK)


PAIR = (
    "pm AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS pos FROM ("
    + " UNION ALL ".join(
        f"SELECT '{o}' AS series_id, t, \"{o}\" AS r, \"{BENCHMARK}\" AS m FROM pn"
        for o in SERIES if o != BENCHMARK
    )
    + "))"
)
EWB = (
    "sd AS (SELECT series_id, covar_samp(r, m) AS c0, var_pop(m) AS v0 FROM pm WHERE pos <= 22 GROUP BY 1)",
    "fd AS (SELECT pm.*, CASE WHEN pos = 22 THEN c0 WHEN pos > 22 THEN 0.06 * r * m END AS fc, "
    "CASE WHEN pos = 22 THEN v0 WHEN pos > 22 THEN 0.06 * m * m END AS fv FROM pm JOIN sd USING (series_id))",
    sq.decayed("fd", "dc", "fc", 0.94, 620),
    sq.decayed("fd", "dv", "fv", 0.94, 620),
    "eb AS (SELECT fd.series_id, fd.t, fd.r, fd.m, fd.pos, CASE WHEN fd.pos > 22 AND dv.v > 0 THEN dc.v / dv.v END AS ewma_beta "
    "FROM fd JOIN dc USING (series_id, t) JOIN dv USING (series_id, t))",
    f"bf2 AS (SELECT *, {lag('ewma_beta')} AS beta FROM eb)",
    "fs AS (SELECT *, beta * m AS r_explained, r - beta * m AS r_idio, r * r AS rv_total, "
    "pow(beta * m, 2) AS rv_market, pow(r - beta * m, 2) AS rv_idio, "
    "CASE WHEN pow(beta * m, 2) / nullif(r * r, 0) IS NOT NULL THEN "
    "least(greatest(pow(beta * m, 2) / nullif(r * r, 0), 0), 1) END AS frac_market_explained FROM bf2)",
)
register(
    "m13_ols_beta",
    "series_id:s t:d ols_beta:6",
    lambda s, d: cr.ols_beta(pairs(s, d)),
    sql_r(
        f"SELECT series_id, t, {roll2('covar_samp', 'r', 'm', 22)} / "
        f"nullif({roll('var_samp', 'm', 22)}, 0) AS ols_beta FROM pm",
        PN, PAIR,
    ),
)
register(
    "m14_ewma_beta",
    "series_id:s t:d ewma_beta:6",
    lambda s, d: cr.ewma_beta(pairs(s, d)),
    sql_r("SELECT * FROM eb", PN, PAIR, *EWB),
)
register(
    "m15_beta_feature",
    "series_id:s t:d beta:6",
    lambda s, d: cr.beta_feature(pairs(s, d)),
    sql_r("SELECT * FROM bf2", PN, PAIR, *EWB),
)
register(
    "m16_factor_decomposition",
    "series_id:s t:d r_explained:6 r_idio:6",
    lambda s, d: cr.factor_split(cr.beta_feature(pairs(s, d))),
    sql_r("SELECT * FROM fs", PN, PAIR, *EWB),
)
register(
    "m17_variance_split",
    "series_id:s t:d rv_total:6 rv_market:6 rv_idio:6 frac_market_explained:6",
    lambda s, d: cr.factor_split(cr.beta_feature(pairs(s, d))),
    sql_r("SELECT * FROM fs", PN, PAIR, *EWB),
)
register(
    "m18_factor_panel",
    "series_id:s t:d rv_total:6 rv_market:6 rv_idio:6 frac_market_explained:6 beta:6",
    lambda s, d: cr.factor_panel(ret_panel(rets(s, d)), SERIES, BENCHMARK),
    sql_r(
        "SELECT * FROM fs WHERE beta IS NOT NULL AND frac_market_explained IS NOT NULL",
        PN, PAIR, *EWB,
    ),
)
OTHERS = (
    "ot AS ("
    + " UNION ALL ".join(
        "SELECT '{0}' AS series_id, t, \"{0}\" AS own, \"{1}\" AS other_1, \"{2}\" AS other_2 FROM pv".format(
            x, *[o for o in SERIES if o != x]
        )
        for x in SERIES
    )
    + ")",
    f"sx AS (SELECT *, {lag('own')} AS rv_lag_1, {roll('avg', 'own', 5, skip=1)} AS rv_lag_5, "
    f"{roll('avg', 'own', 21, skip=1)} AS rv_lag_21, {sq.lead('own')} AS target, "
    + ", ".join(
        f"{lag(f'other_{i}')} AS cross_{i}_lag1, {roll('avg', f'other_{i}', 5, skip=1)} AS cross_{i}_lag5, "
        f"CASE WHEN {lag(f'other_{i}')} IS NOT NULL THEN least(greatest({lag(f'other_{i}')} / "
        f"({lag('own')} + 1e-10), 0), 10) END AS ratio_{i}_lag1"
        for i in (1, 2)
    )
    + " FROM ot)",
)
SPILL = tuple(f"{c}" for i in (1, 2) for c in (f"cross_{i}_lag1", f"cross_{i}_lag5", f"ratio_{i}_lag1"))
register(
    "m19_spillover_features",
    "series_id:s t:d rv_lag_1:4 rv_lag_5:4 rv_lag_21:4 target:4 "
    + " ".join(f"{c}:4" for c in SPILL),
    lambda s, d: cr.spillover_features(rv_panel(rets(s, d)), SERIES),
    sql_r("SELECT * FROM sx", PV, *OTHERS),
)


def sparse_index(df):
    """Panel dispersion noted on the first trading day of every month."""
    spread = cr.dispersion(
        df.filter(F.col("series_id") == BENCHMARK), ret_panel(df), SERIES
    ).filter(F.col("cross_asset_dispersion").isNotNull())
    return (
        spread.groupBy(F.trunc("t", "month").alias("m"))
        .agg(F.min_by("cross_asset_dispersion", "t").alias("index"), F.min("t").alias("t"))
        .drop("m")
    )


SPARSE = (
    f"dsp AS (SELECT t, x AS \"index\" FROM (SELECT t, {lag('sp')} AS x FROM "
    "(SELECT j.*, list_aggregate([\"A\", \"N\", \"R\"], 'stddev_samp') AS sp FROM j "
    f"WHERE series_id = '{BENCHMARK}')) WHERE x IS NOT NULL)",
    "idx AS (SELECT min(t) AS t, arg_min(\"index\", t) AS \"index\" FROM dsp GROUP BY date_trunc('month', t))",
    "fi AS (SELECT r.series_id, r.t, last_value(idx.\"index\" IGNORE NULLS) OVER "
    "(PARTITION BY r.series_id ORDER BY r.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ix "
    "FROM r LEFT JOIN idx ON r.t = idx.t)",
)
register(
    "m20_index_features",
    "series_id:s t:d index_lag1:6 index_lag5:6 index_vol_21:6 high_index:1",
    lambda s, d: cr.index_features(rets(s, d), sparse_index(rets(s, d)), "index"),
    sql_r(
        f"SELECT fi.series_id AS series_id, t, {lag('ix', part='fi.series_id')} AS index_lag1, "
        f"{roll('avg', 'ix', 5, 3, skip=1, part='fi.series_id')} AS index_lag5, "
        f"{roll('stddev_samp', 'ix', 21, 10, skip=1, part='fi.series_id')} AS index_vol_21, "
        f"CASE WHEN {lag('ix', part='fi.series_id')} > hi THEN 1.0 ELSE 0.0 END AS high_index "
        "FROM fi JOIN (SELECT series_id, quantile_cont(ix, 0.75) AS hi FROM fi GROUP BY series_id) q "
        "ON fi.series_id = q.series_id",
        PN, JOINED, *SPARSE,
    ),
)


def tercile_regimes(df, value="vol_c2c_21d"):
    """Regime 0/1/2 with the whole weight on it, from terciles of trailing volatility."""
    from barograph.operators.evaluate import tercile_labels

    lab = tercile_labels(df, value).filter(F.col(value).isNotNull())
    return lab.select(
        "series_id", "t",
        F.when(F.col("regime") == "low", 0).when(F.col("regime") == "high", 2).otherwise(1).alias("regime"),
        (F.col("regime") == "low").cast("double").alias("post_low"),
        (F.col("regime") == "medium").cast("double").alias("post_med"),
        (F.col("regime") == "high").cast("double").alias("post_high"),
    )


TERCILE = (
    "tq AS (SELECT series_id, quantile_cont(vol_c2c_21d, 0.33) AS q1, quantile_cont(vol_c2c_21d, 0.67) AS q2 "
    "FROM v GROUP BY series_id)",
    "tl AS (SELECT v.series_id, t, CASE WHEN vol_c2c_21d >= q2 THEN 'high' WHEN vol_c2c_21d <= q1 THEN 'low' "
    "ELSE 'medium' END AS regime FROM v JOIN tq ON v.series_id = tq.series_id WHERE vol_c2c_21d IS NOT NULL)",
)
register(
    "m21_regime_features",
    "series_id:s t:d regime_lag1:i post_low_lag1:6 post_med_lag1:6 post_high_lag1:6",
    lambda s, d: cr.regime_features(rets(s, d), tercile_regimes(vols(s, d))),
    sql_r(
        "SELECT series_id, t, coalesce(lag(g) OVER w, 1) AS regime_lag1, "
        "coalesce(lag(CASE WHEN g IS NULL THEN NULL WHEN g = 0 THEN 1.0 ELSE 0.0 END) OVER w, CAST(1 AS DOUBLE) / 3) AS post_low_lag1, "
        "coalesce(lag(CASE WHEN g IS NULL THEN NULL WHEN g = 1 THEN 1.0 ELSE 0.0 END) OVER w, CAST(1 AS DOUBLE) / 3) AS post_med_lag1, "
        "coalesce(lag(CASE WHEN g IS NULL THEN NULL WHEN g = 2 THEN 1.0 ELSE 0.0 END) OVER w, CAST(1 AS DOUBLE) / 3) AS post_high_lag1 "
        "FROM (SELECT r.series_id, r.t, CASE tl.regime WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END AS g "
        "FROM r LEFT JOIN tl ON r.series_id = tl.series_id AND r.t = tl.t) WINDOW w AS (PARTITION BY series_id ORDER BY t)",
        _VOL, *TERCILE,
    ),
)
register(
    "m22_target_correlations",
    "series_id:s feature:s corr:6",
    lambda s, d: cr.target_correlations(rt.base_features(rets(s, d)), rt.BASE_FEATURES),
    sql_r(
        " UNION ALL ".join(
            f"SELECT series_id, '{c}' AS feature, corr({c}, target) AS corr FROM bf GROUP BY series_id"
            for c in rt.BASE_FEATURES
        ),
        *BASE_SQL,
    ),
)
