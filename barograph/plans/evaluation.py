"""Evaluation, ranking and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.operators import evaluate as ev
from barograph.operators import returns as rt
from barograph.plans import sqltext as sq
from barograph.plans.cross import TERCILE
from barograph.plans.market import HAR_TABLE, _VOL, sql_r
from barograph.plans.registry import register_reusing as register
from barograph.plans.registry import shared
from barograph.plans.tables import SERIES, rets, vols

MODELS = {"last": "rv_lag_1", "mean5": "rv_lag_5", "mean21": "rv_lag_21"}
PRED = (
    HAR_TABLE,
    "pr AS ("
    + " UNION ALL ".join(
        f"SELECT series_id, t, '{m}' AS model, target AS actual, {c} AS pred FROM ht WHERE hpos > hn - 500"
        for m, c in MODELS.items()
    )
    + ")",
)
QL = "avg(ln(greatest(pred, 1e-8)) + greatest(actual, 1e-8) / greatest(pred, 1e-8))"


def metrics_sql(name: str, src: str, keys: str) -> str:
    w = f"(PARTITION BY {keys} ORDER BY t)"
    return (
        f"{name} AS (SELECT {keys}, sqrt(avg(pow(actual - pred, 2))) AS rmse, avg(abs(actual - pred)) AS mae, "
        f"{QL} AS qlike, avg(hit) * 100 AS dir_acc, count(*) AS n FROM (SELECT *, CASE WHEN lag(pred) OVER {w} IS NULL THEN NULL "
        f"WHEN sign(actual - lag(actual) OVER {w}) = sign(pred - lag(pred) OVER {w}) THEN 1.0 ELSE 0.0 END AS hit "
        f"FROM {src}) GROUP BY {keys})"
    )


MET = metrics_sql("mt", "pr", "series_id, model")


@shared()
def predictions(s, d):
    return ev.naive_forecasts(rt.har_table(rets(s, d)))


@shared()
def metrics(s, d):
    return ev.metric_table(predictions(s, d))


def _agg(**cols):
    return lambda s, d: predictions(s, d).groupBy("series_id", "model").agg(
        *[make().alias(n) for n, make in cols.items()]
    )


def _sql_agg(cols: str) -> str:
    return sql_r(f"SELECT series_id, model, {cols} FROM pr GROUP BY 1, 2", *PRED)


register(
    "e1_rmse_mae", "series_id:s model:s rmse:4 mae:4",
    _agg(rmse=ev.rmse, mae=ev.mae),
    _sql_agg("sqrt(avg(pow(actual - pred, 2))) AS rmse, avg(abs(actual - pred)) AS mae"),
)
register(
    "e2_mape", "series_id:s model:s mape:1",
    _agg(mape=ev.mape),
    _sql_agg("avg(abs(actual - pred) / (abs(actual) + 1e-10)) * 100 AS mape"),
)
register("e3_qlike", "series_id:s model:s qlike:4", _agg(qlike=ev.qlike), _sql_agg(f"{QL} AS qlike"))
register(
    "e4_qlike_ratio", "series_id:s model:s qlike:4",
    _agg(qlike=ev.qlike_ratio),
    _sql_agg(
        "avg(greatest(actual, 1e-6) / greatest(pred, 1e-6) - ln(greatest(actual, 1e-6) / greatest(pred, 1e-6)) - 1) AS qlike"
    ),
)
register(
    "e5_directional_accuracy", "series_id:s model:s dir_acc:6 n:i",
    metrics, sql_r("SELECT * FROM mt", *PRED, MET),
)
_M = "rmse:4 mae:4 qlike:4 dir_acc:6 n:i"
register(
    "e6_metric_table", f"series_id:s model:s {_M}",
    metrics, sql_r("SELECT * FROM mt", *PRED, MET),
)


@shared()
def regimes(s, d):
    v = vols(s, d).filter(F.col("vol_c2c_21d").isNotNull())
    return ev.tercile_labels(v.select("series_id", "t", "vol_c2c_21d"), "vol_c2c_21d")


PREG = (
    "pg AS (SELECT pr.*, tl.regime FROM pr JOIN tl ON pr.series_id = tl.series_id AND pr.t = tl.t)",
    "pa AS (SELECT * FROM pg UNION ALL SELECT series_id, t, model, actual, pred, 'All' FROM pg)",
)
register(
    "e7_metrics_by_regime", f"series_id:s model:s regime:s {_M}",
    lambda s, d: ev.metrics_overall_and_by_regime(
        predictions(s, d).join(regimes(s, d).select("series_id", "t", "regime"), ["series_id", "t"])
    ),
    sql_r(
        "SELECT * FROM mr WHERE regime = 'All' OR n >= 5",
        _VOL, *TERCILE, *PRED, *PREG, metrics_sql("mr", "pa", "series_id, model, regime"),
    ),
)
register(
    "e8_tercile_regimes", "series_id:s t:d regime:s",
    regimes, sql_r("SELECT * FROM tl", _VOL, *TERCILE),
)
REGMET = (
    "rm AS (SELECT series_id, model, regime, count(*) AS n, sqrt(avg(pow(actual - pred, 2))) AS rmse, "
    f"avg(abs(actual - pred)) AS mae, {QL} AS qlike FROM pg GROUP BY 1, 2, 3 HAVING count(*) >= 10)"
)


@shared()
def by_regime(s, d):
    return ev.regime_metrics(predictions(s, d), regimes(s, d))


register(
    "e9_regime_metrics", "series_id:s model:s regime:s n:i rmse:4 mae:4 qlike:4",
    by_regime,
    sql_r("SELECT * FROM rm", _VOL, *TERCILE, *PRED, *PREG, REGMET),
)
register(
    "e9_regime_days", "series_id:s regime:s n_days:i",
    lambda s, d: ev.regime_days(regimes(s, d)),
    sql_r("SELECT series_id, regime, count(*) AS n_days FROM tl GROUP BY 1, 2", _VOL, *TERCILE),
)
RANK = (
    "rk AS (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY composite_score) AS overall_rank FROM ("
    "SELECT *, round(0.35 * rank_rmse + 0.30 * rank_qlike + 0.20 * rank_dir_acc + 0.15 * rank_mae, 9) AS composite_score FROM ("
    "SELECT *, rank() OVER (PARTITION BY series_id ORDER BY rmse) AS rank_rmse, rank() OVER (PARTITION BY series_id ORDER BY mae) AS rank_mae, "
    "rank() OVER (PARTITION BY series_id ORDER BY qlike) AS rank_qlike, rank() OVER (PARTITION BY series_id ORDER BY dir_acc DESC) AS rank_dir_acc FROM mt)))",
    "cr AS (SELECT *, row_number() OVER (ORDER BY round(composite_score, 9), model) AS final_rank FROM (SELECT model, avg(rmse) AS rmse, avg(mae) AS mae, "
    "avg(qlike) AS qlike, avg(dir_acc) AS dir_acc, avg(composite_score) AS composite_score FROM rk GROUP BY model))",
)


@shared()
def ranked(s, d):
    return ev.rank_models(metrics(s, d))


_RK = "rank_rmse:i rank_mae:i rank_qlike:i rank_dir_acc:i"
register("e10_metric_ranks", f"series_id:s model:s {_RK}", ranked, sql_r("SELECT * FROM rk", *PRED, MET, *RANK))
register(
    "e11_composite_score", "series_id:s model:s composite_score:6 overall_rank:i",
    ranked, sql_r("SELECT * FROM rk", *PRED, MET, *RANK),
)
register(
    "e12_cross_series_ranking", "model:s rmse:4 mae:4 qlike:4 dir_acc:6 composite_score:6 final_rank:i",
    lambda s, d: ev.rank_across_series(ranked(s, d)),
    sql_r("SELECT * FROM cr", *PRED, MET, *RANK),
)
register(
    "e13_metric_pivot", "model:s A:4 N:4 R:4",
    lambda s, d: ev.pivot_metric(metrics(s, d), "rmse", SERIES),
    sql_r(
        "SELECT model, " + ", ".join(f"max(rmse) FILTER (series_id = '{x}') AS \"{x}\"" for x in SERIES)
        + " FROM mt GROUP BY model",
        *PRED, MET,
    ),
)
register(
    "e14_pipeline_summary",
    f"series_id:s model:s rmse:4 {_RK} overall_rank:i rmse_high:4 rmse_low:4 rmse_medium:4",
    lambda s, d: ev.pipeline_summary(ranked(s, d), by_regime(s, d)),
    sql_r(
        "SELECT rk.*, "
        + ", ".join(f"w.rmse_{g}" for g in ("high", "low", "medium"))
        + " FROM rk LEFT JOIN (SELECT series_id, model, "
        + ", ".join(f"max(rmse) FILTER (regime = '{g}') AS rmse_{g}" for g in ("high", "low", "medium"))
        + " FROM rm GROUP BY 1, 2) w USING (series_id, model)",
        _VOL, *TERCILE, *PRED, *PREG, REGMET, MET, *RANK,
    ),
)


def _norm(m, lower):
    low, high = f"min({m}) OVER ()", f"max({m}) OVER ()"
    part = f"({m} - {low}) / nullif({high} - {low}, 0)"
    return f"CASE WHEN {high} > {low} THEN {'1 - ' + part if lower else part} ELSE {1.0 if lower else 0.5} END AS {m}_norm"


register(
    "e15_normalised_metrics", "model:s rmse_norm:6 mae_norm:6 qlike_norm:6 dir_acc_norm:6",
    lambda s, d: ev.normalise_metrics(ev.rank_across_series(ranked(s, d))),
    sql_r(
        "SELECT model, " + ", ".join(_norm(m, m != "dir_acc") for m in ("rmse", "mae", "qlike", "dir_acc")) + " FROM cr",
        *PRED, MET, *RANK,
    ),
)
register(
    "e16_rolling_rmse", "series_id:s model:s t:d rolling_rmse:4",
    lambda s, d: ev.rolling_rmse(predictions(s, d)),
    sql_r(
        f"SELECT series_id, model, t, sqrt({sq.roll('avg', 'se', 63, 10, part='series_id, model')}) AS rolling_rmse "
        "FROM (SELECT *, pow(actual - pred, 2) AS se FROM pr)",
        *PRED,
    ),
)
