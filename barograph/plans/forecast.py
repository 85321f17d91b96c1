"""Regression, forecasting and selection jobs (F1-F32) and latent regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.functions.windows import by_series, stack
from barograph.operators import boosting as bo
from barograph.operators import cross as cr
from barograph.operators import evaluate as ev
from barograph.operators import garch as ga
from barograph.operators import hypothesis as hy
from barograph.operators import intraday as it
from barograph.operators import regimes as rg
from barograph.operators import regression as rr
from barograph.operators import returns as rt
from barograph.operators import selection as se
from barograph.operators import technical as te
from barograph.plans import sqltext as sq
from barograph.plans.cross import (
    JOINED, OTHERS, PN, PV, SPARSE, SPILL, TERCILE, ret_panel, rv_panel, sparse_index, tercile_regimes,
)
from barograph.plans.evaluation import MODELS, PRED, QL, metrics_sql
from barograph.plans.evaluation import predictions as naive
from barograph.plans.intraday import MOMF, moment_table, sql_i
from barograph.plans.market import AHAR_SQL, BASE_SQL, HAR_TABLE, _VOL, sql_r
from barograph.plans.registry import QUERIES
from barograph.plans.registry import register_reusing as register
from barograph.plans.registry import shared
from barograph.plans.tables import BENCHMARK, SERIES, rets, vols
from barograph.sources.checkpoint import stored

HAR = list(rt.HAR)
lag = sq.lag


def score_sql(fit: str, xs, row: str = "s") -> str:
    return " + ".join([f"{fit}.c", *[f"{fit}.b{i} * {row}.{x}" for i, x in enumerate(xs)]])


@shared()
def har(s, d):
    return rt.har_table(rets(s, d))


TRAIN, TEST = "hpos <= hn - 500", "s.hpos > s.hn - 500"
RIDGE = (HAR_TABLE, *sq.ridge("ht", "series_id", HAR, "target", 10, True, "rg", TRAIN))
SETS = {"har": HAR}


@shared()
def har_split(s, d):
    return rr.train_test(har(s, d))


@shared()
def har_predictions(s, d):
    split = har_split(s, d)
    return rr.ridge_predictions(split, rr.ridge_models(split, SETS), SETS)


register(
    "f1_ridge_predictions",
    "series_id:s t:d actual:4 pred:4",
    har_predictions,
    sql_r(
        f"SELECT s.series_id, s.t, s.target AS actual, {score_sql('rg', HAR)} AS pred FROM ht s JOIN rg USING (series_id) WHERE {TEST}",
        *RIDGE,
    ),
)
register(
    "f1_ridge_coefficients",
    "series_id:s term:s coef:5 beta:7 intercept:4",
    lambda s, d: rr.coefficients(rr.ridge_models(har_split(s, d), SETS), SETS),
    sql_r(
        " UNION ALL ".join(
            f"SELECT series_id, '{x}' AS term, w{i} AS coef, b{i} AS beta, c AS intercept FROM rg" for i, x in enumerate(HAR)
        ),
        *RIDGE,
    ),
)
_ALPHAS = "(VALUES (CAST(0.1 AS DOUBLE)), (CAST(1 AS DOUBLE)), (CAST(10 AS DOUBLE))) v(alpha)"
FOLDS = (
    HAR_TABLE,
    "fo AS (SELECT *, CASE WHEN hpos <= hn - 5 * (hn // 6) THEN 0 ELSE (hpos - (hn - 5 * (hn // 6)) - 1) // (hn // 6) + 1 END AS fold FROM ht)",
    f"ft AS (SELECT fo.*, f, alpha FROM fo JOIN (SELECT unnest(generate_series(1, 5)) AS f) ON fold < f, {_ALPHAS})",
    *sq.ridge("ft", "series_id, f, alpha", HAR, "target", "alpha", False, "fg"),
    f"fe AS (SELECT series_id, alpha, f, sqrt(avg(pow(s.target - ({score_sql('fg', HAR)}), 2))) AS e FROM fo s JOIN fg ON fg.series_id = s.series_id AND fg.f = s.fold GROUP BY ALL)".replace(
        "SELECT series_id, alpha, f,", "SELECT fg.series_id, fg.alpha, fg.f,"
    ),
)
register(
    "f2_alpha_grid",
    "series_id:s alpha:2 cv_rmse:4 is_best:b",
    lambda s, d: rr.alpha_grid(har(s, d)),
    sql_r(
        "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cv_rmse, alpha) = 1 AS is_best FROM "
        "(SELECT series_id, alpha, avg(e) AS cv_rmse FROM fe GROUP BY 1, 2)",
        *FOLDS,
    ),
)


def sets_sql(src: str, sets: dict, tag: str) -> tuple[list[str], str, str]:
    """Fits of several feature sets, their forecasts and their losses."""
    ctes, preds, fits = [], [], []
    for i, (name, xs) in enumerate(sets.items()):
        f = f"{tag}{i}"
        ctes += sq.ridge(src, "series_id", list(xs), "target", 10, True, f, TRAIN)
        preds.append(
            f"SELECT s.series_id, s.t, '{name}' AS model, s.target AS actual, {score_sql(f, xs)} AS pred "
            f"FROM {src} s JOIN {f} ON {f}.series_id = s.series_id WHERE {TEST}"
        )
        fits.append((name, f, list(xs)))
    ctes.append(f"{tag}p AS ({' UNION ALL '.join(preds)})")
    ctes.append(
        f"{tag}l AS (SELECT series_id, model, sqrt(avg(pow(actual - pred, 2))) AS rmse, {QL} AS qlike, count(*) AS n FROM {tag}p GROUP BY 1, 2)"
    )
    return ctes, fits


_V, _VF = sets_sql("ah2", rt.AHAR_SETS, "hv")


def _w(xs, fit, name):
    return f"{fit}.w{xs.index(name)}" if name in xs else "NULL"


_VT = " UNION ALL ".join(
    f"SELECT series_id, '{n}' AS model, {_w(xs, f, 'leverage_term')} AS lev_coef, "
    f"{_w(xs, f, 'rv_neg_lag_1')} - {_w(xs, f, 'rv_pos_lag_1')} AS asym_coef FROM {f}"
    for n, f, xs in _VF
)
register(
    "f3_har_variants",
    "series_id:s model:s rmse:4 qlike:3 n:i lev_coef:5 asym_coef:5",
    lambda s, d: rr.har_variant_metrics(rt.ahar_table(rets(s, d)), rt.AHAR_SETS),
    sql_r(
        f"SELECT * FROM hvl JOIN ({_VT}) USING (series_id, model)",
        *AHAR_SQL,
        "ah2 AS (SELECT *, pos2 AS hpos, count(*) OVER (PARTITION BY series_id) AS hn FROM ah)",
        *_V,
    ),
)
MOMENT_SETS = {"HAR_baseline": HAR, "HAR+Moments": list(it.MOMENT_FEATURES)}
_MM, _ = sets_sql("mf", MOMENT_SETS, "mm")
_LOSS = "series_id:s model:s rmse:4 qlike:2 n:i"
register(
    "f4_moment_augmented",
    _LOSS,
    lambda s, d: rr.har_variant_metrics(moment_table(s, d), MOMENT_SETS),
    sql_i("lineitem", "SELECT * FROM mml", *MOMF, *_MM),
)
INDEX = ["index_lag1", "index_lag5", "index_vol_21", "high_index"]
SPILL_SETS = {"HAR": HAR, "HAR+Spillover": HAR + list(SPILL), "HAR+Index": HAR + list(SPILL) + INDEX}


def spill_table(s, d, index=None, value="index"):
    df = cr.spillover_features(rv_panel(rets(s, d)), SERIES)
    index = sparse_index(rets(s, d)) if index is None else index
    full = cr.index_features(df, index, value)
    return full.dropna("any", subset=[*SPILL_SETS["HAR+Index"], "target"])


_SI = (
    "si0 AS (SELECT sx.*, last_value(idx.\"index\" IGNORE NULLS) OVER (PARTITION BY sx.series_id ORDER BY sx.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ix "
    "FROM sx LEFT JOIN idx ON sx.t = idx.t)",
    f"si1 AS (SELECT si0.*, {sq.lag('ix', part='si0.series_id')} AS index_lag1, {sq.roll('avg', 'ix', 5, 3, skip=1, part='si0.series_id')} AS index_lag5, "
    f"{sq.roll('stddev_samp', 'ix', 21, 10, skip=1, part='si0.series_id')} AS index_vol_21, CASE WHEN {sq.lag('ix', part='si0.series_id')} > hi THEN 1.0 ELSE 0.0 END AS high_index "
    "FROM si0 JOIN (SELECT series_id, quantile_cont(ix, 0.75) AS hi FROM si0 GROUP BY 1) q ON q.series_id = si0.series_id)",
    "si AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS hpos, count(*) OVER (PARTITION BY series_id) AS hn FROM si1 WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in (*SPILL_SETS["HAR+Index"], "target")) + ")",
)
_SS, _ = sets_sql("si", SPILL_SETS, "ss")
register(
    "f5_spillover_forecast",
    _LOSS,
    lambda s, d: rr.har_variant_metrics(spill_table(s, d), SPILL_SETS),
    sql_r("SELECT * FROM ssl", PN, PV, JOINED, *SPARSE, *OTHERS, *_SI, *_SS),
)


def wf_sql(alpha, first: int, rolling: int | None, tag: str, xs=HAR) -> list[str]:
    low = "" if rolling is None else f" AND s.blk >= wb - {rolling // 21}"
    return [
        f"{tag}b AS (SELECT *, (hpos - 1) // 21 AS blk FROM ht)",
        f"{tag}w AS (SELECT DISTINCT series_id, blk AS wb FROM {tag}b WHERE blk >= {first // 21})",
        f"{tag}t AS (SELECT s.*, wb FROM {tag}b s JOIN {tag}w ON s.series_id = {tag}w.series_id AND s.blk < wb{low})",
        *sq.ridge(f"{tag}t", "series_id, wb", list(xs), "target", alpha, True, f"{tag}f"),
        f"{tag}p AS (SELECT s.series_id, s.t, s.blk, {tag}f.n AS n_train, s.hn, s.target AS actual, {score_sql(tag + 'f', xs)} AS pred "
        f"FROM {tag}b s JOIN {tag}f ON {tag}f.series_id = s.series_id AND {tag}f.wb = s.blk)",
        f"{tag}q AS (SELECT * FROM {tag}p WHERE blk * 21 < hn - 21)",
        metrics_sql(f"{tag}m", f"{tag}q", "series_id, blk"),
        f"{tag}x AS (SELECT m.*, blk - {first // 21} AS \"window\", n_train, test_start, test_end FROM {tag}m m JOIN (SELECT series_id, blk, max(n_train) AS n_train, "
        f"min(t) AS test_start, max(t) AS test_end FROM {tag}q GROUP BY 1, 2) USING (series_id, blk))",
    ]


WF = [HAR_TABLE, *wf_sql(12, 756, None, "we"), *wf_sql(12, 756, 756, "wr")]
_BOTH = "(SELECT *, 'expanding' AS mode FROM wex UNION ALL SELECT *, 'rolling' FROM wrx)"
_W = "window:i n_train:i test_start:d test_end:d rmse:4 mae:4 qlike:3 dir_acc:5"


@shared()
def experiments(s, d):
    return rr.walk_forward_experiments(har(s, d))


register(
    "f6_walk_forward", f"series_id:s mode:s {_W}", experiments, sql_r(f"SELECT * FROM {_BOTH}", *WF)
)
register(
    "f7_walk_forward_summary",
    "series_id:s mode:s n_windows:i mean_rmse:4 std_rmse:4 min_rmse:4 max_rmse:4 mean_mae:4 mean_qlike:3 mean_dir_acc:5",
    lambda s, d: rr.walk_forward_summary(experiments(s, d)),
    sql_r(
        "SELECT series_id, mode, count(*) AS n_windows, avg(rmse) AS mean_rmse, stddev_samp(rmse) AS std_rmse, min(rmse) AS min_rmse, "
        f"max(rmse) AS max_rmse, avg(mae) AS mean_mae, avg(qlike) AS mean_qlike, avg(dir_acc) AS mean_dir_acc FROM {_BOTH} GROUP BY 1, 2",
        *WF,
    ),
)
HAR4 = [*HAR, "abs_ret_lag1"]


@shared()
def retrained(s, d):
    table = har(s, d)
    models = rr.walk_forward_models(table, HAR4, 10.0, 252, 21)
    return rr.walk_forward_predictions(table, models, HAR4, 21, whole_only=False)


register(
    "f9_periodic_retrain",
    "series_id:s t:d n_train:i actual:4 pred:4",
    retrained,
    sql_r("SELECT * FROM wop", HAR_TABLE, *wf_sql(10, 252, None, "wo", HAR4)),
)
_HIST = "(SELECT h.*, wb - 36 AS \"window\", window_end FROM whf h JOIN (SELECT series_id, blk, hn, max(t) AS window_end FROM whb GROUP BY ALL) e ON e.series_id = h.series_id AND e.blk = h.wb - 1 WHERE wb * 21 < hn - 21)"
HIST = [HAR_TABLE, *wf_sql(10, 756, None, "wh")]
HIST.append(
    "hs AS (" + " UNION ALL ".join(
        f"SELECT series_id, \"window\", window_end, n AS n_train, c + {' + '.join(f'b{j} * m{j}' for j in range(3))} AS intercept, '{x}' AS term, w{i} AS coef "
        f"FROM {_HIST} JOIN whf_m USING (series_id, wb)".replace(" n AS n_train", " h2.n AS n_train").replace(_HIST, f"{_HIST} h2")
        for i, x in enumerate(HAR)
    ) + ")"
)


@shared()
def history(s, d):
    return rr.coefficient_history(har(s, d))


register(
    "f12_coefficient_history",
    "series_id:s window:i window_end:d n_train:i intercept:4 term:s coef:4",
    history,
    sql_r("SELECT * FROM hs", *HIST),
)
register(
    "f13_coefficient_drift",
    "series_id:s window:i window_end:d l2_drift:4 cosine_sim:5 max_abs_change:4",
    lambda s, d: rr.coefficient_drift(history(s, d)),
    sql_r(
        "SELECT series_id, \"window\", max(window_end) AS window_end, sqrt(sum(pow(coef - b, 2))) AS l2_drift, CASE WHEN sqrt(sum(coef * coef) * sum(b * b)) > 1e-10 "
        "THEN sum(coef * b) / sqrt(sum(coef * coef) * sum(b * b)) ELSE 0 END AS cosine_sim, max(abs(coef - b)) AS max_abs_change FROM "
        "(SELECT *, lag(coef) OVER (PARTITION BY series_id, term ORDER BY \"window\") AS b FROM hs) WHERE b IS NOT NULL GROUP BY 1, 2",
        *HIST,
    ),
)
register(
    "f10_bootstrap_intervals",
    "series_id:s t:d actual:4 point_pred:4 lower:4 upper:4 in_interval:i pi_width:4",
    lambda s, d: rr.bootstrap_intervals(har(s, d)),
)
register(
    "f11_interval_coverage",
    "series_id:s n:i coverage_pct:4 mean_width:4",
    lambda s, d: rr.coverage(rr.bootstrap_intervals(har(s, d))),
)


@shared()
def regime_table(s, d):
    return cr.regime_features(har(s, d), tercile_regimes(vols(s, d))).withColumn(
        "regime", F.col("regime_lag1")
    )


REG = (
    _VOL, *TERCILE, HAR_TABLE,
    "rt0 AS (SELECT ht.*, CASE tl.regime WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END AS g FROM ht LEFT JOIN tl ON ht.series_id = tl.series_id AND ht.t = tl.t)",
    f"rt AS (SELECT *, coalesce({lag('g')}, 1) AS regime FROM rt0)",
    *sq.ridge("rt", "series_id", HAR, "target", 10, True, "ra", TRAIN),
    *sq.ridge("rt", "series_id, regime", HAR, "target", 10, True, "ro", TRAIN),
    f"rp AS (SELECT s.series_id, s.t, s.regime, s.target AS actual, {score_sql('ra', HAR)} AS pa, {score_sql('ro', HAR)} AS po, ro.n AS ron FROM rt s "
    f"JOIN ra ON ra.series_id = s.series_id LEFT JOIN ro ON ro.series_id = s.series_id AND ro.regime = s.regime WHERE {TEST})",
    "rq AS (SELECT series_id, t, regime, 'global_har' AS model, actual, pa AS pred FROM rp UNION ALL "
    "SELECT series_id, t, regime, 'regime_har', actual, CASE WHEN ron >= 50 THEN po ELSE pa END FROM rp)",
)
register(
    "f15_regime_ridge",
    "series_id:s t:d regime:i model:s actual:4 pred:4",
    lambda s, d: rr.regime_predictions(regime_table(s, d)),
    sql_r("SELECT * FROM rq", *REG),
)


@shared()
def all_predictions(s, d):
    return stack(naive(s, d), har_predictions(s, d))


FOUR = [*MODELS, "har"]
COMBO = (
    *PRED, *RIDGE[1:],
    f"ap AS (SELECT series_id, t, model, actual, pred FROM pr UNION ALL SELECT s.series_id, s.t, 'har', s.target, {score_sql('rg', HAR)} FROM ht s JOIN rg ON rg.series_id = s.series_id WHERE {TEST})",
    "av AS (SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY t) <= floor(count(*) OVER (PARTITION BY series_id, model) * 0.3) AS is_val FROM ap)",
    "iw AS (SELECT series_id, model, i / sum(i) OVER (PARTITION BY series_id) AS weight FROM (SELECT series_id, model, 1 / (sqrt(avg(pow(actual - pred, 2))) + 1e-10) AS i FROM av WHERE is_val GROUP BY 1, 2))",
)
register(
    "f18_simple_combination",
    "series_id:s t:d actual:4 pred:4",
    lambda s, d: rr.simple_combination(all_predictions(s, d)),
    sql_r("SELECT series_id, t, max(actual) AS actual, avg(pred) AS pred FROM ap GROUP BY 1, 2", *COMBO),
)
register(
    "f19_inverse_rmse_weights",
    "series_id:s model:s weight:6",
    lambda s, d: rr.inverse_rmse_weights(all_predictions(s, d)),
    sql_r("SELECT * FROM iw", *COMBO),
)
register(
    "f19_weighted_combination",
    "series_id:s t:d actual:4 pred:4",
    lambda s, d: rr.weighted_combination(
        all_predictions(s, d), rr.inverse_rmse_weights(all_predictions(s, d)), "InvRMSE"
    ),
    sql_r(
        "SELECT series_id, t, max(actual) AS actual, sum(pred * weight) AS pred FROM ap JOIN iw USING (series_id, model) GROUP BY 1, 2",
        *COMBO,
    ),
)
_M = range(len(FOUR))


def _subset_fit(on: list[int]) -> str:
    """Least squares on some of the models: weights, 0 for the others, and the loss."""
    loss = "yy" + "".join(f" - 2 * w{i} * c{i}" for i in on) + "".join(f" + w{i} * w{j} * g{min(i, j)}{max(i, j)}" for i in on for j in on)
    weights = ", ".join(f"w{i}" if i in on else f"0.0 AS w{i}" for i in _M)
    return f"SELECT series_id, {weights}, {loss} AS loss FROM {sq.solved('gg', on) if on else 'gg'}"


# non-negative least squares as the best of all subsets whose weights are all positive or zero
WEIGHTS = (
    *COMBO,
    "gv AS (SELECT series_id, t, max(actual) AS y, "
    + ", ".join(f"max(pred) FILTER (model = '{m}') AS p{i}" for i, m in enumerate(FOUR))
    + " FROM av WHERE is_val GROUP BY 1, 2)",
    "gg AS (SELECT series_id, sum(y * y) AS yy, "
    + ", ".join([f"sum(p{i} * p{j}) AS g{i}{j}" for i in _M for j in _M if i <= j] + [f"sum(p{i} * y) AS c{i}" for i in _M])
    + " FROM gv WHERE " + " AND ".join(f"p{i} IS NOT NULL" for i in _M) + " GROUP BY 1)",
    "gs AS (" + " UNION ALL ".join(_subset_fit([i for i in _M if mask >> i & 1]) for mask in range(2 ** len(FOUR))) + ")",
    "gb AS (SELECT *, " + " + ".join(f"w{i}" for i in _M) + " AS total FROM gs WHERE "
    + " AND ".join(f"w{i} >= 0" for i in _M) + " QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY loss) = 1)",
    "gw AS (" + " UNION ALL ".join(
        f"SELECT series_id, '{m}' AS model, CASE WHEN total > 1e-10 THEN w{i} / total ELSE {1 / len(FOUR)} END AS weight FROM gb"
        for i, m in enumerate(FOUR)
    ) + ")",
)
register(
    "f20_granger_ramanathan",
    "series_id:s model:s weight:6",
    lambda s, d: rr.granger_ramanathan_weights(all_predictions(s, d), FOUR),
    sql_r("SELECT * FROM gw", *WEIGHTS),
)
register(
    "f21_combination_summary",
    "series_id:s model:s rmse:4 n:i is_best:b",
    lambda s, d: rr.combination_summary(all_predictions(s, d), FOUR),
    sql_r(
        "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rmse, model) = 1 AS is_best FROM ("
        "SELECT series_id, model, sqrt(avg(pow(actual - pred, 2))) AS rmse, count(*) AS n FROM every GROUP BY 1, 2)",
        *WEIGHTS,
        "later AS (SELECT * FROM av WHERE NOT is_val)",
        "every AS (SELECT series_id, t, model, actual, pred FROM later UNION ALL "
        "SELECT series_id, t, 'Simple', max(actual), avg(pred) FROM later GROUP BY 1, 2 UNION ALL "
        "SELECT series_id, t, 'InvRMSE', max(actual), sum(pred * weight) FROM later JOIN iw USING (series_id, model) GROUP BY 1, 2 UNION ALL "
        "SELECT series_id, t, 'GrangerRam', max(actual), sum(pred * weight) FROM later JOIN gw USING (series_id, model) GROUP BY 1, 2)",
    ),
)

BASE = list(rt.BASE_FEATURES)
# what the enriched matrix adds to the base features, by the query that has each column's twin
ADDED = {
    "t2_atr": [f"atr{m}_{k}d" for k in (5, 14, 21) for m in ("", "_norm")],
    "t3_bollinger": ["bb_width_20d", "bb_pct_b_20d"],
    "t4_rsi": ["rsi_14d", "rsi_extreme_dist"],
    "t5_price_gap": [f"price_ma_gap{m}_{k}d" for m in ("", "_abs") for k in (10, 50)],
    "t6_macd": ["macd_norm", "macd_abs_norm", "macd_delta"],
    "t7_volume_ratio": ["vol_ratio_21d", "vol_x_ret_lag_1"],
    "t8_sign_streak": ["return_streak"],
    "m1_term_slopes": ["ts_slope_5_21", "ts_slope_21_63", "ts_slope_5_63"],
    "m2_vol_of_vol": ["vov_10d", "vov_21d"],
    "m3_range_spread": ["park_gk_spread_21d", "park_gk_spread_norm"],
    "m4_rolling_shape": ["realized_skew_21d", "realized_kurt_21d"],
    "m5_up_down_ratio": ["updown_vol_ratio_21d"],
    "m6_jump_count": ["jump_count_21d"],
    "m8_dispersion": ["cross_asset_dispersion", "dispersion_5d_avg"],
    "m9_benchmark_context": ["bench_vol"],
    "m10_rolling_beta": ["rolling_beta_21d", "beta_instability_21d"],
    "m11_series_spread": ["spread_mean", "spread_vol"],
    "m12_bull_regime": ["bull_regime_flag"],
}
MATRIX = [*BASE, *(c for cols in ADDED.values() for c in cols)]


@shared(store=True)
def enriched(s, d):
    """Base, technical, surface and cross-series features of a row, complete rows only."""
    # one plan of all features takes the planner minutes, so daily tables are written in between
    df = stored(te.technical_features(stored(vols(s, d), "volatility")), "technical")
    df = stored(te.surface_features(df), "surface")
    panel = stored(ret_panel(rets(s, d)), "panel")
    df = cr.dispersion(df, panel, SERIES)
    df = cr.benchmark_context(df, BENCHMARK, "vol_c2c_21d", "bench_vol")
    df = cr.rolling_beta(df, panel, SERIES, BENCHMARK)
    df = cr.spread_features(df, panel, "R", "N")
    df = cr.bull_regime(df, panel, BENCHMARK)
    added = [c for cols in ADDED.values() for c in cols]
    base = rt.base_features(rets(s, d)).drop("pos")
    # the benchmark's beta to itself is one up to the last bits, which must not count as a feature
    df = stored(df.select("series_id", "t", *[F.round(c, 8).alias(c) for c in added]), "added")
    full = base.join(df, ["series_id", "t"]).dropna("any", subset=added)
    return full.withColumn("pos", F.row_number().over(by_series()))


def matrix_train(s, d):
    return rr.train_test(enriched(s, d)).filter(~F.col("is_test"))


_ADDED = ", ".join(MATRIX[len(BASE):])
MTRAIN = (
    *BASE_SQL,
    "em AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS mpos, count(*) OVER (PARTITION BY series_id) AS mn "
    f"FROM (SELECT series_id, t, {', '.join(BASE)}, target, {_ADDED} FROM bf "
    + " ".join(f"JOIN (SELECT series_id, t, {', '.join(f'round({c}, 8) AS {c}' for c in cols)} FROM ({QUERIES[q].sql})) USING (series_id, t)" for q, cols in ADDED.items())
    + ") WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in MATRIX[len(BASE):]) + ")",
    "btr AS MATERIALIZED (SELECT * FROM em WHERE mpos <= mn - 500)",
)
register(
    "f22_pearson_ranking",
    "series_id:s feature:s pearson_abs_corr:6 rank_pearson:i",
    lambda s, d: se.pearson_ranking(matrix_train(s, d), MATRIX, None),
    sql_r(
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(pearson_abs_corr, 9) DESC NULLS LAST, feature) AS rank_pearson FROM ("
        + " UNION ALL ".join(
            f"SELECT series_id, '{c}' AS feature, CASE WHEN NOT isnan(corr({c}, target)) THEN abs(corr({c}, target)) END AS pearson_abs_corr FROM btr GROUP BY series_id" for c in MATRIX
        )
        + "))",
        *MTRAIN,
    ),
)
_NT = ", ".join(
    f"ntile(10) OVER (PARTITION BY series_id ORDER BY round({c}, 9), t) AS {c}" for c in (*MATRIX, "target")
)
register(
    "f23_mutual_information",
    "series_id:s feature:s mutual_info:6 rank_mi:i",
    lambda s, d: se.mutual_information_ranking(matrix_train(s, d), MATRIX, top_k=None),
    sql_r(
        "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(mutual_info, 9) DESC, feature) AS rank_mi FROM (SELECT series_id, feature, sum(c / n * ln(c * n / (nx * ny))) AS mutual_info FROM ("
        "SELECT *, sum(c) OVER (PARTITION BY series_id, feature) AS n, sum(c) OVER (PARTITION BY series_id, feature, b) AS nx, sum(c) OVER (PARTITION BY series_id, feature, target) AS ny FROM ("
        + " UNION ALL ".join(
            f"SELECT series_id, '{c}' AS feature, {c} AS b, target, CAST(count(*) AS DOUBLE) AS c FROM nt GROUP BY ALL" for c in MATRIX
        )
        + ")) GROUP BY 1, 2)",
        *MTRAIN,
        f"nt AS (SELECT series_id, {_NT} FROM btr)",
    ),
)
register(
    "f24_tree_gain_ranking",
    "series_id:s feature:s tree_gain:6 rank_tree:i",
    lambda s, d: se.tree_gain_ranking(matrix_train(s, d), MATRIX, top_k=None),
)


def _elimination(s, d):
    return se.recursive_elimination(matrix_train(s, d), MATRIX)


register(
    "f25_recursive_elimination",
    "series_id:s n_selected:i feature:s",
    lambda s, d: _elimination(s, d).select(
        "series_id", "n_selected", F.explode("selected_features").alias("feature")
    ),
)


def merged_rankings(s, d, top_k=None):
    train = matrix_train(s, d)
    return se.merge_rankings(
        se.pearson_ranking(train, MATRIX, top_k),
        se.mutual_information_ranking(train, MATRIX, top_k=top_k),
        se.tree_gain_ranking(train, MATRIX, top_k=top_k),
        se.recursive_elimination(train, MATRIX),
    )


register(
    "f26_merged_rankings",
    "series_id:s feature:s pearson_abs_corr:6 rank_pearson:i mutual_info:6 rank_mi:i tree_gain:6 rank_tree:i rfecv_selected:i avg_rank:4",
    merged_rankings,
)
register(
    "f27_selection_summary",
    "series_id:s features_ranked:i top_pearson:s top_mi:s top_tree:s",
    lambda s, d: se.selection_summary(merged_rankings(s, d)),
)
_ATTR = (
    *RIDGE,
    "at0 AS (SELECT s.series_id, "
    + ", ".join(f"b{i} * ({x} - rg_m.m{i}) AS p{i}" for i, x in enumerate(HAR))
    + f" FROM ht s JOIN rg ON rg.series_id = s.series_id JOIN rg_m ON rg_m.series_id = s.series_id WHERE {TEST})",
)
register(
    "f28_linear_attribution",
    "series_id:s feature:s mean_abs:4 mean_signed:4 direction:s place:i",
    lambda s, d: rr.linear_attribution(har(s, d)),
    sql_r(
        "SELECT *, CASE WHEN mean_signed > 0 THEN 'increases forecast' ELSE 'decreases forecast' END AS direction, "
        "row_number() OVER (PARTITION BY series_id ORDER BY mean_abs DESC, feature) AS place FROM ("
        + " UNION ALL ".join(
            f"SELECT series_id, '{x}' AS feature, avg(abs(p{i})) AS mean_abs, avg(p{i}) AS mean_signed FROM at0 GROUP BY 1" for i, x in enumerate(HAR)
        )
        + ")",
        *_ATTR,
    ),
)
register(
    "f29_dependence_curve",
    "series_id:s t:d rv_lag_1:4 target:4 smoothed:4",
    lambda s, d: rr.dependence_curve(har_split(s, d).filter("is_test"), "rv_lag_1", "target"),
    sql_r(
        "SELECT series_id, t, rv_lag_1, target, avg(target) OVER (PARTITION BY series_id ORDER BY rv_lag_1, t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS smoothed "
        "FROM ht WHERE hpos > hn - 500",
        HAR_TABLE,
    ),
)

# --- conditional variance ------------------------------------------------------------

GARCH0 = (
    "g0 AS (SELECT series_id, t, 100 * log_return AS r, 100 * (log_return - avg(log_return) OVER (PARTITION BY series_id)) AS e FROM r WHERE log_return IS NOT NULL)",
    f"g1 AS (SELECT *, avg(e * e) OVER (PARTITION BY series_id) AS s2, row_number() OVER (PARTITION BY series_id ORDER BY t) AS pos, {lag('e')} AS e1 FROM g0)",
)


def impact_params(s, d):
    """Parameter rows with the level of every series, one linear and one log model."""
    base = ga.returns_pct(rets(s, d)).groupBy("series_id").agg(F.max("s2").alias("s2"))
    cells = F.array(
        F.struct(
            F.lit("GJR-GARCH").alias("model"), F.lit(0.05).alias("alpha"), F.lit(0.05).alias("gamma"),
            F.lit(0.90).alias("beta"), (F.col("s2") * (1 - 0.05 - 0.90 - 0.05 / 2)).alias("omega"),
        ),
        F.struct(
            F.lit("EGARCH").alias("model"), F.lit(0.10).alias("alpha"), F.lit(-0.05).alias("gamma"),
            F.lit(0.95).alias("beta"), (F.ln("s2") * (1 - 0.95)).alias("omega"),
        ),
    )
    return base.select("series_id", F.inline(cells))


register(
    "f30_news_impact",
    "series_id:s model:s point:i eps:6 h_next:2",
    lambda s, d: ga.news_impact(impact_params(s, d)),
    sql_r(
        "SELECT series_id, model, point, eps, CASE WHEN model = 'EGARCH' THEN exp(omega + 0.1 * (abs(z) - sqrt(2 / pi())) - 0.05 * z + 0.95 * lb) "
        "ELSE omega + (0.05 + CASE WHEN eps < 0 THEN 0.05 ELSE 0 END) * eps * eps + 0.9 * greatest(omega / (1 - 0.05 - 0.9 - 0.025 + 1e-10), 1e-4) END AS h_next FROM ("
        "SELECT *, eps / sqrt(greatest(exp(lb), 1e-6)) AS z FROM (SELECT *, CASE WHEN model = 'EGARCH' THEN omega / (0.05 + 1e-10) ELSE 0 END AS lb FROM ("
        "SELECT series_id, model, CASE WHEN model = 'EGARCH' THEN ln(s2) * 0.05 ELSE s2 * (1 - 0.05 - 0.9 - 0.025) END AS omega, point, -5 + point * CAST(10 AS DOUBLE) / 99 AS eps "
        "FROM (SELECT series_id, max(s2) AS s2 FROM g1 GROUP BY 1), (VALUES ('GJR-GARCH'), ('EGARCH')) v(model), (SELECT unnest(generate_series(0, 99)) AS point))))",
        *GARCH0,
    ),
)
_GRIDSQL = ", ".join(
    f"('{m}', CAST({a} AS DOUBLE), CAST({g} AS DOUBLE), CAST({b} AS DOUBLE))"
    for m, gs in (("GARCH", (0.0,)), ("GJR-GARCH", (0.05, 0.10)))
    for a in ga.GRID_ALPHA for g in gs for b in ga.GRID_BETA
    if a + b + g / 2 < 1.0
)
SCAN = (
    *GARCH0,
    f"gg AS (SELECT g1.*, model, alpha, gamma, beta, s2 * (1 - alpha - beta - gamma / 2) AS omega, CASE WHEN pos = 1 THEN s2 ELSE s2 * (1 - alpha - beta - gamma / 2) + "
    f"(alpha + CASE WHEN e1 < 0 THEN gamma ELSE 0 END) * e1 * e1 END AS f FROM g1, (VALUES {_GRIDSQL}) v(model, alpha, gamma, beta))",
    "gh AS (SELECT a.series_id, a.model, a.alpha, a.gamma, a.beta, a.t, any_value(a.e) AS e, any_value(a.omega) AS omega, sum(pow(a.beta, a.pos - b.pos) * b.f) AS h FROM gg a JOIN gg b "
    "ON a.series_id = b.series_id AND a.model = b.model AND a.alpha = b.alpha AND a.gamma = b.gamma AND a.beta = b.beta AND b.pos BETWEEN a.pos - 340 AND a.pos GROUP BY ALL)",
    "gs AS (SELECT series_id, model, alpha, gamma, beta, count(*) AS n, max(omega) AS omega, -0.5 * sum(ln(2 * pi()) + ln(greatest(h, 1e-12)) + e * e / greatest(h, 1e-12)) AS loglik FROM gh GROUP BY ALL)",
)
_SC = "series_id:s model:s alpha:3 gamma:3 beta:3 n:i omega:3 loglik:3 aic:3 bic:3 persistence:4"
register(
    "f31_garch_scan",
    _SC,
    lambda s, d: ga.garch_scan(rets(s, d)),
    sql_r(
        "SELECT *, alpha + beta + gamma / 2 AS persistence, 2 * k - 2 * loglik AS aic, k * ln(n) - 2 * loglik AS bic FROM (SELECT *, CASE WHEN model = 'GARCH' THEN 3 ELSE 4 END AS k FROM gs)",
        *SCAN,
    ),
)
# log-variance step by step: each grid point and series is one row of the recursion
EGARCH_SCAN = (
    "q0 AS (SELECT series_id, t, 100 * log_return - avg(100 * log_return) OVER (PARTITION BY series_id) AS e FROM r WHERE log_return IS NOT NULL)",
    "q1 AS (SELECT *, avg(e * e) OVER (PARTITION BY series_id) AS s2, count(*) OVER (PARTITION BY series_id) AS n, "
    "row_number() OVER (PARTITION BY series_id ORDER BY t) AS pos FROM q0)",
    "qg AS (SELECT CAST(a AS DOUBLE) AS alpha, CAST(g AS DOUBLE) AS gamma, CAST(b AS DOUBLE) AS beta FROM "
    + ", ".join(
        f"(VALUES {', '.join(f'({v})' for v in grid)}) {name}({name[-1]})"
        for name, grid in (("va", ga.EGARCH_ALPHA), ("vg", ga.EGARCH_GAMMA), ("vb", ga.EGARCH_BETA))
    )
    + ")",
    "qe AS (SELECT * FROM (WITH RECURSIVE fold AS ("
    "SELECT series_id, s2, n, alpha, gamma, beta, (1 - beta) * ln(s2) AS omega, CAST(0 AS BIGINT) AS seen, ln(s2) AS lh, CAST(0 AS DOUBLE) AS ll "
    "FROM (SELECT DISTINCT series_id, s2, n FROM q1) CROSS JOIN qg "
    "UNION ALL SELECT f.series_id, f.s2, f.n, alpha, gamma, beta, omega, seen + 1, "
    "omega + beta * lh + alpha * (abs(e / exp(lh / 2)) - sqrt(2 / pi())) + gamma * e / exp(lh / 2), "
    "ll - 0.5 * (ln(2 * pi()) + lh + e / exp(lh / 2) * e / exp(lh / 2)) "
    "FROM fold f JOIN q1 ON q1.series_id = f.series_id AND q1.pos = seen + 1) "
    "SELECT series_id, 'EGARCH' AS model, alpha, gamma, beta, n, omega, ll AS loglik, 8 - 2 * ll AS aic, "
    "4 * ln(n) - 2 * ll AS bic, beta AS persistence FROM fold WHERE seen = n))",
)
register("f31_egarch_scan", _SC, lambda s, d: ga.egarch_scan(rets(s, d)), sql_r("SELECT * FROM qe", *EGARCH_SCAN))
register(
    "f31_best_model",
    _SC,
    lambda s, d: ga.best_models(ga.volatility_scan(rets(s, d))),
    sql_r(
        "SELECT * FROM (SELECT series_id, model, alpha, gamma, beta, n, omega, loglik, 2 * k - 2 * loglik AS aic, k * ln(n) - 2 * loglik AS bic, "
        "alpha + beta + gamma / 2 AS persistence FROM (SELECT *, CASE WHEN model = 'GARCH' THEN 3 ELSE 4 END AS k FROM gs) "
        "UNION ALL SELECT * FROM qe) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY aic, model, alpha, gamma, beta) = 1",
        *SCAN,
        *EGARCH_SCAN,
    ),
)
register(
    "f32_conditional_vs_realised",
    "series_id:s rmse:3 mae:3 corr:6 worst_date:d worst_gap:3",
    lambda s, d: ga.conditional_against_realised(rets(s, d), 0.05, 0.90),
    sql_r(
        "SELECT series_id, sqrt(avg(gap * gap)) AS rmse, avg(abs(gap)) AS mae, corr(rvol, cvol) AS corr, arg_max(t, (gap, t)) AS worst_date, max(gap) AS worst_gap FROM "
        "(SELECT *, rvol - cvol AS gap FROM (SELECT gw.series_id, gw.t, sqrt(v * 252) AS cvol, "
        + sq.roll("stddev_samp", "r", 20, part="gw.series_id").replace("ORDER BY t", "ORDER BY gw.t")
        + " * sqrt(252) AS rvol FROM gw JOIN gd ON gd.series_id = gw.series_id AND gd.t = gw.t)) WHERE rvol IS NOT NULL GROUP BY 1",
        *GARCH0,
        "gw AS (SELECT *, CASE WHEN pos = 1 THEN s2 ELSE s2 * (1 - 0.05 - 0.9) + 0.05 * e1 * e1 END AS f FROM g1)",
        sq.decayed("gw", "gd", "f", 0.90, 360),
    ),
)

# --- tree models: refitted for each series every 21 rows, all windows in one job -------


def base_table(s, d):
    return rt.base_features(rets(s, d))


register(
    "f8_boosted_walk_forward",
    "series_id:s window:i n_train:i n:i test_start:d test_end:d rmse:4 qlike:3",
    lambda s, d: se.window_metrics(bo.forecasts(bo.walk_forward(base_table(s, d), BASE, bo.FORECAST))),
)


@shared(store=True)
def importance_history(s, d):
    return bo.importances(bo.walk_forward(base_table(s, d), BASE, bo.HISTORY))


register(
    "f14_importance_history",
    "series_id:s window:i feature:s importance:6 mean_importance:6 place:i scaled:6",
    lambda s, d: se.importance_profile(importance_history(s, d)),
)
register(
    "x20_importance_stability",
    "series_id:s window:i spearman_rho:6 p_value:6 n:i",
    lambda s, d: hy.rank_stability(importance_history(s, d), "window", "feature", "importance"),
)


@shared()
def corr_history(s, d):
    return se.correlation_history(rt.base_features(rets(s, d)), BASE)


CORRH = (
    *BASE_SQL,
    "ch0 AS (SELECT *, (pos - 1) // 252 AS wn FROM bf)",
    "chw AS ("
    + " UNION ALL ".join(
        f"SELECT series_id, wn, '{c}' AS feature, n, CASE WHEN isnan(x) THEN NULL ELSE x END AS importance FROM "
        f"(SELECT series_id, wn, count(*) AS n, abs(corr({c}, target)) AS x FROM ch0 GROUP BY 1, 2)" for c in BASE
    )
    + ")",
)
register(
    "f14_correlation_profile",
    "series_id:s window:i n:i feature:s importance:6 mean_importance:6 place:i scaled:6",
    lambda s, d: se.importance_profile(corr_history(s, d)),
    sql_r(
        "SELECT series_id, wn AS \"window\", n, feature, importance, mean_importance, place, coalesce((importance - lo) / nullif(hi - lo, 0), 0) AS scaled FROM chw JOIN ("
        "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mean_importance DESC, feature) AS place FROM (SELECT series_id, feature, avg(importance) AS mean_importance, "
        "min(importance) AS lo, max(importance) AS hi FROM chw GROUP BY 1, 2)) USING (series_id, feature) WHERE place <= 10",
        *CORRH,
    ),
)
register(
    "x20_rank_stability",
    "series_id:s window:i spearman_rho:6 n:i",
    lambda s, d: hy.rank_stability(corr_history(s, d), "window", "feature", "importance"),
    sql_r(
        "SELECT series_id, wn AS \"window\", corr(p, rk) AS spearman_rho, count(*) AS n FROM (SELECT *, lag(rk) OVER (PARTITION BY series_id, feature ORDER BY wn) AS p FROM "
        "(SELECT *, rank() OVER (PARTITION BY series_id, wn ORDER BY importance) + (count(*) OVER (PARTITION BY series_id, wn, importance) - 1) / 2.0 AS rk FROM chw WHERE importance IS NOT NULL)) WHERE p IS NOT NULL GROUP BY 1, 2",
        *CORRH,
    ),
)


EM_STEPS = 25


@shared(store=True)
def mixture(s, d):
    return rg.mixture_regimes(vols(s, d), "vol_c2c_21d", EM_STEPS)


def _em_sql(before: str, after: str) -> str:
    """One EM step of all series; ``before`` and ``after`` hold weights, means and variances."""
    def each(text: str) -> str:
        return ", ".join(text.replace("#", str(k)) for k in range(3))

    return (
        f"{after} AS MATERIALIZED (SELECT series_id, "
        + each("r# / n AS w#, CASE WHEN r# > 1e-12 THEN s# / r# ELSE m# END AS m#, CASE WHEN r# > 1e-12 THEN greatest(q# / r# - pow(s# / r#, 2), 1e-4) ELSE v# END AS v#")
        + " FROM (SELECT series_id, count(*) AS n, "
        + each("any_value(m#) AS m#, any_value(v#) AS v#, sum(e# / e) AS r#, sum(e# / e * z) AS s#, sum(e# / e * z * z) AS q#")
        + f" FROM (SELECT *, e0 + e1 + e2 AS e FROM (SELECT zz.series_id, z, {each('m#, v#')}, "
        + each("w# * exp(-0.5 * pow(z - m#, 2) / v#) / sqrt(2 * pi() * v#) AS e#")
        + f" FROM zz JOIN {before} ON zz.series_id = {before}.series_id)) GROUP BY series_id))"
    )


LOGVOL = (
    _VOL,
    "zz AS MATERIALIZED (SELECT series_id, t, lv, (lv - avg(lv) OVER (PARTITION BY series_id)) / coalesce(nullif(stddev_pop(lv) OVER (PARTITION BY series_id), 0), 1) AS z "
    "FROM (SELECT series_id, t, ln(vol_c2c_21d + 1e-10) AS lv FROM v WHERE vol_c2c_21d IS NOT NULL))",
)
MIX = (
    *LOGVOL,
    "em0 AS MATERIALIZED (SELECT series_id, "
    + ", ".join(
        f"1.0 / 3 AS w{k}, coalesce(avg(z) FILTER (g = {k}), 0) AS m{k}, greatest(coalesce(var_pop(z) FILTER (g = {k}), 1), 1e-4) AS v{k}" for k in range(3)
    )
    + " FROM (SELECT *, ntile(3) OVER (PARTITION BY series_id ORDER BY z, t) - 1 AS g FROM zz) GROUP BY series_id)",
    *[_em_sql(f"em{i}", f"em{i + 1}") for i in range(EM_STEPS)],
    "mo AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY m, k) - 1 AS state FROM ("
    + " UNION ALL ".join(f"SELECT series_id, {k} AS k, w{k} AS w, m{k} AS m, v{k} AS v FROM em{EM_STEPS}" for k in range(3))
    + "))",
    "md0 AS (SELECT zz.series_id, zz.t, lv, state, w * exp(-0.5 * pow(z - m, 2) / v) / sqrt(2 * pi() * v) AS e FROM zz JOIN mo ON zz.series_id = mo.series_id)",
    "mx AS MATERIALIZED (SELECT series_id, t, any_value(lv) AS lv, arg_max(state, (e, -state)) AS regime, "
    + ", ".join(f"sum(e) FILTER (state = {k}) / sum(e) AS post_{n}" for k, n in enumerate(rg.NAMES))
    + " FROM md0 GROUP BY 1, 2)",
    f"mn AS (SELECT *, {sq.lead('regime')} AS nx FROM mx)",
)
_POST = "post_low:4 post_med:4 post_high:4"
register(
    "e17_mixture_parameters",
    "series_id:s state:i weight:5 mean:5 variance:5",
    lambda s, d: rg.mixture_parameters(rg.log_volatility(vols(s, d), "vol_c2c_21d"), EM_STEPS).select(
        "series_id",
        F.inline(F.array(*[
            F.struct(F.lit(k).alias("state"), F.col(f"w{k}").alias("weight"), F.col(f"m{k}").alias("mean"), F.col(f"v{k}").alias("variance"))
            for k in range(3)
        ])),
    ),
    sql_r("SELECT series_id, state, w AS weight, m AS mean, v AS variance FROM mo", *MIX),
)
register("e17_mixture_regimes", "series_id:s t:d regime:i", mixture, sql_r("SELECT series_id, t, regime FROM mx", *MIX))
register(
    "e17_regime_statistics",
    "series_id:s regime:i n:i mean_vol:4 std_log_vol:4 persistence:4 frequency_pct:4",
    lambda s, d: rg.regime_statistics(mixture(s, d)),
    sql_r(
        "SELECT *, n / sum(n) OVER (PARTITION BY series_id) * 100 AS frequency_pct FROM (SELECT series_id, regime, count(*) AS n, "
        "exp(avg(lv)) AS mean_vol, stddev_samp(lv) AS std_log_vol, avg(CASE WHEN nx IS NOT NULL THEN CAST(nx = regime AS INTEGER) END) AS persistence FROM mn GROUP BY 1, 2)",
        *MIX,
    ),
)
_TRN = "series_id:s from_regime:i to_low:6 to_med:6 to_high:6"
register(
    "e17_transition_matrix",
    _TRN,
    lambda s, d: rg.transition_matrix(mixture(s, d)),
    sql_r(
        "SELECT series_id, regime AS from_regime, "
        + ", ".join(f"avg(CAST(nx = {k} AS INTEGER)) AS to_{n}" for k, n in enumerate(rg.NAMES))
        + " FROM mn WHERE nx IS NOT NULL GROUP BY 1, 2",
        *MIX,
    ),
)
register(
    "e17_tercile_transitions",
    _TRN,
    lambda s, d: rg.transition_matrix(tercile_regimes(vols(s, d))),
    sql_r(
        "SELECT series_id, g AS from_regime, avg(CASE WHEN nx = 0 THEN 1.0 ELSE 0 END) AS to_low, avg(CASE WHEN nx = 1 THEN 1.0 ELSE 0 END) AS to_med, "
        f"avg(CASE WHEN nx = 2 THEN 1.0 ELSE 0 END) AS to_high FROM (SELECT *, {sq.lead('g')} AS nx FROM (SELECT series_id, t, "
        "CASE regime WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS g FROM tl)) WHERE nx IS NOT NULL GROUP BY 1, 2",
        _VOL, *TERCILE,
    ),
)
register("e18_posteriors", f"series_id:s t:d {_POST}", mixture, sql_r("SELECT * FROM mx", *MIX))


def tercile_levels(s, d):
    """Tercile labels with the standardised log volatility of their rows."""
    levels = rg.log_volatility(vols(s, d), "vol_c2c_21d").select("series_id", "t", "z")
    return tercile_regimes(vols(s, d)).select("series_id", "t", "regime").join(levels, ["series_id", "t"])


_LOG = "CASE WHEN {0} > 0 THEN ln({0}) ELSE CAST('-Infinity' AS DOUBLE) END"
# emissions e0..e2 of every row and log moves a00..a22 of every series
TERCILE_ROWS = (
    *LOGVOL, *TERCILE,
    "pg AS (SELECT tl.series_id, tl.t, z, CASE regime WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS g, "
    "row_number() OVER (PARTITION BY tl.series_id ORDER BY tl.t) AS pos FROM tl JOIN zz ON tl.series_id = zz.series_id AND tl.t = zz.t)",
)
MIXTURE_ROWS = (
    *MIX,
    "pg AS (SELECT mx.series_id, mx.t, z, regime AS g, row_number() OVER (PARTITION BY mx.series_id ORDER BY mx.t) AS pos "
    "FROM mx JOIN zz ON mx.series_id = zz.series_id AND mx.t = zz.t)",
)
STEPS = (
    "pl AS (SELECT series_id, " + ", ".join(f"avg(z) FILTER (g = {k}) AS m{k}, greatest(stddev_pop(z) FILTER (g = {k}), 1e-3) AS s{k}" for k in range(3)) + " FROM pg GROUP BY 1)",
    f"pn0 AS (SELECT *, {sq.lead('g')} AS nx FROM pg)",
    "pm0 AS (SELECT series_id, "
    + ", ".join(f"coalesce(avg(CAST(nx = {j} AS INTEGER)) FILTER (g = {i}), 1.0 / 3) AS p{i}{j}" for i in range(3) for j in range(3))
    + " FROM pn0 WHERE nx IS NOT NULL GROUP BY 1)",
    "pa AS (SELECT series_id, " + ", ".join(f"{_LOG.format(f'p{i}{j}')} AS a{i}{j}" for i in range(3) for j in range(3)) + " FROM pm0)",
    "pe AS MATERIALIZED (SELECT pg.series_id, t, pos, "
    + ", ".join(f"CASE WHEN s{k} IS NULL THEN CAST('-Infinity' AS DOUBLE) ELSE -0.5 * pow((z - m{k}) / s{k}, 2) - ln(s{k}) END AS e{k}" for k in range(3))
    + f", {', '.join(f'a{i}{j}' for i in range(3) for j in range(3))} FROM pg JOIN pl USING (series_id) JOIN pa USING (series_id))",
)
_COME = [[f"fw.f{i} + pe.a{i}{j}" for i in range(3)] for j in range(3)]
BEST = (
    "fw AS (SELECT series_id, pos, e0 - ln(3) AS f0, e1 - ln(3) AS f1, e2 - ln(3) AS f2, 0 AS b0, 0 AS b1, 0 AS b2 FROM pe WHERE pos = 1 UNION ALL "
    "SELECT pe.series_id, pe.pos, "
    + ", ".join(f"greatest({', '.join(c)}) + pe.e{j}" for j, c in enumerate(_COME)) + ", "
    + ", ".join(f"CASE WHEN {c[0]} >= greatest({c[1]}, {c[2]}) THEN 0 WHEN {c[1]} >= {c[2]} THEN 1 ELSE 2 END" for c in _COME)
    + " FROM fw JOIN pe ON pe.series_id = fw.series_id AND pe.pos = fw.pos + 1)",
    "bw AS (SELECT series_id, pos, CASE WHEN f0 >= greatest(f1, f2) THEN 0 WHEN f1 >= f2 THEN 1 ELSE 2 END AS state FROM fw "
    "WHERE (series_id, pos) IN (SELECT series_id, max(pos) FROM pe GROUP BY 1) UNION ALL "
    "SELECT bw.series_id, bw.pos - 1, CASE bw.state WHEN 0 THEN fw.b0 WHEN 1 THEN fw.b1 ELSE fw.b2 END "
    "FROM bw JOIN fw ON fw.series_id = bw.series_id AND fw.pos = bw.pos WHERE bw.pos > 1)",
)
register(
    "e19_tercile_path",
    "series_id:s t:d state:i",
    lambda s, d: rg.likely_path(tercile_levels(s, d)),
    sql_r("SELECT pe.series_id, pe.t, state FROM bw JOIN pe ON pe.series_id = bw.series_id AND pe.pos = bw.pos", *TERCILE_ROWS, *STEPS, *BEST).replace("WITH ", "WITH RECURSIVE ", 1),
)
# scaled by the sum of each row, so that products of probabilities don't vanish
_AHEAD = [" + ".join(f"ah.f{i} * exp(pe.a{i}{j})" for i in range(3)) for j in range(3)]
_BEHIND = [" + ".join(f"exp(nx.a{i}{j} + nx.e{j}) * bh.g{j}" for j in range(3)) for i in range(3)]
SMOOTH = (
    "ah AS (SELECT series_id, pos, exp(e0) / (exp(e0) + exp(e1) + exp(e2)) AS f0, exp(e1) / (exp(e0) + exp(e1) + exp(e2)) AS f1, exp(e2) / (exp(e0) + exp(e1) + exp(e2)) AS f2 "
    "FROM pe WHERE pos = 1 UNION ALL SELECT series_id, pos, x0 / (x0 + x1 + x2), x1 / (x0 + x1 + x2), x2 / (x0 + x1 + x2) FROM (SELECT pe.series_id, pe.pos, "
    + ", ".join(f"({x}) * exp(pe.e{j}) AS x{j}" for j, x in enumerate(_AHEAD))
    + " FROM ah JOIN pe ON pe.series_id = ah.series_id AND pe.pos = ah.pos + 1))",
    "bh AS (SELECT series_id, max(pos) AS pos, 1.0 :: DOUBLE AS g0, 1.0 :: DOUBLE AS g1, 1.0 :: DOUBLE AS g2 FROM pe GROUP BY 1 UNION ALL "
    "SELECT series_id, pos, x0 / (x0 + x1 + x2), x1 / (x0 + x1 + x2), x2 / (x0 + x1 + x2) FROM (SELECT nx.series_id, nx.pos - 1 AS pos, "
    + ", ".join(f"{x} AS x{i}" for i, x in enumerate(_BEHIND))
    + " FROM bh JOIN pe nx ON nx.series_id = bh.series_id AND nx.pos = bh.pos WHERE nx.pos > 1))",
)
register(
    "e18_smoothed_states",
    "series_id:s t:d smooth_low:5 smooth_med:5 smooth_high:5",
    lambda s, d: rg.smoothed_states(tercile_levels(s, d)),
    sql_r(
        "SELECT pe.series_id, pe.t, f0 * g0 / (f0 * g0 + f1 * g1 + f2 * g2) AS smooth_low, f1 * g1 / (f0 * g0 + f1 * g1 + f2 * g2) AS smooth_med, "
        "f2 * g2 / (f0 * g0 + f1 * g1 + f2 * g2) AS smooth_high FROM pe JOIN ah ON ah.series_id = pe.series_id AND ah.pos = pe.pos JOIN bh ON bh.series_id = pe.series_id AND bh.pos = pe.pos",
        *TERCILE_ROWS, *STEPS, *SMOOTH,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
register(
    "e19_likely_path",
    "series_id:s t:d state:i",
    lambda s, d: rg.likely_path(mixture(s, d)),
    sql_r(
        "SELECT pe.series_id, pe.t, state FROM bw JOIN pe ON pe.series_id = bw.series_id AND pe.pos = bw.pos",
        *MIXTURE_ROWS, *STEPS, *BEST,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)


def _regime_join(s, d):
    m = mixture(s, d)
    return rg.regime_table(m, rg.likely_path(m))


register(
    "e20_regime_table",
    f"series_id:s t:d regime:i {_POST} state:i",
    _regime_join,
    sql_r(
        "SELECT mx.*, state FROM mx JOIN pe ON pe.series_id = mx.series_id AND pe.t = mx.t JOIN bw ON pe.series_id = bw.series_id AND pe.pos = bw.pos",
        *MIXTURE_ROWS, *STEPS, *BEST,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
AUG = [*BASE, "regime_lag1", "post_low_lag1", "post_med_lag1", "post_high_lag1"]


def augmented(s, d):
    return cr.regime_features(rt.base_features(rets(s, d)), mixture(s, d)).withColumn(
        "regime", F.col("regime_lag1")
    )


register(
    "f16_regime_boosting",
    "series_id:s t:d model:s actual:4 pred:4",
    lambda s, d: bo.boosted_tail(rr.train_test(augmented(s, d)), AUG, "regime_gbt"),
)


def _three_models(s, d):
    table = cr.regime_features(har(s, d), mixture(s, d)).withColumn("regime", F.col("regime_lag1"))
    cols = ["series_id", "t", "regime", "model", "actual", "pred"]
    return stack(
        rr.regime_predictions(table).select(*cols),
        bo.boosted_tail(rr.train_test(augmented(s, d)), AUG, "regime_gbt", keep=["regime"]).select(*cols),
    )


register(
    "f17_regime_model_comparison",
    "series_id:s model:s regime:s rmse:4 mae:4 qlike:3 dir_acc:4 n:i",
    lambda s, d: ev.metrics_overall_and_by_regime(
        _three_models(s, d).withColumn("regime", F.col("regime").cast("string"))
    ),
)
