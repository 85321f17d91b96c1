"""Intraday estimators and jump tests."""

from __future__ import annotations

from barograph.operators import intraday as it
from barograph.plans import sqltext as sq
from barograph.plans.market import _VOL
from barograph.plans.registry import register
from barograph.plans.tables import event_ticks, lineitem_ticks, rets, vols

HOUR = 3_600_000_000
KEY_RANGE = 1 << 51

TICKS = {
    "events": "tk AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS day, "
    "epoch_us(ts) AS seq, value AS p FROM events)",
    "lineitem": "tk AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS day, "
    "(l_orderkey * 8 + l_linenumber) * 65536 + (CAST(round(l_extendedprice * 100) AS BIGINT) * 50 + CAST(l_quantity AS BIGINT)) % 65536 AS seq, l_extendedprice / l_quantity AS p FROM lineitem)",
}
_D = "(PARTITION BY series_id, day ORDER BY seq, p)"
_LAGS = ", ".join(f"lag(x, {h}) OVER {_D} AS x{h}" for h in range(1, 9))
DAYS = (
    f"tr AS (SELECT *, row_number() OVER {_D} AS bar, ln(p / lag(p) OVER {_D}) AS x FROM tk)",
    f"tl AS (SELECT *, {_LAGS} FROM tr)",
    "dy AS (SELECT series_id, day AS t, count(x) AS m, sum(x * x) AS rv, "
    "sum(abs(x) * abs(x1)) * pi() / 2 AS bv, CASE WHEN count(x) < 10 THEN sum(x * x) ELSE greatest(0, sum(x * x) + "
    + " + ".join(f"2 * {it.parzen(h, 8)!r} * coalesce(sum(x * x{h}), 0)" for h in range(1, 9))
    + ") END AS rk, sum(pow(x, 3)) AS s3, sum(pow(x, 4)) AS s4 FROM tl WHERE x IS NOT NULL GROUP BY 1, 2)",
    "jv AS (SELECT *, CASE WHEN bv IS NOT NULL THEN greatest(rv - bv, 0) END AS jump_var, "
    "CASE WHEN bv IS NOT NULL THEN greatest(rv - bv, 0) END / (rv + 1e-12) AS jump_ratio, bv AS cont_var, "
    "rv * 252 AS rv_ann, bv * 252 AS bv_ann, rk * 252 AS rk_ann FROM dy)",
)
_J = f"(rv - bv) / (sqrt({it.BNS_PHI!r} / 78) * (rv + 1e-12))"
BNS = (
    f"bn AS (SELECT *, CASE WHEN p_value < 0.01 THEN 1 ELSE 0 END AS jump_detected FROM "
    f"(SELECT *, {sq.norm_tail2('j_stat')} AS p_value FROM (SELECT *, {_J} AS j_stat FROM jv)))"
)
LM = (
    "lb AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day, bar) AS g, "
    "CAST(count(*) OVER (PARTITION BY series_id) AS DOUBLE) AS n FROM tr WHERE x IS NOT NULL)",
    "lp AS (SELECT *, abs(x) * abs(lag(x) OVER (PARTITION BY series_id ORDER BY g)) AS pr FROM lb)",
    "ll AS (SELECT *, CASE WHEN l_stat > sqrt(2 * ln(n)) - ln(ln(n)) / (2 * sqrt(2 * ln(n))) THEN 1 ELSE 0 END AS jump_bar "
    "FROM (SELECT *, abs(x) / sqrt(pi() / 2 * sum(pr) OVER (PARTITION BY series_id ORDER BY g "
    "ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) / 19 + 1e-12) AS l_stat FROM lp) WHERE g > 20)",
    "ld AS (SELECT series_id, day AS t, sum(jump_bar) AS n_jump_bars, max(l_stat) AS max_l_stat, count(*) AS n_bars, "
    "max(jump_bar) AS jump_day_lm, avg(jump_bar) AS jump_intensity FROM ll GROUP BY 1, 2)",
)


def sql_i(src: str, select: str, *ctes: str) -> str:
    return sq.query(TICKS[src], *DAYS, *ctes, select=select)


def event_returns(s, d):
    return it.tick_returns(event_ticks(s, d), HOUR)


def event_days(s, d):
    return it.realised_measures(event_returns(s, d))


def line_days(s, d):
    return it.realised_measures(it.tick_returns(lineitem_ticks(s, d), KEY_RANGE))


for name, cols in (
    ("i1_realised_variance", "m:i rv:5"),
    ("i2_bipower_variation", "bv:5"),
    ("i3_realised_kernel", "rk:5"),
):
    register(
        name, f"series_id:s t:d {cols}", event_days,
        sql_i("events", "SELECT * FROM dy"),
    )
register(
    "i4_jump_variation",
    "series_id:s t:d jump_var:5 jump_ratio:6 cont_var:5 rv_ann:4 bv_ann:4 rk_ann:4",
    lambda s, d: it.jump_variation(event_days(s, d)),
    sql_i("events", "SELECT * FROM jv"),
)


def bns(s, d):
    return it.bns_test(it.jump_variation(event_days(s, d)))


def lm_bars(s, d):
    return it.lee_mykland(event_returns(s, d))


register(
    "i5_bns_test",
    "series_id:s t:d j_stat:5 p_value:6 jump_detected:i",
    bns,
    sql_i("events", "SELECT * FROM bn", BNS),
)
register(
    "i6_lee_mykland",
    "series_id:s day:d bar:i l_stat:5 jump_bar:i",
    lm_bars,
    sql_i("events", "SELECT * FROM ll", *LM),
)
register(
    "i7_jump_days",
    "series_id:s t:d n_jump_bars:i max_l_stat:5 n_bars:i jump_day_lm:i jump_intensity:6",
    lambda s, d: it.jump_days(lm_bars(s, d)),
    sql_i("events", "SELECT * FROM ld", *LM),
)
register(
    "i8_test_agreement",
    "series_id:s common_days:i bns_days:i lm_days:i both_days:i",
    lambda s, d: it.test_agreement(bns(s, d), it.jump_days(lm_bars(s, d))),
    sql_i(
        "events",
        "SELECT series_id, count(*) AS common_days, sum(jump_detected) AS bns_days, sum(jump_day_lm) AS lm_days, "
        "count(*) FILTER (jump_detected = 1 AND jump_day_lm = 1) AS both_days FROM bn JOIN ld USING (series_id, t) GROUP BY 1",
        BNS, *LM,
    ),
)


def combined(s, d):
    test = bns(s, d)
    return it.combine_tests(
        test.select("series_id", "t", "rv", "bv", "rk"), test, it.jump_days(lm_bars(s, d))
    )


register(
    "i9_combined_tests",
    "series_id:s t:d rv:5 bv:5 rk:5 j_stat:5 jump_detected:i n_jump_bars:i max_l_stat:5 jump_intensity:6",
    combined,
    sql_i("events", "SELECT * FROM bn LEFT JOIN ld USING (series_id, t)", BNS, *LM),
)


def merged(s, d):
    daily = vols(s, d).select("series_id", "t", "vol_c2c_21d", "vol_park_21d", "vol_gk_21d")
    est = it.bns_test(it.jump_variation(line_days(s, d))).select(
        "series_id", "t", "rv_ann", "bv_ann", "rk_ann", "jump_detected"
    )
    return daily.join(est, ["series_id", "t"])


EST = ["vol_c2c_21d", "vol_park_21d", "vol_gk_21d", "rv_ann", "bv_ann", "rk_ann"]
MERGED = (
    sq.BARS, sq.RET, _VOL,
    "mg AS (SELECT v.series_id, v.t, vol_c2c_21d, vol_park_21d, vol_gk_21d, rv_ann, bv_ann, rk_ann, jump_detected "
    "FROM v JOIN bn ON v.series_id = bn.series_id AND v.t = bn.t)",
)


def _loss_sql(est, extra="", having=10):
    part = ", day_type" if extra else ""
    return " UNION ALL ".join(
        f"SELECT series_id{part}, '{e}' AS estimator, avg(pow(y - f, 2)) AS mse, "
        "avg(ln(greatest(f, 1e-8)) + greatest(y, 1e-8) / greatest(f, 1e-8)) AS qlike, count(*) AS n FROM ("
        f"SELECT series_id{extra}, {sq.lead('rv_ann')} AS y, {sq.lag(e)} AS f FROM mg) "
        f"WHERE y IS NOT NULL AND f IS NOT NULL GROUP BY series_id{part} HAVING count(*) >= {having}"
        for e in est
    )


register(
    "i10_estimator_comparison",
    "series_id:s estimator:s mse:2 qlike:2 n:i",
    lambda s, d: it.estimators_as_forecasts(merged(s, d), EST),
    sql_i("lineitem", _loss_sql(EST), BNS, *MERGED),
)
EST_J = ["rv_ann", "bv_ann", "vol_gk_21d"]
register(
    "i11_loss_by_jump_day",
    "series_id:s day_type:s estimator:s mse:2 qlike:3 n:i",
    lambda s, d: it.loss_by_jump_day(merged(s, d), EST_J),
    sql_i(
        "lineitem",
        _loss_sql(EST_J, ", CASE WHEN coalesce(jump_detected, 0) = 1 THEN 'Jump' ELSE 'No-Jump' END AS day_type", 5),
        BNS, *MERGED,
    ),
)
MOM = (
    "mo AS (SELECT series_id, t, CASE WHEN m >= 5 THEN rv END AS rv, "
    "CASE WHEN m >= 5 THEN CASE WHEN rv <= 1e-20 THEN 0 ELSE sqrt(m) * s3 / (pow(rv, 1.5) + 1e-20) END END AS rs, "
    "CASE WHEN m >= 5 THEN CASE WHEN rv <= 1e-20 THEN 0 ELSE m * s4 / (pow(rv, 2) + 1e-20) END END AS rk, "
    "CASE WHEN m >= 5 THEN rv * 252 END AS rv_ann FROM dy)"
)
register(
    "i12_realised_moments",
    "series_id:s t:d rv:5 rs:6 rk:5 rv_ann:4",
    lambda s, d: it.realised_moments(event_days(s, d)),
    sql_i("events", "SELECT * FROM mo", MOM),
)


def moment_table(s, d):
    return it.moment_features(rets(s, d), it.realised_moments(line_days(s, d)))


MOMF = (
    sq.BARS, sq.RET, MOM,
    "mj AS (SELECT r.series_id, r.t, r.rv, rs, rk, nx FROM r LEFT JOIN (SELECT series_id, t, rs, rk, "
    f"{sq.lead('rv_ann')} AS nx FROM mo) q ON r.series_id = q.series_id AND r.t = q.t)",
    "mq AS (SELECT *, left_skew_flag * rv_lag_1 AS lev_interaction FROM (SELECT mj.series_id, mj.t, "
    + ", ".join(
        x.replace("BY series_id ORDER BY t", "BY mj.series_id ORDER BY mj.t").replace("(rv", "(mj.rv")
        for x in (
            f"{sq.lag('rv')} AS rv_lag_1",
            f"{sq.roll('avg', 'rv', 5, skip=1)} AS rv_lag_5",
            f"{sq.roll('avg', 'rv', 21, skip=1)} AS rv_lag_21",
            f"coalesce(nx, {sq.lead('rv')}) AS target",
            f"CASE WHEN {sq.lag('rs')} < 0 THEN 1.0 ELSE 0.0 END AS left_skew_flag",
            *[
                f"{sq.lag(c)} AS {c}_lag1, {sq.roll('avg', c, 5, 3, skip=1)} AS {c}_lag5, "
                f"{sq.roll('avg', c, 21, 10, skip=1)} AS {c}_lag21"
                for c in ("rs", "rk")
            ],
        )
    )
    + " FROM mj))",
    "mf AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS hpos, "
    "count(*) OVER (PARTITION BY series_id) AS hn FROM mq WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in (*it.MOMENT_FEATURES, "target")) + ")",
)
register(
    "i13_moment_features",
    "series_id:s t:d " + " ".join(f"{c}:4" for c in (*it.MOMENT_FEATURES, "target")),
    moment_table,
    sql_i("lineitem", "SELECT * FROM mf", *MOMF),
)
register(
    "i14_bar_profile",
    "series_id:s bar:i mean_abs_ret:8 n:i",
    lambda s, d: it.bar_profile(event_returns(s, d)),
    sql_i(
        "events",
        "SELECT series_id, bar, avg(abs(x)) AS mean_abs_ret, count(*) AS n FROM tr WHERE x IS NOT NULL GROUP BY 1, 2",
    ),
)
register(
    "i15_jump_split",
    "series_id:s day_type:s bin:i n:i mean_rv_ann:3",
    lambda s, d: it.jump_split(it.bns_test(it.jump_variation(line_days(s, d)))),
    sql_i(
        "lineitem",
        "SELECT series_id, day_type, bin, count(*) AS n, avg(rv_ann) AS mean_rv_ann FROM (SELECT series_id, "
        "CASE WHEN jump_detected = 1 THEN 'Jump' ELSE 'No-Jump' END AS day_type, rv_ann, least(39, CAST(floor("
        "(rv_ann - min(rv_ann) OVER w) / (max(rv_ann) OVER w - min(rv_ann) OVER w) * 40) AS BIGINT)) AS bin "
        "FROM bn WHERE rv_ann IS NOT NULL WINDOW w AS (PARTITION BY series_id)) GROUP BY 1, 2, 3",
        BNS,
    ),
)
register(
    "i16_skew_trend",
    "series_id:s n:i slope:3 intercept:2 rs_p01:6 rs_p99:6",
    lambda s, d: it.skew_trend(it.realised_moments(line_days(s, d))),
    sql_i(
        "lineitem",
        "SELECT series_id, count(*) AS n, regr_slope(y, rs) AS slope, regr_intercept(y, rs) AS intercept, "
        "quantile_cont(rs, 0.01) AS rs_p01, quantile_cont(rs, 0.99) AS rs_p99 FROM (SELECT *, "
        f"{sq.lead('rv_ann')} AS y FROM mo) WHERE rs IS NOT NULL AND y IS NOT NULL GROUP BY 1",
        MOM,
    ),
)
