"""Drift, monitoring (D1-D11) and sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.operators import drift as dr
from barograph.operators import sentiment as sn
from barograph.plans import sqltext as sq
from barograph.plans.forecast import HAR4, har, retrained, wf_sql
from barograph.plans.hypothesis import ks_p_sql
from barograph.plans.market import HAR_TABLE, sql_r
from barograph.plans.registry import register_reusing as register
from barograph.plans.registry import shared
from barograph.plans.tables import rets, table


def _windows_sql(name: str, src: str, cols: str, keys: str = "series_id") -> str:
    return (
        f"{name} AS (SELECT * FROM (SELECT *, CASE WHEN p <= 756 THEN -1 ELSE (p - 757) // 63 END AS wn FROM (SELECT {keys}, t, {cols}, "
        f"row_number() OVER (PARTITION BY {keys} ORDER BY t) AS p, count(*) OVER (PARTITION BY {keys}) AS n FROM {src})) WHERE wn = -1 OR 756 + (wn + 1) * 63 <= n)"
    )


def _psi_sql(tag: str, src: str, keys: str = "series_id") -> tuple[str, ...]:
    qs = ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 10))
    shares = ", ".join(f"count(*) FILTER (b = {i}) / count(*) + 1e-8 AS s{i}" for i in range(10))
    term = " + ".join(f"(c.s{i} - r.s{i}) * ln(c.s{i} / r.s{i})" for i in range(10))
    return (
        f"{tag}c AS (SELECT {keys}, [{qs}] AS cuts FROM {src} WHERE wn = -1 GROUP BY {keys})",
        f"{tag}b AS (SELECT {keys}, wn, len([c for c in cuts if c <= value]) AS b FROM {src} JOIN {tag}c USING ({keys}))",
        f"{tag}s AS (SELECT {keys}, wn, {shares} FROM {tag}b GROUP BY {keys}, wn)",
        f"{tag} AS (SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.wn, {term} AS psi FROM {tag}s c JOIN {tag}s r USING ({keys}) WHERE c.wn >= 0 AND r.wn = -1)",
    )


RV = "rvv AS (SELECT series_id, t, rv AS value FROM r WHERE rv IS NOT NULL)"
DW = (RV, _windows_sql("dw", "rvv", "value"), *_psi_sql("ps", "dw"))
BOTH = (
    "bo AS (SELECT series_id, wn, value, FALSE AS ref FROM dw WHERE wn >= 0 UNION ALL SELECT w.series_id, w.wn, d.value, TRUE FROM dw d JOIN (SELECT DISTINCT series_id, wn FROM dw WHERE wn >= 0) w USING (series_id) WHERE d.wn = -1)",
    "jr AS (SELECT series_id, wn, min(value) AS lo, max(value) AS hi, count(*) FILTER (ref) AS nr, count(*) FILTER (NOT ref) AS nc FROM bo GROUP BY 1, 2)",
    "jb AS (SELECT series_id, wn, least(49, CAST(floor((value - lo) / ((hi - lo) / 50)) AS BIGINT)) AS b, 1.0 / ((hi - lo) / 50) AS tot, count(*) FILTER (ref) / nr AS p0, count(*) FILTER (NOT ref) / nc AS q0 FROM bo JOIN jr USING (series_id, wn) GROUP BY series_id, wn, b, lo, hi, nr, nc)",
    "jp AS (SELECT *, p0 * tot / (tot + 1e-10) AS p, q0 * tot / (tot + 1e-10) AS q FROM jb)",
    "jd AS (SELECT series_id, wn, greatest(0.5 * sum(p * ln((p + 1e-10) / ((p + q) / 2 + 1e-10)) + q * ln((q + 1e-10) / ((p + q) / 2 + 1e-10))), 0) AS jsd FROM jp GROUP BY 1, 2)",
    "kd0 AS (SELECT series_id, wn, count(*) FILTER (ref) OVER w AS c1, count(*) FILTER (NOT ref) OVER w AS c2, count(*) FILTER (ref) OVER (PARTITION BY series_id, wn) AS n1, "
    "count(*) FILTER (NOT ref) OVER (PARTITION BY series_id, wn) AS n2 FROM bo WINDOW w AS (PARTITION BY series_id, wn ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    "kd AS (SELECT series_id, wn, max(abs(c1 / n1 - c2 / n2)) AS ks_stat, max(n1) AS n1, max(n2) AS n2 FROM kd0 GROUP BY 1, 2)",
    f"sc AS (SELECT *, CASE WHEN psi >= 0.1 OR ks_pvalue < 0.05 THEN 1 ELSE 0 END AS drift_flag, CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS psi_level FROM "
    f"(SELECT series_id, wn, date, psi, jsd, ks_stat, {ks_p_sql('ks_stat', 'n1', 'n2')} AS ks_pvalue FROM ps JOIN jd USING (series_id, wn) JOIN kd USING (series_id, wn) "
    "JOIN (SELECT series_id, wn, max(t) AS date FROM dw GROUP BY 1, 2) USING (series_id, wn)))",
)


def rv_rows(s, d):
    return rets(s, d).filter(F.col("rv").isNotNull()).select("series_id", "t", "rv")


register(
    "d1_population_stability",
    "series_id:s window:i psi:6",
    lambda s, d: dr.psi(dr.drift_windows(rv_rows(s, d)), "rv"),
    sql_r('SELECT series_id, wn AS "window", psi FROM ps', *DW),
)
register(
    "d2_jensen_shannon",
    "series_id:s window:i jsd:6",
    lambda s, d: dr.jensen_shannon(dr.against_reference(dr.drift_windows(rv_rows(s, d)), "rv")),
    sql_r('SELECT series_id, wn AS "window", jsd FROM jd', *DW, *BOTH),
)


@shared()
def rv_scan(s, d):
    return dr.drift_scan(rets(s, d), "rv")


register(
    "d3_drift_scan",
    "series_id:s window:i date:d psi:6 jsd:6 ks_stat:6 ks_pvalue:6 drift_flag:i psi_level:s",
    rv_scan,
    sql_r('SELECT *, wn AS "window" FROM sc', *DW, *BOTH),
)
FD = (
    HAR_TABLE,
    _windows_sql("fw", "ht", ", ".join(HAR4)),
    "fl AS (" + " UNION ALL ".join(f"SELECT series_id, '{c}' AS feature, t, wn, {c} AS value FROM fw" for c in HAR4) + ")",
    *_psi_sql("pf", "fl", "series_id, feature"),
    "fdt AS (SELECT series_id, wn, max(t) AS date FROM fw GROUP BY 1, 2)",
    "fp AS (SELECT series_id, feature, wn, date, psi FROM pf JOIN fdt USING (series_id, wn))",
)


@shared()
def feature_psi(s, d):
    return dr.feature_drift(har(s, d), HAR4)


register(
    "d4_feature_drift",
    "series_id:s feature:s window:i date:d psi:6",
    feature_psi,
    sql_r('SELECT *, wn AS "window" FROM fp', *FD),
)
register(
    "d5_drift_summary",
    "series_id:s n_windows:i n_drifts:i psi_max:6",
    lambda s, d: dr.drift_summary(rv_scan(s, d)),
    sql_r(
        "SELECT series_id, count(*) AS n_windows, sum(drift_flag) AS n_drifts, max(psi) AS psi_max FROM sc GROUP BY 1",
        *DW, *BOTH,
    ),
)
_Q = "avg(ln(greatest(pred, 1e-8)) + greatest(actual, 1e-8) / greatest(pred, 1e-8))"
_E = "sqrt(avg(pow(actual - pred, 2)))"
MON = (
    HAR_TABLE, *wf_sql(10, 252, None, "wo", HAR4),
    "mn AS (SELECT series_id, t, actual, pred, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS a FROM wop)",
    f"mb AS (SELECT series_id, {_E} AS baseline_rmse, {_Q} AS baseline_qlike, count(*) AS n, {_E} * 1.4 AS alert_upper_rmse FROM mn WHERE a < 63 GROUP BY 1)",
    "mx AS (SELECT series_id, k AS wn, t, actual, pred FROM (SELECT *, a - 63 AS r FROM mn WHERE a >= 63) m, LATERAL (SELECT unnest(generate_series(greatest(0, CAST(floor((r - 63) / 21.0) AS BIGINT) + 1), r // 21)) AS k))",
    f"mw AS (SELECT series_id, wn, count(*) AS n, max(t) AS date, {_E} AS rmse, {_Q} AS qlike, CAST(stddev_pop(pred) < 1e-8 AS INTEGER) AS health_all_same, "
    "max(CASE WHEN pred < 0 THEN 1 ELSE 0 END) AS health_has_negative, CAST(max(abs(pred)) > 10 * avg(abs(pred)) AS INTEGER) AS health_extreme_outlier FROM mx GROUP BY 1, 2 HAVING count(*) = 63)",
)
LOG = (
    *DW, *BOTH, *MON, *FD[1:],
    "fm AS (SELECT series_id, date, max(psi) AS psi FROM fp GROUP BY 1, 2)",
    "lg0 AS (SELECT mw.*, baseline_rmse, alert_upper_rmse, (SELECT arg_max(psi, date) FROM sc WHERE sc.series_id = mw.series_id AND sc.date <= mw.date) AS psi_rv, "
    "(SELECT arg_max(psi, date) FROM fm WHERE fm.series_id = mw.series_id AND fm.date <= mw.date) AS psi_feat_max FROM mw JOIN mb USING (series_id))",
    "lg1 AS (SELECT *, CASE WHEN rmse > alert_upper_rmse THEN 1 ELSE 0 END AS perf_alert, CASE WHEN coalesce(psi_rv, 0) >= 0.1 OR coalesce(psi_feat_max, 0) >= 0.1 THEN 1 ELSE 0 END AS drift_alert, "
    "greatest(health_all_same, health_has_negative, health_extreme_outlier) AS health_alert FROM lg0)",
    "lg AS (SELECT *, CASE perf_alert + drift_alert + health_alert WHEN 0 THEN 'GREEN' WHEN 1 THEN 'YELLOW' ELSE 'RED' END AS alert_level FROM lg1)",
)
register(
    "d6_monitor_baseline",
    "series_id:s n:i baseline_rmse:4 baseline_qlike:3 alert_upper_rmse:4",
    lambda s, d: dr.monitor_baseline(retrained(s, d)),
    sql_r("SELECT * FROM mb", *MON),
)
register(
    "d7_monitor_windows",
    "series_id:s window:i n:i date:d rmse:4 qlike:3",
    lambda s, d: dr.monitor_windows(retrained(s, d)),
    sql_r('SELECT *, wn AS "window" FROM mw', *MON),
)
register(
    "d8_prediction_health",
    "series_id:s window:i health_all_same:i health_has_negative:i health_extreme_outlier:i",
    lambda s, d: dr.monitor_windows(retrained(s, d)),
    sql_r('SELECT *, wn AS "window" FROM mw', *MON),
)
register(
    "d9_as_of_drift",
    "series_id:s window:i date:d psi_rv:6",
    lambda s, d: dr.as_of(
        dr.monitor_windows(retrained(s, d)), rv_scan(s, d).select("series_id", "date", "psi"), "date", "psi", "psi_rv"
    ),
    sql_r('SELECT *, wn AS "window" FROM lg', *LOG),
)


@shared()
def log(s, d):
    return dr.monitor_log(retrained(s, d), rv_scan(s, d), feature_psi(s, d))


register(
    "d10_monitor_log",
    "series_id:s window:i date:d rmse:4 qlike:3 baseline_rmse:4 alert_upper_rmse:4 psi_rv:6 psi_feat_max:6 perf_alert:i drift_alert:i health_alert:i alert_level:s",
    log,
    sql_r('SELECT *, wn AS "window" FROM lg', *LOG),
)
register(
    "d11_alert_rates",
    "series_id:s total_windows:i green_pct:4 yellow_pct:4 red_pct:4 perf_alerts:i drift_alerts:i health_alerts:i",
    lambda s, d: dr.alert_rates(log(s, d)),
    sql_r(
        "SELECT series_id, count(*) AS total_windows, "
        + ", ".join(f"avg(CASE WHEN alert_level = '{x.upper()}' THEN 100.0 ELSE 0 END) AS {x}_pct" for x in ("green", "yellow", "red"))
        + ", sum(perf_alert) AS perf_alerts, sum(drift_alert) AS drift_alerts, sum(health_alert) AS health_alerts FROM lg GROUP BY 1",
        *LOG,
    ),
)

_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


def _inlist(ws):
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


_UP = f"len([w for w in {_WORDS} if list_contains({_inlist(sn.POSITIVE)}, w)])"
_DN = f"len([w for w in {_WORDS} if list_contains({_inlist(sn.NEGATIVE)}, w)])"
_SCORE = f"coalesce(CAST({_UP} - {_DN} AS DOUBLE) / nullif({_UP} + {_DN}, 0), 0)"
register(
    "n1_text_scores",
    "doc_id:i compound_score:6",
    lambda s, d: sn.scored(table(s, d, "documents"), "text"),
    f"SELECT doc_id, {_SCORE} AS compound_score FROM documents",
)


def daily(s, d):
    """Documents laid over the calendar of the bars: source picks the series, length the day."""
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("n_chars") % 2000).cast("int"))
    key = F.when(F.col("lang") == "en", "A").when(F.col("lang") == "de", "N").otherwise("R")
    docs = table(s, d, "documents").select(key.alias("series_id"), day.alias("t"), "text")
    return sn.daily_sentiment(sn.scored(docs, "text"))


DAILY = (
    "sd0 AS (SELECT CASE lang WHEN 'en' THEN 'A' WHEN 'de' THEN 'N' ELSE 'R' END AS series_id, DATE '1996-01-01' + CAST(n_chars % 2000 AS INTEGER) AS t, "
    f"{_SCORE} AS s FROM documents)",
    "sd1 AS (SELECT series_id, t, avg(s) AS compound_score, count(*) AS n_texts FROM sd0 GROUP BY 1, 2)",
)
register(
    "n1_daily_sentiment",
    "series_id:s t:d compound_score:6 n_texts:i",
    daily,
    sq.query(*DAILY, select="SELECT * FROM sd1"),
)
register(
    "n2_merged_sentiment",
    "series_id:s t:d rv_lag_1:4 compound_score:6",
    lambda s, d: sn.merge_sentiment(har(s, d), daily(s, d)),
    sql_r(
        "SELECT ht.series_id, ht.t, rv_lag_1, coalesce(compound_score, 0) AS compound_score FROM ht LEFT JOIN sd1 ON sd1.series_id = ht.series_id AND sd1.t = ht.t",
        HAR_TABLE, *DAILY,
    ),
)
