"""Streaming queries and their batch twins (D12-D17) and the result sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.plans import sqltext as sq
from barograph.plans.drift import MON
from barograph.plans.forecast import HAR4, har, retrained, wf_sql
from barograph.plans.market import HAR_TABLE, sql_r
from barograph.plans.registry import register_reusing as register
from barograph.plans.registry import shared
from barograph.plans.tables import rets, table
from barograph.sources.bars import write_series
from barograph.streaming import monitor, online, ticks
from barograph.streaming.runner import drain, fresh_folder, staged


def _round_trip(s, d):
    folder = fresh_folder(s, "returns")
    write_series(rets(s, d).select("series_id", "t", "close", "log_return"), folder)
    return s.read.parquet(folder)


register(
    "s7_result_sink",
    "series_id:s t:d close:8 log_return:8",
    _round_trip,
    sql_r("SELECT series_id, t, close, log_return FROM r"),
)


@shared()
def online_rows(s, d):
    return online.online_batch(har(s, d), HAR4)


def online_streamed(s, d):
    features = har(s, d).select("series_id", "t", "target", *HAR4)
    return drain(online.online_stream(staged(features, "features"), HAR4), "online")


_K = range(len(HAR4))
_LINE = "OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"
_PREV = "OVER (PARTITION BY series_id ORDER BY pos)"


def _each(text: str) -> str:
    """``text`` for every feature: # is its number, @ its name."""
    return ", ".join(text.replace("#", str(i)).replace("@", f) for i, f in enumerate(HAR4))


def _fade(x: str, d: float) -> str:
    """Decayed average of ``x`` up to each row, starting from zero."""
    return f"pow({d}, pos) * sum({1 - d} * ({x}) * pow({d}, -pos)) {_LINE}"


def _cholesky() -> list[str]:
    """Weights w0, w1, ... of (gram + alpha) w = cross, column by column."""
    out, src = [], "og"
    for j in _K:
        d = f"sqrt(g{j}{j} + {online.EWMA['alpha']}" + "".join(f" - l{j}{m} * l{j}{m}" for m in range(j)) + ")"
        out.append(f"oa{j} AS (SELECT *, {d} AS l{j}{j} FROM {src})")
        below = [
            f"(g{j}{i}" + "".join(f" - l{i}{m} * l{j}{m}" for m in range(j)) + f") / l{j}{j} AS l{i}{j}" for i in _K if i > j
        ]
        solved = f"(c{j}" + "".join(f" - l{j}{m} * f{m}" for m in range(j)) + f") / l{j}{j} AS f{j}"
        src = f"ob{j}"
        out.append(f"{src} AS (SELECT *, {', '.join([*below, solved])} FROM oa{j})")
    for j in reversed(_K):
        w = f"(f{j}" + "".join(f" - l{m}{j} * w{m}" for m in _K if m > j) + f") / l{j}{j} AS w{j}"
        out.append(f"oc{j} AS (SELECT *, {w} FROM {src})")
        src = f"oc{j}"
    return out


_GRAM = ", ".join(f"{_fade(f'z{i} * z{j}', 0.97)} AS g{i}{j}" for i in _K for j in _K if i <= j)
ONLINE = (
    HAR_TABLE,
    f"o0 AS (SELECT series_id, t, target AS y, {_each('@ AS x#')}, row_number() OVER (PARTITION BY series_id ORDER BY t) AS pos FROM ht)",
    f"o1 AS (SELECT *, {_each(f'avg(x#) {_LINE} AS m#')} FROM o0)",
    f"o2 AS (SELECT *, {_each(f'coalesce(lag(m#) {_PREV}, 0) AS p#')} FROM o1)",
    f"o3 AS (SELECT *, {_each(_fade('(x# - p#) * (x# - m#)', 0.97) + ' AS s#')}, {_each(_fade('(x# - p#) * (x# - m#)', 0.99) + ' AS v#')} FROM o2)",
    f"o4 AS (SELECT *, {_each('(x# - m#) / sqrt(greatest(s#, 1e-8)) AS z#')}, {_each('(x# - m#) / sqrt(greatest(v#, 1e-8)) AS u#')}, "
    f"{_each(f'lag(s#) {_PREV} AS sp#')}, {_each(f'lag(v#) {_PREV} AS vp#')} FROM o3)",
    f"og AS (SELECT *, {_GRAM}, {_each(_fade('z# * y', 0.97) + ' AS c#')} FROM o4)",
    *_cholesky(),
    f"ow AS (SELECT *, {_each(f'lag(w#) {_PREV} AS b#')} FROM oc0)",
)
_AHEAD = " + ".join(f"b{i} * (x{i} - p{i}) / sqrt(greatest(sp{i}, 1e-8))" for i in _K)
_EWMA_ROWS = f"SELECT series_id, t, pos - 1 AS step, y AS actual, CASE WHEN pos > {online.BURN_IN} THEN {_AHEAD} END AS pred_ewma FROM ow"
_EWMA_SQL = sql_r(_EWMA_ROWS, *ONLINE)
_ERR = "(y - k" + "".join(f" - k{i} * u{i}" for i in _K) + ")"
_SIZE = f"{2 * online.SGD['rate']} / (1 + {online.SGD['fade']} * o4.pos)"
_STEP = ", ".join(f"k{i} + {_SIZE} * ({_ERR} * u{i} - {online.SGD['alpha']} * k{i})" for i in _K)
_SGD_AHEAD = " + ".join(f"k{i} * (x{i} - p{i}) / sqrt(greatest(vp{i}, 1e-8))" for i in _K)
_SGD_ROWS = (
    "SELECT * FROM (WITH RECURSIVE sg AS ("
    f"SELECT DISTINCT series_id, CAST(0 AS BIGINT) AS seen, {_each('CAST(0 AS DOUBLE) AS k#')}, CAST(0 AS DOUBLE) AS k FROM o4 "
    f"UNION ALL SELECT sg.series_id, seen + 1, {_STEP}, k + {_SIZE} * {_ERR} "
    "FROM sg JOIN o4 ON o4.series_id = sg.series_id AND o4.pos = seen + 1) "
    f"SELECT o4.series_id, t, pos - 1 AS step, y AS actual, CASE WHEN pos > {online.BURN_IN} THEN k + {_SGD_AHEAD} END AS pred_sgd "
    "FROM o4 JOIN sg ON sg.series_id = o4.series_id AND seen = pos - 1)"
)
_SGD_SQL = sql_r(_SGD_ROWS, *ONLINE[:6])
_ON = "series_id:s t:d step:i actual:4"
register("d12_online_ewma_ridge", f"{_ON} pred_ewma:4", online_rows, _EWMA_SQL)
register("d12_online_ewma_ridge_stream", f"{_ON} pred_ewma:4", online_streamed, _EWMA_SQL)
register("d13_online_sgd_ridge", f"{_ON} pred_sgd:4", online_rows, _SGD_SQL)
register("d13_online_sgd_ridge_stream", f"{_ON} pred_sgd:4", online_streamed, _SGD_SQL)
register(
    "d14_coefficient_trace",
    "series_id:s t:d step:i " + " ".join(f"w_{f}:6" for f in HAR4),
    lambda s, d: online.coefficient_trace(online_rows(s, d), HAR4),
    sql_r(
        f"SELECT series_id, t, pos - 1 AS step, {_each('b# AS w_@')} FROM ow WHERE pos > {online.BURN_IN} AND (pos - 1) % 5 = 0",
        *ONLINE,
    ),
)
register(
    "d15_online_vs_offline",
    "series_id:s model:s rmse:4 n:i",
    lambda s, d: online.online_against_offline(online_rows(s, d), retrained(s, d)),
    sql_r(
        "SELECT series_id, model, sqrt(avg((actual - pred) * (actual - pred))) AS rmse, count(*) AS n FROM ("
        "SELECT series_id, actual, 'EWMA_Online' AS model, pred_ewma AS pred FROM tail UNION ALL "
        "SELECT series_id, actual, 'SGD_Online', pred_sgd FROM tail UNION ALL "
        "SELECT tail.series_id, tail.actual, 'Offline_21d', wop.pred FROM tail JOIN wop USING (series_id, t)) "
        "WHERE pred IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 10",
        *ONLINE,
        *wf_sql(10, 252, None, "wo", HAR4),
        f"oe AS ({_EWMA_ROWS})",
        f"os AS ({_SGD_ROWS})",
        "tail AS (SELECT series_id, t, oe.actual, pred_ewma, pred_sgd FROM oe JOIN os USING (series_id, t) "
        "WHERE pred_ewma IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY t DESC) <= 500)",
    ),
)


def tick_stream(s, d):
    raw = table(s, d, "events")
    stream = s.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return ticks.unique_ticks(
        stream.select(
            "event_id", F.col("event_type").alias("series_id"),
            F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        )
    )


def flat(df, window: str):
    return df.withColumn("start", F.date_format(f"{window}.start", "yyyy-MM-dd HH:mm:ss")).drop(window)


EV = "ev AS (SELECT event_type AS series_id, ts, event_id, value AS price FROM events)"
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _bars_sql(name: str, width: str) -> str:
    return (
        f"{name} AS (SELECT series_id, time_bucket(INTERVAL '{width}', ts) AS w, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, "
        "arg_max(price, (ts, event_id)) AS close, count(*) AS n FROM ev GROUP BY 1, 2)"
    )


register(
    "d16_event_time_bars",
    "series_id:s start:s open:4 high:4 low:4 close:4 n:i",
    lambda s, d: drain(flat(ticks.window_bars(tick_stream(s, d), "1 hour"), "w"), "bars"),
    sq.query(
        EV, _bars_sql("hb", "1 hour"),
        select=f"SELECT series_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS start, open, high, low, close, n FROM hb WHERE w + INTERVAL 1 HOUR <= {_CLOSED}",
    ),
)
register(
    "d16_streaming_variance",
    "series_id:s start:s n_bars:i rv:4",
    lambda s, d: drain(
        ticks.realised_variance(tick_stream(s, d), "5 minutes", "1 day").withColumn(
            "start", F.date_format("start", "yyyy-MM-dd")
        ),
        "variance",
    ),
    sq.query(
        EV, _bars_sql("fb", "5 minutes"),
        "fr AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY series_id, CAST(w AS DATE) ORDER BY w) AS x FROM fb)",
        select="SELECT series_id, strftime(CAST(w AS DATE), '%Y-%m-%d') AS start, count(*) AS n_bars, coalesce(sum(x * x), 0) AS rv FROM fr GROUP BY series_id, CAST(w AS DATE) "
        f"HAVING CAST(w AS DATE) + INTERVAL 1 DAY <= {_CLOSED}",
    ),
)
register(
    "d16_activity_sessions",
    "series_id:s start:s n:i high:4 low:4",
    lambda s, d: drain(flat(ticks.activity_sessions(tick_stream(s, d)), "s"), "sessions"),
    sq.query(
        EV,
        "gaps AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY series_id ORDER BY ts, event_id) + INTERVAL 10 MINUTE, false) AS fresh FROM ev)",
        "runs AS (SELECT *, count_if(fresh) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM gaps)",
        select="SELECT series_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, max(price) AS high, min(price) AS low "
        f"FROM runs GROUP BY series_id, run HAVING max(ts) + INTERVAL 10 MINUTE <= {_CLOSED}",
    ),
)


def alert_stream(s, d):
    preds = retrained(s, d).select("series_id", "t", "actual", "pred")
    return drain(monitor.monitor_stream(staged(preds, "forecasts")), "alerts")


register(
    "d17_alert_stream",
    "series_id:s window:i date:d rmse:4 qlike:3 alert_upper_rmse:4 perf_alert:i health_alert:i alert_level:s late:i",
    alert_stream,
    sql_r(
        "SELECT *, CASE perf_alert + health_alert WHEN 0 THEN 'GREEN' WHEN 1 THEN 'YELLOW' ELSE 'RED' END AS alert_level, 0 AS late FROM (SELECT mw.series_id, wn AS \"window\", date, rmse, qlike, "
        "alert_upper_rmse, CASE WHEN rmse > alert_upper_rmse THEN 1 ELSE 0 END AS perf_alert, greatest(health_all_same, health_has_negative, health_extreme_outlier) AS health_alert "
        "FROM mw JOIN mb USING (series_id))",
        *MON,
    ),
)
