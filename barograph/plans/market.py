"""Sources, quality, returns, volatility and technical indicators (S, Q, R, T, M1-M6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.operators import quality as ql
from barograph.operators import returns as rt
from barograph.operators import technical as te
from barograph.plans import sqltext as sq
from barograph.plans.registry import register
from barograph.plans.tables import SERIES, bars, rets, table, vols
from barograph.sources import articles, bars as src

B, R = sq.BARS, sq.RET
lag, roll, W = sq.lag, sq.roll, sq.W


def _on_rets(*steps):
    def build(spark, d):
        df = rets(spark, d)
        for step in steps:
            df = step(df)
        return df

    return build


def _on_vols(*steps):
    def build(spark, d):
        df = vols(spark, d)
        for step in steps:
            df = step(df)
        return df

    return build


def sql_r(select: str, *ctes: str) -> str:
    return sq.query(B, R, *ctes, select=select)


# --- sources -----------------------------------------------------------------------

register(
    "s1_read_bars",
    "series_id:s t:d price:8 volume:2",
    lambda s, d: table(s, d, "lineitem")
    .withColumnsRenamed({"l_returnflag": "series_id", "l_shipdate": "t", "l_quantity": "volume"})
    .select(
        "series_id", F.to_date("t").alias("t"),
        (F.col("l_extendedprice") / F.col("volume")).alias("price"), "volume",
    ),
    "SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS t, "
    "l_extendedprice / l_quantity AS price, l_quantity AS volume FROM lineitem",
)
register(
    "s2_sorted_series",
    "series_id:s t:d pos:i close:8",
    lambda s, d: rets(s, d),
    sql_r("SELECT series_id, t, pos, close FROM r"),
)
register(
    "s3_daily_bars",
    "series_id:s t:d open:8 high:8 low:8 close:8 volume:2",
    bars,
    sq.query(B, select="SELECT * FROM bars"),
)
register(
    "s4_aligned_panel",
    "t:d A:6 N:6 R:6",
    lambda s, d: src.aligned_panel(rets(s, d), "log_return", SERIES),
    sql_r(
        "SELECT t, max(log_return) FILTER (series_id = 'A') AS \"A\", "
        "max(log_return) FILTER (series_id = 'N') AS \"N\", "
        "max(log_return) FILTER (series_id = 'R') AS \"R\" FROM r GROUP BY t "
        "HAVING count(log_return) FILTER (series_id IN ('A', 'N', 'R')) = 3"
    ),
)


def _metric_union(s, d):
    li = table(s, d, "lineitem")
    first = li.groupBy(F.col("l_returnflag").alias("model")).agg(
        F.avg("l_discount").alias("rmse"), F.count(F.lit(1)).alias("n")
    )
    second = li.groupBy(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("version")
    ).agg(F.avg("l_discount").alias("rmse"), F.avg("l_tax").alias("mae"))
    return src.union_metrics(first, second)


register(
    "s5_union_metrics",
    "model:s rmse:8 mae:8 n:i",
    _metric_union,
    "SELECT l_returnflag AS model, avg(l_discount) AS rmse, NULL AS mae, count(*) AS n "
    "FROM lineitem GROUP BY l_returnflag UNION ALL "
    "SELECT l_returnflag || '_' || l_linestatus, avg(l_discount), avg(l_tax), NULL "
    "FROM lineitem GROUP BY l_returnflag, l_linestatus",
)


def _articles(s, d):
    doc = table(s, d, "documents")
    day = F.concat(F.lit("2024-03-"), F.lpad((F.col("n_chars") % 40).cast("string"), 2, "0"))
    article = F.struct(
        F.when(F.col("lang") == "de", F.lit("[Removed]"))
        .when(F.col("lang") == "en", F.col("source"))
        .alias("title"),
        F.col("text").alias("description"),
        F.concat(day, F.lit("T00:00:00Z")).alias("publishedAt"),
        F.struct(F.col("lang").alias("name")).alias("source"),
    )
    payload = doc.select("doc_id", F.to_json(F.array(article)).alias("payload"))
    return articles.flatten_articles(payload, "payload", "doc_id").withColumn(
        "text_md5", F.md5("text")
    )


register(
    "s6_flatten_articles",
    "doc_id:i date:d title:s source:s text_md5:s",
    _articles,
    "SELECT doc_id, day AS date, source AS title, lang AS source, "
    "md5(trim(source || '. ' || text, ' ')) AS text_md5 FROM (SELECT *, "
    "TRY_CAST('2024-03-' || lpad(CAST(n_chars % 40 AS VARCHAR), 2, '0') AS DATE) AS day "
    "FROM documents WHERE lang = 'en') WHERE day IS NOT NULL AND source <> ''",
)
register(
    "s8_head_sample",
    "series_id:s t:d pos:i close:8",
    lambda s, d: src.head_per_series(bars(s, d), 5),
    sq.query(
        B,
        select=f"SELECT * FROM (SELECT *, row_number() OVER {W} AS pos FROM bars) WHERE pos <= 5",
    ),
)

# --- quality -----------------------------------------------------------------------

register(
    "q1_quality_report",
    "series_id:s rows:i start:d end:d missing_cells:i duplicate_dates:i non_bdays:i "
    "neg_prices:i zero_volume:i bad_ohlc:i close_min:8 close_max:8 status:s",
    lambda s, d: ql.quality_report(bars(s, d)),
    sq.query(
        B,
        select="""SELECT *, CASE WHEN missing_cells + duplicate_dates + neg_prices + bad_ohlc > 0
 THEN 'CHECK' ELSE 'OK' END AS status FROM (
 SELECT series_id, count(*) AS rows, min(t) AS start, max(t) AS "end",
 5 * count(*) - count(open) - count(high) - count(low) - count(close) - count(volume) AS missing_cells,
 count(t) - count(DISTINCT t) AS duplicate_dates,
 count(*) FILTER (dayofweek(t) IN (0, 6)) AS non_bdays,
 count(*) FILTER (least(open, high, low, close) < 0) AS neg_prices,
 count(*) FILTER (volume = 0) AS zero_volume,
 count(*) FILTER (high < low OR open NOT BETWEEN low AND high OR close NOT BETWEEN low AND high) AS bad_ohlc,
 min(close) AS close_min, max(close) AS close_max FROM bars GROUP BY series_id)""",
    ),
)
register(
    "q2_return_summary",
    "series_id:s n:i mean:8 std:6 skew:6 kurt:5 min:6 max:6 ann_vol:5",
    lambda s, d: ql.return_summary(rets(s, d)),
    sql_r(
        "SELECT series_id, count(log_return) AS n, avg(log_return) AS mean, "
        "stddev_samp(log_return) AS std, skewness(log_return) AS skew, "
        "kurtosis(log_return) AS kurt, min(log_return) AS min, max(log_return) AS max, "
        "stddev_samp(log_return) * sqrt(252) AS ann_vol FROM r GROUP BY series_id"
    ),
)

_VOL = "v AS (SELECT *, " + ", ".join(
    f"{roll('stddev_samp', 'log_return', k)} * sqrt(252) AS vol_c2c_{k}d, "
    f"sqrt({roll('avg', 'hl2', k)} * 252 / (4 * ln(2))) AS vol_park_{k}d, "
    f"sqrt(greatest({roll('avg', 'gk_daily_var', k)}, 0) * 252) AS vol_gk_{k}d"
    for k in (5, 21, 63)
) + """ FROM (SELECT *, pow(ln(high / low), 2) AS hl2,
 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS gk_daily_var FROM r))"""

register(
    "q3_volatility_summary",
    "series_id:s ann_vol_21d:5 ann_vol_63d:5 parkinson_21d:5 garman_klass_21d:5 max_rv_21d:5 min_rv_21d:5",
    lambda s, d: ql.volatility_summary(vols(s, d)),
    sql_r(
        "SELECT series_id, avg(vol_c2c_21d) AS ann_vol_21d, avg(vol_c2c_63d) AS ann_vol_63d, "
        "avg(vol_park_21d) AS parkinson_21d, avg(vol_gk_21d) AS garman_klass_21d, "
        "max(vol_c2c_21d) AS max_rv_21d, min(vol_c2c_21d) AS min_rv_21d FROM v GROUP BY series_id",
        _VOL,
    ),
)
_COVER = ("vol_c2c_21d", "vol_c2c_63d", "vol_park_21d")
register(
    "q4_recent_coverage",
    "series_id:s feature:s present:i",
    lambda s, d: ql.recent_coverage(vols(s, d), _COVER),
    sql_r(
        " UNION ALL ".join(
            f"SELECT series_id, '{c}' AS feature, count({c}) AS present FROM (SELECT *, "
            "row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS back FROM v) "
            "WHERE back <= 5 GROUP BY series_id"
            for c in _COVER
        ),
        _VOL,
    ),
)


def _sql_quantile(p: str) -> str:
    from barograph.functions import special as sp

    def poly(cs, x):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * {x} + {c!r})"
        return out

    q, s = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    qq = f"({q} * {q})"
    mid = f"{q} * {poly(sp.QUANTILE_A, qq)} / {poly(sp.QUANTILE_B, qq)}"
    tail = f"{poly(sp.QUANTILE_C, s)} / {poly(sp.QUANTILE_D, s)}"
    lo = sp.QUANTILE_TAIL
    return f"CASE WHEN {p} < {lo} THEN {tail} WHEN {p} > {1 - lo} THEN -({tail}) ELSE {mid} END"


_QQ = (
    "o AS (SELECT series_id, t, log_return AS sample, CAST(row_number() OVER "
    "(PARTITION BY series_id ORDER BY log_return, t) AS DOUBLE) AS i, "
    "CAST(count(*) OVER (PARTITION BY series_id) AS DOUBLE) AS n FROM r WHERE log_return IS NOT NULL)",
    "pp AS (SELECT *, CASE WHEN i = n THEN pow(0.5, 1 / n) WHEN i = 1 THEN 1 - pow(0.5, 1 / n) "
    "ELSE (i - 0.3175) / (n + 0.365) END AS p FROM o)",
    f"qq AS (SELECT *, {_sql_quantile('p')} AS theoretical FROM pp)",
)
register(
    "q5_qq_points",
    "series_id:s t:d sample:6 p:8 theoretical:6",
    lambda s, d: ql.qq_points(rets(s, d), "log_return"),
    sql_r("SELECT * FROM qq", *_QQ),
)
register(
    "q5_qq_line",
    "series_id:s slope:6 intercept:6 r:6",
    lambda s, d: ql.qq_line(ql.qq_points(rets(s, d), "log_return")),
    sql_r(
        "SELECT series_id, regr_slope(sample, theoretical) AS slope, "
        "regr_intercept(sample, theoretical) AS intercept, corr(sample, theoretical) AS r "
        "FROM qq GROUP BY series_id",
        *_QQ,
    ),
)
register(
    "q6_histogram",
    "series_id:s bin:i n:i density:8",
    lambda s, d: ql.histogram(rets(s, d), "log_return", 90),
    sql_r(
        "SELECT series_id, bin, n, n / sum(n) OVER (PARTITION BY series_id) / width AS density FROM ("
        "SELECT series_id, width, least(CAST(floor((x - low) / width) AS BIGINT), 89) AS bin, count(*) AS n FROM ("
        "SELECT r.series_id, log_return AS x, m.least AS low, (m.most - m.least) / 90 AS width FROM r JOIN ("
        "SELECT series_id, min(log_return) AS least, max(log_return) AS most FROM r GROUP BY 1) m "
        "ON r.series_id = m.series_id WHERE log_return IS NOT NULL) GROUP BY 1, 2, 3)"
    ),
)
register(
    "q6_histogram_rows",
    "series_id:s binned:i",
    lambda s, d: ql.histogram(rets(s, d), "log_return", 90).groupBy("series_id").agg(F.sum("n").alias("binned")),
    sql_r("SELECT series_id, count(log_return) AS binned FROM r GROUP BY 1"),
)
register(
    "q7_density_overlay",
    "series_id:s mean:8 std:6 kurt:5 t_df:i t_scale:6",
    lambda s, d: ql.density_overlay(rets(s, d), "log_return"),
    sql_r(
        "SELECT *, std * sqrt(CAST(t_df - 2 AS DOUBLE) / t_df) AS t_scale FROM (SELECT *, "
        "greatest(3, CAST(floor(6 / greatest(kurt, 0.5) + 4) AS INTEGER)) AS t_df FROM ("
        "SELECT series_id, avg(log_return) AS mean, stddev_samp(log_return) AS std, "
        "kurtosis_pop(log_return) AS kurt FROM r GROUP BY series_id))"
    ),
)
register(
    "q8_normalised_price",
    "series_id:s t:d norm_close:6",
    lambda s, d: ql.normalised_price(bars(s, d)),
    sq.query(
        B, select=f"SELECT series_id, t, close / first_value(close) OVER {W} AS norm_close FROM bars"
    ),
)

# --- returns and volatility --------------------------------------------------------

for name, c, digits in (
    ("r1_simple_return", "simple_return", 4),
    ("r2_log_return", "log_return", 8),
    ("r3_daily_variance", "rv", 4),
):
    register(
        name, f"series_id:s t:d {c}:{digits}", rets, sql_r(f"SELECT series_id, t, {c} FROM r")
    )
for name, cols in (
    ("r4_close_to_close_vol", "vol_c2c_5d:5 vol_c2c_21d:5 vol_c2c_63d:5"),
    ("r5_parkinson_vol", "vol_park_5d:5 vol_park_21d:5 vol_park_63d:5"),
    ("r6_garman_klass_vol", "gk_daily_var:6 vol_gk_5d:5 vol_gk_21d:5 vol_gk_63d:5"),
):
    register(
        name,
        f"series_id:s t:d {cols}",
        vols,
        sql_r("SELECT * FROM v", _VOL),
    )
register(
    "r7_target_lead",
    "series_id:s t:d target:4",
    _on_rets(rt.with_target),
    sql_r(f"SELECT series_id, t, lead(rv) OVER {W} AS target FROM r"),
)
_LAGS = ", ".join(
    [f"{lag('rv', k)} AS rv_lag{k}" for k in (1, 2, 3, 5, 10, 21)]
    + [f"{lag('log_return', k)} AS ret_lag{k}" for k in (1, 2, 3, 5)]
)
register(
    "r8_lags",
    "series_id:s t:d " + " ".join(f"rv_lag{k}:4" for k in (1, 2, 3, 5, 10, 21)) + " "
    + " ".join(f"ret_lag{k}:6" for k in (1, 2, 3, 5)),
    _on_rets(rt.with_lags),
    sql_r(f"SELECT series_id, t, {_LAGS} FROM r"),
)
HAR_SQL = (
    f"{lag('rv')} AS rv_lag_1, {roll('avg', 'rv', 5, skip=1)} AS rv_lag_5, "
    f"{roll('avg', 'rv', 21, skip=1)} AS rv_lag_21, abs({lag('log_return')}) AS abs_ret_lag1"
)
register(
    "r9_har_averages",
    "series_id:s t:d rv_lag_1:4 rv_lag_5:4 rv_lag_21:4 rv_lag_22:4",
    _on_rets(lambda df: rt.with_har(df, (5, 21, 22))),
    sql_r(
        f"SELECT series_id, t, {HAR_SQL}, {roll('avg', 'rv', 22, skip=1)} AS rv_lag_22 FROM r"
    ),
)
EWM10 = (
    f"r1 AS (SELECT *, {lag('rv')} AS rv1 FROM r)",
    sq.ewm("r1", "e10", "rv1", 10, 5),
)
register(
    "r10_ewm_variance",
    "series_id:s t:d rv_ewm_10:4",
    _on_rets(rt.with_ewm_variance),
    sql_r("SELECT series_id, t, v AS rv_ewm_10 FROM e10", *EWM10),
)
register(
    "r11_abs_return_lag",
    "series_id:s t:d abs_ret_lag1:8",
    _on_rets(rt.with_har),
    sql_r(f"SELECT series_id, t, abs({lag('log_return')}) AS abs_ret_lag1 FROM r"),
)
BASE_SQL = (
    *EWM10,
    "bf AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS pos FROM ("
    f"SELECT r.series_id, r.t, {_LAGS.replace('(rv', '(r.rv').replace('(log', '(r.log').replace('BY series_id ORDER BY t', 'BY r.series_id ORDER BY r.t')}, "
    f"{roll('stddev_samp', 'r.log_return', 5, skip=1).replace('BY series_id ORDER BY t', 'BY r.series_id ORDER BY r.t')} * sqrt(252) AS roll_vol_5, "
    f"{roll('stddev_samp', 'r.log_return', 21, skip=1).replace('BY series_id ORDER BY t', 'BY r.series_id ORDER BY r.t')} * sqrt(252) AS roll_vol_21, "
    "e10.v AS rv_ewm_10, abs(lag(r.log_return) OVER (PARTITION BY r.series_id ORDER BY r.t)) AS abs_ret_lag1, "
    "lead(r.rv) OVER (PARTITION BY r.series_id ORDER BY r.t) AS target "
    "FROM r JOIN e10 ON r.series_id = e10.series_id AND r.t = e10.t) WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in (*rt.BASE_FEATURES, "target")) + ")",
)
register(
    "r12_base_features",
    "series_id:s t:d pos:i "
    + " ".join(f"{c}:4" for c in (*rt.BASE_FEATURES, "target")),
    _on_rets(rt.base_features),
    sql_r("SELECT * FROM bf", *BASE_SQL),
)
_SIDES = (
    "r2 AS (SELECT *, CASE WHEN log_return IS NOT NULL THEN pow(greatest(log_return, 0), 2) * 252 END AS rv_pos, "
    "CASE WHEN log_return IS NOT NULL THEN pow(least(log_return, 0), 2) * 252 END AS rv_neg, "
    "CASE WHEN log_return IS NOT NULL THEN least(log_return, 0) END AS falls, "
    "CASE WHEN log_return IS NOT NULL THEN greatest(log_return, 0) END AS rises FROM r)"
)
_SEMI = ", ".join(
    f"{lag(f'rv_{x}')} AS rv_{x}_lag_1, {roll('avg', f'rv_{x}', 5, skip=1)} AS rv_{x}_lag_5, "
    f"{roll('avg', f'rv_{x}', 21, skip=1)} AS rv_{x}_lag_21"
    for x in ("pos", "neg")
)
_LEV = (
    f"{lag('falls')} AS leverage_term, abs({roll('sum', 'falls', 5, 3, skip=1)}) "
    f"- {roll('sum', 'rises', 5, 3, skip=1)} AS ret_asym_5"
)
register(
    "r13_semivariance",
    "series_id:s t:d rv_pos_lag_1:4 rv_pos_lag_5:4 rv_pos_lag_21:4 rv_neg_lag_1:4 rv_neg_lag_5:4 rv_neg_lag_21:4",
    _on_rets(rt.with_semivariance),
    sql_r(f"SELECT series_id, t, {_SEMI} FROM r2", _SIDES),
)
register(
    "r14_leverage_term",
    "series_id:s t:d leverage_term:8",
    _on_rets(rt.with_leverage),
    sql_r(f"SELECT series_id, t, {_LEV} FROM r2", _SIDES),
)
register(
    "r15_return_asymmetry",
    "series_id:s t:d ret_asym_5:6",
    _on_rets(rt.with_leverage),
    sql_r(f"SELECT series_id, t, {_LEV} FROM r2", _SIDES),
)
AHAR_SQL = (
    _SIDES,
    "ah AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS pos2 FROM ("
    f"SELECT series_id, t, {HAR_SQL}, {_SEMI}, {_LEV}, {sq.lead('rv')} AS target FROM r2) "
    "WHERE rv_lag_21 IS NOT NULL AND ret_asym_5 IS NOT NULL AND target IS NOT NULL)",
)
HAR_TABLE = (
    "ht AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS hpos, "
    "count(*) OVER (PARTITION BY series_id) AS hn FROM ("
    f"SELECT series_id, t, rv, log_return, {HAR_SQL}, {sq.lead('rv')} AS target FROM r) "
    "WHERE rv_lag_1 IS NOT NULL AND rv_lag_21 IS NOT NULL AND target IS NOT NULL)"
)
_SPLIT = (
    "sp AS (SELECT *, CASE WHEN hpos > hn - 500 THEN 'test' "
    "WHEN hpos > floor((hn - 500) * (1 - 0.15)) THEN 'val' ELSE 'train' END AS split FROM ht)"
)
register(
    "r16_tail_split",
    "series_id:s split:s n:i first_day:d last_day:d",
    lambda s, d: rt.split_tail(rt.har_table(rets(s, d)), 500, 0.15)
    .groupBy("series_id", "split")
    .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_day"), F.max("t").alias("last_day")),
    sql_r(
        "SELECT series_id, split, count(*) AS n, min(t) AS first_day, max(t) AS last_day "
        "FROM sp GROUP BY 1, 2",
        HAR_TABLE, _SPLIT,
    ),
)
register(
    "r17_scaled_features",
    "series_id:s t:d split:s " + " ".join(f"{c}_scaled:6" for c in rt.HAR),
    lambda s, d: rt.scale_on_train(rt.split_tail(rt.har_table(rets(s, d)), 500, 0.15), rt.HAR),
    sql_r(
        "SELECT series_id, t, split, "
        + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}_scaled" for c in rt.HAR)
        + " FROM sp JOIN (SELECT series_id, "
        + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in rt.HAR)
        + " FROM sp WHERE split = 'train' GROUP BY series_id) USING (series_id)",
        HAR_TABLE, _SPLIT,
    ),
)


def _sequences(s, d):
    seqs = rt.sequences(rets(s, d), ("rv", "log_return"), 22).withColumn("target", F.col("rv"))
    pos = F.sequence(F.lit(0), F.lit(21))
    return seqs.select(
        "series_id", "t", "target", F.size("window").alias("length"),
        F.posexplode("window").alias("step", "row"),
    ).select(
        "series_id", "t", "target", "length", "step",
        F.col("row")[0].alias("rv"), F.col("row")[1].alias("ret"),
    )


register(
    "r18_sequences",
    "series_id:s t:d target:4 length:i step:i rv:4 ret:6",
    _sequences,
    sql_r(
        "SELECT a.series_id, a.t, a.rv AS target, 22 AS length, b.pos - a.pos + 22 AS step, "
        "b.rv AS rv, b.log_return AS ret FROM r a JOIN r b ON a.series_id = b.series_id "
        "AND b.pos BETWEEN a.pos - 22 AND a.pos - 1 WHERE a.pos >= 24"
    ),
)

# --- technical ---------------------------------------------------------------------

_TR = (
    f"tr AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) "
    "AS true_range FROM r)"
)
register(
    "t1_true_range",
    "series_id:s t:d true_range:8",
    lambda s, d: te.true_range(bars(s, d)),
    sql_r("SELECT series_id, t, true_range FROM tr", _TR),
)
register(
    "t2_atr",
    "series_id:s t:d " + " ".join(f"atr_{k}d:6 atr_norm_{k}d:6" for k in (5, 14, 21)),
    lambda s, d: te.atr(bars(s, d)),
    sql_r(
        "SELECT series_id, t, "
        + ", ".join(
            f"{roll('avg', 'true_range', k, skip=1)} AS atr_{k}d, "
            f"{roll('avg', 'true_range', k, skip=1)} / ({lag('close')} + 1e-6) AS atr_norm_{k}d"
            for k in (5, 14, 21)
        )
        + " FROM tr",
        _TR,
    ),
)
_MA, _SD = roll("avg", "close", 20, skip=1), roll("stddev_samp", "close", 20, skip=1)
register(
    "t3_bollinger",
    "series_id:s t:d bb_width_20d:6 bb_pct_b_20d:6",
    lambda s, d: te.bollinger(bars(s, d)),
    sql_r(
        f"SELECT series_id, t, 2 * {_SD} / ({_MA} + 1e-6) AS bb_width_20d, "
        f"({lag('close')} - ({_MA} - 2 * {_SD})) / (4 * {_SD} + 1e-6) AS bb_pct_b_20d FROM r"
    ),
)
_RSI = (
    f"d1 AS (SELECT *, close - {lag('close')} AS step FROM r)",
    "d2 AS (SELECT *, CASE WHEN step IS NOT NULL THEN greatest(step, 0) END AS up, "
    "CASE WHEN step IS NOT NULL THEN -least(step, 0) END AS down FROM d1)",
    f"d3 AS (SELECT *, 100 - 100 / (1 + {roll('avg', 'up', 14, skip=1)} / "
    f"({roll('avg', 'down', 14, skip=1)} + 1e-10)) AS rsi_14d FROM d2)",
)
register(
    "t4_rsi",
    "series_id:s t:d rsi_14d:5 rsi_extreme_dist:5",
    lambda s, d: te.rsi(bars(s, d)),
    sql_r("SELECT series_id, t, rsi_14d, abs(rsi_14d - 50) AS rsi_extreme_dist FROM d3", *_RSI),
)
register(
    "t5_price_gap",
    "series_id:s t:d price_ma_gap_10d:6 price_ma_gap_50d:6 price_ma_gap_abs_10d:6 price_ma_gap_abs_50d:6",
    lambda s, d: te.price_gap(bars(s, d)),
    sql_r(
        "SELECT *, abs(price_ma_gap_10d) AS price_ma_gap_abs_10d, abs(price_ma_gap_50d) AS price_ma_gap_abs_50d "
        "FROM (SELECT series_id, t, "
        + ", ".join(
            f"({lag('close')} - {roll('avg', 'close', k, skip=1)}) / "
            f"({roll('avg', 'close', k, skip=1)} + 1e-6) AS price_ma_gap_{k}d"
            for k in (10, 50)
        )
        + " FROM r)"
    ),
)
_MACD = (
    sq.ewm("r", "ef", "close", 12, 12),
    sq.ewm("r", "es", "close", 26, 26),
    "md AS (SELECT r.series_id, r.t, r.close, ef.v - es.v AS macd FROM r "
    "JOIN ef ON r.series_id = ef.series_id AND r.t = ef.t "
    "JOIN es ON r.series_id = es.series_id AND r.t = es.t)",
)
register(
    "t6_macd",
    "series_id:s t:d macd_norm:6 macd_abs_norm:6 macd_delta:6",
    lambda s, d: te.macd(bars(s, d)),
    sql_r(
        f"SELECT series_id, t, {lag('macd / (close + 1e-6)')} AS macd_norm, "
        f"abs({lag('macd / (close + 1e-6)')}) AS macd_abs_norm, "
        f"({lag('macd')} - {lag('macd', 2)}) / ({lag('close')} + 1e-6) AS macd_delta FROM md",
        *_MACD,
    ),
)
_VR = f"{lag('volume')} / ({roll('avg', 'volume', 21, 10, skip=1)} + 1e-6)"
register(
    "t7_volume_ratio",
    "series_id:s t:d vol_ratio_21d:6 vol_x_ret_lag_1:6",
    _on_rets(te.volume_ratio),
    sql_r(
        f"SELECT series_id, t, {_VR} AS vol_ratio_21d, "
        f"{_VR} * abs({lag('log_return')}) AS vol_x_ret_lag_1 FROM r"
    ),
)
register(
    "t8_sign_streak",
    "series_id:s t:d return_streak:i",
    _on_rets(te.sign_streak),
    sql_r(
        f"SELECT series_id, t, {lag('len')} AS return_streak FROM (SELECT *, row_number() OVER "
        "(PARTITION BY series_id, run ORDER BY t) - 1 AS len FROM (SELECT *, sum(brk) OVER "
        f"{W} AS run FROM (SELECT *, CASE WHEN sign(log_return) = 0 THEN 1 WHEN "
        f"(log_return IS NULL AND {lag('log_return')} IS NULL) THEN 1 "
        f"WHEN sign(log_return) = sign({lag('log_return')}) THEN 0 ELSE 1 END AS brk FROM r)))"
    ),
)
register(
    "m1_term_slopes",
    "series_id:s t:d ts_slope_5_21:6 ts_slope_21_63:6 ts_slope_5_63:6",
    _on_vols(te.term_slopes),
    sql_r(
        "SELECT series_id, t, "
        + ", ".join(
            f"{lag(f'vol_c2c_{a}d')} / ({lag(f'vol_c2c_{b}d')} + 1e-10) AS ts_slope_{a}_{b}"
            for a, b in ((5, 21), (21, 63), (5, 63))
        )
        + " FROM v",
        _VOL,
    ),
)
register(
    "m2_vol_of_vol",
    "series_id:s t:d vov_10d:4 vov_21d:4",
    _on_rets(te.vol_of_vol),
    sql_r(
        f"SELECT series_id, t, {roll('stddev_samp', 'rv', 10, skip=1)} AS vov_10d, "
        f"{roll('stddev_samp', 'rv', 21, skip=1)} AS vov_21d FROM r"
    ),
)
register(
    "m3_range_spread",
    "series_id:s t:d park_gk_spread_21d:6 park_gk_spread_norm:6",
    _on_vols(te.range_spread),
    sql_r(
        f"SELECT series_id, t, {lag('vol_gk_21d - vol_park_21d')} AS park_gk_spread_21d, "
        f"{lag('vol_gk_21d - vol_park_21d')} / ({lag('vol_gk_21d')} + 1e-10) AS park_gk_spread_norm FROM v",
        _VOL,
    ),
)
_F21 = sq.frame(21, 1)
register(
    "m4_rolling_shape",
    "series_id:s t:d realized_skew_21d:6 realized_kurt_21d:5",
    _on_rets(te.rolling_shape),
    sql_r(
        f"SELECT series_id, t, CASE WHEN count(log_return) OVER {_F21} >= 15 THEN "
        f"{sq.skew('log_return', _F21)} END AS realized_skew_21d, "
        f"CASE WHEN count(log_return) OVER {_F21} >= 15 THEN "
        f"{sq.kurt('log_return', _F21)} END AS realized_kurt_21d FROM r"
    ),
)
register(
    "m5_up_down_ratio",
    "series_id:s t:d updown_vol_ratio_21d:5",
    _on_rets(te.up_down_ratio),
    sql_r(
        f"SELECT series_id, t, {roll('avg', 'rv_pos', 21, 10, skip=1)} / "
        f"({roll('avg', 'rv_neg', 21, 10, skip=1)} + 1e-10) AS updown_vol_ratio_21d FROM r2",
        _SIDES,
    ),
)
register(
    "m6_jump_count",
    "series_id:s t:d jump_count_21d:i",
    _on_rets(te.jump_count),
    sql_r(
        f"SELECT series_id, t, {roll('sum', 'hit', 21, 10)} AS jump_count_21d FROM (SELECT *, "
        f"coalesce(CAST(abs({lag('log_return')}) > 3 * {roll('stddev_samp', 'log_return', 21, 10, skip=1)} "
        "AS INTEGER), 0) AS hit FROM r)"
    ),
)
