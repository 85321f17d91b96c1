"""Vector autoregression and connectedness (V1-V9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.operators import regression as rr
from barograph.operators import spillover as sp
from barograph.plans import sqltext as sq
from barograph.plans.cross import PV, rv_panel
from barograph.plans.forecast import SPILL_SETS, _LOSS, spill_table
from barograph.plans.market import sql_r
from barograph.plans.registry import register_reusing as register
from barograph.plans.registry import shared
from barograph.plans.tables import SERIES, rets
from barograph.sources.bars import series_pairs

LAGS = 2


@shared()
def panel(s, d):
    return rv_panel(rets(s, d))


def _fit(p: int) -> tuple[str, ...]:
    names = sp.lag_names(SERIES, p)
    out = [
        PV,
        "va AS (SELECT 'all' AS panel_id, *, " + ", ".join(
            f"lag(\"{x}\", {k}) OVER (ORDER BY t) AS {x}_lag{k}" for k in range(1, p + 1) for x in SERIES
        ) + " FROM pv)",
        "vb AS (SELECT panel_id, t, " + ", ".join(f'"{x}" AS y_{x}' for x in SERIES) + ", " + ", ".join(names) + f" FROM va WHERE {names[-1]} IS NOT NULL)",
    ]
    for x in SERIES:
        out += sq.ridge("vb", "panel_id", names, f"y_{x}", 0, False, f"f{x}")
    rows = []
    for x in SERIES:
        rows.append(f"SELECT '{x}' AS equation, 'const' AS regressor, 0 AS lag, c AS coef, n FROM f{x}")
        for i, name in enumerate(names):
            series, k = name.rsplit("_lag", 1)
            rows.append(f"SELECT '{x}', '{series}', {k}, b{i}, n FROM f{x}")
    out.append(f"vc AS ({' UNION ALL '.join(rows)})")
    return tuple(out)


_COEF = "equation:s regressor:s lag:i coef:4 n:i"
register(
    "v1_var_fit",
    _COEF,
    lambda s, d: sp.var_coefficients(panel(s, d), SERIES, LAGS),
    sql_r("SELECT * FROM vc", *_fit(LAGS)),
)
register(
    "v2_var_lag_order",
    "lags:i n:i aic:6 is_best:b",
    lambda s, d: sp.var_lag_order(panel(s, d), SERIES, 10),
)
register(
    "v3_lag_matrix",
    "equation:s regressor:s lag:i coef:5",
    lambda s, d: sp.var_coefficients(panel(s, d), SERIES, 1).filter(F.col("lag") == 1),
    sql_r("SELECT * FROM vc WHERE lag = 1", *_fit(1)),
)
def _responses(p: int, steps: int) -> tuple[str, ...]:
    """Table th(h, i, j, v, n): answers of i to a one-deviation shock in j, h periods on."""
    names, k = sp.lag_names(SERIES, p), range(len(SERIES))
    fitted = {x: f"f{x}.c" + "".join(f" + f{x}.b{i} * {name}" for i, name in enumerate(names)) for x in SERIES}
    out = [
        *_fit(p),
        "ve AS (SELECT " + ", ".join(f"y_{x} - ({fitted[x]}) AS e{i}" for i, x in enumerate(SERIES))
        + " FROM vb" + "".join(f" CROSS JOIN f{x}" for x in SERIES) + ")",
        "vs AS (SELECT count(*) AS n, " + ", ".join(f"avg(e{i} * e{j}) AS s{j}{i}" for i in k for j in k if i <= j) + " FROM ve)",
    ]
    src = "vs"
    for j in k:  # Cholesky factor, column by column
        d = f"sqrt(s{j}{j}" + "".join(f" - l{j}{m} * l{j}{m}" for m in range(j)) + ")"
        cells = [f"(s{i}{j}" + "".join(f" - l{i}{m} * l{j}{m}" for m in range(j)) + f") / l{j}{j} AS l{i}{j}" for i in k if i > j]
        src = f"(SELECT *, {d} AS l{j}{j} FROM {src})"
        src = f"(SELECT *, {', '.join(cells)} FROM {src})" if cells else src
    out.append(f"vl AS {src}")
    out.append("vk AS (" + " UNION ALL ".join(
        f"SELECT '{SERIES[i]}' AS i, '{SERIES[j]}' AS j, {f'l{i}{j}' if j <= i else '0.0::DOUBLE'} AS v, n FROM vl" for i in k for j in k
    ) + ")")
    out.append("ph0 AS (" + " UNION ALL ".join(f"SELECT '{x}' AS i, '{x}' AS j, 1.0::DOUBLE AS v" for x in SERIES) + ")")
    for h in range(1, steps + 1):
        terms = " UNION ALL ".join(
            f"SELECT q.i, regressor AS j, q.v * coef AS v FROM ph{h - m} q JOIN vc ON equation = q.j AND lag = {m}"
            for m in range(1, min(h, p) + 1)
        )
        out.append(f"ph{h} AS (SELECT i, j, sum(v) AS v FROM ({terms}) GROUP BY 1, 2)")
    out.append("th AS (" + " UNION ALL ".join(
        f"SELECT {h} AS h, q.i, vk.j, sum(q.v * vk.v) AS v, max(n) AS n FROM ph{h} q JOIN vk ON vk.i = q.j GROUP BY 2, 3"
        for h in range(steps + 1)
    ) + ")")
    return tuple(out)


register(
    "v4_impulse_responses",
    "response:s shock:s period:i irf:4",
    lambda s, d: sp.irf(panel(s, d), SERIES, LAGS),
    sql_r(
        f"SELECT i AS response, j AS shock, h AS period, v * sqrt(n / (n - {len(SERIES) * LAGS + 1.0})) AS irf FROM th",
        *_responses(LAGS, 20),
    ),
)


@shared()
def shares(s, d):
    return sp.fevd(panel(s, d), SERIES, LAGS)


FEVD = (
    *_responses(LAGS, sp.HORIZON - 1),
    "fs AS (SELECT i, j, sum(v * v) / sum(sum(v * v)) OVER (PARTITION BY i) AS share FROM th GROUP BY i, j)",
)
register("v5_fevd", "i:s j:s share:6", shares, sql_r("SELECT * FROM fs", *FEVD))


def corr_shares(s, d):
    """Squared correlations of the panel as a share matrix: a full (i, j) table with a SQL twin."""
    from barograph.operators.risk import full_correlation
    from barograph.sources.bars import panel_pairs

    pairs = panel_pairs(panel(s, d), series_pairs(SERIES, ordered=True, diagonal=True))
    return full_correlation(pairs).select("i", "j", F.pow("corr", F.lit(2.0)).alias("share"))


CS = (
    PV,
    "cs AS ("
    + " UNION ALL ".join(
        f"SELECT '{i}' AS i, '{j}' AS j, pow(corr(\"{i}\", \"{j}\"), 2) AS share FROM pv"
        for i, j in series_pairs(SERIES, ordered=True, diagonal=True)
    )
    + ")",
    "cn AS (SELECT *, share / greatest(sum(share) OVER (PARTITION BY i), 1e-10) AS s FROM cs)",
)
register(
    "v6_connectedness_table",
    "series:s from_others:8 to_others:8 net:8",
    lambda s, d: sp.connectedness(corr_shares(s, d)),
    sql_r(
        "SELECT a.i AS series, from_others, to_others, to_others - from_others AS net FROM (SELECT i, sum(s) FILTER (i <> j) AS from_others FROM cn GROUP BY 1) a "
        "JOIN (SELECT j, sum(s) FILTER (i <> j) AS to_others FROM cn GROUP BY 1) b ON a.i = b.j",
        *CS,
    ),
)
register(
    "v6_fevd_connectedness",
    "series:s from_others:6 to_others:6 net:6",
    lambda s, d: sp.connectedness(shares(s, d)),
    sql_r(
        "SELECT a.i AS series, from_others, to_others, to_others - from_others AS net FROM (SELECT i, sum(share) FILTER (i <> j) AS from_others FROM fs GROUP BY 1) a "
        "JOIN (SELECT j, sum(share) FILTER (i <> j) AS to_others FROM fs GROUP BY 1) b ON a.i = b.j",
        *FEVD,
    ),
)
register(
    "v7_total_connectedness",
    "tci:8",
    lambda s, d: sp.total_connectedness(corr_shares(s, d)),
    sql_r("SELECT sum(share) FILTER (i <> j) / 3 AS tci FROM cs", *CS),
)


@shared()
def rolling(s, d):
    return sp.rolling_shares(panel(s, d), SERIES)


register(
    "v8_rolling_connectedness",
    "t:d series:s from_others:6 to_others:6 net:6 tci:6",
    lambda s, d: sp.rolling_connectedness(rolling(s, d)),
)
register(
    "v9_ordered_pairs",
    "cause:s effect:s n:i",
    lambda s, d: _pair_counts(s, d),
    sql_r(
        " UNION ALL ".join(
            f"SELECT '{i}' AS cause, '{j}' AS effect, count(*) AS n FROM pv" for i, j in series_pairs(SERIES, ordered=True)
        ),
        PV,
    ),
)


def _pair_counts(s, d):
    from barograph.sources.bars import panel_pairs

    pairs = panel_pairs(panel(s, d), series_pairs(SERIES, ordered=True))
    return pairs.groupBy(F.col("i").alias("cause"), F.col("j").alias("effect")).agg(F.count(F.lit(1)).alias("n"))


def _tci_table(s, d):
    index = sp.total_connectedness(rolling(s, d), "t")
    return spill_table(s, d, index, "tci")


register(
    "f5_connectedness_forecast",
    _LOSS,
    lambda s, d: rr.har_variant_metrics(_tci_table(s, d), SPILL_SETS),
)
