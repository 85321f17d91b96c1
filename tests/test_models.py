"""Queries without a SQL twin against brute force on small fixtures."""

import itertools

import numpy as np
import pandas as pd
import pytest
from helpers import days, long_frame, ols, panel, ridge, wide_frame

from barograph.functions import linalg
from barograph.operators import garch, hypothesis, regression, risk, selection, spillover
from barograph.sources.bars import series_pairs

NAMES = ("A", "B", "C")
X = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    frames = []
    for s in ("A", "B"):
        z = rng.normal(size=(300, 6))
        y = z @ np.array([2.0, -1.0, 0.5, 0.0, 0.0, 0.1]) + rng.normal(size=300) + 30
        f = pd.DataFrame(z, columns=X)
        f["target"], f["series_id"], f["t"] = y, s, days(300)
        f["pos"] = range(1, 301)
        frames.append(f)
    pdf = pd.concat(frames)
    return pdf, spark.createDataFrame(pdf)


def by_key(pdf, s):
    g = pdf[pdf.series_id == s].sort_values("t")
    return g[X].to_numpy(), g["target"].to_numpy()


def test_ridge_and_predictions(table):
    pdf, df = table
    split = regression.train_test(df, 50)
    sets = {"two": X[:2], "all": X}
    models = regression.ridge_models(split, sets, 10.0)
    pred = regression.ridge_predictions(split, models, sets).toPandas()
    for s in ("A", "B"):
        x, y = by_key(pdf, s)
        for name, cols in sets.items():
            k = len(cols)
            _, predict = ridge(x[:250, :k], y[:250], 10.0)
            mine = pred[(pred.series_id == s) & (pred.model == name)].sort_values("t")["pred"]
            np.testing.assert_allclose(mine, predict(x[250:, :k]), rtol=1e-9)


@pytest.mark.parametrize("rolling", [None, 60])
def test_walk_forward_refits(table, rolling):
    pdf, df = table
    models = regression.walk_forward_models(df, X[:3], 12.0, 120, 20, rolling)
    got = regression.walk_forward_predictions(df, models, X[:3], 20, whole_only=True).toPandas()
    x, y = by_key(pdf, "B")
    want = []
    for start in range(120, 300 - 20, 20):
        lo = 0 if rolling is None else start - rolling
        _, predict = ridge(x[lo:start, :3], y[lo:start], 12.0)
        want.append(predict(x[start:start + 20, :3]))
    mine = got[got.series_id == "B"].sort_values("t")["pred"]
    np.testing.assert_allclose(mine, np.concatenate(want), rtol=1e-8)


def test_walk_forward_rejects_ragged_steps(table):
    with pytest.raises(ValueError):
        regression.walk_forward_models(table[1], X[:3], 1.0, 100, 21)


def test_granger_ramanathan_is_the_best_nonnegative_fit(spark):
    rng = np.random.default_rng(3)
    y = rng.uniform(1, 2, 100)
    p = {"a": y + rng.normal(size=100) * 0.1, "b": y * 0.5 + rng.normal(size=100) * 0.3, "c": -y}
    pdf = pd.concat([pd.DataFrame({"series_id": "A", "t": days(100), "model": m, "actual": y, "pred": v}) for m, v in p.items()])
    got = regression.granger_ramanathan_weights(spark.createDataFrame(pdf), list(p), 1.0).toPandas().set_index("model")["weight"]
    P = np.column_stack(list(p.values()))
    w = np.zeros(3)
    for _ in range(20000):  # projected gradient
        w = np.maximum(w - 1e-3 * (P.T @ (P @ w - y)) / 10, 0)
    np.testing.assert_allclose([got[m] for m in p], w / w.sum(), atol=1e-4)


def test_bootstrap_intervals_hold_their_level(table):
    out = regression.bootstrap_intervals(table[1], X[:3], 10.0, replicas=40, block=10, test_rows=60)
    rows = out.toPandas()
    assert len(rows) == 120
    assert (rows.lower <= rows.upper).all() and (rows.lower >= 0).all()
    x, y = by_key(table[0], "A")
    _, predict = ridge(x[:240, :3], y[:240], 10.0)
    mine = rows[rows.series_id == "A"].sort_values("t")
    np.testing.assert_allclose(mine["point_pred"], predict(x[240:, :3]), rtol=1e-9)
    inside = (mine.point_pred > mine.lower - 0.2) & (mine.point_pred < mine.upper + 0.2)
    assert inside.mean() > 0.9
    again = out.toPandas()
    np.testing.assert_allclose(rows.sort_values(["series_id", "t"])["upper"], again.sort_values(["series_id", "t"])["upper"])


def test_recursive_elimination(table):
    pdf, df = table
    got = selection.recursive_elimination(df, X, 10.0, 5, 2).toPandas().set_index("series_id")

    def path(x, y):
        keep, out = list(range(6)), []
        while True:
            out.append(list(keep))
            if len(keep) == 2:
                return out
            w, _ = ridge(x[:, keep], y, 10.0)
            keep.pop(int(np.argmin(np.abs(w))))

    for s in ("A", "B"):
        x, y = by_key(pdf, s)
        scores = {}
        for i in range(5):
            a = 50 + 50 * i
            for keep in path(x[:a], y[:a]):
                _, predict = ridge(x[:a][:, keep], y[:a], 10.0)
                e = np.sqrt(np.mean((y[a:a + 50] - predict(x[a:a + 50][:, keep])) ** 2))
                scores.setdefault(len(keep), []).append(e)
        best = min(sorted(scores), key=lambda k: np.mean(scores[k]))
        assert got.loc[s, "n_selected"] == best
        np.testing.assert_allclose(got.loc[s, "cv_rmse"], [np.mean(scores[k]) for k in sorted(scores)], rtol=1e-8)
        assert list(got.loc[s, "selected_features"]) == [X[i] for i in next(p for p in path(x, y) if len(p) == best)]


def test_adf_lag_choice(spark):
    x = panel(300, 2)
    got = hypothesis.adf(spark.createDataFrame(long_frame(x, "AB")), "value", 6).toPandas().set_index("series_id")
    for i, s in enumerate("AB"):
        v = x[:, i]
        d = np.diff(v)

        def design(k, first):
            rows = range(first, len(d))
            return np.array([[v[r], *[d[r - j] for j in range(1, k + 1)]] for r in rows]), d[first:]

        aic = []
        for k in range(7):
            A, y = design(k, 6)
            _, res = ols(A, y)
            n = len(y)
            aic.append(n * (np.log(2 * np.pi * (res @ res) / n) + 1) + 2 * (k + 2))
        k = int(np.argmin(aic))
        A, y = design(k, k)
        b, res = ols(A, y)
        A1 = np.column_stack([np.ones(len(A)), A])
        se = np.sqrt((res @ res) / (len(y) - k - 2) * np.linalg.inv(A1.T @ A1)[1, 1])
        assert got.loc[s, "used"] == k
        assert got.loc[s, "icbest"] == pytest.approx(min(aic))
        assert got.loc[s, "statistic"] == pytest.approx(b[1] / se, rel=1e-8)
        assert got.loc[s, "nobs"] == len(y)


def test_pacf_solves_yule_walker(spark):
    x = panel(200, 1)[:, :1]
    rows = hypothesis.acf(spark.createDataFrame(long_frame(x, "A")), "value", 6)
    got = hypothesis.pacf(rows).orderBy("lag").toPandas()["pacf"].to_numpy()
    d = x[:, 0] - x[:, 0].mean()
    rho = np.array([1.0] + [(d[k:] * d[:-k]).sum() / (d @ d) for k in range(1, 7)])
    for k in range(1, 7):
        R = rho[np.abs(np.subtract.outer(range(k), range(k)))]
        assert got[k - 1] == pytest.approx(np.linalg.solve(R, rho[1:k + 1])[-1], abs=1e-9)


def test_p_value_matrix_is_symmetric(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=80)
    pdf = pd.concat([pd.DataFrame({"series_id": "A", "t": days(80), "model": m, "actual": y,
                                   "pred": y + rng.normal(size=80) * s}) for m, s in (("a", 0.1), ("b", 0.5), ("c", 0.12))])
    dm = hypothesis.diebold_mariano(hypothesis.loss_differentials(spark.createDataFrame(pdf), ["a", "b", "c"]))
    m = hypothesis.p_value_matrix(dm, ["a", "b", "c"]).toPandas().set_index("model")[["a", "b", "c"]].loc[["a", "b", "c"]].to_numpy(float)
    np.testing.assert_allclose(m, m.T)
    assert m[0, 1] < 0.05 and m[1, 2] < 0.05 and (np.diag(m) == 1).all()
    wins = hypothesis.win_matrix(dm, ["a", "b", "c"]).toPandas().set_index("winner")
    assert wins.loc["a", "b"] == 1 and wins.loc["a", "a"] == 0


def var_fit(x, p):
    n, k = x.shape
    Z = np.column_stack([np.ones(n - p)] + [x[p - j:n - j] for j in range(1, p + 1)])
    B, *_ = np.linalg.lstsq(Z, x[p:], rcond=None)
    res = x[p:] - Z @ B
    return B, res


def shares_of(x, p, horizon):
    B, res = var_fit(x, p)
    k = x.shape[1]
    L = np.linalg.cholesky(res.T @ res)
    A = [B[1 + j * k:1 + (j + 1) * k].T for j in range(p)]
    psi = [np.eye(k)]
    for h in range(1, horizon):
        psi.append(sum(psi[h - j] @ A[j - 1] for j in range(1, min(h, p) + 1)))
    th = sum((m @ L) ** 2 for m in psi)
    return th / th.sum(1, keepdims=True)


def test_var_shares_and_lag_order(spark):
    x = panel(300)
    df = spark.createDataFrame(wide_frame(x, NAMES))
    got = spillover.fevd(df, NAMES, 2).toPandas().pivot(index="i", columns="j", values="share").to_numpy()
    np.testing.assert_allclose(got, shares_of(x, 2, 10), rtol=1e-7)
    np.testing.assert_allclose(got.sum(1), 1.0)
    order = spillover.var_lag_order(df, NAMES, 4).orderBy("lags").toPandas()
    want = []
    for p in range(1, 5):
        _, res = var_fit(x[4 - p:], p)
        n = len(res)
        want.append(np.linalg.slogdet(res.T @ res / n)[1] + 2 / n * (9 * p + 3))
    np.testing.assert_allclose(order["aic"], want, rtol=1e-8)
    assert order[order.is_best]["lags"].iloc[0] == int(np.argmin(want)) + 1
    r = spillover.irf(df, NAMES, 2, 5).toPandas()
    B, res = var_fit(x, 2)
    L = np.linalg.cholesky(res.T @ res / (len(res) - 7))
    first = r[r.period == 0].pivot(index="response", columns="shock", values="irf").to_numpy()
    np.testing.assert_allclose(first, L, rtol=1e-7, atol=1e-12)


def test_rolling_connectedness_windows(spark):
    x = panel(150)
    df = spark.createDataFrame(wide_frame(x, NAMES))
    got = spillover.rolling_shares(df, NAMES, 60, 20)
    rows = got.toPandas()
    dates, ends = days(150), list(range(60, 150, 20))
    assert sorted(rows["t"].unique()) == [dates[e - 1] for e in ends]
    for e in ends:
        m = rows[rows.t == dates[e - 1]].pivot(index="i", columns="j", values="share").to_numpy()
        np.testing.assert_allclose(m, shares_of(x[e - 60:e], 1, 10), rtol=1e-6)
    c = spillover.rolling_connectedness(got).toPandas()
    assert ((c.tci >= 0) & (c.tci <= 1)).all()
    np.testing.assert_allclose(c.groupby("t")["net"].sum(), 0.0, atol=1e-12)
    np.testing.assert_allclose(c.groupby("t")["from_others"].sum() / 3, c.groupby("t")["tci"].first())


def test_published_connectedness_table(spark):
    # identity shares: nothing is received or sent
    rows = [(i, j, 1.0 if i == j else 0.0) for i in NAMES for j in NAMES]
    out = spillover.connectedness(spark.createDataFrame(rows, "i string, j string, share double")).toPandas()
    assert (out[["from_others", "to_others", "net"]] == 0).all().all()


def test_dcc_grid_likelihood(spark):
    e = panel(120)
    e = (e - e.mean(0)) / e.std(0)
    pairs = risk.matrix_pairs(spark.createDataFrame(wide_frame(e, NAMES)), NAMES)
    grid = risk.dcc_grid(pairs, NAMES, (0.02, 0.05), (0.80, 0.90))
    got = grid.toPandas().set_index(["a", "b"])["loglik"]
    Qbar = np.cov(e.T)
    best = {}
    for a, b in itertools.product((0.02, 0.05), (0.80, 0.90)):
        Q, ll = Qbar, 0.0
        for t in range(len(e)):
            if t:
                Q = (1 - a - b) * Qbar + a * np.outer(e[t - 1], e[t - 1]) + b * Q
            d = np.sqrt(np.diag(Q))
            R = Q / np.outer(d, d)
            ll -= 0.5 * (np.linalg.slogdet(R)[1] + e[t] @ np.linalg.solve(R, e[t]) - e[t] @ e[t])
        best[a, b] = ll
        assert got[a, b] == pytest.approx(ll, rel=1e-8)
    top = risk.dcc_choice(grid).first()
    assert (top["a"], top["b"]) == max(best, key=best.get)
    corr = risk.dcc(pairs, 0.05, 0.90).toPandas()
    assert corr["corr"].between(-1 - 1e-12, 1 + 1e-12).all()
    assert len(series_pairs(NAMES, diagonal=True)) == 6


def test_garch_and_egarch_likelihoods(spark):
    r = np.random.default_rng(5).normal(size=150) * 0.01
    df = spark.createDataFrame(long_frame(r[:, None], "A", "log_return"))
    e = 100 * (r - r.mean())
    s2 = (e**2).mean()
    scan = garch.volatility_scan(df).toPandas()
    for _, row in scan.sample(12, random_state=0).iterrows():
        a, g, b = row.alpha, row.gamma, row.beta
        ll = 0.0
        if row.model == "EGARCH":
            lh = np.log(s2)
            for v in e:
                z = v / np.exp(lh / 2)
                ll -= 0.5 * (np.log(2 * np.pi) + lh + z * z)
                lh = (1 - b) * np.log(s2) + b * lh + a * (abs(z) - np.sqrt(2 / np.pi)) + g * z
        else:
            h = s2
            for t, v in enumerate(e):
                if t:
                    h = s2 * (1 - a - b - g / 2) + (a + g * (e[t - 1] < 0)) * e[t - 1] ** 2 + b * h
                ll -= 0.5 * (np.log(2 * np.pi) + np.log(h) + v * v / h)
        assert row.loglik == pytest.approx(ll, rel=1e-9)
    best = garch.best_models(garch.volatility_scan(df)).first()
    assert best["aic"] == pytest.approx(scan["aic"].min())


def test_moments_of_one_hot_key(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1000, 2)) + 100
    pdf = pd.DataFrame(x, columns=["a", "b"])
    pdf["k"] = np.where(np.arange(1000) < 990, "hot", "cold")
    m = linalg.grouped_moments(spark.createDataFrame(pdf).repartition(8), ["k"], ["a", "b"]).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        want = np.cov(g[["a", "b"]].to_numpy().T, bias=True)
        np.testing.assert_allclose(m.loc[k, "comoment"], [want[0, 0], want[0, 1], want[1, 1]], rtol=1e-8)
