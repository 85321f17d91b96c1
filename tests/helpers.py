"""Small hand-made series for brute-force comparisons."""

import datetime as dt

import numpy as np
import pandas as pd


def days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def panel(n=400, k=3, seed=1):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, k))
    for t in range(1, n):
        x[t] = 0.5 * x[t - 1] + 0.2 * x[t - 1, ::-1] + rng.normal(size=k)
    return x


def long_frame(x, names, value="value"):
    n = len(x)
    return pd.concat(
        [pd.DataFrame({"series_id": s, "t": days(n), value: x[:, i]}) for i, s in enumerate(names)]
    )


def wide_frame(x, names):
    out = pd.DataFrame(x, columns=list(names))
    out.insert(0, "t", days(len(x)))
    return out


def ols(X, y):
    X1 = np.column_stack([np.ones(len(X)), X])
    b, *_ = np.linalg.lstsq(X1, y, rcond=None)
    res = y - X1 @ b
    return b, res


def ridge(X, y, alpha, scaled=True):
    mu = X.mean(0)
    sd = X.std(0) if scaled else np.ones(X.shape[1])
    sd = np.where(sd > 0, sd, 1.0)
    Z = (X - mu) / sd
    w = np.linalg.solve(Z.T @ Z + alpha * np.eye(Z.shape[1]), Z.T @ (y - y.mean()))
    return w, lambda Q: y.mean() + ((Q - mu) / sd) @ w
