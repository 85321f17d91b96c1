"""Mixtures and paths against plain recursions and all paths of a short series."""

import itertools

import numpy as np
import pandas as pd
import pytest
from helpers import days

from barograph.operators import regimes


def series(n, seed):
    rng = np.random.default_rng(seed)
    state = np.cumsum(rng.random(n) < 0.08) % 3
    return state, state * 1.5 + rng.normal(size=n) * (0.5 + 0.3 * state)


@pytest.fixture(scope="module")
def panel(spark):
    frames = []
    for k, (name, n) in enumerate((("A", 90), ("B", 41), ("C", 8), ("D", 1))):
        state, z = series(n, k + 3)
        frames.append(pd.DataFrame({"series_id": name, "t": days(n), "z": z, "regime": state.astype(np.int32)}))
    pdf = pd.concat(frames)
    return pdf, spark.createDataFrame(pdf).withColumn("regime", regimes.F.col("regime").cast("int"))


def states(rows):
    """Log emissions and log moves as the operator estimates them."""
    levels = [(rows.z[rows.regime == k].mean(), max(rows.z[rows.regime == k].std(ddof=0), 1e-3)) for k in range(3)]
    emit = np.full((len(rows), 3), -np.inf)
    for k, (m, s) in enumerate(levels):
        if (rows.regime == k).any():
            emit[:, k] = -0.5 * ((rows.z - m) / s) ** 2 - np.log(s)
    moves = np.full((3, 3), 1 / 3)
    label = rows.regime.to_numpy()
    for k in range(3):
        after = label[1:][label[:-1] == k]
        if len(after):
            moves[k] = [(after == j).mean() for j in range(3)]
    with np.errstate(divide="ignore"):
        return emit, np.log(moves)


@pytest.mark.parametrize("block", [4, 512])
def test_paths_and_smoothing(panel, monkeypatch, block):
    pdf, df = panel
    monkeypatch.setattr(regimes, "BLOCK", block)
    path = regimes.likely_path(df).toPandas()
    smooth = regimes.smoothed_states(df).toPandas()
    for name, rows in pdf.groupby("series_id"):
        emit, moves = states(rows)
        n = len(rows)
        score, back = emit[0] - np.log(3), []
        ahead = [score]
        for t in range(1, n):
            step = score[:, None] + moves
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + emit[t]
            ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + moves, axis=0) + emit[t])
        want = [int(score.argmax())]
        for b in reversed(back):
            want.append(int(b[want[-1]]))
        assert path[path.series_id == name].sort_values("t").state.tolist() == want[::-1]
        behind = [np.zeros(3)]
        for t in range(n - 1, 0, -1):
            behind.append(np.logaddexp.reduce(moves + (emit[t] + behind[-1])[None, :], axis=1))
        both = np.array(ahead) + np.array(behind[::-1])
        weight = np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None])
        got = smooth[smooth.series_id == name].sort_values("t")[["smooth_low", "smooth_med", "smooth_high"]]
        np.testing.assert_allclose(got, weight, atol=1e-10)
        if n == 8:
            total = {}
            for p in itertools.product(range(3), repeat=n):
                total[p] = emit[0, p[0]] - np.log(3) + sum(moves[a, b] for a, b in zip(p, p[1:])) + sum(emit[t, p[t]] for t in range(1, n))
            assert tuple(want[::-1]) == max(total, key=total.get)
            mass = np.zeros((n, 3))
            for p, v in total.items():
                mass[np.arange(n), p] += np.exp(v)
            np.testing.assert_allclose(got, mass / mass.sum(axis=1)[:, None], atol=1e-10)


def em(z, steps):
    order = np.argsort(z, kind="stable")
    third = np.empty(len(z), int)
    third[order] = np.concatenate([np.full(len(p), k) for k, p in enumerate(np.array_split(np.arange(len(z)), 3))])
    w = np.full(3, 1 / 3)
    m = np.array([z[third == k].mean() if (third == k).any() else 0.0 for k in range(3)])
    v = np.array([max(z[third == k].var(), 1e-4) if (third == k).any() else 1.0 for k in range(3)])
    for _ in range(steps):
        d = w * np.exp(-0.5 * (z[:, None] - m) ** 2 / v) / np.sqrt(2 * np.pi * v)
        like = np.log(d.sum(axis=1)).mean()
        r = d / d.sum(axis=1)[:, None]
        n = r.sum(axis=0)
        w, some = n / len(z), n > 1e-12
        mean = r.T @ z / np.where(some, n, 1)
        m, v = np.where(some, mean, m), np.where(some, np.maximum(r.T @ z**2 / np.where(some, n, 1) - mean**2, 1e-4), v)
    order = np.argsort(m, kind="stable")
    return like, w[order], m[order], v[order]


def test_mixtures_of_each_series(panel):
    pdf, df = panel
    got = regimes.mixture_parameters(df, iterations=12).toPandas().set_index("series_id")
    assert set(got.index) == {"A", "B", "C", "D"}
    for name, rows in pdf.groupby("series_id"):
        if len(rows) < 8:
            continue
        like, w, m, v = em(rows.z.to_numpy(), 12)
        for c, want in (("w", w), ("m", m), ("v", v)):
            np.testing.assert_allclose([got.loc[name, f"{c}{k}"] for k in range(3)], want, atol=1e-8)
        assert abs(got.loc[name, "loglik"] - like) < 1e-8


def test_settled_series_leave(panel):
    """A tolerance ends each series on its own; likelihoods never fall."""
    pdf, df = panel
    short = regimes.mixture_parameters(df, iterations=5).toPandas().set_index("series_id").loglik
    full = regimes.mixture_parameters(df, iterations=60, tolerance=1e-3).toPandas().set_index("series_id").loglik
    assert set(full.index) == {"A", "B", "C", "D"} and (full.sort_index() >= short.sort_index() - 1e-9).all()


def test_regimes_and_posteriors(panel):
    pdf, df = panel
    vol = df.select("series_id", "t", regimes.F.exp("z").alias("vol_x"))
    out = regimes.mixture_regimes(vol, "vol_x", iterations=10).toPandas()
    posts = out[["post_low", "post_med", "post_high"]].to_numpy()
    np.testing.assert_allclose(posts.sum(axis=1), 1, atol=1e-12)
    assert len(out) == len(pdf) and (posts.argmax(axis=1) == out.regime).all()
