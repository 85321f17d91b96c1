"""Histogram boosting against trees grown by trying every split."""

import numpy as np
import pandas as pd
import pytest
from helpers import days

from barograph.operators import boosting
from barograph.operators.boosting import Boosting

X = ["x0", "x1", "x2"]


def brute(x, y, place, o, ask):
    """Trees by trying each value of each feature at each node; forecasts for ``ask`` and mean gains."""
    columns = x.shape[1]
    gains = {f: [] for f in range(columns)}
    pred, out = np.full(len(y), y.mean()), np.full(len(ask), y.mean())
    for turn in range(o.rounds):
        used = boosting.share(o.seed, turn, place) < o.row_share
        draw = boosting.share(o.seed + 1, turn, np.arange(columns))
        chosen = sorted(sorted(range(columns), key=lambda f: draw[f])[: max(1, int(o.column_share * columns))])
        g = pred - y

        def grow(rows, asked, level):
            own = rows & used
            n, total = own.sum(), g[own].sum()
            found = []
            if level < o.depth and n:
                for f in chosen:
                    for v in np.unique(x[:, f])[:-1]:
                        left = own & (x[:, f] <= v)
                        nl = left.sum()
                        if min(nl, n - nl) < o.least_rows:
                            continue
                        gl = g[left].sum()
                        gain = gl**2 / (nl + o.l2) + (total - gl) ** 2 / (n - nl + o.l2) - total**2 / (n + o.l2)
                        found.append((gain, f, v))
            top = max((gain for gain, _, _ in found), default=0)
            if top <= 1e-9:
                value = -o.rate * total / (n + o.l2)
                pred[rows] += value
                out[asked] += value
                return
            best = next(s for s in found if s[0] >= top * (1 - 1e-9))
            gains[best[1]].append(best[0])
            side, to = x[:, best[1]] <= best[2], ask[:, best[1]] <= best[2]
            grow(rows & side, asked & to, level + 1)
            grow(rows & ~side, asked & ~to, level + 1)

        grow(np.ones(len(y), bool), np.ones(len(ask), bool), 0)
    mean = np.array([np.mean(v) if v else 0.0 for v in gains.values()])
    return out, mean / mean.sum()


def data(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    x[:, 2] = rng.integers(0, 4, n)
    return x, np.sin(2 * x[:, 0]) + (x[:, 2] == 2) * x[:, 1] + 0.1 * rng.normal(size=n)


@pytest.mark.parametrize("options", [Boosting(rounds=12, rate=0.3), Boosting(rounds=10, depth=2, l2=2.0, column_share=0.7, least_rows=4)])
def test_trees_against_every_split(options):
    x, y = data(90, 1)
    place = np.arange(1, 91)
    ask, _ = data(40, 2)
    trees = boosting.Trees(x, y, place, options)
    want, gain = brute(x, y, place, options, ask)
    np.testing.assert_allclose(trees.predict(ask), want, atol=1e-9)
    np.testing.assert_allclose(trees.importance(), gain, atol=1e-9)


def test_few_bins_and_missing_values():
    x, y = data(400, 3)
    x[::7, 0] = np.nan
    trees = boosting.Trees(x, y, np.arange(400), Boosting(rounds=60, rate=0.2, bins=16))
    assert max(len(e) for e in trees.edges) <= 15
    assert np.mean((trees.predict(x) - y) ** 2) < 0.35 * y.var()


@pytest.fixture(scope="module")
def panel(spark):
    frames = []
    for k, (name, n) in enumerate((("A", 130), ("B", 75), ("C", 30))):
        x, y = data(n, 10 + k)
        f = pd.DataFrame(x, columns=X)
        frames.append(f.assign(target=y, series_id=name, t=days(n), pos=range(1, n + 1)))
    pdf = pd.concat(frames)
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("rolling", [None, 30])
def test_walk_forward(panel, rolling):
    """Every window of every series is the fit of its own training rows."""
    pdf, df = panel
    options = Boosting(rounds=4, column_share=0.7)
    fits = boosting.walk_forward(df, X, options, start=40, step=10, rolling=rolling, run=3)
    got = boosting.forecasts(fits).toPandas()
    seen = boosting.importances(fits).toPandas()
    windows = {(s, w) for s, w in zip(got.series_id, got.window)}
    assert windows == {("A", w) for w in range(8)} | {("B", w) for w in range(3)}
    for s, w in windows:
        rows = pdf[pdf.series_id == s]
        end = 40 + 10 * w
        train, test = slice(0 if rolling is None else end - rolling, end), slice(end, end + 10)
        trees = boosting.Trees(rows[X].to_numpy()[train], rows.target.to_numpy()[train], rows.pos.to_numpy()[train], options)
        mine = got[(got.series_id == s) & (got.window == w)].sort_values("t")
        assert list(mine.t) == list(rows.t[test]) and set(mine.n_train) == {end if rolling is None else rolling}
        np.testing.assert_allclose(mine.pred, trees.predict(rows[X].to_numpy()[test]), atol=1e-12)
        gains = seen[(seen.series_id == s) & (seen.window == w)].set_index("feature").importance
        np.testing.assert_allclose(gains[X], trees.importance(), atol=1e-12)


def test_tail_and_gains(panel):
    pdf, df = panel
    options = Boosting(rounds=5)
    split = df.selectExpr("*", "pos > 25 AS is_test", "'k' AS kept").drop("pos")
    got = boosting.boosted_tail(split, X, "trees", options, keep=["kept"]).toPandas()
    assert len(got) == 105 + 50 + 5 and set(got.kept) == {"k"} and set(got.model) == {"trees"}
    rows = pdf[pdf.series_id == "B"]
    trees = boosting.Trees(rows[X].to_numpy()[:25], rows.target.to_numpy()[:25], np.arange(1, 26), options)
    mine = got[got.series_id == "B"].sort_values("t").pred
    np.testing.assert_allclose(mine, trees.predict(rows[X].to_numpy()[25:]), atol=1e-12)
    gains = boosting.tree_gains(df, X, options).toPandas()
    assert len(gains) == 9 and np.allclose(gains.groupby("series_id").importance.sum(), 1)
    assert boosting.tree_gains(df.filter("1 = 0"), X, options).collect() == []
